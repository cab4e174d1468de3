"""Near duplicates among embeddings by an inverted multi-index.

Copies of one direction are one vector with a count. Each half of the normalised vectors has a codebook of its own,
fitted on a bounded sample (SAMPLE_ROWS vectors, SAMPLE_VALUES numbers); the pairs of codewords form the grid of cells,
with about ROWS_PER_CELL vectors a cell. All vectors are indexed. A vector visits the cells of the grid by the
multi-sequence algorithm in ascending distance to the cell's two codewords until the distance exceeds that of its
own cell by a margin. The margin is the one that reaches TARGET_RECALL for partners at exactly the threshold cosine in
random directions, drawn around the sample; closer partners are reached more often. Of two vectors in different cells
the one in the lower cell visits the other. What meets is verified by the cosine in double precision.

A cell's vectors and visitors meet in blocks of at most BLOCK rows each, so a large cell is many tasks. A block pair
answers with one row a vector: how many it links, and the smallest vector of its local component; links are not listed.
Inside a group of near copies that are not equal the comparisons still grow with the square of its size.

Vectors that are null, zero or hold null or non-finite values link with nothing and are components of their own, as do
vectors whose norm overflows; vectors of different lengths never link. Repeated rows count as other vectors. A null id
is never a component's id unless its component has no other, and such a row is not kept. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import Scratch, query, table
from .components import components

THRESHOLD = 0.9
TARGET_RECALL = 0.995
ROWS_PER_CELL, MAX_WORDS = 128, 256  # codewords of a half at most
SAMPLE_ROWS, SAMPLE_VALUES = 16_384, 1 << 23
ROUNDS = 12  # of k-means
DRAWS = 4  # partners drawn around each vector of the sample
BLOCK = 1024


# --- index ------------------------------------------------------------------

@dataclass
class Grid:
    """Codebooks of both halves and the margin up to which cells are visited."""

    left: np.ndarray
    right: np.ndarray
    margin: float

    @property
    def cells(self) -> int:
        return len(self.left) * len(self.right)

    def distances(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.left.shape[1]
        return squared(units[:, :cut], self.left), squared(units[:, cut:], self.right)


def squared(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (words * words).sum(1) - 2 * x @ words.T, 0.0)


def k_means(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    words = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(ROUNDS):
        own = squared(x, words).argmin(1)
        n = np.bincount(own, minlength=len(words))
        total = np.zeros_like(words)
        np.add.at(total, own, x)
        words = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], words)
    return words


def fit(units: np.ndarray, rows: float, threshold: float, recall: float) -> Grid:
    """The grid for about `rows` vectors like the sampled ones."""
    rng = np.random.default_rng(0)
    dim = units.shape[1]
    k = int(np.clip(round((rows / ROWS_PER_CELL) ** 0.5), 1, min(MAX_WORDS, len(units))))
    grid = Grid(k_means(units[:, : dim // 2], k, rng), k_means(units[:, dim // 2 :], k, rng), 0.0)
    d = grid.distances(units)
    best = d[0].min(1) + d[1].min(1)
    needed = []
    for _ in range(DRAWS):
        aside = rng.normal(size=units.shape)
        aside -= (aside * units).sum(1)[:, None] * units
        norm = np.linalg.norm(aside, axis=1)[:, None]
        partner = threshold * units + (1 - threshold**2) ** 0.5 * np.divide(aside, norm, out=np.zeros_like(aside), where=norm > 1e-9)
        there = [x.argmin(1) for x in grid.distances(partner)]
        at = np.arange(len(units))
        needed.append(d[0][at, there[0]] + d[1][at, there[1]] - best)
    grid.margin = float(np.quantile(np.concatenate(needed), recall))
    return grid


def multi_sequence(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """(distance, left word, right word) of all cells in ascending distance, as far as asked."""
    a, b = np.argsort(left, kind="stable").tolist(), np.argsort(right, kind="stable").tolist()
    x, y = left[a].tolist(), right[b].tolist()
    heap, reached = [(x[0] + y[0], 0, 0)], {(0, 0)}
    while heap:
        d, i, j = heapq.heappop(heap)
        yield d, a[i], b[j]
        for p, q in ((i + 1, j), (i, j + 1)):
            if p < len(x) and q < len(y) and (p, q) not in reached:
                reached.add((p, q))
                heapq.heappush(heap, (x[p] + y[q], p, q))


def visited(grid: Grid, units: np.ndarray) -> list[list[int]]:
    """Cells of each vector, its own first, then the others within the margin."""
    left, right = grid.distances(units)
    out = []
    for x, y in zip(left, right):
        cells: list[int] = []
        for d, i, j in multi_sequence(x, y):
            if not cells:
                limit = d + grid.margin
            elif d > limit:
                break
            cells.append(i * len(grid.right) + j)
        out.append(cells)
    return out


# --- verification -----------------------------------------------------------

def smallest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n items the smallest item that the links (a, b) reach."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def met(own: np.ndarray, own_n: np.ndarray, other: np.ndarray | None, other_n: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Copies linked with each row of own (then of other, if given), and the first row of its local component."""
    cosine = own @ (own if other is None else other).T
    hit = cosine >= threshold
    if other is None:
        np.fill_diagonal(hit, False)
        a, b = np.nonzero(np.triu(hit))
        return hit @ own_n, smallest(len(own), a, b)
    a, b = np.nonzero(hit)
    return np.concatenate([hit @ other_n, own_n @ hit]), smallest(len(own) + len(other), a, b + len(own))


def normal(values: pa.Array | np.ndarray) -> np.ndarray | None:
    """The direction of a vector in double precision; None if it has none."""
    x = np.asarray(values, np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        norm = np.linalg.norm(x)
    return x / norm if len(x) and np.isfinite(norm) and norm > 0 and np.isfinite(x).all() else None


# --- jobs -------------------------------------------------------------------

def directions(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """id, key (a digest of the direction, null if it has none), unit (its numbers as bytes), for every row."""
    frame = vectors.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{vector_column}`").cast("array<double>").alias("v"))

    def run(batches):
        for batch in batches:
            units = [None if v is None or None in v else normal(v) for v in batch.column(1).to_pylist()]
            data = [None if u is None else (u + 0.0).tobytes() for u in units]
            keys = [None if d is None else hashlib.blake2b(d, digest_size=16).digest() for d in data]
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "key": pa.array(keys, pa.binary()), "unit": pa.array(data, pa.binary())})

    return frame.mapInArrow(run, f"id {dict(frame.dtypes)['id']}, key binary, unit binary")


def grids(nodes: DataFrame, threshold: float, recall: float) -> tuple[dict[int, Grid], dict[int, int]]:
    """By vector length: the grid and its first cell number. Lengths that the sample lacks are a cell each, by length."""
    size = nodes.agg(F.count("*").alias("n"), F.max(F.length("unit")).alias("longest")).first()
    if not size.n:
        return {}, {}
    rows = int(min(SAMPLE_ROWS, max(256, SAMPLE_VALUES * 8 // size.longest)))
    sample = nodes.select("key", "unit").orderBy("key").limit(rows).collect()  # digests are in random order
    units: dict[int, list[np.ndarray]] = {}
    for r in sample:
        units.setdefault(len(r.unit) // 8, []).append(np.frombuffer(r.unit, np.float64))
    found = {d: fit(np.stack(u), size.n * len(u) / len(sample), threshold, recall) for d, u in sorted(units.items())}
    first, at = {}, 0
    for d, g in found.items():
        first[d] = at
        at += g.cells
    return found, first


def linked(vectors: DataFrame, id_column: str, vector_column: str, threshold: float = THRESHOLD, recall: float = TARGET_RECALL) -> DataFrame:
    """id, n_links, component_id, kept of every row."""
    scratch = Scratch(vectors.sparkSession, "neighbours")
    rows = scratch.write(directions(vectors, id_column, vector_column), "rows")
    nodes = rows.where(F.col("key").isNotNull()).groupBy("key").agg(F.count("*").alias("copies"), F.min("id").alias("least"), F.first("unit").alias("unit"))
    nodes = scratch.write(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")  # numbers hold as written
    known, first = grids(nodes, threshold, recall)

    def assign(batches):
        for batch in batches:
            of_dim: dict[int, list[int]] = {}
            for k, u in enumerate(batch.column(2).to_pylist()):
                of_dim.setdefault(len(u) // 8, []).append(k)
            for d, ks in of_dim.items():
                some = batch.take(pa.array(ks))
                if d in known:
                    cells = visited(known[d], np.stack([np.frombuffer(u, np.float64) for u in some.column(2).to_pylist()]))
                    cells = [[first[d] + c for c in row] for row in cells]
                else:
                    cells = [[-d]] * len(ks)
                own = [c[0] for c in cells]
                yield pa.RecordBatch.from_pydict({"node": some.column(0), "copies": some.column(1), "unit": some.column(2), "cell": pa.array(own, pa.int64()),
                                                  "visits": pa.array([[c for c in row if c > row[0]] for row in cells], pa.list_(pa.int64()))})

    placed = scratch.write(nodes.select("node", "copies", "unit").mapInArrow(assign, "node long, copies long, unit binary, cell long, visits array<long>"), "placed")
    count = lambda df: {r.cell: r["count"] for r in df.groupBy("cell").count().collect()}  # a number for each cell, of which there are at most MAX_WORDS squared a length
    own, guests = count(placed), count(placed.select(F.explode("visits").alias("cell")))
    own_blocks, guest_blocks = ({c: -(-n // BLOCK) for c, n in x.items()} for x in (own, guests))

    def deal(batches):
        spread = lambda node, n: (node * 0x9E3779B97F4A7C15 % (1 << 64) >> 32) % n
        for batch in batches:
            take, cells, blocks, others, roles = [], [], [], [], []

            def put(k, cell, block, other, role):
                for column, x in zip((take, cells, blocks, others, roles), (k, cell, block, other, role)):
                    column.append(x)

            for k, (node, cell, visits) in enumerate(zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist())):
                n = own_blocks[cell]
                mine = spread(node, n)
                strangers = guest_blocks.get(cell, 0)
                for other in range(strangers):
                    put(k, cell, mine, other, 0)
                for later in range(mine, n if own[cell] > 1 else 0):
                    put(k, cell, mine, strangers + later, 0)
                for earlier in range(mine):
                    put(k, cell, earlier, strangers + mine, 1)
                for there in visits:
                    if there in own_blocks:
                        for block in range(own_blocks[there]):
                            put(k, there, block, spread(node, guest_blocks[there]), 1)
            for s in range(0, len(take), BLOCK * 8):
                part = slice(s, s + BLOCK * 8)
                some = batch.take(pa.array(take[part], pa.int64()))
                yield pa.RecordBatch.from_pydict({"node": some.column(0), "copies": some.column(1), "unit": some.column(2), "cell": pa.array(cells[part], pa.int64()),
                                                  "block": pa.array(blocks[part], pa.int32()), "other": pa.array(others[part], pa.int32()), "role": pa.array(roles[part], pa.int32())})

    def verify(group: pa.Table) -> pa.Table:
        role, node, copies = (group.column(c).to_numpy() for c in ("role", "node", "copies"))
        units = np.stack([np.frombuffer(u, np.float64) for u in group.column("unit").to_pylist()])
        here, there = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        alone = group.column("other")[0].as_py() == guest_blocks.get(group.column("cell")[0].as_py(), 0) + group.column("block")[0].as_py()
        if alone:
            there = there[:0]
        elif not len(there) or not len(here):
            here = there = here[:0]
        at = np.concatenate([here, there])
        n, head = met(units[here], copies[here], None if alone else units[there], copies[there], threshold) if len(at) else (np.zeros(0, np.int64),) * 2
        some = np.flatnonzero(n)
        low = np.full(len(at), np.iinfo(np.int64).max)
        np.minimum.at(low, head, node[at])
        return pa.table({"node": node[at[some]], "n": n[some], "head": low[head[some]]})

    dealt = placed.mapInArrow(deal, "node long, copies long, unit binary, cell long, block int, other int, role int")
    hits = scratch.write(dealt.groupBy("cell", "block", "other").applyInArrow(verify, "node long, n long, head long"), "hits")
    joined = components(hits.where(F.col("node") != F.col("head")).select(F.col("node").alias("a"), F.col("head").alias("b")), scratch, "components")
    sums = hits.groupBy("node").agg(F.sum("n").alias("n"))
    facts = nodes.select("node", "key", "copies", "least").join(joined.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = facts.groupBy("component").agg(F.min("least").alias("component_id"))
    facts = facts.join(least, "component").join(sums, "node", "left").select("key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.select("id", "key").join(facts, "key", "left").select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", F.col("id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))


SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding) AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM least LEFT JOIN n USING (vec_id)
"""


@query("op12_embedding_neighbours", SQL)
def op12_embedding_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").withColumnRenamed("id", "vec_id")
