"""Embedding near duplicates against brute force, and the recall of the index."""

import math

import numpy as np
import pytest

from curbside.llm import embedding_neighbours as N

VECTORS = "vec_id long, embedding array<float>, cell string, unit int, label int"


def brute(rows, threshold=0.9):
    units = []
    for _, v in rows:
        ok = v is not None and len(v) and None not in v and all(math.isfinite(x) for x in v) and any(v)
        x = np.asarray(v, np.float32).astype(np.float64) if ok else None
        units.append(x / np.linalg.norm(x) if ok else None)
    n = len(rows)
    near = [[i != j and units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and float(units[i] @ units[j]) >= threshold for j in range(n)] for i in range(n)]
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            low = min([label[i], *(label[j] for j in range(n) if near[i][j])])
            changed, label[i] = changed or low != label[i], low
    least = {}
    for i, (k, _) in enumerate(rows):
        least.setdefault(label[i], []).append(k)
    first = {c: min((k for k in ks if k is not None), default=None) for c, ks in least.items()}
    return sorted(((k, sum(near[i]), first[label[i]], k is not None and k == first[label[i]]) for i, (k, _) in enumerate(rows)), key=str)


def clouds(rng, n, dim, spread):
    centres = rng.normal(size=(6, dim))
    return [(centres[rng.integers(6)] + spread * rng.normal(size=dim)).astype(np.float32).tolist() for _ in range(n)]


@pytest.mark.parametrize(("seed", "block", "per_cell"), [(0, 1024, 128), (1, 7, 4), (2, 3, 500)])
def test_neighbours_equal_brute_force(spark, monkeypatch, seed, block, per_cell):
    """With a margin that takes every cell, all pairs meet once, whatever the blocks."""
    monkeypatch.setattr(N, "BLOCK", block)
    monkeypatch.setattr(N, "ROWS_PER_CELL", per_cell)
    rng = np.random.default_rng(seed)
    vectors = clouds(rng, 90, 8, 0.2) + clouds(rng, 12, 5, 0.3)
    vectors += [vectors[3]] * 5 + [[2 * x for x in vectors[3]]] * 2
    rows = [(int(k), v) for k, v in zip(rng.permutation(len(vectors)), vectors)]
    rows += [(500, None), (501, []), (502, [0.0] * 8), (503, [1.0, None] * 4), (504, [math.nan] * 8), (505, [math.inf] + [0.0] * 7), (506, [1.0]), (507, [3.0]), (508, [-1.0]), (None, vectors[3]), (509, [5.0, 5.0]), (510, [1.0, 1.2]), (None, [9.0] * 3)]
    frame = spark.createDataFrame([(k, v, "c", 1, 2) for k, v in rows], VECTORS).repartition(3)
    fit = N.fit

    def wide(*a):
        grid = fit(*a)
        grid.margin = math.inf
        return grid

    monkeypatch.setattr(N, "fit", wide)
    got = N.linked(frame, "vec_id", "embedding").collect()
    assert sorted(((r.id, r.n_links, r.component_id, r.kept) for r in got), key=str) == brute(rows)
    assert N.linked(frame.limit(0), "vec_id", "embedding").collect() == []


def test_cells_come_in_ascending_distance():
    rng = np.random.default_rng(4)
    left, right = rng.random(7), rng.random(9)
    got = list(N.multi_sequence(left, right))
    assert [d for d, _, _ in got] == sorted((x + y for x in left for y in right))
    assert all(d == left[i] + right[j] for d, i, j in got) and len({(i, j) for _, i, j in got}) == 63


def test_recall_at_the_threshold():
    """Partners at exactly the threshold, the hardest case, none of them in the sample."""
    rng = np.random.default_rng(5)
    units = rng.normal(size=(4000, 32))
    units /= np.linalg.norm(units, axis=1)[:, None]
    aside = rng.normal(size=units.shape)
    aside -= (aside * units).sum(1)[:, None] * units
    partner = 0.9 * units + 0.19**0.5 * aside / np.linalg.norm(aside, axis=1)[:, None]
    grid = N.fit(units[:2000], 20_000, 0.9, 0.98)
    a, b = N.visited(grid, units[2000:]), N.visited(grid, partner[2000:])
    met = [(y[0] in x) if x[0] <= y[0] else (x[0] in y) for x, y in zip(a, b)]
    assert np.mean(met) > 0.96
    assert np.mean([len(x) for x in a]) < grid.cells / 3  # far from all cells


def test_recall_on_the_table(spark):
    """All links of the given table are found, copies and near copies alike."""
    import duckdb

    sf = "/root/testdata/sf0.1"
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{sf}/embeddings.parquet'").fetchall()
    x = np.array([v for _, v in rows], np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    want = dict(zip((k for k, _ in rows), ((x @ x.T >= 0.9).sum(1) - 1).tolist()))
    got = {r.vec_id: r.n_links for r in N.op12_embedding_neighbours(spark, sf).collect()}
    assert got.keys() == want.keys() and sum(got.values()) >= 0.99 * sum(want.values()) and all(n <= want[k] for k, n in got.items())
