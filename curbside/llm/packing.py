"""Best-fit packing of tokenised documents by bin completion.

Pieces of one length are interchangeable, so the packing is decided on counts per length, at most `capacity`
numbers however many documents there are:

1. tasks tokenise the documents and write (document, piece, length), numbering the pieces of each length;
2. counts per length go to the driver; best-fit decreasing over them gives the incumbent;
3. if it misses the lower bound, a branch-and-bound search looks for fewer sequences: around the largest length
   left it enumerates undominated fillings, fullest first, applies each as often as the counts allow, and prunes
   whatever the waste so far shows cannot beat the incumbent. The search stops after SEARCH_NODES fillings and
   then keeps the incumbent;
4. the result is a list of patterns (lengths in one sequence, number of sequences); the k-th piece of a length
   finds its sequence and place in it by arithmetic.

Text ids come from a byte-level BPE file. Null and empty texts are a single end token. Repeated rows are packed
one by one.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import combinations
from operator import neg

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import TEXTS, Scratch, clean_ids, map_batches, query, slices, table

CAPACITY = 1024
END_ID = 2
VOCABULARY = "byte_bpe_50k"
SEARCH_NODES = 3000
FILLINGS = 8  # tried at each node of the search
FILL_STEPS = 500  # lengths tried for one node's fillings

Pattern = tuple[tuple[int, ...], int]  # lengths in descending order, number of sequences


# --- token ids --------------------------------------------------------------

@lru_cache(maxsize=2)
def _encoders(vocabulary: str):
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))
    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return whole, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_ids(text: str, vocabulary: str = VOCABULARY) -> Sequence[int]:
    """Ids of the vocabulary file as `tokenizers` gives them, without special tokens added.

    `tiktoken` has the same vocabulary and is several times faster. It serves Latin texts of ordinary shape; where the
    two could differ (other scripts, whose letter classes depend on the Unicode version, special-token strings, very
    long runs) `tokenizers` itself does.
    """
    whole, fast = _encoders(vocabulary)
    if "<|" not in text and len(text) < 1_000_000 and (text.isascii() or max(text) < "ɐ"):
        return fast.encode_ordinary(text)
    return whole.encode(text, add_special_tokens=False).ids


def cut(n: int, capacity: int = CAPACITY) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be shorter than the capacity."""
    first = (n - 1) % capacity + 1 if n else 0
    yield 0, first
    for start in range(first, n, capacity):
        yield start, capacity


def tokenised_pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and (task, nth): the nth piece of its length in its task."""
    docs = clean_ids(docs, "doc_id", "text")
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in slices(batches, TEXTS):
            rows: list[tuple[int, int, int, int, int, int]] = []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = np.array([*token_ids(text or "", vocabulary), end_id], "<u4")
                for piece, (start, length) in enumerate(cut(len(ids), capacity)):
                    rows.append((i, piece, start, length, zlib.crc32(ids[start : start + length].tobytes()), int(seen[length])))
                    seen[length] += 1
            own, piece, start, length, crc, nth = (np.array(c, np.int64) for c in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 6
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column(0).take(pa.array(own)), "piece": pa.array(piece.astype(np.int32)), "start": pa.array(start), "length": pa.array(length), "ids_crc32": pa.array(crc),
                 "task": pa.array(np.full(len(own), task, np.int64)), "nth": pa.array(nth)}
            )

    return docs.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, task long, nth long")


# --- packing on counts ------------------------------------------------------

def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences needed at least: total length, and lengths of over half the capacity with what cannot join them."""
    total = sum(n * c for n, c in counts.items())
    best = -(-total // capacity)
    for k in [0, *sorted(n for n in counts if n <= capacity // 2)]:
        alone = sum(c for n, c in counts.items() if n > capacity - k)
        large = {n: c for n, c in counts.items() if capacity / 2 < n <= capacity - k}
        room = sum((capacity - n) * c for n, c in large.items())
        small = sum(n * c for n, c in counts.items() if k <= n <= capacity // 2)
        best = max(best, alone + sum(large.values()) + max(0, -(-(small - room) // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing; sequences with equal contents are handled together."""
    open_: dict[int, list[Pattern]] = {}  # room left -> patterns
    for length in sorted(counts, reverse=True):
        left = counts[length]
        for room in sorted(r for r in open_ if r >= length):
            # what comes back with less room may take the same length again, so each pattern is filled up at once
            again: list[Pattern] = []
            for items, n in open_.pop(room):
                times = room // length
                full = min(n, left // times)
                if full:
                    open_.setdefault(room - times * length, []).append((items + (length,) * times, full))
                    left -= full * times
                n -= full
                if n and left and left < times:
                    open_.setdefault(room - left * length, []).append((items + (length,) * left, 1))
                    left, n = 0, n - 1
                if n:
                    again.append((items, n))
            if again:
                open_.setdefault(room, []).extend(again)
            if not left:
                break
        if left:
            times = capacity // length
            if left // times:
                open_.setdefault(capacity - times * length, []).append(((length,) * times, left // times))
            if left % times:
                open_.setdefault(capacity - left % times * length, []).append(((length,) * (left % times), 1))
    return [p for ps in open_.values() for p in ps]


def _dominated(filling: tuple[int, ...], counts: dict[int, int], room: int) -> bool:
    """Some length left out could replace one or two of those taken, at no less use of the room."""
    waste = room - sum(filling)
    for k in (1, 2):
        for part in set(combinations(filling, k)):
            s = sum(part)
            if any(counts.get(t, 0) > filling.count(t) for t in range(s + (k == 1), s + waste + 1)):
                return True
    return False


def fillings(counts: dict[int, int], lengths: Sequence[int], room: int, limit: int = FILLINGS, steps: int = FILL_STEPS) -> list[tuple[int, ...]]:
    """Undominated ways to fill the room from the counts, least waste first. lengths: the counted ones, descending.

    Ends early once `limit` fillings leave no waste, or after `steps` lengths tried.
    """
    found: list[tuple[int, tuple[int, ...]]] = []
    perfect = 0
    taken: list[int] = []

    def extend(at: int, left: int) -> None:
        nonlocal steps, perfect
        at, fits = max(at, bisect_left(lengths, -left, key=neg)), False
        for i in range(at, len(lengths)):
            n = lengths[i]
            if counts[n] > taken.count(n):
                fits = True
                steps -= 1
                if steps < 0 or perfect >= limit:
                    return
                taken.append(n)
                extend(i, left - n)
                taken.pop()
        if not fits:
            found.append((left, tuple(taken)))
            perfect += left == 0

    extend(0, room)
    found.sort(key=lambda f: (f[0], len(f[1])))
    kept = [f for w, f in found[: 4 * limit] if not w or not _dominated(f, counts, room)]
    return kept[:limit] or [f for _, f in found[:limit]] or [()]


def pack_counts(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = SEARCH_NODES) -> list[Pattern]:
    """Patterns that hold exactly the given counts, in as few sequences as the search finds."""
    counts = {n: c for n, c in counts.items() if c}
    incumbent = best_fit(counts, capacity)
    best, bound = sum(n for _, n in incumbent), lower_bound(counts, capacity)
    slack = (best - 1) * capacity - sum(n * c for n, c in counts.items())  # waste that a better packing may have
    left, path, used, waste = dict(counts), [], 0, 0
    stack: list[Iterator[tuple[int, ...]]] = []

    def branches() -> Iterator[tuple[int, ...]]:
        lengths = sorted(left, reverse=True)
        top = lengths[0]
        left[top] -= 1
        found = fillings(left, lengths, capacity - top)
        left[top] += 1
        return iter([tuple(sorted((top, *f), reverse=True)) for f in found])

    if best > bound and left:
        stack.append(branches())
    while stack and nodes > 0 and best > bound:
        items = next(stack[-1], None)
        if items is None:
            stack.pop()
            if path:
                done, times = path.pop()
                for n in done:
                    left[n] = left.get(n, 0) + times
                used, waste = used - times, waste - times * (capacity - sum(done))
            continue
        nodes -= 1
        times = min(left[n] // items.count(n) for n in set(items))
        free = capacity - sum(items)
        if waste + times * free > slack:
            times = (slack - waste) // free if free else 0  # the counts allow it more often than the waste does
            if times <= 0:
                continue
        for n in items:
            left[n] -= times
            if not left[n]:
                del left[n]
        path.append((items, times))
        used, waste = used + times, waste + times * (capacity - sum(items))
        if not left and used < best:
            best, incumbent = used, list(path)
            slack = (best - 1) * capacity - sum(n * c for n, c in counts.items())
        stack.append(branches() if left else iter(()))
    return incumbent


class Places:
    """Where the k-th piece of a length goes: runs of ranks, one for each (pattern, length)."""

    def __init__(self, patterns: Sequence[Pattern]):
        self.runs: dict[int, list[tuple[int, int, int, int]]] = {}
        next_rank: dict[int, int] = {}
        first = 0
        for items, n in patterns:
            offset = 0
            for length in sorted(set(items), reverse=True):
                each = items.count(length)
                rank = next_rank.get(length, 0)
                self.runs.setdefault(length, []).append((rank, each, first, offset))
                next_rank[length] = rank + each * n
                offset += each * length
            first += n

    def of(self, length: int, rank: int) -> tuple[int, int]:
        runs = self.runs[length]
        start, each, first, offset = runs[bisect_right(runs, rank, key=lambda r: r[0]) - 1]
        return first + (rank - start) // each, offset + (rank - start) % each * length


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row for each piece."""
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = scratch.write(tokenised_pieces(docs, capacity, end_id, vocabulary), "pieces")
    by_task = pieces.groupBy("task", "length").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("task")) - F.col("count")
    tasks = scratch.write(by_task.select("task", "length", "count", before.alias("before")), "tasks")
    counts = {r.length: r.n for r in tasks.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most `capacity` rows
    places = Places(pack_counts(counts, capacity))
    ranked = pieces.join(tasks.drop("count").hint("merge"), ["task", "length"]).select(  # the table grows with the tasks: not shipped whole
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank")
    )

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [places.of(n, r) for n, r in zip(batch.column(3).to_pylist(), batch.column(5).to_pylist())]
        columns = {c: batch.column(i) for i, c in enumerate(("doc_id", "piece", "start", "length", "ids_crc32"))}
        return pa.RecordBatch.from_pydict(columns | {"sequence_id": pa.array([f[0] for f in found], pa.int64()), "offset": pa.array([f[1] for f in found], pa.int64())})

    return map_batches(ranked, place, f"doc_id {dict(docs.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


@query("op8_packing")
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
