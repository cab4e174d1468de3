"""Language-model scores from a sharded Elias-Fano n-gram trie.

Tokens are words (A-Z lower-cased) and one end token a text, which is also the context of the first word. The base
score adds one to every count. The model interpolates the word pair with that:

    p(w | v) = (c(v w) + KAPPA * p(w)) / (c(v) + KAPPA),  p(w) = (c(w) + 1) / (N + V + 1)

1. Tasks cut the documents into batches and write each as a word list with 64-bit hashes and the texts as numbers in
   it. Word counts are summed over all batches (a word travels once a batch) and return to the batches.
2. A batch sends each distinct word pair, with its training count, to the shard of its context. A context with more than
   SPREAD occurrences is divided over several shards by its successors, so no shard grows with one word.
3. A shard builds its trie from all batches' training pairs: sorted context hashes (48 bits), monotone pointers to their
   successors, and successor fingerprints (40 bits) in order, each level Elias-Fano coded; beside them one byte a
   successor for the smoothed c(v w) / (c(v) + KAPPA), quantised evenly in
   logarithm. The levels lie in one buffer and are read
   in place, as from a mapped file. Every pair of every batch is looked up: the context among the contexts, then the
   fingerprint between that context's pointers. The shard answers a batch with one byte a pair.
4. Batches add up their documents' scores.

Null and empty texts are one end token. Null doc_ids count as the empty string for the fold. Repeated rows are learned
from and scored one by one. With nothing to learn from, every probability of the base is 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import Scratch, clean_ids, partitions, query, rows_per_batch, table
from .shingles import grouped, mix, word_hashes

KAPPA = 20.0
SPREAD = 1_000_000
BATCH_BYTES = 900_000  # so few words that two bytes number them
SHARD_PAIRS = 1_000_000
FINGERPRINT = 40
CONTEXT = 48  # bits of a context's hash; a shard holds some 10^5 contexts at any corpus size
LEVELS = 255  # quantised probabilities, evenly spaced in logarithm
END = np.uint64(0xE4D0_F7E7_7E57_0001)
_U = np.uint64


# --- Elias-Fano levels ------------------------------------------------------

class EliasFano:
    """A non-decreasing sequence of integers below `universe`: low bits packed, high bits in unary."""

    def __init__(self, header: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.n, self.bits = int(header[0]), int(header[1])
        self.low, self.high = low, high
        ones = np.unpackbits(high, bitorder="little")
        self._zeros = np.flatnonzero(ones == 0)  # where each high value ends
        self._ones = None

    @staticmethod
    def encode(values: np.ndarray, universe_bits: int) -> list[np.ndarray]:
        n = len(values)
        bits = max(0, universe_bits - max(1, int(n).bit_length()))
        v = values.astype(np.uint64)
        top = (v >> _U(bits)).astype(np.int64)
        high = np.zeros(n + (int(top[-1]) if n else 0) + 2, np.uint8)
        high[top + np.arange(n)] = 1
        low = np.zeros((n * bits + 63) // 64 + 1, np.uint64)
        if bits and n:
            part = v & _U((1 << bits) - 1)
            at = np.arange(n, dtype=np.uint64) * _U(bits)
            word, shift = (at >> _U(6)).astype(np.int64), at & _U(63)
            np.bitwise_or.at(low, word, part << shift)
            spill = shift + _U(bits) > _U(64)
            np.bitwise_or.at(low, word[spill] + 1, part[spill] >> (_U(64) - shift[spill]))
        return [np.array([n, bits], np.uint64), low, np.packbits(high, bitorder="little")]

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * _U(self.bits)
        word, shift = (at >> _U(6)).astype(np.int64), at & _U(63)
        got = self.low[word] >> shift
        spill = shift + _U(self.bits) > _U(64)
        got[spill] |= self.low[word[spill] + 1] << (_U(64) - shift[spill])
        return got & _U((1 << self.bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        if self._ones is None:
            self._ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))
        return ((self._ones[i] - i).astype(np.uint64) << _U(self.bits)) | self.lows(i)

    def find(self, x: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> np.ndarray:
        """Index of each x, -1 where it does not occur; within [first, last) if given."""
        x = x.astype(np.uint64)
        top = (x >> _U(self.bits)).astype(np.int64)
        known = top < len(self._zeros)
        top = np.minimum(top, len(self._zeros) - 1)
        lo = np.where(top > 0, self._zeros[np.maximum(top - 1, 0)] - np.maximum(top - 1, 0), 0)
        hi = np.minimum(self._zeros[top] - top, self.n)
        if first is not None:
            lo, hi = np.maximum(lo, first), np.minimum(hi, last)
        want, end = x & _U((1 << self.bits) - 1), hi.copy()
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) // 2
            less = self.lows(mid) < want[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
        hit = known & (lo < end)
        hit[hit] = self.lows(lo[hit]) == want[hit]
        return np.where(hit, lo, -1)


class Trie:
    """Contexts, pointers, successors and quantised probabilities in one buffer."""

    def __init__(self, buffer):
        head = np.frombuffer(buffer, np.int64, 11)
        kinds = ("<u8", "<u8", "u1") * 3 + ("u1", "<f8")
        parts, at = [], 88
        for size, kind in zip(head[:11], kinds):
            parts.append(np.frombuffer(buffer, kind, int(size) // np.dtype(kind).itemsize, at))
            at += -(-int(size) // 8) * 8
        self.contexts, self.pointers, self.successors = (EliasFano(*parts[k : k + 3]) for k in (0, 3, 6))
        self.codes, (self.low, self.step) = parts[9], parts[10]

    @staticmethod
    def build(context: np.ndarray, successor: np.ndarray, p: np.ndarray) -> bytes:
        """From distinct (context hash, successor fingerprint) pairs in order, and their probabilities."""
        names, start = np.unique(context, return_index=True)
        logs = np.log10(p)
        low, high = (logs.min(), logs.max()) if len(p) else (0.0, 0.0)
        step = max((high - low) / (LEVELS - 1), 1e-12)
        code = np.rint((logs - low) / step)
        place = np.repeat(np.arange(len(names), dtype=np.uint64), np.diff(np.append(start, len(context))))
        parts = [
            *EliasFano.encode(names, CONTEXT), *EliasFano.encode(np.append(start, len(context)), max(1, int(len(context)).bit_length())),
            *EliasFano.encode((place << _U(FINGERPRINT)) | successor, FINGERPRINT + max(1, int(len(names)).bit_length())), code.astype(np.uint8), np.array([low, step]),
        ]
        raw = [np.ascontiguousarray(x).tobytes() for x in parts]
        return np.array([len(r) for r in raw], np.int64).tobytes() + b"".join(r + b"\0" * (-len(r) % 8) for r in raw)

    def find(self, context: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """Code + 1 of each pair, 0 where it was not learned."""
        at = self.contexts.find(context)
        out = np.zeros(len(at), np.uint8)
        seen = np.flatnonzero(at >= 0)
        k = at[seen]
        first, last = self.pointers.get(k).astype(np.int64), self.pointers.get(k + 1).astype(np.int64)
        got = self.successors.find((k.astype(np.uint64) << _U(FINGERPRINT)) | successor[seen], first, last)
        out[seen[got >= 0]] = self.codes[got[got >= 0]] + 1
        return out


# --- batches ----------------------------------------------------------------

def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 7 == 2


def _pack(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def tokenised(docs: DataFrame) -> DataFrame:
    """batch, doc_ids, held, ends (token counts up to each text's end), ids (two or four bytes each), words (uint64, sorted)."""
    kind = dict(docs.dtypes)["doc_id"]

    def batches(source) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        for batch in source:
            tokens: list[np.ndarray] = []
            sizes: list[int] = []
            first, size = 0, 0

            def out(stop: int) -> pa.RecordBatch:
                words, ids = np.unique(np.concatenate(tokens), return_inverse=True)
                own = batch.slice(first, stop - first)
                return pa.RecordBatch.from_pydict(
                    {"batch": pa.array([(task << 32) + number], pa.int64()), "doc_ids": pa.ListArray.from_arrays(pa.array([0, stop - first], pa.int32()), own.column(0)),
                     "held": pa.ListArray.from_arrays(pa.array([0, stop - first], pa.int32()), own.column(2)), "ends": pa.array([_pack(np.cumsum(sizes).astype(np.int64))], pa.binary()),
                     "ids": pa.array([_pack(ids.astype(np.uint16 if len(words) <= 1 << 16 else np.int32))], pa.binary()), "words": pa.array([_pack(words)], pa.binary())}
                )

            done = 0
            for run in grouped(batch.column(1).to_pylist()):
                words, start = word_hashes(b" ".join(run))
                cut = np.searchsorted(start, np.cumsum([0] + [len(d) + 1 for d in run]))
                for a, b in zip(cut[:-1], cut[1:]):
                    tokens += [words[a:b], np.array([END])]
                    sizes.append(int(b - a) + 1)
                size += sum(map(len, run))
                done += len(run)
                if size >= BATCH_BYTES:
                    yield out(done)
                    tokens, sizes, first, size, number = [], [], done, 0, number + 1
            if sizes:
                yield out(done)
                number += 1

    rows = clean_ids(docs, "doc_id", "text").withColumn("held", held_out())
    return rows.mapInArrow(batches, f"batch long, doc_ids array<{kind}>, held array<boolean>, ends binary, ids binary, words binary")


def _open(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ends, ids, words, training flag of each token, context id of each token); the end token's id is the first context."""
    ends, words = np.frombuffer(row["ends"], np.int64), np.frombuffer(row["words"], np.uint64)
    ids = np.frombuffer(row["ids"], np.uint16 if len(words) <= 1 << 16 else np.int32).astype(np.int64)
    sizes = np.diff(np.concatenate([[0], ends]))
    learn = np.repeat(~np.array(row["held"], bool), sizes)
    before = np.concatenate([[0], ids[:-1]])
    before[np.concatenate([[0], ends[:-1]])] = int(np.searchsorted(words, END))
    return ends, ids, words, learn, before


def word_rows(batches: DataFrame) -> DataFrame:
    """h, batch, word (its number in the batch), n (training tokens)."""

    def run(source):
        for b in source:
            for row in b.to_pylist():
                _, ids, words, learn, _ = _open(row)
                n = np.bincount(ids[learn], minlength=len(words))
                yield pa.RecordBatch.from_pydict(
                    {"h": pa.array(words.view(np.int64)), "batch": pa.array(np.full(len(words), row["batch"], np.int64)), "word": pa.array(np.arange(len(words), dtype=np.int32)), "n": pa.array(n.astype(np.int64))}
                )

    return batches.select("batch", "held", "ends", "ids", "words").mapInArrow(run, "h long, batch long, word int, n long")


class Pairs:
    """The distinct (context, word) pairs of one batch in order of (shard, context hash, fingerprint)."""

    def __init__(self, row: dict, shards: int):
        self.ends, self.ids, self.words, learn, before = _open(row)
        self.counts = np.frombuffer(row["counts"], np.int64)
        key, self.of = np.unique(before * len(self.words) + self.ids, return_inverse=True)
        context, word = key // len(self.words), key % len(self.words)
        spread = np.maximum(1, -(-self.counts[context] // SPREAD)).astype(np.uint64)
        h, w = self.words[context], self.words[word]
        shard = (mix(h + (mix(w) % spread) * _U(0x9E3779B97F4A7C15)) % _U(shards)).astype(np.int64)
        self.order = np.lexsort((w, h, shard))
        self.shard, self.h, self.c = shard[self.order], h[self.order] >> _U(64 - CONTEXT), self.counts[context][self.order]
        self.fingerprint = w[self.order] >> _U(64 - FINGERPRINT)
        self.n = np.bincount(self.of[learn], minlength=len(key))[self.order]


def pair_blobs(batches: DataFrame, shards: int) -> DataFrame:
    """shard, batch, and the batch's pairs for that shard: contexts with sizes, fingerprints, training counts.

    A context that lies in one shard has the sum of its pairs for a count; `wide` and `totals` hold the position and count
    of those that are divided.
    """

    def run(source):
        for b in source:
            for row in b.to_pylist():
                p = Pairs(row, shards)
                cut = np.concatenate([[0], np.flatnonzero(np.diff(p.shard)) + 1, [len(p.shard)]])
                rows: dict[str, list] = {k: [] for k in ("shard", "batch", "contexts", "tops", "wide", "totals", "sizes", "low", "high", "n")}
                for a, z in zip(cut[:-1], cut[1:]):
                    h = p.h[a:z]
                    start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                    f, c = p.fingerprint[a:z], p.c[a:z][start]
                    wide = np.flatnonzero(c > SPREAD)
                    values = (int(p.shard[a]), row["batch"], _pack(h[start].astype(np.uint32)), _pack((h[start] >> _U(32)).astype(np.uint16)), _pack(wide.astype(np.int32)), _pack(c[wide]), _pack(np.diff(np.append(start, z - a)).astype(np.int32)),
                              _pack(f.astype(np.uint32)), _pack((f >> _U(32)).astype(np.uint8)), _pack(p.n[a:z].astype(np.int32)))
                    for k, v in zip(rows, values):
                        rows[k].append(v)
                yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64() if k in ("shard", "batch") else pa.binary()) for k, v in rows.items()})

    return batches.mapInArrow(run, "shard long, batch long, contexts binary, tops binary, wide binary, totals binary, sizes binary, low binary, high binary, n binary")


def answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """One shard: build the trie from all batches' training pairs, look up every batch's pairs."""
    opened, wide = [], []
    for r in pdf.itertuples(index=False):
        size = np.frombuffer(r.sizes, np.int32)
        f = np.frombuffer(r.low, np.uint32).astype(np.uint64) | (np.frombuffer(r.high, np.uint8).astype(np.uint64) << _U(32))
        h = np.frombuffer(r.contexts, np.uint32).astype(np.uint64) | (np.frombuffer(r.tops, np.uint16).astype(np.uint64) << _U(32))
        wide.append((h[np.frombuffer(r.wide, np.int32)], np.frombuffer(r.totals, np.int64)))
        opened.append((np.repeat(h, size), f, np.frombuffer(r.n, np.int32)))
    learned = [tuple(x[o[2] > 0] for x in o) for o in opened]
    h, f, n = (np.concatenate(x) for x in zip(*learned))
    order = np.lexsort((f, h))
    h, f, n = h[order], f[order], n[order].astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (f[1:] != f[:-1])])) if len(h) else np.zeros(0, np.int64)
    total = np.add.reduceat(n, new) if len(h) else n
    h, f = h[new], f[new]
    contexts, first, size = np.unique(h, return_index=True, return_counts=True)
    c = np.add.reduceat(total, first) if len(h) else total
    divided, at = np.unique(np.concatenate([x for x, _ in wide]), return_index=True)
    here = np.isin(divided, contexts)
    c[np.searchsorted(contexts, divided[here])] = np.concatenate([x for _, x in wide])[at[here]]
    trie = Trie(Trie.build(h, f, total / (np.repeat(c, size).astype(float) + KAPPA)))
    codes = [_pack(trie.find(o[0], o[1])) for o in opened]
    return pd.DataFrame({"batch": pdf["batch"], "shard": pdf["shard"], "codes": codes, "low": trie.low, "step": trie.step})


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    kind = dict(docs.dtypes)["doc_id"]
    batches = scratch.write(tokenised(docs), "batches", "zstd")
    words = word_rows(batches)
    with rows_per_batch(spark, 1):
        counts = scratch.write(words.groupBy("h").agg(F.sum("n").alias("c")), "counts")
    scratch.settle()
    size = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    n_train, n_words = int(size.n), int(size.v)
    by_batch = words.join(counts, "h").groupBy("batch").agg(F.collect_list(F.struct("word", "c")).alias("found"))  # one for each word of the batch

    def dense(source):
        for b in source:
            out = []
            for found in b.column(1):
                word, c = found.values.field(0).to_numpy(), found.values.field(1).to_numpy()
                flat = np.zeros(len(word), np.int64)
                flat[word] = c
                out.append(_pack(flat))
            yield pa.RecordBatch.from_pydict({"batch": b.column(0), "counts": pa.array(out, pa.binary())})

    with rows_per_batch(spark, 1):
        by_batch = scratch.write(by_batch.mapInArrow(dense, "batch long, counts binary"), "by_batch", "zstd")
    scratch.drop("counts")
    scratch.settle()
    counted = scratch.write(batches.join(by_batch.hint("merge"), "batch"), "counted", "zstd")
    scratch.drop("batches", "by_batch")
    scratch.settle()

    tokens = counted.agg(F.sum(F.octet_length("ids"))).first()[0] or 0
    shards = max(partitions(spark), -(-int(tokens) // 2 // SHARD_PAIRS))
    blobs = pair_blobs(counted, shards).groupBy("shard").applyInPandas(answer, "batch long, shard long, codes binary, low double, step double")
    with rows_per_batch(spark, 1):
        answers = scratch.write(blobs, "answers", "zstd")
    scratch.settle()
    told = answers.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("shard", "codes", "low", "step"))).alias("told"))  # at most one for each shard

    def add_up(source):
        bottom = n_train + n_words + 1
        for b in source:
            for row in b.to_pylist():
                p = Pairs(row, shards)
                base = np.log10((p.counts + 1) / bottom)
                r = np.concatenate([np.concatenate([[0.0], 10.0 ** (t["low"] + t["step"] * np.arange(LEVELS))])[np.frombuffer(t["codes"], np.uint8)] for t in row["told"]])
                pair = np.empty(len(r))
                pair[p.order] = r
                before = np.empty(len(r), np.int64)
                before[p.order] = p.c
                prob = pair[p.of] + KAPPA / (before[p.of] + KAPPA) * 10.0 ** base[p.ids]
                start = np.concatenate([[0], p.ends[:-1]])
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": pa.array(row["doc_ids"], b.schema.field("doc_ids").type.value_type), "held_out": pa.array(row["held"], pa.bool_()), "n_tokens": pa.array(np.diff(np.append(start, p.ends[-1]))),
                     "n_known": pa.array(np.add.reduceat((p.counts > 0)[p.ids].astype(np.int64), start)), "train_tokens": pa.array(np.full(len(start), n_train, np.int64)),
                     "base_score": pa.array(np.add.reduceat(base[p.ids], start)), "score": pa.array(np.add.reduceat(np.log10(prob), start))}
                )

    result = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    with rows_per_batch(spark, 1):
        scores = scratch.write(counted.join(told, "batch").mapInArrow(add_up, result), "scores")
    scratch.drop("counted", "answers")
    return scores


@query("op7_lm_scoring")
def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
