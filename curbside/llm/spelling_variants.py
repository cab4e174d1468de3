"""Spelling variants: words one edit apart, each with the most frequent of its near words as form.

Words: runs of Latin letters of at least MIN_LENGTH code points with at least MIN_COUNT occurrences. Runs are counted
where they stand (one crc32 decides by document and run whether a code point is left out, as in the query's contract),
each task sends a distinct word once per COMBINE words.

Search: if two words differ by one edit, they share the first half of the one that asks or the last half. So the
vocabulary is sorted twice, by the words and by the reversed words, and only the range of words that share the asked
half can hold near ones. Within it the edit matrix is filled in a band of three diagonals, one row for each range of
adjacent words with a common prefix (the intervals of the adjacent longest common prefixes): words that follow each
other reuse the rows of their common prefix, and a range ends as soon as all of its row exceeds one edit. All words of
a shard walk together, a letter a step.

Scale: both lists are cut by range into shards of about SHARD words. A word is asked in its own shard and in those
others of the list that its range touches, unless the band row over such a shard's common prefix already exceeds one
edit. A shard answers with one row for each word: number of near words and the best of them. Forms are followed to
their roots by doubling, at most as often as the logarithm of their length, which the tenfold step in counts bounds.

Null and empty texts have no words, a null id counts as an empty one, repeated rows count again, ties go to the
smaller word in code-point order, very long texts and words are whole. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import Scratch, clean_ids, query, table

MIN_LENGTH, MIN_COUNT = 7, 2
LEAD = 10  # a form has this many times the occurrences
DROP_EACH = 31
COMBINE = 200_000  # distinct words a task counts before it sends them on
SHARD, MAX_SHARDS = 20_000, 4096  # words of a shard; shards at most, whose bounds go to every task
BOUND = 64  # code points of a shard's first and last word that are sent
ASKED = 5_000  # words that walk together

_RUN = re.compile(rb"[a-z\xc0-\xff]{%d,}" % MIN_LENGTH)


# --- words ------------------------------------------------------------------

def runs(doc_id, text: str) -> Counter:
    """Occurrences of the document's words, of at least MIN_LENGTH code points, as Latin-1 bytes; one code point may be left out."""
    found = Counter(_RUN.findall(text.encode("latin-1", "replace").lower()))  # bytes lower only A-Z; other letters turn to ?
    head = b"" if doc_id is None else str(doc_id).encode()
    out: Counter = Counter()
    for word, n in found.items():
        h = zlib.crc32(head + b":" + (word if word.isascii() else word.decode("latin-1").encode()))
        if h % DROP_EACH == 0:
            k = h % len(word)
            word = word[:k] + word[k + 1 :]
            if len(word) < MIN_LENGTH:
                continue
        out[word] += n
    return out


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n of every word with at least MIN_COUNT occurrences."""

    def sent(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"word": pa.array([w.decode("latin-1") for w in counts], pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for word, n in runs(i, text or "").items():
                    counts[word] += n
                if len(counts) >= COMBINE:
                    yield sent(counts)
                    counts = Counter()
        yield sent(counts)

    counted = clean_ids(docs, "doc_id", "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


# --- one shard --------------------------------------------------------------

def half(length):
    """Code points that a near word shares at the start, else at least as many at the end."""
    return (length - 1) // 2


def after(prefix: bytes) -> bytes | None:
    """The first key behind all that begin with `prefix`; None: there is none."""
    cut = prefix.rstrip(b"\xff")
    return cut[:-1] + bytes([cut[-1] + 1]) if cut else None


class Letters:
    """Words as one buffer of bytes."""

    def __init__(self, words: list[bytes]):
        self.length = np.array([len(w) for w in words], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.length)])
        self.bytes = np.frombuffer(b"".join(words) + b"\0", np.uint8).astype(np.int16)

    def get(self, word: np.ndarray, k) -> np.ndarray:
        """The k-th letter of each word; -1 outside of it."""
        inside = (k >= 0) & (k < self.length[word])
        return np.where(inside, self.bytes[np.where(inside, self.at[word] + k, 0)], -1)


def common_prefixes(words: list[bytes]) -> np.ndarray:
    """Length of the prefix that each word shares with the one before; -1 for the first."""
    out = np.full(len(words), -1, np.int64)
    for i in range(1, len(words)):
        a, b = words[i - 1], words[i]
        n, k = min(len(a), len(b)), 0
        while k < n and a[k] == b[k]:
            k += 1
        out[i] = k
    return out


def band(before: tuple, left: np.ndarray, here: np.ndarray, right: np.ndarray, depth: int, length: np.ndarray) -> tuple:
    """Row depth + 1 of the edit matrix at columns depth, depth + 1, depth + 2, given row depth at depth - 1, depth, depth + 1.

    left, here, right: whether the new letter differs from the asked word's letters depth - 1, depth, depth + 1.
    Values over 1 need not be exact.
    """
    low, mid, high = before
    new_low = np.minimum(mid + 1, low + left)
    new_mid = np.minimum(np.minimum(mid + here, high + 1), new_low + 1)
    new_high = np.where(depth + 2 <= length, np.minimum(high + right, new_mid + 1), 2)
    return new_low, np.where(depth + 1 <= length, new_mid, 2), new_high


def near_words(words: list[bytes], asked: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(asked, word) numbers of all pairs one edit apart that share the asked word's first half; `words` is sorted."""
    stock, shared, ask = Letters(words), common_prefixes(words), Letters(asked)
    start = half(ask.length)
    first, last = [], []
    for w, n in zip(asked, start.tolist()):
        first.append(bisect_left(words, w[:n]))
        end = after(w[:n])
        last.append(len(words) if end is None else bisect_left(words, end))
    first, last = np.array(first, np.int64), np.array(last, np.int64)
    waiting = np.flatnonzero(last > first)
    waiting = waiting[np.argsort(start[waiting], kind="stable")]
    depths = start[waiting]

    found_asked, found_word = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    who = lo = hi = np.zeros(0, np.int64)
    row = (np.zeros(0, np.int8),) * 3
    depth, came = 0, 0
    while came < len(waiting) or len(who):
        if not len(who):
            depth = int(depths[came])
        until = int(np.searchsorted(depths, depth, "right"))  # those whose first half ends here begin
        if until > came:
            new = waiting[came:until]
            came = until
            who, lo, hi = np.concatenate([who, new]), np.concatenate([lo, first[new]]), np.concatenate([hi, last[new]])
            row = tuple(np.concatenate([r, np.full(len(new), v, np.int8)]) for r, v in zip(row, (1, 0, 1)))
        ends = stock.length[lo] == depth  # the range's first word is no longer than the prefix
        gap = ask.length[who] - depth
        last_value = np.where(gap == -1, row[0], np.where(gap == 0, row[1], np.where(gap == 1, row[2], 2)))
        hit = ends & (last_value == 1)
        found_asked.append(who[hit])
        found_word.append(lo[hit])
        lo = lo + ends
        begins = np.flatnonzero(shared <= depth)  # where a range with a longer common prefix begins
        a, b = np.searchsorted(begins, lo), np.searchsorted(begins, hi)
        n = b - a
        of = np.repeat(np.arange(len(who)), n)
        k = np.repeat(a, n) + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        next_lo = begins[k]
        next_hi = np.append(begins, len(words))[k + 1]
        who = who[of]
        letter = stock.get(next_lo, depth)
        row = band(tuple(r[of] for r in row), letter != ask.get(who, depth - 1), letter != ask.get(who, depth), letter != ask.get(who, depth + 1), depth, ask.length[who])
        keep = np.minimum(np.minimum(row[0], row[1]), row[2]) <= 1  # the rest exceeds one edit whatever follows
        who, lo, hi, row = who[keep], next_lo[keep], next_hi[keep], tuple(r[keep].astype(np.int8) for r in row)
        depth += 1
    return np.concatenate(found_asked), np.concatenate(found_word)


def far_from(prefix: bytes, word: bytes) -> bool:
    """Whether every word that begins with `prefix` is more than one edit from `word`; they share the word's first half."""
    one, depth = Letters([word]), half(len(word))
    who, length, row = np.zeros(1, np.int64), one.length, (np.array([1]), np.array([0]), np.array([1]))
    for c in prefix[depth:]:
        row = band(row, c != one.get(who, depth - 1), c != one.get(who, depth), c != one.get(who, depth + 1), depth, length)
        depth += 1
        if min(r[0] for r in row) > 1:
            return True
    return False


def same_half(words: list[bytes], asked: list[bytes], a: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Whether the pairs, given reversed, share the first half of the asked word: the other list has those."""
    stock, ask = Letters([x[::-1] for x in words]), Letters([x[::-1] for x in asked])
    out, left, k = np.zeros(len(a), bool), np.arange(len(a)), 0
    need = half(ask.length[a])
    while len(left):
        out[left[need[left] <= k]] = True
        left = left[need[left] > k]
        left = left[stock.get(w[left], k) == ask.get(a[left], k)]
        k += 1
    return out


# --- both lists -------------------------------------------------------------

def best_near(words: DataFrame, scratch: Scratch) -> DataFrame:
    """word, n, n_near, best_n, best: every word of (word, n) with its number of near words and the most frequent of them."""
    spark = words.sparkSession
    shards = int(min(MAX_SHARDS, max(1, -(-2 * words.count() // SHARD))))
    both = words.select(F.lit(0).alias("side"), F.col("word").alias("key"), "n").union(words.select(F.lit(1), F.reverse("word"), "n"))
    both = both.repartitionByRange(shards, "side", "key").withColumn("shard", F.spark_partition_id())
    both = scratch.write(both.withColumn("shard", F.col("shard") * 2 + F.col("side")), "lists")  # a shard lies in one list
    ends = both.groupBy("side", "shard").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    bounds = [ends.where(F.col("side") == s).select("shard", F.substring("low", 1, BOUND), F.substring("high", 1, BOUND)).collect() for s in (0, 1)]  # at most MAX_SHARDS and one
    bounds = [sorted((low.encode("latin-1"), high.encode("latin-1"), shard) for shard, low, high in b) for b in bounds]

    def guests(batches):
        lows, highs = ([[x[k] for x in b] for b in bounds] for k in (0, 1))
        for batch in batches:
            rows = []
            for side, key, n, shard in zip(*(c.to_pylist() for c in batch.columns)):
                word = key.encode("latin-1")
                prefix = word[: half(len(word))][:BOUND]
                end = after(prefix)
                first = bisect_left(highs[side], prefix)
                last = len(lows[side]) if end is None else bisect_left(lows[side], end)
                for low, high, other in bounds[side][first:last] if last - first > 1 else ():
                    if other != shard:
                        common = low[: next((k for k, (x, y) in enumerate(zip(low, high)) if x != y), min(len(low), len(high)))]
                        if not (common.startswith(prefix) and len(prefix) < BOUND and far_from(common, word)):
                            rows.append((key, n, other))
            yield pa.RecordBatch.from_pydict({"word": pa.array([r[0] for r in rows], pa.string()), "own": pa.array([r[1] for r in rows], pa.int64()), "at": pa.array([r[2] for r in rows], pa.int32())})

    asked = both.select("side", "key", "n", "shard").mapInArrow(guests, "word string, own long, at int")

    def answer(key, left: pa.Table, right: pa.Table) -> pa.Table:
        stock = sorted(zip((k.encode("latin-1") for k in left.column("key").to_pylist()), left.column("n").to_pylist()))
        words, counts = [w for w, _ in stock], np.array([n for _, n in stock], np.int64)
        visits = sorted(zip((k.encode("latin-1") for k in right.column("word").to_pylist()), right.column("own").to_pylist()))
        backwards = left.num_rows > 0 and left.column("side")[0].as_py() == 1
        turned = [w[::-1] for w in words] if backwards else words
        rank = np.empty(len(words), np.int64)
        rank[sorted(range(len(words)), key=turned.__getitem__)] = np.arange(len(words))
        out: dict[str, list] = {c: [] for c in ("word", "n", "n_near", "best_n", "best")}
        for source, own in ((stock, True), (visits, False)):
            for s in range(0, len(source), ASKED):
                some = [w for w, _ in source[s : s + ASKED]]
                a, w = near_words(words, some)
                if backwards:
                    new = ~same_half(words, some, a, w)
                    a, w = a[new], w[new]
                order = np.lexsort((rank[w], -counts[w], a))
                a, w = a[order], w[order]
                n_near = np.bincount(a, minlength=len(some))
                best = np.full(len(some), -1)
                lead = np.flatnonzero(np.diff(a, prepend=-1))
                best[a[lead]] = w[lead]
                for (x, n), near, b in zip(source[s : s + ASKED], n_near.tolist(), best.tolist()):
                    if own or near:
                        out["word"].append((x[::-1] if backwards else x).decode("latin-1"))
                        out["n"].append(n)
                        out["n_near"].append(near)
                        out["best_n"].append(int(counts[b]) if b >= 0 else None)
                        out["best"].append(turned[b].decode("latin-1") if b >= 0 else None)
        return pa.table({c: pa.array(x, pa.string() if c in ("word", "best") else pa.int64()) for c, x in out.items()})

    parts = both.groupBy("shard").cogroup(asked.groupBy("at")).applyInArrow(answer, "word string, n long, n_near long, best_n long, best string")
    first = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("less"), "best"))).alias("top")
    found = parts.groupBy("word").agg(F.first("n").alias("n"), F.sum("n_near").alias("n_near"), first)
    return found.select("word", "n", "n_near", (-F.col("top.less")).alias("best_n"), F.col("top.best").alias("best"))


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """word, root for the rows of (word, form): the last word on the way over forms."""
    now = scratch.write(forms.select("word", F.col("form").alias("root")), "roots-0")
    k = 0
    while True:
        k += 1
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = scratch.write(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), f"roots-{k}")
        now = step.drop("moved")
        if step.where("moved").isEmpty():
            return now
        scratch.drop(f"roots-{k - 1}")


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the texts."""
    scratch = Scratch(docs.sparkSession, "variants")
    words = scratch.write(word_counts(docs), "words")
    near = best_near(words, scratch)
    chosen = F.col("best_n") >= LEAD * F.col("n")
    near = scratch.write(near.select("word", "n", "n_near", F.when(chosen, F.col("best")).alias("form"), F.when(chosen, F.col("best_n")).alias("form_n")), "near")
    found = roots(near.where(F.col("form").isNotNull()), scratch)
    return near.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


@query("op13_spelling_variants")
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))
