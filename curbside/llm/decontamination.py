"""Benchmark decontamination with spaced seeds.

Texts become tokens (runs of letters and digits, lower case), tokens become 64-bit hashes. A mask lists the token
positions of a window that count; the others are ignored, so a substituted token does not break a seed that
skips it. Both sides are hashed under each mask at every position and joined on the hash. Every hit fixes a
document, a benchmark item and a diagonal (the shift between them); along that diagonal the tokens are then
compared one by one, which settles the matter.

An item is leaked into a document when some window of WINDOW aligned tokens (the whole item if it is shorter)
has at most ALLOWED differing tokens, scaled down for shorter items. The masks find every such window: any two
positions of 13, or one of 9 to 12, leave a mask placement untouched (see the tests). Items of fewer than MIN_ITEM
tokens are found by their whole token sequence, even a single word. Letters of scripts without spaces are tokens one
by one, so an item in such a script is as many tokens as it has letters.

The seed table of the benchmark is counted first. Up to BROADCAST_SEEDS rows (24 bytes each) it is shipped to the
executors; beyond that the hashes meet in a shuffled join. Null and empty texts match nothing; very long texts are
hashed whole. Rows that share a doc_id, null included, count as one document with several texts; repeated benchmark
rows count once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import DOCUMENT_COLUMNS, Scratch, clean_ids, query, table

MASKS: tuple[tuple[int, ...], ...] = ((0, 1, 3, 4, 5, 6), (0, 1, 2, 3, 7, 8))
WINDOW, ALLOWED, MIN_ITEM = 13, 2, 9
BROADCAST_SEEDS = 1_000_000
SPLIT = r"[^\p{L}\p{N}]+"
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsMyanmar}\p{IsKhmer}]"


def _tokens(text: Column) -> Column:
    spaced = F.when(text.rlike(UNSPACED), F.regexp_replace(text, UNSPACED, " $0 ")).otherwise(text)
    return F.filter(F.split(F.lower(F.coalesce(spaced, F.lit(""))), SPLIT), lambda w: w != "")


def _hashes(text: Column) -> Column:
    return F.transform(_tokens(text), lambda w: F.xxhash64(w))


def _seeds(hashes: Column, mask: Sequence[int], number: int) -> Column:
    """One seed for each window start; none when the text is shorter than the mask."""
    last = F.size(hashes) - F.lit(mask[-1] + 1)
    keys = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.lit(number), *[F.get(hashes, i + F.lit(o)) for o in mask]))
    return F.when(last >= 0, keys).otherwise(F.array().cast("array<bigint>"))


def _seed_rows(df: DataFrame, key: str, masks: Sequence[Sequence[int]]) -> DataFrame:
    """(key, seed, start): every window of every text under every mask. Expects a column `h` of token hashes."""
    firsts = [F.greatest(F.size("h") - F.lit(m[-1]), F.lit(0)) for m in masks]
    df = df.select(key, firsts[0].alias("first"), F.posexplode(F.concat(*[_seeds(F.col("h"), m, i) for i, m in enumerate(masks)])).alias("at", "seed"))
    if len(masks) > 2:
        raise ValueError("two masks at most")
    return df.select(key, "seed", F.when(F.col("at") < F.col("first"), F.col("at")).otherwise(F.col("at") - F.col("first")).alias("start"))


def _needed(size: Column, window: int, allowed: int) -> Column:
    """Equal tokens that a window of `size` aligned tokens must hold."""
    return size - F.floor(size * F.lit(allowed) / F.lit(window)).cast("int")


def leaks(
    docs: DataFrame, benchmark: DataFrame, masks: Sequence[Sequence[int]] = MASKS, window: int = WINDOW, allowed: int = ALLOWED, broadcast_seeds: int = BROADCAST_SEEDS
) -> DataFrame:
    """doc_id, item_id, n_equal (tokens equal on the best diagonal) and n_best (most equal tokens in one window)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "leaks")
    docs = clean_ids(docs, "doc_id", "text")
    items = clean_ids(benchmark, "item_id", "text").distinct().select("item_id", _hashes(F.col("text")).alias("h")).where(F.size("h") >= MIN_ITEM)
    items = scratch.write(items, "items")
    item_seeds = scratch.write(_seed_rows(items, "item_id", masks).select("item_id", "seed", F.col("start").alias("item_start")), "seeds")
    n_seeds = item_seeds.count()
    if n_seeds <= broadcast_seeds:
        item_seeds = F.broadcast(item_seeds)
    hashed = docs.select("doc_id", _hashes(F.col("text")).alias("h"))
    hits = _seed_rows(hashed, "doc_id", masks).join(item_seeds, "seed")
    lines = hits.select("doc_id", "item_id", (F.col("start") - F.col("item_start")).alias("shift")).distinct()
    lines = scratch.write(lines, "lines")

    suspects = lines.select(F.col("doc_id").alias("d")).distinct()
    texts = docs.join(suspects, docs["doc_id"].eqNullSafe(suspects["d"]), "left_semi").select("doc_id", _hashes(F.col("text")).alias("h"))
    pairs = texts.join(lines.withColumnRenamed("doc_id", "d"), F.col("doc_id").eqNullSafe(F.col("d"))).drop("d")
    own = items.select(F.col("item_id").alias("i"), F.col("h").alias("item_h"))
    pairs = pairs.join(F.broadcast(own) if n_seeds <= broadcast_seeds else own, F.col("item_id").eqNullSafe(F.col("i"))).drop("i")
    first = F.greatest(F.lit(0), -F.col("shift"))
    stop = F.least(F.size("item_h"), F.size("h") - F.col("shift"))
    aligned = F.zip_with(
        F.slice("item_h", F.col("first") + 1, F.col("stop") - F.col("first")), F.slice("h", F.col("first") + F.col("shift") + 1, F.col("stop") - F.col("first")), lambda a, b: (a == b).cast("int")
    )
    width = F.least(F.lit(window), F.size("item_h"))
    pairs = pairs.select("doc_id", "item_id", "shift", "h", "item_h", first.alias("first"), stop.alias("stop")).where(F.col("stop") - F.col("first") >= width)
    pairs = pairs.select("doc_id", "item_id", aligned.alias("same"), width.alias("width"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.size("same") - F.col("width") + 1), lambda s: total(F.slice("same", s, F.col("width")))))
    pairs = pairs.select("doc_id", "item_id", total(F.col("same")).alias("n_equal"), best.alias("n_best"), "width")
    pairs = pairs.where(F.col("n_best") >= _needed(F.col("width"), window, allowed))
    return pairs.groupBy("doc_id", "item_id").agg(F.max("n_equal").cast("long").alias("n_equal"), F.max("n_best").cast("long").alias("n_best"))


def short_leaks(docs: DataFrame, benchmark: DataFrame, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """The columns of `leaks` for documents that hold all tokens of an item of fewer than MIN_ITEM, in order and side by side."""
    docs, benchmark = clean_ids(docs, "doc_id", "text"), clean_ids(benchmark, "item_id", "text")
    items = benchmark.select("item_id", _hashes(F.col("text")).alias("h")).where(F.size("h").between(1, MIN_ITEM - 1))
    items = items.select("item_id", F.size("h").alias("n"), F.xxhash64(F.size("h"), "h").alias("seed")).distinct()
    items = Scratch(docs.sparkSession, "short").write(items, "items")
    lengths = [r.n for r in items.select("n").distinct().collect()]  # MIN_ITEM - 1 at most
    if not lengths:
        return docs.limit(0).select("doc_id", *[F.lit(None).cast(t).alias(c) for c, t in (("item_id", dict(items.dtypes)["item_id"]), ("n_equal", "long"), ("n_best", "long"))])

    def windows(n: int) -> Column:
        last = F.size("h") - F.lit(n)
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.lit(n), F.slice("h", i + 1, n)))).otherwise(F.array().cast("array<bigint>"))

    seeds = docs.select("doc_id", _hashes(F.col("text")).alias("h")).select("doc_id", F.explode(F.array_distinct(F.concat(*[windows(n) for n in lengths]))).alias("seed"))
    hits = seeds.join(F.broadcast(items) if items.count() <= broadcast_seeds else items, "seed")
    return hits.select("doc_id", "item_id", F.col("n").cast("long").alias("n_equal"), F.col("n").cast("long").alias("n_best")).distinct()


def all_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The columns of `leaks` for items of every length."""
    return leaks(docs, benchmark).unionByName(short_leaks(docs, benchmark))


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents into which no benchmark item has leaked, however short it is."""
    docs, scratch = clean_ids(docs, *DOCUMENT_COLUMNS), Scratch(docs.sparkSession, "leaked")
    found = all_leaks(docs, benchmark)
    leaked = scratch.write(found.select(F.col("doc_id").alias("d")).distinct(), "ids")
    return docs.join(leaked, docs["doc_id"].eqNullSafe(leaked["d"]), "left_anti")


def _oracle() -> str:
    seeds = lambda key, rows: " UNION ALL ".join(
        f"SELECT {key}, {n} AS mask, i AS start, [{', '.join(f'w[i + {o + 1}]' for o in m)}] AS seed FROM (SELECT {key}, w, unnest(range(0, len(w) - {m[-1]})) AS i FROM {rows})" for n, m in enumerate(MASKS)
    )
    letters = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Myanmar}\p{Khmer}]"
    words = rf"list_filter(regexp_split_to_array(lower(regexp_replace(coalesce(text, ''), '{letters}', ' \0 ', 'g')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
    return rf"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents), b AS (SELECT item_id, w FROM (SELECT DISTINCT item_id, {words} AS w FROM benchmark) WHERE len(w) >= {MIN_ITEM}),
sh AS (SELECT item_id, w FROM (SELECT DISTINCT item_id, {words} AS w FROM benchmark) WHERE len(w) BETWEEN 1 AND {MIN_ITEM - 1}),
ds AS ({seeds('doc_id', 'd')}), bs AS ({seeds('item_id', 'b')}),
lines AS (SELECT DISTINCT doc_id, item_id, ds.start - bs.start AS shift FROM ds JOIN bs USING (mask, seed)),
al AS (SELECT doc_id, item_id, greatest(0, -shift) AS a, least(len(b.w), len(d.w) - shift) AS e, shift, d.w AS dw, b.w AS bw, least({WINDOW}, len(b.w)) AS width
 FROM lines JOIN d USING (doc_id) JOIN b USING (item_id)),
eq AS (SELECT doc_id, item_id, width, list_transform(range(a, e), lambda j: (bw[j + 1] = dw[j + shift + 1])::INT) AS same FROM al WHERE e - a >= width),
sc AS (SELECT doc_id, item_id, width, list_sum(same) AS n_equal, list_max(list_transform(range(1, len(same) - width + 2), lambda s: list_sum(same[s:s + width - 1]))) AS n_best FROM eq)
SELECT doc_id, item_id, max(n_equal)::BIGINT AS n_equal, max(n_best)::BIGINT AS n_best FROM sc WHERE n_best >= width - floor(width * {ALLOWED} / {WINDOW}) GROUP BY doc_id, item_id
UNION ALL SELECT DISTINCT doc_id, item_id, n, n FROM (SELECT doc_id, n, w[i:i + n - 1] AS part FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT len(w) AS n FROM sh)))
 JOIN (SELECT item_id, w, len(w) AS n FROM sh) USING (n) WHERE part = w"""


@query("op6_decontamination", _oracle())
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
