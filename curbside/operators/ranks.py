"""Exact order statistics without sorting a group in one task.

Rows are first counted per distinct value (a partial aggregate). Values then
get a two-level bin, a monotone function of the value alone, and running
counts are taken bin by bin: over coarse bins, over fine bins of one coarse
bin, and over the distinct values of one fine bin. No window holds a whole
group, however many rows or distinct values one key has.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import null_safe_join, stable_checkpoint, sum_of

COARSE_PER_UNIT = 64      # coarse bins per unit of signed log(1 + |v|)
FINE_PER_COARSE = 65536


def _bins(v: Column) -> tuple[Column, Column]:
    scale = F.signum(v) * F.log1p(F.abs(v)) * COARSE_PER_UNIT
    coarse = F.floor(scale)
    return coarse, F.floor((scale - coarse) * FINE_PER_COARSE)


def cumulative_counts(
    df: DataFrame, keys: Sequence[str], value: str, measures: dict[str, Column]
) -> DataFrame:
    """Per distinct value: each measure, and `<measure>_before` = its sum over smaller values.

    `measures` are aggregate Columns that add up (sum, count). Null and NaN values are skipped.
    """
    keys = list(keys)
    names = list(measures)
    v = F.col(value).cast("double")
    distinct = (
        df.filter(v.isNotNull() & ~F.isnan(v))
        .groupBy(*keys, v.alias(value))
        .agg(*[m.alias(n) for n, m in measures.items()])
    )
    coarse, fine = _bins(F.col(value))
    distinct = distinct.withColumns({"__coarse": coarse, "__fine": fine})
    fine_sums = distinct.groupBy(*keys, "__coarse", "__fine").agg(
        *[F.sum(n).alias(f"__f_{n}") for n in names]
    )
    coarse_sums = fine_sums.groupBy(*keys, "__coarse").agg(*[F.sum(f"__f_{n}").alias(f"__c_{n}") for n in names])

    def before(frame, partition, order, pairs):
        w = Window.partitionBy(*partition) if partition else Window.partitionBy(F.lit(0))
        w = w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return frame.withColumns({dst: F.coalesce(F.sum(src).over(w), F.lit(0)) for src, dst in pairs})

    coarse_run = before(coarse_sums, keys, "__coarse", [(f"__c_{n}", f"__cb_{n}") for n in names])
    fine_run = before(fine_sums, [*keys, "__coarse"], "__fine", [(f"__f_{n}", f"__fb_{n}") for n in names])
    value_run = before(
        distinct, [*keys, "__coarse", "__fine"], value, [(n, f"__vb_{n}") for n in names]
    )
    offsets = null_safe_join(
        fine_run.select(*keys, "__coarse", "__fine", *[f"__fb_{n}" for n in names]),
        coarse_run.select(*keys, "__coarse", *[f"__cb_{n}" for n in names]),
        [*keys, "__coarse"],
    )
    joined = null_safe_join(value_run, offsets, [*keys, "__coarse", "__fine"])
    return joined.select(
        *keys, value, *names,
        *[
            sum_of([F.col(f"__vb_{n}"), F.col(f"__fb_{n}"), F.col(f"__cb_{n}")]).alias(f"{n}_before")
            for n in names
        ],
    )


def values_at_ranks(
    df: DataFrame, keys: Sequence[str], value: str, ranks: dict[str, Callable[[Column], Column]]
) -> DataFrame:
    """Per key and name: the value at a 0-based rank, and `<name>_before` = rows strictly below it.

    A rank is a function of the key's row count. The first pass only counts rows per bin, so the
    shuffle carries bins; the second pass keeps the rows of the few bins that hold a wanted rank.
    The wanted bins are written out, which tells the optimizer their size before it picks the join.
    """
    keys = list(keys)
    v = F.col(value).cast("double")
    coarse, fine = _bins(v)
    base = df.filter(v.isNotNull() & ~F.isnan(v)).select(
        *keys, v.alias("__v"), coarse.alias("__coarse"), fine.alias("__fine")
    )
    bins = base.groupBy(*keys, "__coarse", "__fine").agg(F.count(F.lit(1)).alias("__n"))
    blocks = bins.groupBy(*keys, "__coarse").agg(F.sum("__n").alias("__bn"))
    by_key = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    blocks = blocks.withColumns(
        {
            "__b0": F.coalesce(F.sum("__bn").over(by_key.orderBy("__coarse").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "__total": F.sum("__bn").over(by_key),
        }
    )
    wanted = F.explode(
        F.array(*[F.struct(F.lit(n).alias("name"), fn(F.col("__total")).cast("bigint").alias("rank")) for n, fn in ranks.items()])
    )
    hit = blocks.withColumn("__w", wanted).filter(
        (F.col("__b0") <= F.col("__w.rank")) & (F.col("__w.rank") < F.col("__b0") + F.col("__bn"))
    ).select(*keys, "__coarse", "__b0", "__total", "__w")
    inner = Window.partitionBy(*keys, "__coarse").orderBy("__fine").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("__f0", F.coalesce(F.sum("__n").over(inner), F.lit(0)))
    joined = null_safe_join(bins, hit, [*keys, "__coarse"])
    start = F.col("__b0") + F.col("__f0")
    targets = joined.filter((start <= F.col("__w.rank")) & (F.col("__w.rank") < start + F.col("__n"))).select(
        *keys, "__coarse", "__fine", F.col("__w.name").alias("__name"), F.col("__w.rank").alias("__rank"), start.alias("__start"), "__total"
    )
    targets = stable_checkpoint(targets)
    at = [*keys, "__coarse", "__fine"]
    values = (
        null_safe_join(base, targets.select(*at).distinct(), at)
        .groupBy(*at, "__v").agg(F.count(F.lit(1)).alias("__n"))
    )
    inside = Window.partitionBy(*at).orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    values = values.withColumn("__v0", F.coalesce(F.sum("__n").over(inside), F.lit(0)))
    below = F.col("__start") + F.col("__v0")
    found = null_safe_join(values, targets, at).filter((below <= F.col("__rank")) & (F.col("__rank") < below + F.col("__n")))
    aggs = []
    for n in ranks:
        mine = F.col("__name") == n
        aggs += [F.max(F.when(mine, F.col("__v"))).alias(n), F.max(F.when(mine, below)).alias(f"{n}_before")]
    return found.groupBy(*keys).agg(*aggs, F.max("__total").alias("rows"))


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, quantiles: dict[str, float]
) -> DataFrame:
    """Exact quantiles per key with linear interpolation, one column per name."""
    keys = list(keys)

    def position(q):
        return lambda total: F.lit(float(q)) * (total - 1)

    ranks = {}
    for name, q in quantiles.items():
        ranks[f"__lo_{name}"] = lambda total, p=position(q): F.floor(p(total))
        ranks[f"__hi_{name}"] = lambda total, p=position(q): F.ceil(p(total))
    out = values_at_ranks(df, keys, value, ranks)
    columns = []
    for name, q in quantiles.items():
        pos = position(q)(F.col("rows"))
        lo, hi = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        columns.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return out.select(*keys, *columns)


def exact_median(df: DataFrame, keys: Sequence[str], value: str, name: str = "median") -> DataFrame:
    return exact_quantiles(df, keys, value, {name: 0.5})


def percentile_of(column: str, n: float) -> Column:
    """Percentile aggregate for groups whose distinct values are known to be few."""
    return F.percentile(F.col(column), n / 100.0)


def roc_points(df: DataFrame, keys: Sequence[str], score: str, label: str) -> DataFrame:
    """True and false positive rates at each distinct score used as threshold (score >= threshold)."""
    y = F.col(label).cast("long")
    runs = cumulative_counts(df, keys, score, {"pos": F.sum(y), "neg": F.sum(1 - y)})
    totals = runs.groupBy(*keys).agg(F.sum("pos").alias("__p"), F.sum("neg").alias("__q"))
    runs = null_safe_join(runs, totals, list(keys))
    return runs.select(
        *keys, score, "pos", "neg", "pos_before", "neg_before",
        F.try_divide((F.col("__p") - F.col("pos_before")).cast("double"), F.col("__p").cast("double")).alias("tpr"),
        F.try_divide((F.col("__q") - F.col("neg_before")).cast("double"), F.col("__q").cast("double")).alias("fpr"),
        F.col("__p").alias("n_pos"), F.col("__q").alias("n_neg"),
    )


def optimal_threshold(df: DataFrame, keys: Sequence[str], score: str, label: str) -> DataFrame:
    """Score at which tpr is nearest to 1 - fpr (ties: the lower score)."""
    pts = roc_points(df, keys, score, label)
    gap = F.struct(F.round(F.abs(F.col("tpr") - (1 - F.col("fpr"))), 12), F.col(score))
    return pts.groupBy(*keys).agg(F.min_by(F.col(score), gap).alias("threshold"))


def auc(df: DataFrame, keys: Sequence[str], score: str, label: str) -> DataFrame:
    """Area under the ROC curve and gini, by the rank-sum identity with ties counted half."""
    pts = roc_points(df, keys, score, label)
    wins = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0))
    area = F.try_divide(wins.cast("double"), (F.max("n_pos") * F.max("n_neg")).cast("double"))
    return pts.groupBy(*keys).agg(area.alias("auc"), (2 * area - 1).alias("gini"))


def best_precision(df: DataFrame, keys: Sequence[str], score: str, label: str, min_recall: float = 0.7) -> DataFrame:
    """Best precision over thresholds whose recall is at least `min_recall`."""
    pts = roc_points(df, keys, score, label)
    tp = F.col("n_pos") - F.col("pos_before")
    fp = F.col("n_neg") - F.col("neg_before")
    precision = F.try_divide(tp.cast("double"), (tp + fp).cast("double"))
    return pts.groupBy(*keys).agg(F.max(F.when(F.col("tpr") >= min_recall, precision)).alias("best_precision"))


def row_ranks(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rank", total: str | None = None) -> DataFrame:
    """row_number() over (partition by keys order by order) without one task for each key; `total` adds the key's rows.

    Rows are dealt to tasks by range of (keys, order) and written; a row's rank is its place among its key's rows in its
    range plus the key's rows in earlier ranges. The order must tell all rows of a key apart.
    """
    keys = list(keys)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stable_checkpoint(df.repartitionByRange(n, *[F.col(k) for k in keys], *order).withColumn("__p", F.spark_partition_id()))
    sizes = dealt.groupBy(*keys, "__p").agg(F.count(F.lit(1)).alias("__c"))  # a row for each key of a range
    by_key = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("__c").over(by_key.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumns({"__before": before, "__total": F.sum("__c").over(by_key)}).drop("__c")
    inside = F.row_number().over(Window.partitionBy(*keys, "__p").orderBy(*order))
    out = null_safe_join(dealt.withColumn("__n", inside), sizes, [*keys, "__p"]).withColumn(name, F.col("__n") + F.col("__before"))
    out = out.withColumn(total, F.col("__total")) if total else out
    return out.drop("__p", "__n", "__before", "__total")
