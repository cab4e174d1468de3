"""Join and set helpers with checked sizes and explicit null rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import null_safe_join
from .ranks import exact_quantiles

def any_left_join(left: DataFrame, right: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Left join with at most one match per left row: the right side keeps its first row by `order`."""
    others = [c for c in right.columns if c not in keys]
    one = right.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("__m"))
    return left.join(one.select(*keys, "__m.*"), list(keys), "left")


def exclude(df: DataFrame, keys: Sequence[str], exclusions: DataFrame) -> DataFrame:
    """Anti join (null-safe, unlike NOT IN)."""
    return df.join(exclusions.select(*keys).distinct(), list(keys), "left_anti")


def keep_listed(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Semi join with an id list that must be unique."""
    duplicated = ids.groupBy(key).count().filter("count > 1")
    if not duplicated.isEmpty():
        raise ValueError(f"id list repeats values of {key}")
    return df.join(ids.select(key), key, "left_semi")


def star_join(fact: DataFrame, dims: Sequence[tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Inner joins of a fact to its dimensions; unmatched fact rows drop."""
    for dim, keys in dims:
        fact = fact.join(dim, list(keys))
    return fact


def with_group_quantiles(df: DataFrame, keys: Sequence[str], quantiles: dict[str, tuple[str, float]]) -> DataFrame:
    """Joins exact group quantiles back to the rows: name -> (column, q)."""
    for name, (column, q) in quantiles.items():
        df = null_safe_join(df, exact_quantiles(df, keys, column, {name: q}), keys, "left")
    return df


def median_fill(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls replaced by the column's exact median."""
    for c in columns:
        med = exact_quantiles(df, [], c, {"m": 0.5}).select("m").scalar()
        df = df.withColumn(c, F.coalesce(F.col(c).cast("double"), med))
    return df


def min_max_scaled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    bounds = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    out = {}
    for c in columns:
        lo, hi = bounds.select(f"lo_{c}").scalar(), bounds.select(f"hi_{c}").scalar()
        out[c] = F.try_divide((F.col(c) - lo).cast("double"), (hi - lo).cast("double"))
    return df.withColumns(out)


def one_hot(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """0/1 columns named column=value."""
    return df.withColumns({f"{column}={v}": F.when(F.col(column) == F.lit(v), 1).otherwise(0) for v in values})


def share_of_total(df: DataFrame, keys: Sequence[str], measure: str, within: Sequence[str] = ()) -> DataFrame:
    """Sum of a measure per key and its share of the total (per `within`).

    Totals are an aggregate joined back, not a window, so a large group is not gathered in one task.
    """
    grouped = df.groupBy(*keys).agg(F.sum(measure).alias(measure))
    totals = df.groupBy(*within).agg(F.sum(measure).alias("__total"))
    joined = null_safe_join(grouped, totals, within) if within else grouped.withColumn("__total", totals.select("__total").scalar())
    share = F.try_divide(F.col(measure).cast("double"), F.col("__total").cast("double"))
    return joined.withColumn("share", share).drop("__total")


def main_category(df: DataFrame, keys: Sequence[str], category: str) -> DataFrame:
    """Most frequent category per key; ties go to the smaller name."""
    counts = df.groupBy(*keys, category).agg(F.count(F.lit(1)).alias("__n"))
    best = F.min_by(category, F.struct(-F.col("__n"), F.col(category)))
    return counts.groupBy(*keys).agg(best.alias(category), F.max("__n").alias("trips"))


def overlap_counts(df: DataFrame, flags: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Disjoint counts of every non-empty combination of boolean flags: only_a, a_b, a_b_c, ..."""
    aggs = []
    for mask in range(1, 1 << len(flags)):
        on = [f for i, f in enumerate(flags) if mask >> i & 1]
        cond = F.lit(True)
        for f in flags:
            cond = cond & (F.col(f) if f in on else ~F.col(f))
        aggs.append(F.count_if(cond).alias("_".join(on) if len(on) > 1 else f"only_{on[0]}"))
    return df.groupBy(*keys).agg(*aggs)


def zero_filled_hours(df: DataFrame, ts: str, hours: Sequence[int] | None = None) -> DataFrame:
    """Row count per hour of day, with zeros; optionally only the selected hours."""
    counts = df.groupBy(F.hour(ts).alias("hour")).agg(F.count(F.lit(1)).alias("rides"))
    grid = df.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    if hours is not None:
        grid = grid.filter(F.col("hour").isin(list(hours)))
    return grid.join(counts, "hour", "left").select("hour", F.coalesce("rides", F.lit(0)).alias("rides"))


def ordered_by_map(df: DataFrame, column: str, order: dict[str, int]) -> DataFrame:
    rank = F.element_at(F.create_map(*[F.lit(v) for kv in order.items() for v in kv]), F.col(column))
    return df.withColumn("sort_rank", rank).orderBy(F.asc_nulls_last("sort_rank"), column)


def renumbered_by_mean(df: DataFrame, keys: Sequence[str], cluster: str, target: str, ascending: bool = True) -> DataFrame:
    """Cluster ids replaced by the rank (from 0) of the cluster's mean target."""
    means = df.groupBy(*keys, cluster).agg(F.avg(target).alias("__m"))
    order = F.col("__m").asc() if ascending else F.col("__m").desc()
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(order, cluster)
    ranks = means.select(*keys, cluster, (F.row_number().over(w) - 1).alias("__new"))
    return null_safe_join(df, ranks, [*keys, cluster]).drop(cluster).withColumnRenamed("__new", cluster)


def hash_half(column: Column) -> Column:
    return F.pmod(column, F.lit(2))
