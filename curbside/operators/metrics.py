"""Metric registry: metrics as data, compiled to one pass over the facts.

A metric names a numerator, a denominator and a weight, each an aggregate of
one column under predicates. All metrics of an experiment are compiled
together: each entity column that is counted distinctly contributes one
(keys, entity) group that carries a bit mask of satisfied predicates, so any
number of conditional distinct counts costs one shuffle with map-side combine.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import dtype_of, null_safe_join
from ..functions.hashing import user_bucket
from ..functions.scalars import all_of, lift
from .ranks import exact_quantiles

INTEGRAL = {"tinyint", "smallint", "int", "bigint"}
MASK_BITS = 60
ADDITIVE = ("sum", "sum_hours", "count", "mean", "max", "min")


@dataclass(frozen=True)
class Agg:
    """Aggregate `fn` of `column` over rows that satisfy every predicate in `where`."""

    column: str
    fn: str = "sum"
    where: tuple[str, ...] = ()

    def narrowed(self, extra: Sequence[str]) -> Agg:
        return Agg(self.column, self.fn, tuple(extra) + self.where)


@dataclass(frozen=True)
class Metric:
    name: str
    x: Agg
    y: Agg
    n: Agg
    where: tuple[str, ...] = ()
    estimator: str = "t_test_ratio"
    split_col: str | None = None

    def parts(self) -> dict[str, Agg]:
        return {k: getattr(self, k).narrowed(self.where) for k in ("x", "y", "n")}


@dataclass(frozen=True)
class ExperimentSpec:
    split_col: str
    user_col: str
    metrics: tuple[Metric, ...]
    totals: dict[str, Agg] = field(default_factory=dict)
    confidence: float = 0.95
    buckets: int = 1000
    small_buckets: int = 500
    small_rows: int = 1000


def aggregate(df: DataFrame, keys: Sequence[str], aggs: dict[str, Agg]) -> DataFrame:
    """All aggregates per key in one pass (exact medians join a rank pass of their own)."""
    keys = list(keys)
    unique: dict[Agg, str] = {}
    for agg in aggs.values():
        unique.setdefault(agg, f"__a{len(unique)}")
    medians = {a: n for a, n in unique.items() if a.fn == "median"}
    plain = {a: n for a, n in unique.items() if a.fn in ADDITIVE}
    distinct = {a: n for a, n in unique.items() if a.fn == "nunique"}
    unknown = [a.fn for a in unique if a.fn not in (*ADDITIVE, "median", "nunique")]
    if unknown:
        raise ValueError(f"unknown aggregate: {unknown[0]}")

    out = _distinct_pass(df, keys, distinct, plain) if distinct else _plain_pass(df, keys, plain, bool(medians))
    for agg, name in medians.items():
        med = exact_quantiles(df.filter(all_of(agg.where)), keys, agg.column, {name: 0.5})
        out = null_safe_join(out, med, keys, "left")
    return out.select(*keys, *[F.col(unique[a]).alias(n) for n, a in aggs.items()])


def _row_value(agg: Agg) -> Column:
    value = F.lit(1) if agg.column == "*" else F.col(agg.column)
    if agg.fn == "count":
        return F.when(all_of(agg.where) & value.isNotNull(), 1)
    return F.when(all_of(agg.where), value)


def _plain_pass(df, keys, plain, keep_keys):
    exprs = []
    for agg, name in plain.items():
        v = _row_value(agg)
        exprs.append(
            {
                "sum": lambda v: F.coalesce(F.sum(v), F.lit(0)),
                "sum_hours": lambda v: F.coalesce(F.sum(v), F.lit(0)) / 3600.0,
                "count": F.count, "mean": F.avg, "max": F.max, "min": F.min,
            }[agg.fn](v).alias(name)
        )
    if not exprs:
        exprs = [F.count(F.lit(1)).alias("__rows")]
    return df.groupBy(*keys).agg(*exprs)


def _distinct_pass(df, keys, distinct, plain):
    groups: list[tuple[str, list[tuple[Agg, str]]]] = []
    for agg, name in distinct.items():
        for column, members in groups:
            if column == agg.column and len(members) < MASK_BITS:
                members.append((agg, name))
                break
        else:
            groups.append((agg.column, [(agg, name)]))
    integral = all(dtype_of(df, column) in INTEGRAL for column, _ in groups)
    kind = "bigint" if integral else "string"

    entries = []
    for i, (column, members) in enumerate(groups):
        mask = F.lit(0).cast("bigint")
        for bit, (agg, _) in enumerate(members):
            mask = mask + F.when(all_of(agg.where), F.lit(1 << bit)).otherwise(F.lit(0)).cast("bigint")
        entries.append(
            F.struct(F.lit(i).alias("kind"), F.col(column).cast(kind).alias("id"), mask.alias("mask"))
        )
    carried = {name: _row_value(agg).alias(name) for agg, name in plain.items()}
    wide = df.select(*keys, *carried.values(), F.explode(F.array(*entries)).alias("__e"))
    first = F.col("__e.kind") == 0
    stage1 = [F.bit_or("__e.mask").alias("__mask")]
    stage2 = []
    for agg, name in plain.items():
        v = F.when(first, F.col(name))
        if agg.fn == "mean":
            stage1 += [F.sum(v).alias(name), F.count(v).alias(f"{name}__n")]
            stage2.append(F.try_divide(F.sum(name).cast("double"), F.sum(f"{name}__n").cast("double")).alias(name))
        elif agg.fn in ("max", "min"):
            f = getattr(F, agg.fn)
            stage1.append(f(v).alias(name))
            stage2.append(f(name).alias(name))
        else:
            stage1.append((F.count(v) if agg.fn == "count" else F.sum(v)).alias(name))
            total = F.coalesce(F.sum(name), F.lit(0))
            stage2.append((total / 3600.0 if agg.fn == "sum_hours" else total).alias(name))
    entity = (
        wide.filter(first | (F.col("__e.id").isNotNull() & (F.col("__e.mask") != 0)))
        .groupBy(*keys, F.col("__e.kind").alias("__kind"), F.col("__e.id").alias("__id"))
        .agg(*stage1)
    )
    for i, (_, members) in enumerate(groups):
        here = (F.col("__kind") == i) & F.col("__id").isNotNull()
        for bit, (_, name) in enumerate(members):
            hit = here & (F.col("__mask").bitwiseAND(F.lit(1 << bit)) != 0)
            stage2.append(F.count(F.when(hit, 1)).alias(name))
    return entity.groupBy(*keys).agg(*stage2)


def _limit(rows: Column, cap: int, small_cap: int, small_rows: int) -> Column:
    """min(rows // 2, cap), with the smaller cap under the row threshold; at least one bucket."""
    half = F.floor(rows / 2)
    limit = F.when(rows < small_rows, F.least(half, F.lit(small_cap))).otherwise(F.least(half, F.lit(cap)))
    return F.greatest(limit, F.lit(1)).cast("bigint")


def bucket_limit(df: DataFrame, cap: int, small_cap: int, small_rows: int) -> Column:
    """The bucket count of a whole frame."""
    n = df.agg(F.count(F.lit(1)).alias("n"))
    return n.select(_limit(F.col("n"), cap, small_cap, small_rows)).scalar()


def with_bucket_limit(df: DataFrame, cap: int, small_cap: int, small_rows: int, keys: Sequence[str] = ()) -> DataFrame:
    """Adds `__limit`, the bucket count of the row's own key (experiment)."""
    if not keys:
        return df.withColumn("__limit", bucket_limit(df, cap, small_cap, small_rows))
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    return null_safe_join(df, n.select(*keys, _limit(F.col("__n"), cap, small_cap, small_rows).alias("__limit")), keys)


def metric_rows(
    df: DataFrame, split_col: str, unit: Column, metrics: Sequence[Metric], keys: Sequence[str] = ()
) -> DataFrame:
    """Long frame (keys, split, unit, metric, x, y, n): one row per unit (bucket or user) and metric."""
    aggs = {f"{m.name}__{p}": a for m in metrics for p, a in m.parts().items()}
    wide = aggregate(df.withColumn("unit", unit), [*keys, split_col, "unit"], aggs)
    long = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(m.name).alias("metric"),
                    *[F.col(f"{m.name}__{p}").cast("double").alias(p) for p in ("x", "y", "n")],
                )
                for m in metrics
            ]
        )
    )
    return (
        wide.select(*keys, F.col(split_col).alias("split"), "unit", long.alias("m"))
        .select(*keys, "split", "unit", "m.*")
        .filter(F.col("n") > 0)  # a unit with no row after the metric's own filter is not an observation
    )


def bucket_rows(df: DataFrame, spec: ExperimentSpec, n_buckets=None, keys: Sequence[str] = ()) -> DataFrame:
    """Metric rows per user bucket; users are spread over buckets by hash."""
    if n_buckets is None:
        df = with_bucket_limit(df, spec.buckets, spec.small_buckets, spec.small_rows, keys)
    limit = F.col("__limit") if n_buckets is None else n_buckets
    out = None
    for split_col in dict.fromkeys(m.split_col or spec.split_col for m in spec.metrics):
        chosen = [m for m in spec.metrics if (m.split_col or spec.split_col) == split_col]
        part = metric_rows(
            df.filter(F.col(split_col).isNotNull()), split_col, user_bucket(F.col(spec.user_col), limit), chosen, keys
        ).withColumn("split", F.col("split").cast("string"))
        out = part if out is None else out.unionByName(part)
    return out


def totals(df: DataFrame, spec: ExperimentSpec, keys: Sequence[str] = ()) -> DataFrame:
    """Secondary metrics and x/y ratios per split, one row each. A zero or null denominator gives 0."""
    own = [m for m in spec.metrics if (m.split_col or spec.split_col) == spec.split_col]
    aggs = dict(spec.totals)
    for m in own:
        parts = m.parts()
        aggs[f"__{m.name}_x"], aggs[f"__{m.name}_y"] = parts["x"], parts["y"]
    wide = aggregate(df.filter(F.col(spec.split_col).isNotNull()), [*keys, spec.split_col], aggs)
    ratios = [
        F.coalesce(
            F.try_divide(F.col(f"__{m.name}_x").cast("double"), F.col(f"__{m.name}_y").cast("double")), F.lit(0.0)
        ).alias(m.name)
        for m in own
    ]
    return wide.select(*keys, F.col(spec.split_col).alias("split"), *spec.totals, *ratios)


def pairs_with_lift(total: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Totals melted to (split pair, metric, split_0, split_1, lift) for every pair of splits."""
    names = [c for c in total.columns if c not in (*keys, "split")]
    long = total.select(
        *keys, F.col("split"), *[F.col(n).cast("double").alias(n) for n in names]
    ).unpivot([*keys, "split"], names, "metric", "value")
    left = long.withColumnsRenamed({"split": "s0", "value": "split_0"})
    right = long.withColumnsRenamed({"split": "s1", "value": "split_1"})
    on = [*keys, "metric"]
    return (
        left.join(right, on)  # result-sized: splits x metrics rows on each side
        .filter(F.col("s0") < F.col("s1"))
        .select(
            *keys,
            F.concat_ws("_", F.col("s0").cast("string"), F.col("s1").cast("string")).alias("split_pair"),
            "metric", "split_0", "split_1", lift("split_0", "split_1").alias("lift"),
        )
    )


def split_pairs(df: DataFrame, split_col: str, keys: Sequence[str] = ()) -> DataFrame:
    """Every 2-combination of the non-null split values, in order."""
    values = df.filter(F.col(split_col).isNotNull()).select(*keys, split_col).distinct()
    a = values.withColumnRenamed(split_col, "split_0")
    b = values.withColumnRenamed(split_col, "split_1")
    cond = F.col("split_0") < F.col("split_1")
    joined = a.join(b, list(keys)).filter(cond) if keys else a.join(b, cond)
    return joined.select(*keys, "split_0", "split_1")
