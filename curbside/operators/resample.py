"""Resampling: Poisson bootstrap, exact subsamples, simulated false-positive rate and power.

Bootstrap replicates are made where the rows are: a task adds up the weighted units
of a group for all replicates at once and sends (group, replicate) sums, so the
shuffle carries groups x replicates rows per task. Simulated
samples are drawn as ranks (see `sampling`). Draws are a function of (seed,
unit, replicate) or (seed, group, sample, number of the draw).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pvalues as P
from ..functions.frames import dtype_of, null_safe_join, spread, stable_checkpoint
from ..functions.hashing import draw, draw_bits, draw_key
from .ranks import values_at_ranks
from .sampling import half_sums, sample_sums
from .tests import chi2_test, pair_up, proportion_test, ratio_t_test, ratio_z_test, welch_test
from .weighted_medians import replicate_medians, weights

BLOCK = 64  # units whose weights are made at once


def _draw(rows: DataFrame, seed: int, unit: str, rep: Column) -> Column:
    return draw(seed, draw_key(F.col(unit), dtype_of(rows, unit)), rep)


def replicate_sums(
    rows: DataFrame, unit: str, columns: Sequence[str], keys: Sequence[str], reps: int, seed: int
) -> DataFrame:
    """Poisson-weighted sums of `columns` and of the weight per (keys, split, rep).

    Rows are summed per unit first, so one unit keeps one weight in a replicate.
    """
    columns, grp = list(columns), [*keys, "split"]
    per_unit = rows.groupBy(*grp, unit).agg(
        F.count(F.lit(1)).cast("double").alias("__rows"), *[F.sum(F.col(c).cast("double")).alias(c) for c in columns]
    )
    bits = draw_bits(seed, draw_key(F.col(unit), dtype_of(rows, unit)))
    per_unit = stable_checkpoint(per_unit.select(*grp, bits.alias("__bits"), "__rows", *columns))
    known = per_unit.groupBy(*grp).agg(*[F.count(c).alias(f"__known_{c}") for c in columns])
    known = stable_checkpoint(known.withColumn("__g", F.monotonically_increasing_id()))  # a row for each group
    placed = null_safe_join(per_unit, known.select(*grp, "__g"), grp).select("__g", "__bits", "__rows", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in columns])

    def run(batches):
        at, total = None, None

        def sent():
            out = {"__g": np.full(reps, at, np.int64), "rep": np.arange(1, reps + 1, dtype=np.int32)} | {c: total[:, i] for i, c in enumerate(["w", *columns])}
            return pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in out.items()})

        for batch in batches:  # sorted by group
            g, own = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            m = np.stack([batch.column(i).to_numpy() for i in range(2, batch.num_columns)], 1)
            edges = [0, *(np.flatnonzero(np.diff(g)) + 1).tolist(), len(g)]
            for first, last in zip(edges, edges[1:]):
                if first == last:
                    continue
                if g[first] != at:
                    if at is not None:
                        yield sent()
                    at, total = int(g[first]), np.zeros((reps, 1 + len(columns)))
                for i in range(first, last, BLOCK):
                    j = min(i + BLOCK, last)
                    total += weights(own[i:j], reps).T @ m[i:j]
        if at is not None:
            yield sent()

    schema = "__g long, rep int, w double, " + ", ".join(f"`{c}` double" for c in columns)
    made = spread(placed, "__bits").sortWithinPartitions("__g").mapInArrow(run, schema)
    sums = made.groupBy("__g", "rep").agg(F.sum("w").cast("bigint").alias("w"), *[F.sum(c).alias(c) for c in columns])
    return sums.join(known, "__g").select(*grp, "rep", "w", *[F.when(F.col(f"__known_{c}") > 0, F.col(c)).alias(c) for c in columns])


def _replicate_deltas(stat: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, split_0, split_1, rep, d) from per-split replicate values in column `v`."""
    pairs = pair_up(stat, [*keys, "rep"])
    return pairs.select(*keys, "split_0", "split_1", "rep", (F.col("v_1") - F.col("v_0")).alias("d"))


def summarise_replicates(
    deltas: DataFrame, keys: Sequence[str], confidence: float, zero_rule: bool = False, original: DataFrame | None = None
) -> DataFrame:
    """p from the normal fit of replicates, quantile interval; optional shift to the observed delta.

    zero_rule: p becomes 1 when the interval holds 0.
    """
    grp = [*keys, "split_0", "split_1"]
    tail = (1 - confidence) / 2
    out = deltas.groupBy(*grp).agg(
        F.count("d").alias("reps"), F.avg("d").alias("boot_mean"), F.stddev_pop("d").alias("boot_sd"),
        F.percentile("d", F.lit(tail)).alias("lb"), F.percentile("d", F.lit(1 - tail)).alias("ub"),
        F.count_if(F.col("d") < 0).alias("negative"),
    )
    if original is not None:
        out = null_safe_join(out, original.select(*grp, "observed"), grp)
        shift = F.col("observed") - F.col("boot_mean")
        out = out.withColumns(
            {"lb": F.col("lb") + shift, "ub": F.col("ub") + shift, "boot_mean": F.col("observed")}
        ).drop("observed")
    out = out.withColumn("delta", F.col("boot_mean")).withColumn(
        "pvalue", P.normal_two_sided(F.try_divide(F.col("boot_mean"), F.col("boot_sd")))
    )
    if zero_rule:
        holds = (F.col("lb") < 0) & (F.col("ub") > 0)
        out = out.withColumn("pvalue", F.when(holds, F.lit(1.0)).otherwise(F.col("pvalue")))
    return out


def bootstrap_mean(
    rows: DataFrame, value: str, keys: Sequence[str] = (), unit: str = "unit", reps: int = 1000, seed: int = 1,
    confidence: float = 0.99, zero_rule: bool = True,
) -> DataFrame:
    """Bootstrap of the difference of means between splits."""
    sums = replicate_sums(rows.filter(F.col(value).isNotNull()), unit, [value], keys, reps, seed)
    stat = sums.select(*keys, "split", "rep", F.try_divide(F.col(value), F.col("w")).alias("v"))
    return summarise_replicates(_replicate_deltas(stat, keys), keys, confidence, zero_rule)


def bootstrap_median(
    rows: DataFrame, value: str, keys: Sequence[str] = (), unit: str = "unit", reps: int = 1000, seed: int = 1,
    confidence: float = 0.99, zero_rule: bool = True,
) -> DataFrame:
    """Bootstrap of the difference of medians: weighted medians of all replicates (see `weighted_medians`)."""
    known = rows.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    stat = replicate_medians(known, value, unit, [*keys, "split"], reps, seed)
    return summarise_replicates(_replicate_deltas(stat, keys), keys, confidence, zero_rule)


def bootstrap_ratio(
    rows: DataFrame, x: str, y: str, unit: str, keys: Sequence[str] = (), reps: int = 1000, seed: int = 1,
    confidence: float = 0.99, bias_correction: bool = False,
) -> DataFrame:
    """Cluster bootstrap of sum(x)/sum(y): each user is drawn as a whole. Null p for a zero denominator."""
    sums = replicate_sums(rows, unit, [x, y], keys, reps, seed)
    stat = sums.select(*keys, "split", "rep", F.try_divide(F.col(x), F.col(y)).alias("v"))
    original = None
    if bias_correction:
        base = rows.groupBy(*keys, "split").agg(
            F.try_divide(F.sum(F.col(x).cast("double")), F.sum(F.col(y).cast("double"))).alias("v")
        )
        original = pair_up(base, keys).withColumn("observed", F.col("v_1") - F.col("v_0"))
    return summarise_replicates(_replicate_deltas(stat, keys), keys, confidence, original=original)


def poisson_bootstrap(
    rows: DataFrame, x: str, y: str, unit: str, keys: Sequence[str] = (), reps: int = 1000, seed: int = 1
) -> DataFrame:
    """Weighted-ratio bootstrap with p = 2 min(negative, B - negative) / B."""
    out = bootstrap_ratio(rows, x, y, unit, keys, reps, seed)
    least = F.least(F.col("negative"), F.col("reps") - F.col("negative"))
    return out.withColumn("pvalue", F.try_divide(2.0 * least, F.col("reps").cast("double")))


# --- subsamples -----------------------------------------------------------

def exact_sample(
    df: DataFrame, keys: Sequence[str], unit: str, share: float, cap: int, seed: int = 1
) -> DataFrame:
    """Sample of exact size without replacement per key: the rows with the smallest draws.

    The cut-off draw is found by counting bins of draws, so no key is sorted in one task.
    `unit` identifies a row.
    """
    keys = list(keys)
    size = lambda total: F.least(F.lit(cap), F.floor(total * share)).cast("bigint")
    tagged = df.withColumn("__u", _draw(df, seed, unit, F.lit(0)))
    found = values_at_ranks(tagged, keys, "__u", {"__cut": lambda total: size(total) - 1})
    cut = found.select(*keys, "__cut", (size(F.col("rows")) - F.col("__cut_before")).alias("__need"))
    joined = null_safe_join(tagged, cut, keys)
    inside = joined.filter(F.col("__u") < F.col("__cut"))
    tie = Window.partitionBy(*keys, "__u").orderBy(unit) if keys else Window.partitionBy("__u").orderBy(unit)
    edge = (
        joined.filter(F.col("__u") == F.col("__cut"))
        .withColumn("__rn", F.row_number().over(tie))
        .filter(F.col("__rn") <= F.col("__need"))
        .drop("__rn")
    )
    return inside.unionByName(edge).drop("__u", "__cut", "__need")


def _moments(n: str, c: str) -> tuple[Column, Column]:
    """Mean and summed squares about it, from sums about the group's mean."""
    return F.col(f"{c}_mean") + F.try_divide(F.col(c), F.col(n)), F.greatest(F.lit(0.0), F.col(f"{c}_{c}") - F.try_divide(F.col(c) * F.col(c), F.col(n)))


def _ratio_moments(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The columns of `ratio_stats` for each (keys, sim, split), from sums of x, y about their means and of n."""
    b = F.col("rows").cast("double")
    (ax, mx), (ay, my) = (_moments("rows", c) for c in "xy")
    return sums.select(
        *keys, "sim", "split", F.col("rows").alias("b"), "n", (ax * b).alias("sx"), (ay * b).alias("sy"), ax.alias("ax"), ay.alias("ay"), (mx / b).alias("vx"), (my / b).alias("vy"),
        ((F.col("x_y") - F.col("x") * F.col("y") / b) / b).alias("cxy"),
    )


def _sampled_ratio_stats(rows: DataFrame, unit: str, keys: Sequence[str], sims: int, size: Column, seed: int) -> DataFrame:
    """What `ratio_stats` gives, for every sample. Rows with a null x or y are not sampled."""
    whole = rows.filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    out = sample_sums(whole, unit, {c: F.col(c) for c in ("n", "x", "y")}, [("x", "x"), ("y", "y"), ("x", "y")], [*keys, "split"], sims, size, seed, ["x", "y"], by_unit=True)
    return _ratio_moments(out, keys)


def _sampled_value_stats(rows: DataFrame, value: str, unit: str, keys: Sequence[str], sims: int, size: Column, seed: int) -> DataFrame:
    """What `value_stats` gives, for every sample. Null and NaN values are sampled and then skipped."""
    v = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    columns = {"known": v.isNotNull().cast("int"), "hits": F.coalesce((v > 0).cast("int"), F.lit(0)), "v": v}
    out = sample_sums(rows, unit, columns, [("v", "v")], [*keys, "split"], sims, size, seed, ["v"], by_unit=True)
    n = F.col("known")
    mean, squares = _moments("known", "v")
    return out.select(
        *keys, "sim", "split", n.cast("bigint").alias("n"), mean.alias("mean"), F.when(n > 1, squares / (n - 1)).alias("var"), (mean * n).alias("total"), F.col("hits").cast("bigint").alias("successes"),
    )


def _simulated_tests(rows: DataFrame, estimator: str, unit: str, keys: Sequence[str], value: str | None, sims: int, size: Column, seed: int, mode: str) -> DataFrame:
    grp = [*keys, "sim"]
    if estimator in ("t_test_ratio", "ttest_ratio"):
        pairs = pair_up(_sampled_ratio_stats(rows, unit, keys, sims, size, seed), grp)
        return ratio_t_test(pairs, mode=mode) if estimator == "t_test_ratio" else ratio_z_test(pairs, mode)
    if estimator not in ("t_test", "t_test_ci", "chi2", "prop_test", "proportions_ztest"):
        raise ValueError(f"no simulation for estimator: {estimator}")
    pairs = pair_up(_sampled_value_stats(rows, value, unit, keys, sims, size, seed), grp)
    if estimator in ("t_test", "t_test_ci"):
        return welch_test(pairs)
    return chi2_test(pairs) if estimator == "chi2" else proportion_test(pairs, pooled=estimator == "proportions_ztest")


def simulated_rate(
    rows: DataFrame, estimator: str, unit: str, sims: int, share: float = 0.5, cap: int = 1000,
    keys: Sequence[str] = ("metric",), value: str | None = None, confidence: float = 0.95, seed: int = 1,
    mode: str = "reference",
) -> DataFrame:
    """Share of simulated p-values at or below alpha per (keys, pair): false positives on an
    A/A frame, power on an A/B frame. The denominator is the number of non-null p-values.

    A sample of a split has min(cap, floor(share * rows)) rows, without replacement.
    """
    keys = list(keys)
    size = F.least(F.lit(cap), F.floor(F.col("__n") * share))
    tests = _simulated_tests(rows, estimator, unit, keys, value, sims, size, seed, mode)
    return tests.groupBy(*keys, "split_0", "split_1").agg(
        F.count("pvalue").alias("sims"),
        F.try_divide(
            F.count_if(F.col("pvalue") <= 1 - confidence).cast("double"), F.count("pvalue").cast("double")
        ).alias("rate"),
        F.avg("statistic").alias("mean_statistic"),
    )


def half_split_rate(
    rows: DataFrame, unit: str, sims: int, keys: Sequence[str] = (), confidence: float = 0.95, seed: int = 1,
    drop_zero_denominator: bool = False, mode: str = "bucket",
) -> DataFrame:
    """A/A check of the ratio t-test: each simulation halves the units at random and tests the halves."""
    base = rows.filter(F.col("x").isNotNull() & F.col("y").isNotNull() & ((F.col("y") != 0) | F.lit(not drop_zero_denominator)))
    means = stable_checkpoint(base.groupBy(*keys).agg(F.avg("x").alias("x_mean"), F.avg("y").alias("y_mean")))
    centred = null_safe_join(base.drop("split"), means, keys).withColumns({c: F.col(c) - F.col(f"{c}_mean") for c in "xy"})
    halves = half_sums(centred, unit, ["n", "x", "y"], [("x", "x"), ("y", "y"), ("x", "y")], keys, sims, seed)
    halves = null_safe_join(halves, means, keys)
    tests = ratio_t_test(pair_up(_ratio_moments(halves, keys), [*keys, "sim"]), confidence, mode)
    return tests.groupBy(*keys).agg(
        F.count("pvalue").alias("sims"),
        F.avg((F.col("pvalue") <= 1 - confidence).cast("int")).alias("rate"),
        F.avg("statistic").alias("mean_statistic"),
    )
