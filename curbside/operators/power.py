"""Sample sizes, detectable effects and post-test verdicts from one aggregate per arm."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pvalues as P
from .tests import pair_up


def cohen_w(p0: Column, p1: Column) -> Column:
    """Effect size of a two-cell table against base probabilities (p0, 1 - p0)."""
    d = p1 - p0
    return F.sqrt(F.try_divide(d * d, p0) + F.try_divide(d * d, 1 - p0))


def _whole(c: Column) -> Column:
    return F.floor(c).cast("bigint")


def mean_sample_size(
    df: DataFrame, value: str, lifts: Sequence[float], alpha: float, power: float, keys: Sequence[str] = ()
) -> DataFrame:
    """Arm size at which a lift of the mean is found: effect = mean / sd * lift."""
    stats = df.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n")
    )
    return _needed(stats, lifts, alpha, power)


def ratio_sample_size(
    df: DataFrame, x: str, y: str, lifts: Sequence[float], alpha: float, power: float, keys: Sequence[str] = ()
) -> DataFrame:
    """The same for sum(x)/sum(y), with the sd of the row ratios."""
    stats = df.groupBy(*keys).agg(
        F.try_divide(F.sum(x).cast("double"), F.sum(y).cast("double")).alias("mean"),
        F.stddev_samp(F.try_divide(F.col(x).cast("double"), F.col(y).cast("double"))).alias("sd"),
        F.count(F.lit(1)).alias("n"),
    )
    return _needed(stats, lifts, alpha, power)


def _needed(stats, lifts, alpha, power):
    grid = stats.withColumn("lift", F.explode(F.array(*[F.lit(float(v)) for v in lifts])))
    effect = F.try_divide(F.col("mean"), F.col("sd")) * F.col("lift")
    return grid.withColumn("effect", effect).withColumn(
        "nobs_needed", _whole(P.t_sample_size(F.col("effect"), power, alpha, 1.0))
    )


def binomial_sample_size(
    df: DataFrame, value: str, lifts: Sequence[float], alpha: float, power: float, keys: Sequence[str] = ()
) -> DataFrame:
    """Sample size of a chi-square test for an absolute lift of the share of positive values."""
    stats = df.groupBy(*keys).agg(
        F.count_if(F.col(value) > 0).alias("successes"),
        F.count_if(F.col(value) >= 0).alias("n"),
    )
    grid = stats.withColumn("lift", F.explode(F.array(*[F.lit(float(v)) for v in lifts])))
    p0 = F.try_divide(F.col("successes"), F.col("n"))
    lifted = F.floor(F.col("n") * (p0 + F.col("lift")))
    grid = grid.withColumn("effect", cohen_w(p0, F.try_divide(lifted, F.col("n"))))
    return grid.withColumn("nobs_needed", _whole(P.gof_sample_size(F.col("effect"), power, alpha)))


def detectable_effect(counts: DataFrame, alpha: float, power: float, keys: Sequence[str] = ()) -> DataFrame:
    """Standardised effect found with the given power for each pair's counts; ratio is n1/n0."""
    pairs = pair_up(counts, keys)
    ratio = F.try_divide(F.col("n_1").cast("double"), F.col("n_0").cast("double"))
    return pairs.withColumn("mde", P.t_detectable_effect(F.col("n_0"), ratio, alpha, power))


def closed_form_mde(pairs: DataFrame, alpha: float, power: float, base: str = "mean_0") -> DataFrame:
    """Relative detectable lift: (t_power + t_(1-alpha/2)) * sqrt(s0^2/n0 + s1^2/n1) / base."""
    df = (F.col("n_0") + F.col("n_1") - 2).cast("double")
    se = F.sqrt(F.try_divide(F.col("var_0"), F.col("n_0")) + F.try_divide(F.col("var_1"), F.col("n_1")))
    q = P.t_quantile(F.lit(power), df) - P.t_quantile(F.lit(alpha / 2), df)
    return pairs.withColumn("se", se).withColumn("mde", F.try_divide(q * F.col("se"), F.col(base)))


def _difference(a: Column, b: Column) -> Column:
    return F.try_divide(b - a, F.abs(a))


def verdict_rows(
    df: DataFrame, kind: str, x: str, user: str, y: str | None = None, keys: Sequence[str] = (),
    alpha: float = 0.01, power: float = 0.9,
) -> DataFrame:
    """Post-test sizes per pair: split values, lift, observations, users, needed size and enough flag.

    kind: 'binomial', 'ratio' or 'continuous'. The p-value comes from the matching test
    and is joined by the caller. `nobs_needed` is null when the observed lift is zero.
    """
    keys = list(keys)
    v = F.col(x).cast("double")
    aggs = [
        F.countDistinct(user).alias("users"), F.count_if(v > 0).alias("hit"), F.count_if(v == 0).alias("miss"), F.sum(v).alias("sx"), F.count(v).alias("cx"), F.var_samp(v).alias("vx"),
    ]
    if y:
        over = F.col(y).cast("double")
        aggs += [F.sum(over).alias("sy"), F.var_samp(F.try_divide(v, over)).alias("vr")]
    p = pair_up(df.groupBy(*keys, "split").agg(*aggs), keys)
    users_0, users_1 = F.col("users_0"), F.col("users_1")

    if kind == "binomial":
        obs_0, obs_1 = F.col("hit_0") + F.col("miss_0"), F.col("hit_1") + F.col("miss_1")
        a, b = F.try_divide(F.col("hit_0"), obs_0), F.try_divide(F.col("hit_1"), obs_1)
        lift, effect = b - a, cohen_w(a, b)
        needed = P.gof_sample_size(F.col("effect"), power, alpha)
    elif kind == "ratio":
        obs_0, obs_1 = users_0, users_1
        a, b = F.try_divide(F.col("sx_0"), F.col("sy_0")), F.try_divide(F.col("sx_1"), F.col("sy_1"))
        lift = F.try_divide(b - a, F.abs(a))
        mean_lift = F.try_divide(
            F.try_divide(F.col("sx_1"), F.col("cx_1")), F.try_divide(F.col("sx_0"), F.col("cx_0"))
        ) - 1
        effect = F.try_divide(a, F.sqrt("vr_0")) * mean_lift
        needed = P.t_sample_size(F.col("effect"), power, alpha, 1.0)
    elif kind == "continuous":
        obs_0, obs_1 = F.col("cx_0"), F.col("cx_1")
        a, b = F.try_divide(F.col("sx_0"), obs_0), F.try_divide(F.col("sx_1"), obs_1)
        lift = F.try_divide(b, a) - 1
        effect = F.try_divide(a, F.sqrt("vx_0")) * lift
        needed = P.t_sample_size(F.col("effect"), power, alpha, 1.0)
    else:
        raise ValueError(f"unknown metric kind: {kind}")
    out = p.withColumns(
        {
            "split_a": a, "split_b": b, "lift": lift, "effect": effect,
            "split_a_n_obs": obs_0, "split_b_n_obs": obs_1,
            "n_obs_difference": _difference(obs_0.cast("double"), obs_1.cast("double")),
            "split_a_drivers": users_0, "split_b_drivers": users_1,
            "unique_drivers_difference": _difference(users_0.cast("double"), users_1.cast("double")),
        }
    ).withColumn("nobs_needed", _whole(needed))
    enough = (F.col("split_a_n_obs") >= F.col("nobs_needed")) & (F.col("split_b_n_obs") >= F.col("nobs_needed"))
    return out.withColumn("mde_ok", F.when(enough, 1)).select(
        *keys, "split_0", "split_1", "split_a", "split_b", "lift", "effect", "split_a_n_obs", "split_b_n_obs",
        "n_obs_difference", "split_a_drivers", "split_b_drivers", "unique_drivers_difference", "nobs_needed", "mde_ok",
    )
