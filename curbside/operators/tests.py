"""Two-sample tests from sufficient statistics.

Facts are reduced to a few numbers per (keys, split) by a partial aggregate;
each test is then arithmetic on one row per pair. Delta is always
test (split_1) minus control (split_0).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pvalues as P
from ..functions.frames import null_safe_join
from .ranks import cumulative_counts

# Aliases of the estimator names used by the job configurations.
ESTIMATORS = {
    "t_test": "welch", "t_test_ci": "welch", "ttest": "student", "ttest_ind": "student",
    "t_test_ratio": "ratio_t", "ttest_ratio": "ratio_z",
    "prop": "proportion", "prop_test": "proportion", "prop_test_ci": "proportion",
    "proportions_ztest": "pooled_proportion",
    "mann_whitney_test": "rank", "bootstrap": "bootstrap",
}


def ratio_stats(rows: DataFrame, keys: Sequence[str] = ("metric",)) -> DataFrame:
    """Moments of x and y per (keys, split): numerically stable central moments, not raw squares."""
    return rows.groupBy(*keys, "split").agg(
        F.count(F.lit(1)).alias("b"), F.sum("n").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"),
        F.avg("x").alias("ax"), F.avg("y").alias("ay"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"),
        F.covar_pop("x", "y").alias("cxy"),
    )


def value_stats(rows: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Count, mean and sample variance of a value per (keys, split); nulls and NaN are skipped."""
    v = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    return rows.groupBy(*keys, "split").agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_samp(v).alias("var"),
        F.sum(v).alias("total"), F.count_if(v > 0).alias("successes"),
    )


def pair_up(stats: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per pair of splits: columns of the lower split end in _0, of the higher in _1."""
    cols = ["split", *[c for c in stats.columns if c not in (*keys, "split")]]
    arms = stats.filter(F.col("split").isNotNull()).groupBy(*keys).agg(F.collect_list(F.struct(*cols)).alias("__arms"))  # one entry for each arm
    pairs = arms.select(*keys, F.explode("__arms").alias("__a"), "__arms")
    pairs = pairs.select(*keys, "__a", F.explode(F.filter("__arms", lambda b: b["split"] > F.col("__a.split"))).alias("__b"))
    return pairs.select(*keys, *[F.col(f"__{s}.{c}").alias(f"{c}_{i}") for i, s in enumerate("ab") for c in cols])


def _delta_variance(s: str, mode: str) -> tuple[Column, Column]:
    """Delta-method variance of x/y and the observation count it is divided by."""
    b, n = F.col(f"b_{s}").cast("double"), F.col(f"n_{s}").cast("double")
    obs = n if mode == "reference" else b
    mx = F.try_divide(F.col(f"sx_{s}"), obs)
    my = F.try_divide(F.col(f"sy_{s}"), obs)
    # moments about the per-observation means, moved from the moments about the row means
    dx, dy = F.col(f"ax_{s}") - mx, F.col(f"ay_{s}") - my
    var_x = F.try_divide(b * (F.col(f"vx_{s}") + dx * dx), obs)
    var_y = F.try_divide(b * (F.col(f"vy_{s}") + dy * dy), obs)
    cov = F.try_divide(b * (F.col(f"cxy_{s}") + dx * dy), obs)
    var = (
        F.try_divide(var_x, my * my)
        + F.try_divide(var_y * mx * mx, my * my * my * my)
        - F.try_divide(2 * mx * cov, my * my * my)
    )
    return var, obs


def _ratio_columns(pairs: DataFrame, mode: str) -> DataFrame:
    v0, n0 = _delta_variance("0", mode)
    v1, n1 = _delta_variance("1", mode)
    return pairs.withColumns(
        {
            "ratio_0": F.try_divide(F.col("sx_0"), F.col("sy_0")),
            "ratio_1": F.try_divide(F.col("sx_1"), F.col("sy_1")),
            "q0": F.try_divide(v0, n0), "q1": F.try_divide(v1, n1), "obs_0": n0, "obs_1": n1,
        }
    ).withColumns(
        {
            "delta": F.col("ratio_1") - F.col("ratio_0"),
            "se": F.sqrt(F.col("q0") + F.col("q1")),
        }
    )


def ratio_t_test(pairs: DataFrame, confidence: float = 0.95, mode: str = "reference") -> DataFrame:
    """Delta-method t-test of a ratio with Welch degrees of freedom and interval.

    mode="reference" divides by the summed weights n; mode="bucket" treats each row as one observation.
    """
    df = _ratio_columns(pairs, mode)
    q0, q1 = F.col("q0"), F.col("q1")
    dof = F.try_divide(
        (q0 + q1) * (q0 + q1),
        F.try_divide(q0 * q0, F.col("obs_0") - 1) + F.try_divide(q1 * q1, F.col("obs_1") - 1),
    )
    df = df.withColumns({"statistic": F.try_divide(F.col("delta"), F.col("se")), "df": dof})
    df = df.withColumns(
        {
            "pvalue": P.t_two_sided(F.col("statistic"), F.col("df")),
            "__q": P.t_quantile(F.lit((1 + confidence) / 2.0), F.col("df")),
        }
    )
    return _interval(df).drop("q0", "q1", "obs_0", "obs_1")


def ratio_z_test(pairs: DataFrame, mode: str = "reference") -> DataFrame:
    """Delta-method z-test of a ratio; p = 1 when a denominator sums to zero."""
    df = _ratio_columns(pairs, mode)
    df = df.withColumn("statistic", F.try_divide(F.col("delta"), F.col("se")))
    empty = (F.col("sy_0") == 0) | (F.col("sy_1") == 0)
    return df.withColumn(
        "pvalue", F.when(empty, F.lit(1.0)).otherwise(P.normal_two_sided(F.col("statistic")))
    ).drop("q0", "q1", "obs_0", "obs_1")


def _sample(c: Column, b: Column) -> Column:
    return F.try_divide(c * b, b - 1)


def ratio_normal_interval(pairs: DataFrame, z: float = 1.96) -> DataFrame:
    """Ratio of means with sample (ddof = 1) moments and a normal interval."""
    cols = {}
    for s in ("0", "1"):
        b = F.col(f"b_{s}").cast("double")
        ax, ay = F.col(f"ax_{s}"), F.col(f"ay_{s}")
        var = (
            F.try_divide(_sample(F.col(f"vx_{s}"), b), ay * ay)
            + F.try_divide(_sample(F.col(f"vy_{s}"), b) * ax * ax, ay * ay * ay * ay)
            - F.try_divide(2 * ax * _sample(F.col(f"cxy_{s}"), b), ay * ay * ay)
        )
        cols[f"ratio_{s}"] = F.try_divide(ax, ay)
        cols[f"__v{s}"] = F.try_divide(var, b)
    df = pairs.withColumns(cols)
    df = df.withColumns(
        {"delta": F.col("ratio_1") - F.col("ratio_0"), "se": F.sqrt(F.col("__v0") + F.col("__v1"))}
    )
    df = df.withColumns(
        {
            "statistic": F.try_divide(F.col("delta"), F.col("se")),
            "lb": F.col("delta") - z * F.col("se"), "ub": F.col("delta") + z * F.col("se"),
        }
    )
    return df.withColumn("pvalue", P.normal_two_sided(F.col("statistic"))).drop("__v0", "__v1")


def _interval(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {"lb": F.col("delta") - F.col("__q") * F.col("se"), "ub": F.col("delta") + F.col("__q") * F.col("se")}
    ).drop("__q")


def welch_test(pairs: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Welch t-test of means with its interval."""
    a, b = F.try_divide(F.col("var_0"), F.col("n_0")), F.try_divide(F.col("var_1"), F.col("n_1"))
    df = pairs.withColumns(
        {
            "delta": F.col("mean_1") - F.col("mean_0"), "se": F.sqrt(a + b),
            "df": F.try_divide(
                (a + b) * (a + b),
                F.try_divide(a * a, F.col("n_0") - 1) + F.try_divide(b * b, F.col("n_1") - 1),
            ),
        }
    ).withColumn("statistic", F.try_divide(F.col("delta"), F.col("se")))
    df = df.withColumns(
        {
            "pvalue": P.t_two_sided(F.col("statistic"), F.col("df")),
            "__q": P.t_quantile(F.lit((1 + confidence) / 2.0), F.col("df")),
        }
    )
    return _interval(df)


def student_test(pairs: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Equal-variance t-test of means."""
    n0, n1 = F.col("n_0"), F.col("n_1")
    dof = (n0 + n1 - 2).cast("double")
    pooled = F.try_divide(F.col("var_0") * (n0 - 1) + F.col("var_1") * (n1 - 1), dof)
    df = pairs.withColumns(
        {
            "delta": F.col("mean_1") - F.col("mean_0"), "df": dof,
            "se": F.sqrt(pooled * (F.try_divide(F.lit(1.0), n0) + F.try_divide(F.lit(1.0), n1))),
        }
    ).withColumn("statistic", F.try_divide(F.col("delta"), F.col("se")))
    df = df.withColumns(
        {
            "pvalue": P.t_two_sided(F.col("statistic"), F.col("df")),
            "__q": P.t_quantile(F.lit((1 + confidence) / 2.0), F.col("df")),
        }
    )
    return _interval(df)


def proportion_test(
    pairs: DataFrame, confidence: float = 0.95, pooled: bool = False,
    successes: str = "successes", counts: str = "n",
) -> DataFrame:
    """Two-proportion z-test; unpooled standard error with interval, or pooled."""
    n0, n1 = F.col(f"{counts}_0").cast("double"), F.col(f"{counts}_1").cast("double")
    k0, k1 = F.col(f"{successes}_0"), F.col(f"{successes}_1")
    p0, p1 = F.try_divide(k0, n0), F.try_divide(k1, n1)
    if pooled:
        p = F.try_divide(k0 + k1, n0 + n1)
        se = F.sqrt(p * (1 - p) * (F.try_divide(F.lit(1.0), n0) + F.try_divide(F.lit(1.0), n1)))
    else:
        se = F.sqrt(F.try_divide(p0 * (1 - p0), n0) + F.try_divide(p1 * (1 - p1), n1))
    df = pairs.withColumns({"p_0": p0, "p_1": p1, "delta": p1 - p0, "se": se})
    df = df.withColumn("statistic", F.try_divide(F.col("delta"), F.col("se")))
    df = df.withColumns(
        {
            "pvalue": P.normal_two_sided(F.col("statistic")),
            "__q": P.normal_quantile(F.lit((1 + confidence) / 2.0)),
        }
    )
    return _interval(df)


def chi2_test(pairs: DataFrame, successes: str = "successes", counts: str = "n") -> DataFrame:
    """Chi-square of the 2x2 table of failures and successes with Yates' correction."""
    k0, k1 = F.col(f"{successes}_0").cast("double"), F.col(f"{successes}_1").cast("double")
    n0, n1 = F.col(f"{counts}_0").cast("double"), F.col(f"{counts}_1").cast("double")
    total, hits = n0 + n1, k0 + k1
    terms = []
    for k, n in ((k0, n0), (k1, n1)):
        for observed, margin in ((k, hits), (n - k, total - hits)):
            expected = F.try_divide(n * margin, total)
            gap = F.greatest(F.abs(observed - expected) - 0.5, F.lit(0.0))
            terms.append(F.try_divide(gap * gap, expected))
    stat = terms[0] + terms[1] + terms[2] + terms[3]
    df = pairs.withColumn("statistic", stat)
    return df.withColumn("pvalue", P.chi2_tail(F.col("statistic"), 1.0))


def mann_whitney(rows: DataFrame, value: str, keys: Sequence[str] = (), alternative: str = "two-sided") -> DataFrame:
    """Mann-Whitney U per pair of splits: average ranks, tie correction, continuity correction.

    `rows` has a `split` column. Rows are counted per distinct value first; ranks
    come from running counts over value bins. alternative="legacy_half" halves p.
    """
    keys = list(keys)
    v = F.col(value).cast("double")
    counted = rows.filter(v.isNotNull() & ~F.isnan(v) & F.col("split").isNotNull()).groupBy(
        *keys, F.col("split"), v.alias("__v")
    ).agg(F.count(F.lit(1)).alias("__n"))
    splits = counted.select(*keys, "split").distinct()
    a, b = splits.withColumnRenamed("split", "split_0"), splits.withColumnRenamed("split", "split_1")
    pairs = (a.join(b, keys) if keys else a.join(b, F.col("split_0") < F.col("split_1"))).filter(
        F.col("split_0") < F.col("split_1")
    )
    # each split takes part in (splits - 1) pairs: a fan-out by the number of arms only
    sides = pairs.select(
        *keys, "split_0", "split_1", F.explode(F.array("split_0", "split_1")).alias("split")
    )
    pooled = counted.join(sides, [*keys, "split"])
    grp = [*keys, "split_0", "split_1"]
    runs = cumulative_counts(
        pooled, grp, "__v",
        {
            "n0": F.sum(F.when(F.col("split") == F.col("split_0"), F.col("__n")).otherwise(0)),
            "n1": F.sum(F.when(F.col("split") == F.col("split_1"), F.col("__n")).otherwise(0)),
        },
    )
    tie = (F.col("n0") + F.col("n1")).cast("double")
    rank = F.col("n0_before") + F.col("n1_before") + (tie + 1) / 2
    stats = runs.groupBy(*grp).agg(
        F.sum("n0").alias("n_0"), F.sum("n1").alias("n_1"),
        F.sum(F.col("n0") * rank).alias("rank_sum_0"), F.sum(tie * tie * tie - tie).alias("ties"),
    )
    n0, n1 = F.col("n_0").cast("double"), F.col("n_1").cast("double")
    n = n0 + n1
    u0 = F.col("rank_sum_0") - n0 * (n0 + 1) / 2
    sigma = F.sqrt(n0 * n1 / 12 * ((n + 1) - F.try_divide(F.col("ties"), n * (n - 1))))
    out = stats.withColumns({"u_0": u0, "u_1": n0 * n1 - u0, "sigma": sigma})
    top = F.greatest("u_0", "u_1") - n0 * n1 / 2 - 0.5
    out = out.withColumn("statistic", F.try_divide(top, F.col("sigma")))
    p = F.least(F.lit(1.0), P.normal_two_sided(F.greatest(F.col("statistic"), F.lit(0.0))))
    if alternative == "legacy_half":
        p = p / 2
    return out.withColumn("pvalue", F.when(F.col("sigma") > 0, p)).drop("rank_sum_0", "ties")


def stat_inference(
    rows: DataFrame, estimator: str, keys: Sequence[str] = ("metric",), value: str | None = None,
    confidence: float = 0.95,
) -> DataFrame:
    """(keys, split pair, pvalue, power, is_significant, delta, lb, ub) for one estimator."""
    kind = ESTIMATORS.get(estimator)
    if kind in ("ratio_t", "ratio_z"):
        pairs = pair_up(ratio_stats(rows, keys), keys)
        out = ratio_t_test(pairs, confidence) if kind == "ratio_t" else ratio_z_test(pairs)
    elif kind in ("welch", "student", "proportion", "pooled_proportion"):
        pairs = pair_up(value_stats(rows, value, keys), keys)
        out = {
            "welch": lambda p: welch_test(p, confidence),
            "student": lambda p: student_test(p, confidence),
            "proportion": lambda p: proportion_test(p, confidence),
            "pooled_proportion": lambda p: proportion_test(p, confidence, pooled=True),
        }[kind](pairs)
    elif kind == "rank":
        out = mann_whitney(rows, value, keys)
    elif kind == "bootstrap":
        from .resample import bootstrap_mean

        out = bootstrap_mean(rows, value, keys, confidence=confidence)
    else:
        raise ValueError(f"unknown estimator: {estimator}")
    for name in ("delta", "lb", "ub"):
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast("double"))
    return out.select(
        *keys,
        F.concat_ws("_", F.col("split_0").cast("string"), F.col("split_1").cast("string")).alias("split_pair"),
        "pvalue", F.lit(None).cast("double").alias("power"),
        (F.col("pvalue") < 1 - confidence).cast("int").alias("is_significant"), "delta", "lb", "ub",
    )
