"""End-to-end experiment evaluations composed of the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import null_safe_join, stable_checkpoint
from ..functions.scalars import flag, lift, max_part
from ..operators.correction import benjamini_hochberg
from ..operators.metrics import ExperimentSpec, bucket_rows, metric_rows, pairs_with_lift, totals
from ..operators.polygons import scheduled_polygon_join
from ..operators.power import detectable_effect, verdict_rows
from ..operators.resample import bootstrap_mean, bootstrap_median, bootstrap_ratio, simulated_rate
from ..operators.temporal import latest_per_key, sequence_number
from ..operators.tests import ESTIMATORS, chi2_test, mann_whitney, pair_up, stat_inference, value_stats
from .presets import GOAL_ALPHA, GOAL_POWER


def _pair(df: DataFrame) -> Column:
    return F.concat_ws("_", F.col("split_0").cast("string"), F.col("split_1").cast("string"))


def evaluate(
    facts: DataFrame, spec: ExperimentSpec, keys: Sequence[str] = (), unit: Column | None = None, n_buckets=None,
    power_sims: int = 0, mde_alpha: float = 0.01, mde_power: float = 0.8,
) -> DataFrame:
    """All metrics x all split pairs of every experiment in `keys`.

    One pass makes totals, one for each split column makes the bucketed metric rows, and the bucket limit counts the
    rows once. All results are small (splits; buckets x metrics) and are written out; tests, correction, lifts and
    detectable effects are arithmetic on them. `unit` replaces the hash bucket (e.g. one row per user).
    """
    keys = list(keys)
    total = stable_checkpoint(totals(facts, spec, keys))
    lifts = pairs_with_lift(total, keys)
    if unit is None:
        rows = bucket_rows(facts, spec, n_buckets, keys)
    else:
        rows = metric_rows(facts.filter(F.col(spec.split_col).isNotNull()), spec.split_col, unit, spec.metrics, keys)
    rows = stable_checkpoint(rows)
    on = [*keys, "split_pair", "metric"]
    tests = None
    for estimator in dict.fromkeys(m.estimator for m in spec.metrics):
        names = [m.name for m in spec.metrics if m.estimator == estimator]
        value = None if ESTIMATORS.get(estimator) in ("ratio_t", "ratio_z") else "x"  # other tests look at x of each unit
        part = stat_inference(rows.filter(F.col("metric").isin(names)), estimator, [*keys, "metric"], value, confidence=spec.confidence)
        if power_sims:
            power = simulated_rate(
                rows.filter(F.col("metric").isin(names)), estimator, "unit", power_sims, keys=[*keys, "metric"], value=value, confidence=spec.confidence
            )
            power = power.select(*keys, "metric", _pair(power).alias("split_pair"), F.col("rate").alias("power"))
            part = null_safe_join(part.drop("power"), power, on, "left").select(*part.columns)
        tests = part if tests is None else tests.unionByName(part)
    tests = benjamini_hochberg(tests, keys, spec.confidence)
    # full outer: totals without a test stay, and so do metrics split by another column (week over week)
    out = lifts.join(tests, on, "full_outer")
    if "drivers" in spec.totals or "clients" in spec.totals:
        users = "drivers" if "drivers" in spec.totals else "clients"
        effect = detectable_effect(total.select(*keys, F.col("split").cast("string").alias("split"), F.col(users).alias("n")), mde_alpha, mde_power, keys)
        effect = effect.select(*keys, _pair(effect).alias("split_pair"), "mde")
        out = null_safe_join(out, effect, [*keys, "split_pair"], "left")
    return out


def split_totals(facts: DataFrame, spec: ExperimentSpec, keys: Sequence[str] = ()) -> DataFrame:
    return totals(facts, spec, keys)


def geo_facts(
    suggests: DataFrame, geo_stat: DataFrame, splits: DataFrame
) -> DataFrame:
    """Suggest rows (already inside schedule and polygon, tagged tw / lw) with stat, split and row flags.

    Keeps the latest suggest per (retro, order, driver); `rn` numbers the rows of one offer by time.
    """
    latest = latest_per_key(suggests, ["retro", "order_id", "driver_id"], ["ts", "offer_id"])
    joined = latest.join(geo_stat, "order_id", "left").join(splits, "driver_id", "left")
    geo_driver = (
        joined.filter(F.col("campaign_id").isNotNull()).select("driver_id").distinct().withColumn("is_geo_driver", F.lit(True))
    )
    flags = joined.join(geo_driver, "driver_id", "left").withColumns(
        {
            "is_geo_driver": F.coalesce("is_geo_driver", F.lit(False)), "is_ar": F.col("action").isin(1, -2),
            "is_cp": F.col("status") == "CP", "picked_up": F.col("driver_id").eqNullSafe(F.col("picked_by")),
            "is_geo_trip": F.col("campaign_id").isNotNull(),
        }
    )
    return sequence_number(flags, ["offer_id"], "ts", ["retro", "order_id", "driver_id"])


def area_suggests(suggests: DataFrame, schedule: DataFrame, metres: float, keys: Sequence[str] = ("id_locality",), offer: str = "offer_id", tile: float = 0.05) -> DataFrame:
    """The suggests inside the schedule's polygons or within `metres` of them, once each, with in_polygon and in_buffer.

    `suggests` has ts, lat, lon and the keys; `schedule` is what `parse_schedule` gives. A suggest that is inside one
    polygon counts as inside, whatever other areas it touches.
    """
    places = suggests.select("retro", offer, "ts", "lat", "lon", *keys)
    hits = scheduled_polygon_join(places, schedule, keys=keys, metres=metres, tile=tile)
    flags = hits.groupBy("retro", offer).agg(F.bool_or("in_polygon").alias("in_polygon"))
    return suggests.join(flags, ["retro", offer]).withColumn("in_buffer", ~F.col("in_polygon"))


def breakdown_rows(df: DataFrame, columns: Sequence[str], values: dict[str, Sequence] | None = None) -> DataFrame:
    """Each row once for 'Total' and once per breakdown column, as (breakdown, breakdown_value)."""
    entries = [F.struct(F.lit("Total").alias("name"), F.lit("Total").alias("value"))]
    for c in columns:
        v = F.col(c).cast("string")
        if values and c in values:
            v = F.when(v.isin([str(x) for x in values[c]]), v)
        entries.append(F.struct(F.lit(c).alias("name"), v.alias("value")))
    out = df.withColumn("__b", F.explode(F.array(*entries)))
    return out.filter(F.col("__b.value").isNotNull()).withColumns(
        {"breakdown": F.col("__b.name"), "breakdown_value": F.col("__b.value")}
    ).drop("__b")


def breakdown_evaluation(
    frames: dict[str, DataFrame], metrics: dict[str, tuple[str, str, str | None, tuple[str, ...]]], sources: dict[str, str],
    user: str, alpha: float = 0.01, power: float = 0.9, keys: Sequence[str] = (), reps: int = 1000, seed: int = 1,
) -> DataFrame:
    """Post-test table: metric x pair x breakdown value with p, BH-adjusted p, sizes and enough flag.

    `frames` hold the rows with a `split` column (and `unit`, a row id, for continuous metrics); `sources`
    maps a metric to its frame. Metrics of one kind, frame and breakdown set are stacked as keys and
    evaluated together: one pass for sizes and one for the test, however many metrics and values.
    """
    confidence = 1 - alpha
    batches: dict[tuple, list[str]] = {}
    for name, (kind, _, _, by) in metrics.items():
        columns = tuple(b for b in by if b != "Total" and b in frames[sources[name]].columns)
        batches.setdefault((kind, sources[name], columns), []).append(name)
    out = None
    for (kind, source, columns), names in batches.items():
        entries = []
        for name in names:
            _, x, y, _ = metrics[name]
            over = F.lit(1.0) if y in (None, "drivers") else F.col(y).cast("double")
            entries.append(F.struct(F.lit(name).alias("metric"), F.col(x).cast("double").alias("x"), over.alias("y")))
        frame = frames[source]
        base = list(dict.fromkeys([*keys, "split", user, *(["unit"] if "unit" in frame.columns else []), *columns]))
        narrow = frame.filter(F.col("split").isNotNull()).select(*base, F.array(*entries).alias("__m"))
        rows = breakdown_rows(narrow, columns).withColumn("__m", F.explode("__m"))
        rows = rows.select(*[c for c in rows.columns if c != "__m"], "__m.*")
        grp = [*keys, "metric", "breakdown", "breakdown_value"]
        sizes = verdict_rows(
            rows, "continuous" if kind == "continuous_median" else kind, "x", user, "y" if kind == "ratio" else None, grp, alpha, power
        )
        if kind == "binomial":
            test = chi2_test(pair_up(value_stats(rows, "x", grp), grp))
        elif kind == "ratio":
            test = bootstrap_ratio(rows, "x", "y", user, grp, reps, seed, confidence)
        else:
            boot = bootstrap_median if kind == "continuous_median" else bootstrap_mean
            test = boot(rows, "x", grp, "unit", reps, seed, confidence)
        test = test.select(*grp, "split_0", "split_1", "pvalue")
        label = F.when(F.col("breakdown") == "Total", F.col("metric")).otherwise(F.concat_ws("_", "metric", "breakdown_value"))
        part = null_safe_join(sizes, test, [*grp, "split_0", "split_1"], "left").withColumn("metric", label)
        part = part.withColumns({"split_0": F.col("split_0").cast("string"), "split_1": F.col("split_1").cast("string")})
        out = part if out is None else out.unionByName(part)
    return benjamini_hochberg(out, keys, confidence, null_as_one=True)


def goal_bonus_evaluation(counts: DataFrame, keys: Sequence[str] = ("bonus_id",), reps: int = 1000, seed: int = 1) -> DataFrame:
    """Personal-goal experiments: tpd (rank test), cpt (bootstrap), AR and SR (chi-square), MDE, BH per bonus.

    `counts` has the keys, split, driver_id, count (orders), paid_sum and x (target text such as '5' or '5_10').
    AR: share with count > 0. SR: share with count at or above the largest target step.
    """
    keys = list(keys)
    rows = counts.withColumns(
        {
            "unit": F.col("driver_id"), "activated": flag(F.col("count") > 0), "reached": flag(F.col("count") >= max_part("x")),
        }
    )
    cols = [*keys, "metric", "split_1", "split_2", "p_value"]
    named = lambda df, m: df.select(
        *keys, F.lit(m).alias("metric"), F.col("split_0").alias("split_1"), F.col("split_1").alias("split_2"), F.col("pvalue").alias("p_value")
    )
    parts = [
        named(mann_whitney(rows, "count", keys), "tpd"),
        named(bootstrap_mean(rows, "paid_sum", keys, "unit", reps, seed, 1 - GOAL_ALPHA), "cpt"),
        named(chi2_test(pair_up(value_stats(rows, "activated", keys), keys)), "AR"),
        named(chi2_test(pair_up(value_stats(rows, "reached", keys), keys)), "SR"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    users = rows.groupBy(*keys, "split").agg(F.countDistinct("driver_id").alias("n"))
    effect = detectable_effect(users, GOAL_ALPHA, GOAL_POWER, keys)
    effect = effect.select(*keys, F.col("split_0").alias("split_1"), F.col("split_1").alias("split_2"), "mde")
    adjusted = benjamini_hochberg(out.select(*cols), keys, 1 - GOAL_ALPHA, pvalue="p_value").withColumnRenamed("pvalue_adj", "p_adj")
    return null_safe_join(adjusted, effect, [*keys, "split_1", "split_2"], "left").drop("is_significant_adj")


def city_economics(per_split: DataFrame, drivers: float, keys: Sequence[str] = ()) -> DataFrame:
    """Experiment figures scaled to a city: trips = drivers * (1 - churn) * tpd, contribution and commission from per-trip values.

    `per_split` has split, churn, tpd, copt, compt.
    """
    trips = F.lit(float(drivers)) * (1 - F.col("churn")) * F.col("tpd")
    wide = per_split.withColumn("trips", trips).withColumns(
        {"contribution": F.col("trips") * F.col("copt"), "commission": F.col("trips") * F.col("compt")}
    )
    long = wide.select(*keys, "split", "trips", "contribution", "commission").unpivot(
        [*keys, "split"], ["trips", "contribution", "commission"], "measure", "value"
    )
    a = long.withColumnsRenamed({"split": "split_0", "value": "value_0"})
    b = long.withColumnsRenamed({"split": "split_1", "value": "value_1"})
    return a.join(b, [*keys, "measure"]).filter(F.col("split_0") < F.col("split_1")).select(
        *keys, "measure", "split_0", "split_1", "value_0", "value_1",
        (F.col("value_1") - F.col("value_0")).alias("difference"), lift("value_0", "value_1").alias("lift"),
    )
