"""Goal scoring: who reaches a goal, expected trips and spend, model quality. Models are pyspark.ml."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import dtype_of, spread, stable_checkpoint
from ..functions.hashing import draw, draw_key
from ..functions.scalars import days_since, flag
from ..operators.ranks import auc, best_precision, exact_quantiles, optimal_threshold
from ..operators.resample import exact_sample


def goal_setups(setups: DataFrame, key: str = "id", split: str = "split_no", user: str = "driver_id", max_splits: int = 4, min_users: int = 50) -> DataFrame:
    """Rows of setups with fewer than max_splits splits and more than min_users users."""
    from ..operators.metrics import Agg, aggregate

    sizes = aggregate(setups, [key], {"__s": Agg(split, "nunique"), "__u": Agg(user, "nunique")})
    return setups.join(sizes.filter((F.col("__s") < max_splits) & (F.col("__u") > min_users)).select(key), key, "left_semi")


def training_frame(setups: DataFrame, context: DataFrame, user: str = "driver_id", start: str = "period_date_start") -> DataFrame:
    """Setup rows with days since the first and last trip (clipped at 0) and labels reached / activated."""
    out = setups.join(context, user, "left")
    return out.withColumns(
        {
            "days_since_last": F.coalesce(days_since(start, "dt_last"), F.lit(-1)), "days_since_first": F.coalesce(days_since(start, "dt_first"), F.lit(-1)),
            "trips": F.coalesce("trips", F.lit(0)), "reached": flag(F.col("fact_rides") >= F.col("target_x")), "activated": flag(F.col("fact_rides") > 0),
        }
    )


def undersampled(df: DataFrame, label: str, unit: str, ratio: float = 0.5, seed: int = 1) -> DataFrame:
    """Majority class cut at random to minority / ratio rows; exact size."""
    sizes = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}  # two rows
    if len(sizes) < 2:
        return df
    minority = min(sizes, key=sizes.get)
    majority = next(k for k in sizes if k != minority)
    keep = int(sizes[minority] / ratio)
    rare, common = df.filter(F.col(label) == minority), df.filter(F.col(label) == majority)
    return rare.unionByName(exact_sample(common, [], unit, 1.0, keep, seed))


def train_test(df: DataFrame, unit: str, train: float = 0.7, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Split by a draw on the row id: the same rows on every run, whatever the partitioning."""
    u = draw(seed, draw_key(F.col(unit), dtype_of(df, unit)), F.lit(17))
    return df.filter(u < train), df.filter(u >= train)


def dealt(df: DataFrame, unit: str) -> DataFrame:
    """The rows written in spark.sql.shuffle.partitions files by `unit`: a fit takes few bytes of each but much work, and
    tasks sized by bytes would leave cores idle."""
    return stable_checkpoint(spread(df, F.xxhash64(unit)).sortWithinPartitions(unit))  # the hash keeps an aggregate by `unit` from lending its few partitions


def calibrated_forest(
    df: DataFrame, features: Sequence[str], label: str, unit: str, folds: int = 5, trees: int = 50, depth: int = 6, seed: int = 1
):
    """Random forest with isotonic calibration by folds: one (forest, isotonic) pair per fold."""
    fold = F.floor(draw(seed, draw_key(F.col(unit), dtype_of(df, unit)), F.lit(29)) * folds).cast("int")
    data = df.select(unit, *[F.col(f).cast("double").alias(f) for f in features], F.col(label).cast("double").alias("label"), fold.alias("fold"))
    data = dealt(data, unit)
    pairs = []
    for i in range(folds):
        forest = Pipeline(
            stages=[
                VectorAssembler(inputCols=list(features), outputCol="features"),
                RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, labelCol="label"),
            ]
        ).fit(data.filter(F.col("fold") != i))
        held = forest.transform(data.filter(F.col("fold") == i)).select("label", vector_to_array("probability")[1].alias("score"))
        iso = IsotonicRegression(featuresCol="score", labelCol="label").fit(held)
        pairs.append((forest, iso))
    return pairs


def split_points(forests: Sequence, features: Sequence[str]) -> dict[str, list[float]]:
    """The values at which a tree of the forests splits each feature, ascending."""
    found: dict[str, set[float]] = {f: set() for f in features}
    for forest in forests:
        for i, cut in re.findall(r"If \(feature (\d+) <= ([^)]+)\)", forest.toDebugString):
            found[features[int(i)]].add(float(cut))
    return {f: sorted(cuts) for f, cuts in found.items()}


def calibrated_scores(model, df: DataFrame, features: Sequence[str], name: str = "score") -> DataFrame:
    """Mean calibrated probability over the folds.

    Trees see a feature only through their split points, so the forests score each distinct cell between these points
    once, and a row gets the score of its cell.
    """
    out = df.withColumns({f: F.col(f).cast("double") for f in features})
    cuts = split_points([forest.stages[-1] for forest, _ in model], list(features))
    # cell j of -value begins at -cut, so that a value equal to a cut falls below it, as in a tree
    starts = [[-math.inf, *[-c for c in reversed(cuts[f] or [0.0])], math.inf] for f in features]
    codes = [f"__cell_{f}" for f in features]
    cells = Bucketizer(splitsArray=starts, inputCols=[f"__neg_{f}" for f in features], outputCols=codes)
    coded = cells.transform(out.withColumns({f"__neg_{f}": -F.col(f) for f in features})).drop(*cells.getInputCols())
    inside = {f: F.lit([-v for v in s])[F.col(c).cast("int")] for f, c, s in zip(features, codes, starts)}
    scored = spread(coded.select(*codes).distinct(), *codes).withColumns(inside)
    parts = []
    for i, (forest, iso) in enumerate(model):
        scored = forest.transform(scored).withColumn("__raw", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")
        scored = iso.setFeaturesCol("__raw").setPredictionCol(f"__p{i}").transform(scored).drop("__raw")
        parts.append(F.col(f"__p{i}"))
    scored = stable_checkpoint(scored.select(*codes, (sum(parts[1:], parts[0]) / len(parts)).alias(name)))
    return coded.join(scored, codes).select(*out.columns, name)


def expected_outcome(scored: DataFrame, keys: Sequence[str], score: str = "score", target: str = "target_x", budget: str = "budget", fee: float = 0.19) -> DataFrame:
    """Expected trips = sum(p * target), expected spend = sum(p * budget * (1 - fee))."""
    return scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("users"), F.avg(score).alias("mean_score"), F.sum(F.col(score) * F.col(target)).alias("expected_trips"),
        F.sum(F.col(score) * F.col(budget) * (1 - fee)).alias("expected_spend"),
    )


def mean_score_outcome(scored: DataFrame, keys: Sequence[str], score: str = "score", target: str = "target_x", share: float = 0.84) -> DataFrame:
    """Alternative estimate: mean(p) * target * users * share."""
    return scored.groupBy(*keys, target).agg(F.avg(score).alias("mean_score"), F.count(F.lit(1)).alias("users")).withColumn(
        "expected_trips", F.col("mean_score") * F.col(target) * F.col("users") * share
    )


def backtest(scored: DataFrame, key: str, score: str = "score", target: str = "target_x", budget: str = "budget", fact: str = "fact_rides", label: str = "reached") -> DataFrame:
    """Fact against expectation for every past setup."""
    expected = expected_outcome(scored, [key], score, target, budget)
    facts = scored.groupBy(key).agg(F.sum(fact).alias("fact_trips"), F.sum(label).alias("fact_reached"))
    return expected.join(facts, key)


def scenario_grid(users: DataFrame, targets: Sequence[int], budgets: Sequence[float]) -> DataFrame:
    """Every user under every target x budget scenario (a fan-out by the scenario count)."""
    grid = F.array(*[F.struct(F.lit(int(t)).alias("target_x"), F.lit(float(b)).alias("budget")) for t in targets for b in budgets])
    return users.withColumn("__s", F.explode(grid)).select(*users.columns, "__s.*")


def forest_grid_search(df: DataFrame, features: Sequence[str], label: str, trees: Sequence[int] = (20, 50), depths: Sequence[int] = (3, 6), folds: int = 3, seed: int = 1):
    """Regression forest chosen by cross-validation."""
    rf = RandomForestRegressor(labelCol=label, seed=seed)
    grid = ParamGridBuilder().addGrid(rf.numTrees, list(trees)).addGrid(rf.maxDepth, list(depths)).build()
    cv = CrossValidator(
        estimator=rf, estimatorParamMaps=grid, evaluator=RegressionEvaluator(labelCol=label, metricName="rmse"), numFolds=folds, seed=seed, parallelism=2
    )
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), cv]).fit(df)


def impurity_importances(spark, features: Sequence[str], model) -> DataFrame:
    rows = [(f, float(w)) for f, w in zip(features, model.featureImportances.toArray())]
    return spark.createDataFrame(rows, "feature string, importance double")


def permutation_importances(model, df: DataFrame, features: Sequence[str], label: str, unit: str, seed: int = 1) -> DataFrame:
    """Rise of the mean squared error when one feature is shuffled: values move to the row next in a seeded hash order
    of the whole table.

    Tasks sort buckets of that order; the last row of a bucket takes the first one of the next, so the result does not
    depend on the number of buckets.
    """
    from pyspark.sql import Window

    num = draw_key(F.col(unit), dtype_of(df, unit))
    buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = df.withColumn("__u", draw(seed, num, F.lit(1))).withColumn("__bucket", F.floor(F.col("__u") * buckets).cast("int"))
    values = F.struct(*features)
    firsts = base.groupBy("__bucket").agg(F.min_by(values, F.struct("__u", unit)).alias("__first"))
    order = Window.orderBy("__bucket")  # one row for each bucket
    first_of_all = F.first("__first").over(order)
    firsts = firsts.select("__bucket", F.coalesce(F.lead("__first").over(order), first_of_all).alias("__wrap"))
    base = base.withColumn("__next", F.lead(values).over(Window.partitionBy("__bucket").orderBy("__u", unit)))
    base = base.join(firsts, "__bucket").withColumn("__next", F.coalesce("__next", "__wrap")).drop("__wrap")
    mse = lambda d: d.agg(F.avg(F.pow(F.col("prediction") - F.col(label), 2)).alias("mse"))
    out = mse(model.transform(df)).withColumn("feature", F.lit("__base"))
    for f in features:
        moved = base.withColumn(f, F.col(f"__next.{f}"))
        out = out.unionByName(mse(model.transform(moved)).withColumn("feature", F.lit(f)))
    ref = out.filter(F.col("feature") == "__base").select("mse").scalar()
    return out.filter(F.col("feature") != "__base").select("feature", (F.col("mse") - ref).alias("importance"))


def classification_metrics(scored: DataFrame, keys: Sequence[str], label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """Precision, recall, F1, accuracy, AUC, gini and best precision at recall >= 0.7."""
    p, y = F.col(score) >= threshold, F.col(label) == 1
    counts = scored.groupBy(*keys).agg(
        F.count_if(p & y).cast("double").alias("tp"), F.count_if(p & ~y).cast("double").alias("fp"), F.count_if(~p & y).cast("double").alias("fn"),
        F.count_if(~p & ~y).cast("double").alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    counts = counts.select(
        *keys, F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, tp + fn).alias("recall"),
        F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"), ((tp + tn) / (tp + fp + fn + tn)).alias("accuracy"),
    )
    from ..functions.frames import null_safe_join

    out = null_safe_join(counts, auc(scored, keys, score, label), list(keys), "left") if keys else counts.join(auc(scored, keys, score, label))
    best = best_precision(scored, keys, score, label)
    return null_safe_join(out, best, list(keys), "left") if keys else out.join(best)


def regression_metrics(df: DataFrame, keys: Sequence[str], fact: str, predicted: str) -> DataFrame:
    """R2, MSE, MAE and MAPE (percent, zero facts skipped) in one aggregate."""
    y, f = F.col(fact).cast("double"), F.col(predicted).cast("double")
    err = y - f
    sse = F.sum(err * err)
    return df.groupBy(*keys).agg(
        (1 - F.try_divide(sse, F.var_pop(y) * F.count(y))).alias("r2"), F.avg(err * err).alias("mse"), F.avg(F.abs(err)).alias("mae"),
        (F.avg(F.abs(F.try_divide(err, y))) * 100).alias("mape"),
    )


__all__ = [
    "auc", "backtest", "best_precision", "calibrated_forest", "calibrated_scores", "classification_metrics", "dealt", "exact_quantiles", "expected_outcome",
    "forest_grid_search", "goal_setups", "impurity_importances", "mean_score_outcome", "optimal_threshold", "permutation_importances", "regression_metrics",
    "scenario_grid", "train_test", "training_frame", "undersampled",
]
