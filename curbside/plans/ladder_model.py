"""Ladder response model: training grid, step models, scenario scoring, hold-out control."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import stable_checkpoint
from ..operators.ladders import ladder_outcome, step_deltas

STEP_FEATURES = ("step", "payout", "prev_step_delta", "next_step_delta", "is_attractive", "active_drivers", "avg_price_long", "avg_price_short")


def training_grid(
    facts: DataFrame, ladders: DataFrame, context: DataFrame, max_step: int = 61, min_drivers: int = 50
) -> DataFrame:
    """Every (date, campaign, segment, step) with actuals, zero-filled, for campaign-days of more than min_drivers drivers.

    `facts` has date, campaign, segment, driver_id, step, bill. Only dates and segments that the campaign
    had are laid out: the grid is exploded from each campaign-day's own segment set.
    """
    per_step = facts.groupBy("date", "campaign", "segment", "step").agg(
        F.countDistinct("driver_id").alias("drivers"), F.sum("bill").alias("bill")
    )
    active = facts.groupBy("date", "campaign").agg(F.count("driver_id").alias("__d"), F.collect_set("segment").alias("__s"))
    grid = (
        active.filter(F.col("__d") > min_drivers).withColumn("segment", F.explode("__s"))
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(max_step)))).drop("__d", "__s")
    )
    steps = step_deltas(ladders, ["campaign"])
    out = grid.join(context, "date", "left").join(steps, ["campaign", "step"]).join(per_step, ["date", "campaign", "segment", "step"], "left")
    out = out.fillna(0)
    return out.withColumns({"orders_on_step": F.col("step") * F.col("drivers"), "stops": (F.col("drivers") > 0).cast("int")})


def long_share_line(grid: DataFrame, share: str, step: str = "step") -> DataFrame:
    """Slope and intercept of the long-trip share over the step."""
    return grid.agg(F.regr_slope(share, step).alias("slope"), F.regr_intercept(share, step).alias("intercept"))


@dataclass
class StepModels:
    stops: Any
    orders: Any
    bill: Any
    features: tuple[str, ...]


def fit_step_models(grid: DataFrame, features: Sequence[str] = STEP_FEATURES, trees: int = 30, depth: int = 6, seed: int = 1) -> StepModels:
    """Classifier 'any driver stops here', regressor for orders on the step, regressor for the bill per driver."""
    data = stable_checkpoint(grid.select(*[F.col(f).cast("double").alias(f) for f in features], "stops", F.col("orders_on_step").cast("double"),
                                         F.try_divide(F.col("bill").cast("double"), F.col("drivers").cast("double")).alias("bill_per_driver")))
    assemble = VectorAssembler(inputCols=list(features), outputCol="features")
    fit = lambda est, d: Pipeline(stages=[assemble, est]).fit(d)
    stopped = data.filter("stops = 1")
    return StepModels(
        fit(RandomForestClassifier(labelCol="stops", predictionCol="p_stops", rawPredictionCol="r1", probabilityCol="r2", numTrees=trees, maxDepth=depth, seed=seed), data),
        fit(RandomForestRegressor(labelCol="orders_on_step", predictionCol="p_orders", numTrees=trees, maxDepth=depth, seed=seed), stopped),
        fit(RandomForestRegressor(labelCol="bill_per_driver", predictionCol="p_bill", numTrees=trees, maxDepth=depth, seed=seed), stopped),
        tuple(features),
    )


def score_scenarios(models: StepModels, scenarios: DataFrame, share: DataFrame) -> DataFrame:
    """Scenario rows with stops, orders_on_step, bill and share_long from the models."""
    slope, intercept = share.select("slope").scalar(), share.select("intercept").scalar()
    out = scenarios.withColumns({f: F.col(f).cast("double") for f in models.features})
    out = out.fillna(0.0, list(models.features))
    for model in (models.stops, models.orders, models.bill):
        out = model.transform(out).drop("features", "r1", "r2")
    return out.withColumns(
        {
            "stops": F.col("p_stops").cast("int"), "orders_on_step": F.col("p_orders"), "bill": F.col("p_bill"),
            "share_long": F.greatest(F.lit(0.0), F.least(F.lit(1.0), intercept + slope * F.col("step"))),
        }
    ).drop("p_stops", "p_orders", "p_bill")


def control_report(scored: DataFrame, facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fact against forecast per key: rides, drivers and GMV with relative errors."""
    forecast = ladder_outcome(scored, keys).select(*keys, *[F.col(c).alias(f"{c}_forecast") for c in ("rides", "drivers", "gmv", "fee", "contribution")])
    out = forecast.join(facts, list(keys))
    return out.withColumns(
        {f"{c}_error": F.try_divide((F.col(f"{c}_forecast") - F.col(c)).cast("double"), F.col(c).cast("double")) for c in ("rides", "drivers", "gmv") if c in facts.columns}
    )
