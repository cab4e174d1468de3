"""Payout ladders: parsing, forward fill over steps, step deltas, scenario rows and outcome."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import attractive_payout


def parse_ladders(df: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """JSON list of {"steps": {"1": 165, ...}} to (keys, variant, step, payout) rows."""
    parsed = F.from_json(F.col(text), "array<struct<steps:map<string,double>>>")
    variants = df.select(*keys, F.posexplode(parsed).alias("variant", "__l"))
    steps = variants.select(*keys, "variant", F.explode("__l.steps").alias("step", "payout"))
    return steps.withColumn("step", F.col("step").cast("int"))


def filled_ladder(ladder: DataFrame, keys: Sequence[str], last_step: int = 65) -> DataFrame:
    """Payout at every step 0..last_step: the payout of the nearest lower or equal step, else 0.

    Each given step covers the range up to the key's next step, so rows are produced by an
    explode of ranges. A ladder has at most one row per step.
    """
    w = Window.partitionBy(*keys).orderBy("step")
    first = ladder.groupBy(*keys).agg(F.min("step").alias("step")).filter(F.col("step") > 0)
    start = first.select(*keys, F.lit(0).alias("step"), F.lit(0.0).alias("payout"))
    full = ladder.select(*keys, F.col("step").cast("int").alias("step"), F.col("payout").cast("double")).unionByName(start)
    until = F.coalesce(F.lead("step").over(w) - 1, F.lit(last_step))
    spans = full.withColumn("__until", F.least(until, F.lit(last_step))).filter(F.col("step") <= F.col("__until"))
    return spans.select(*keys, F.explode(F.sequence("step", "__until")).alias("step"), "payout")


def step_deltas(full: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Absolute payout difference to the neighbouring steps and the round-sum flag."""
    w = Window.partitionBy(*keys).orderBy("step")
    return full.withColumns(
        {
            "prev_step_delta": F.abs(F.col("payout") - F.lag("payout").over(w)),
            "next_step_delta": F.abs(F.col("payout") - F.lead("payout").over(w)),
            "is_attractive": attractive_payout("payout"),
        }
    )


def scenario_rows(ladders: DataFrame, keys: Sequence[str], context: DataFrame, steps: tuple[int, int] = (1, 60)) -> DataFrame:
    """Scenario frame: every ladder step with its deltas and the figures of one context row (one day's market)."""
    rows = step_deltas(filled_ladder(ladders, keys, steps[1] + 1), keys).filter(F.col("step").between(*steps))
    return rows.withColumns({c: context.select(c).scalar() for c in context.columns})


def ladder_outcome(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Outcome per scenario from model scores.

    `scored` has step, payout, stops (0/1 class), orders_on_step, bill, share_long, active_drivers,
    avg_price_long, avg_price_short, commission_share, other_incentives. Drivers on a step are the whole multiple of the step in the
    predicted orders, rescaled to the active drivers; the fee is the payout not covered by the bill.
    """
    step = F.col("step")
    kept = scored.filter(F.col("stops") == 1).withColumn("__raw", F.floor(F.col("orders_on_step") / step))
    share = F.try_divide(F.col("__raw"), F.sum("__raw").over(Window.partitionBy(*keys)))  # rows of one ladder: <= 60
    drivers = F.col("__d")
    long = F.floor(step * F.round("share_long", 3)) * F.col("avg_price_long")
    short = F.floor(step * (1 - F.round("share_long", 3))) * F.col("avg_price_short")
    rows = kept.withColumn("__d", share * F.col("active_drivers")).withColumns(
        {
            "fee": F.greatest((F.col("payout") - F.col("bill")) * drivers, F.lit(0.0)),
            "drivers": F.floor(drivers), "gmv": (long + short) * F.floor(drivers),
        }
    )
    out = rows.groupBy(*keys).agg(
        F.sum(step * F.col("drivers")).alias("rides"), F.sum("drivers").alias("drivers"), F.sum("gmv").alias("gmv"),
        F.sum("fee").alias("fee"), F.max("commission_share").alias("__c"), F.max("other_incentives").alias("__o"),
    )
    contribution = F.col("gmv") * F.col("__c") - F.col("fee") - F.col("__o")
    return out.withColumns(
        {
            "tpd": F.try_divide(F.col("rides"), F.col("drivers")), "di_gmv": F.try_divide(-F.col("fee"), F.col("gmv")),
            "dipt": F.try_divide(-F.col("fee"), F.col("rides")), "contribution": contribution,
            "contribution_gmv": F.try_divide(contribution, F.col("gmv")),
        }
    ).drop("__c", "__o")
