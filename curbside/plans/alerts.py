"""Campaign alerts: price health per city, campaign, polygon and slot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import null_safe_join
from ..functions.scalars import clip, safe_ratio
from ..operators.ranks import exact_quantiles, row_ranks

GRAIN = ("locality", "campaign_id", "campaign", "polygon")


def campaign_slots(trips: DataFrame, time_keys: Sequence[str], grain: Sequence[str] = GRAIN) -> DataFrame:
    """Mean surge, price, bill and incentive sums and order count per campaign, polygon and slot."""
    out = trips.groupBy(*grain, *time_keys).agg(
        F.avg(F.coalesce("surge", F.lit(1.0))).alias("surge"), F.sum("price").alias("price"), F.sum("bill").alias("bill"),
        F.sum("incentive").alias("incentive"), F.count("order_id").alias("orders"),
    )
    return out.withColumns(
        {"health": safe_ratio("price", F.col("bill") - F.col("incentive")), "old_price": safe_ratio("price", "orders")}
    )


def top_third_flag(df: DataFrame, keys: Sequence[str], measure: str, tie: Sequence[str]) -> DataFrame:
    """Rank by the measure inside the group and is_top = rank <= half-even round(n / 3)."""
    ranked = row_ranks(df, keys, [F.desc(measure), *[F.asc(t) for t in tie]], "trip_rank", "__rows")
    return ranked.withColumn("is_top", (F.col("trip_rank") <= F.bround(F.col("__rows") / 3)).cast("int")).drop("__rows")


def with_suggestions(slots: DataFrame, tie: Sequence[str], threshold_quantile: float = 0.5) -> DataFrame:
    """Adds the city threshold over its busiest third, the city order and surge medians and a price suggestion.

    The reduction towards the threshold is clipped to [0, 0.1] and the new price is rounded to tens.
    """
    ranked = top_third_flag(slots, ["locality"], "orders", tie)
    top = exact_quantiles(ranked.filter("is_top = 1"), ["locality"], "health", {"threshold": threshold_quantile})
    orders = exact_quantiles(slots, ["locality"], "orders", {"orders_median": 0.5})
    surge = exact_quantiles(slots, ["locality"], "surge", {"surge_median": 0.5})
    out = ranked
    for part in (top, orders, surge):
        out = null_safe_join(out, part, ["locality"], "left")
    out = out.withColumn("reduction", safe_ratio(F.col("health") - F.col("threshold"), "health"))
    out = out.withColumn("suggested_reduction", clip("reduction", 0.0, 0.1))
    return out.withColumn("new_price", F.bround(F.col("old_price") * (1 - F.col("suggested_reduction")), -1))


def daily_alerts(trips: DataFrame, max_health: float = 2.0, max_surge: float = 1.5, time_keys: Sequence[str] = ("slot",)) -> DataFrame:
    """Slots whose price health is too high while surge is low and orders exceed the city median."""
    tie = ("campaign_id", "polygon", *time_keys)
    rows = with_suggestions(campaign_slots(trips, time_keys), tie, 0.5)
    return rows.filter(
        (F.col("health") > max_health) & (F.col("surge") < max_surge) & (F.col("orders") > F.col("orders_median"))
    )


def weekly_alerts(trips: DataFrame, time_keys: Sequence[str] = ("week_day", "time")) -> DataFrame:
    """Slots above the 75th percentile of the busiest third, with surge and orders against the city medians."""
    tie = ("campaign_id", "polygon", *time_keys)
    rows = with_suggestions(campaign_slots(trips, time_keys), tie, 0.75)
    return rows.filter(
        (F.col("suggested_reduction") > 0) & (F.col("surge") < F.col("surge_median")) & (F.col("orders") > F.col("orders_median"))
    )


def message_lines(alerts: DataFrame, owners: DataFrame, time: str) -> DataFrame:
    """One text per city: campaigns, polygons and their slots. Cities without owners are skipped.

    Alert rows are result-grain: a polygon has at most one row per slot of a week.
    """
    slot = F.concat(F.col(time).cast("string"), F.lit(" - GH "), F.format_number("health", 2))
    polygon = alerts.groupBy("locality", "campaign_id", "campaign", "polygon").agg(
        F.array_join(F.sort_array(F.collect_list(slot)), ", ").alias("slots")
    )
    head = F.concat_ws(", ", F.col("campaign_id").cast("string"), F.col("campaign"), F.col("polygon"))
    lines = polygon.groupBy("locality").agg(
        F.array_join(F.sort_array(F.collect_list(F.concat(head, F.lit(": "), F.col("slots")))), "\n").alias("text")
    )
    return lines.join(owners, "locality").select(
        "locality", F.concat_ws("\n", F.concat(F.lit("city: "), F.col("locality").cast("string")), F.col("owners"), F.col("text")).alias("text")
    )
