"""Feature builders the evaluations need: pre-aggregate each side, then join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ratio_or_zero, safe_ratio, slot_start
from .metrics import Agg, aggregate


def rfm_source(
    orders: DataFrame, user: str, region: str, ts: str, payments: DataFrame | None = None, amount: str = "amount",
    as_of: str = "", scale: float = 100.0,
) -> DataFrame:
    """Recency (days since the last order), frequency (orders per active week, rounded), monetary (-sum / scale)."""
    weeks = (
        orders.groupBy(region, user, F.date_trunc("week", ts).alias("__w"))
        .agg(F.count(F.lit(1)).alias("__n"), F.max(ts).alias("__last"))
        .groupBy(region, user)
        .agg(F.sum("__n").alias("__n"), F.count("__w").alias("__weeks"), F.max("__last").alias("__last"))
    )
    base = weeks.select(
        region, user,
        F.datediff(F.lit(as_of).cast("date"), F.col("__last")).alias("recency"),
        F.round(F.col("__n") / F.col("__weeks"), 2).alias("frequency"),
    )
    if payments is None:
        return base
    paid = payments.groupBy(user).agg((-F.sum(amount) / scale).alias("monetary"))
    return base.join(paid, user)


def activity_context(trips: DataFrame, user: str, ts: str, before: str) -> DataFrame:
    """First and last trip date and trip count per user before a date."""
    return (
        trips.filter(F.col(ts) < F.lit(before).cast("timestamp"))
        .groupBy(user)
        .agg(F.min(F.to_date(ts)).alias("dt_first"), F.max(F.to_date(ts)).alias("dt_last"), F.count(F.lit(1)).alias("trips"))
    )


def churn_flags(orders: DataFrame, keys: Sequence[str], ts: str, start: str, end: str, days: Sequence[int] = (7, 14, 21)) -> DataFrame:
    """Churned by day k: the last order inside [start, end] falls in the first k days of the window."""
    first = F.lit(start).cast("date")
    last = (
        orders.filter((F.col(ts) >= first) & (F.to_date(ts) <= F.lit(end).cast("date")))
        .groupBy(*keys)
        .agg(F.max(F.to_date(ts)).alias("last_date"))
    )
    return last.select(
        *keys, "last_date",
        *[
            F.when(F.col("last_date").between(first, F.date_add(first, k - 1)), 1).otherwise(0).alias(f"churn_{k}day")
            for k in days
        ],
    )


def offers_to_rides(offers: DataFrame, rides: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Offer and ride counts per key from separately aggregated sides."""
    o = offers.groupBy(*keys).agg(F.count(F.lit(1)).alias("offers"))
    r = rides.groupBy(*keys).agg(F.count(F.lit(1)).alias("rides"))
    return o.join(r, list(keys), "left").withColumn("rides", F.coalesce("rides", F.lit(0)))


def contribution_economics(trips: DataFrame, keys: Sequence[str], gmv: str, commission: str, incentive: str) -> DataFrame:
    """Rides, sums and per-trip economics: contribution = commission - incentive."""
    out = trips.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rides"), F.sum(gmv).alias("gmv"), F.sum(commission).alias("commission"),
        F.sum(incentive).alias("di"), (F.sum(commission) - F.sum(incentive)).alias("contribution"),
    )
    return out.withColumns(
        {
            "copt": safe_ratio("contribution", "rides"), "dipt": safe_ratio("di", "rides"),
            "compt": safe_ratio("commission", "rides"), "gmvpt": safe_ratio("gmv", "rides"),
        }
    )


def money_per_hour(
    users: DataFrame, key: str, money: DataFrame, hours: DataFrame, trips: DataFrame
) -> DataFrame:
    """Gross and net money, supply hours and trips per user; each side is already one row per user."""
    out = users.join(money, key, "left").join(hours, key, "left").join(trips, key, "left")
    fills = [c for c in out.columns if c not in users.columns]
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in fills})


def market_context(orders: DataFrame, ts: str, user: str, bill: str, distance: str, commission: str) -> DataFrame:
    """Daily market figures. A non-positive bill counts as 1 in GMV."""
    price = F.when(F.col(bill) <= 0, F.lit(1.0)).otherwise(F.col(bill))
    long = F.col(distance) > 6
    daily = aggregate(
        orders.select(
            F.to_date(ts).alias("date"), F.col(user).alias("user"), price.alias("gmv"), F.col(commission).alias("commission"),
            long.alias("long"), F.col(bill).alias("bill"),
        ),
        ["date"],
        {
            "orders": Agg("*", "count"), "active_drivers": Agg("user", "nunique"), "gmv": Agg("gmv", "sum"),
            "commission": Agg("commission", "sum"), "long_orders": Agg("*", "count", ("long",)),
            "avg_price_long": Agg("bill", "mean", ("long",)), "avg_price_short": Agg("bill", "mean", ("not long",)),
        },
    )
    return daily.withColumns(
        {
            "share_long": safe_ratio("long_orders", "orders"), "commission_share": safe_ratio("commission", "gmv"),
            "is_weekend": F.when(F.weekday("date") >= 5, 1).otherwise(0),
        }
    )


def operational_ratios(df: DataFrame, day: Column, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Daily ratio of sums for each name -> (numerator, denominator), guarded against zero."""
    return df.groupBy(day.alias("ds")).agg(
        *[ratio_or_zero(F.sum(x), F.sum(y)).alias(n) for n, (x, y) in pairs.items()]
    )


def stage_funnel(df: DataFrame, day: Column, user: str, stages: dict[str, str]) -> DataFrame:
    """Distinct users per day and stage predicate, in one pass."""
    return aggregate(
        df.withColumn("date", day), ["date"], {name: Agg(user, "nunique", (pred,)) for name, pred in stages.items()}
    )


def view_funnel(
    views: DataFrame, orders: DataFrame, view_id: str, keys: Sequence[str], ts: str, minutes: int = 20
) -> DataFrame:
    """Views left-joined to their orders, per slot and keys: views (distinct users), orders, rides, bill, discount.

    `views` has user and discounts (array of amounts); `orders` has order_id, status and client_bill.
    Rides are orders not cancelled (CC, NC); bill and discount count completed (CP) orders only.
    """
    sale = F.aggregate("discounts", F.lit(0.0), lambda s, x: s + x)
    joined = views.join(orders, view_id, "left").withColumns({"sale_part": sale, "dt": slot_start(ts, minutes)})
    return aggregate(
        joined, [*keys, "dt"],
        {
            "views": Agg("user", "nunique"),
            "orders": Agg("order_id", "nunique", ("order_id > 0",)),
            "rides": Agg("order_id", "nunique", ("order_id > 0", "status not in ('CC', 'NC')")),
            "client_bill": Agg("client_bill", "sum", ("status = 'CP'",)),
            "sale_part_ride": Agg("sale_part", "sum", ("sale_part > 0", "status = 'CP'")),
        },
    )


def monthly_shares(df: DataFrame, ts: str, measures: Sequence[str]) -> DataFrame:
    """Monthly sums of the measures and each one's share of their total."""
    monthly = df.groupBy(F.date_trunc("month", ts).alias("month")).agg(*[F.sum(m).alias(m) for m in measures])
    total = sum((F.col(m) for m in measures[1:]), F.col(measures[0]))
    return monthly.withColumns({f"{m}_share": safe_ratio(m, total) for m in measures})


def bin_study(df: DataFrame, bin_col: Column, totals: Sequence[str], ratios: dict[str, tuple[str, str]]) -> DataFrame:
    return df.groupBy(bin_col.alias("bin")).agg(
        F.count(F.lit(1)).alias("rows"), *[F.sum(t).alias(t) for t in totals],
        *[safe_ratio(F.sum(x), F.sum(y)).alias(n) for n, (x, y) in ratios.items()],
    )
