"""Structured Streaming versions of two batch reports; the same columns as the batch functions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import null_safe_join
from ..functions.scalars import safe_ratio


def closable(events: DataFrame, ts: str, folder: str) -> DataFrame:
    """The stream together with the closing rows that `run_and_close` writes to `folder`: a time and nothing else.

    The folder may be empty. A closing row only moves the watermark; the windows it falls into never close.
    """
    spark = events.sparkSession
    spark.createDataFrame([], f"{ts} timestamp").write.mode("append").parquet(folder)  # the source needs a folder
    closing = spark.readStream.schema(f"{ts} timestamp").parquet(folder)
    return events.unionByName(closing, allowMissingColumns=True)


def streamed_view_funnel(events: DataFrame, ts: str, group: Sequence[str], user: str, kind: str, value: str, minutes: int = 20, late: str = "1 hour") -> DataFrame:
    """20-minute funnel per group: distinct users, views, orders, rides and bill.

    Two chained stateful steps: figures of each user in a window, then the window's sums over its users, so that users
    are counted exactly and a user's many events travel once.
    """
    is_kind = lambda k: F.col(kind) == k
    window = f"{minutes} minutes"
    users = (
        events.withWatermark(ts, late)
        .groupBy(F.window(ts, window).alias("w"), *group, F.col(user).alias("user"))
        .agg(
            F.count_if(is_kind("view")).alias("views"), F.count_if(is_kind("click")).alias("orders"),
            F.count_if(is_kind("purchase")).alias("rides"), F.sum(F.when(is_kind("purchase"), F.col(value))).alias("bill"),
        )
    )
    return (
        users.groupBy(F.window(F.window_time("w"), window).alias("w2"), *group)
        .agg(F.count("user").alias("users"), *[F.sum(c).alias(c) for c in ("views", "orders", "rides", "bill")])
        .select(F.col("w2.start").alias("dt"), *group, "users", "views", "orders", "rides", "bill")
    )


def streamed_price_health(trips: DataFrame, ts: str, keys: Sequence[str], thresholds: DataFrame, on: Sequence[str], minutes: int = 30, late: str = "1 hour") -> DataFrame:
    """30-minute price health per campaign slot joined to static thresholds (columns max_health, max_surge, min_orders)."""
    slots = (
        trips.withWatermark(ts, late)
        .groupBy(F.window(ts, f"{minutes} minutes").alias("w"), *keys)
        .agg(
            F.avg(F.coalesce("surge", F.lit(1.0))).alias("surge"), F.sum("price").alias("price"), F.sum("bill").alias("bill"),
            F.sum("incentive").alias("incentive"), F.count("order_id").alias("orders"),
        )
        .select(F.col("w.start").alias("slot"), *keys, "surge", "price", "bill", "incentive", "orders")
        .withColumn("health", safe_ratio("price", F.col("bill") - F.col("incentive")))
    )
    # null-safe: a plain join would push `key is not null` below the watermark and with it drop closing rows
    return null_safe_join(slots, thresholds, list(on)).filter(
        (F.col("health") > F.col("max_health")) & (F.col("surge") < F.col("max_surge")) & (F.col("orders") > F.col("min_orders"))
    )


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over all available input into parquet and stops (exactly once through the checkpoint)."""
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


CLOSING_TIME = "9000-01-01 00:00:00"


def run_and_close(stream: DataFrame, path: str, checkpoint: str, ts: str, folder: str) -> None:
    """Runs a stream made `closable` over all input, then closes its open windows: for input that has come to its end.

    The closing row goes through the same checkpoint, so each window comes out once, early or late. Input that comes
    after it is late.
    """
    run_to_end(stream, path, checkpoint)
    spark = stream.sparkSession
    spark.createDataFrame([(CLOSING_TIME,)], "t string").select(F.col("t").cast("timestamp").alias(ts)).coalesce(1).write.mode("append").parquet(folder)
    run_to_end(stream, path, checkpoint)


def each_batch(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> None:
    """The same with a function per micro-batch (e.g. an alert table append keyed by batch id)."""
    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
