"""Result tables, run markers and request status: append-only logs with a current-state view."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUSES = ("PENDING", "IN_PROGRESS", "READY", "FAILED")


def due_regions(regions: DataFrame, runs: DataFrame, key: str, run_date: str, today: str | None = None) -> DataFrame:
    """Regions whose last run is before today; never-run regions count as run in year 1."""
    day: Column = F.lit(today).cast("date") if today else F.current_date()
    last = runs.groupBy(key).agg(F.max(run_date).alias("last_run"))
    never = F.lit("0001-01-01").cast("date")
    return (
        regions.join(last, key, "left")
        .withColumn("last_run", F.coalesce(F.col("last_run"), never))
        .filter(F.col("last_run") < day)
    )


def run_marker(regions: DataFrame, key: str, type_id: int, date: str, version: str) -> DataFrame:
    """One (type, region, date, created, version) row per region."""
    return regions.select(
        F.lit(type_id).alias("type_id"), F.col(key).alias("region_id"), F.lit(date).cast("date").alias("date"),
        F.current_timestamp().alias("created"), F.lit(version).alias("version"),
    )


def current_status(log: DataFrame, request: str = "id", status: str = "status", ts: str = "ts") -> DataFrame:
    """Latest status of each request in an append-only status log."""
    return log.groupBy(request).agg(F.max_by(status, ts).alias(status), F.max(ts).alias(ts))


def status_row(spark, request_id: int, status: str) -> DataFrame:
    if status not in STATUSES:
        raise ValueError(f"unknown status: {status}")
    return spark.createDataFrame([(request_id, status)], "id bigint, status string").withColumn("ts", F.current_timestamp())


def newest_pending(requests: DataFrame, status: str = "status", created: str = "created_dt") -> DataFrame:
    """The newest PENDING request (a one-row frame)."""
    return requests.filter(F.col(status) == "PENDING").orderBy(F.desc(created)).limit(1)


def validated_request(requests: DataFrame, limit_range: tuple[int, int], period_range: tuple[int, int]) -> DataFrame:
    """Adds `valid`: the spend limit and training period lie inside their bounds."""
    ok = F.col("limit_sum").between(*limit_range) & F.col("train_period").between(*period_range)
    return requests.withColumn("valid", F.coalesce(ok, F.lit(False)))


def sources_fresh(frames: Sequence[tuple[DataFrame, str]], start: str, end: str) -> DataFrame:
    """One row: 1 when every source covers [start, end], else 0."""
    checks = None
    for df, column in frames:
        covered = (F.min(F.to_date(column)) <= F.lit(start).cast("date")) & (
            F.max(F.to_date(column)) >= F.lit(end).cast("date")
        )
        one = df.agg(F.coalesce(covered, F.lit(False)).cast("int").alias("ok"))
        checks = one if checks is None else checks.unionByName(one)
    return checks.agg((F.sum("ok") == len(frames)).cast("int").alias("flag_data_source_no_problems"))


def append_results(tables: dict[str, DataFrame], columns: dict[str, Sequence[str]], database: str | None = None,
                   partition_by: dict[str, Sequence[str]] | None = None) -> None:
    """Appends several result frames by table name, each with its fixed column list."""
    for name, df in tables.items():
        target = f"{database}.{name}" if database else name
        writer = df.select(*columns[name]).write.mode("append")
        parts = (partition_by or {}).get(name)
        if parts:
            writer = writer.partitionBy(*parts)
        writer.saveAsTable(target)
