"""JDBC reads and appends (row store and column stores). Connection options come from the caller's configuration."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class JdbcTarget:
    url: str
    driver: str | None = None
    properties: dict[str, str] = field(default_factory=dict)

    def options(self) -> dict[str, str]:
        base = {"url": self.url, **self.properties}
        if self.driver:
            base["driver"] = self.driver
        return base


def fetch(spark: SparkSession, target: JdbcTarget, query: str, fetch_size: int = 10_000) -> DataFrame:
    """Result of a query."""
    return spark.read.format("jdbc").options(**target.options(), query=query, fetchsize=str(fetch_size)).load()


def fetch_table(
    spark: SparkSession, target: JdbcTarget, table: str, partition_column: str, lower: str, upper: str, partitions: int, fetch_size: int = 10_000
) -> DataFrame:
    """Parallel read of a big table by ranges of a numeric, date or timestamp column."""
    return spark.read.format("jdbc").options(
        **target.options(), dbtable=table, partitionColumn=partition_column, lowerBound=lower, upperBound=upper,
        numPartitions=str(partitions), fetchsize=str(fetch_size),
    ).load()


def insertable(df: DataFrame, fields: Sequence[str] | None = None, drop_fraction: bool = True) -> DataFrame:
    """Frame ready to append: chosen fields, NaN as null, timestamps cut to seconds. No columns or no rows raise."""
    names = list(fields if fields is not None else df.columns)
    if not names:
        raise ValueError("no fields to insert")
    kinds = dict(df.dtypes)
    out = []
    for n in names:
        if n not in kinds:
            out.append(F.lit(None).cast("string").alias(n))
        elif kinds[n] in ("double", "float"):
            out.append(F.when(~F.isnan(n), F.col(n)).alias(n))
        elif kinds[n].startswith("timestamp") and drop_fraction:
            out.append(F.date_trunc("second", n).alias(n))
        else:
            out.append(F.col(n))
    ready = df.select(*out)
    if ready.isEmpty():
        raise ValueError("no rows to insert")
    return ready


def insert_frame(df: DataFrame, target: JdbcTarget, table: str, fields: Sequence[str] | None = None, batch: int = 1000, writers: int = 8) -> None:
    """Appends a frame in batches over a bounded number of connections."""
    insertable(df, fields).repartition(writers).write.format("jdbc").options(
        **target.options(), dbtable=table, batchsize=str(batch)
    ).mode("append").save()
