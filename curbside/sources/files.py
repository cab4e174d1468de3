"""File sources and sinks chosen by suffix, SQL templates, id lists and label-row CSV folders."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import money_text, null_tokens

FORMATS = {".csv": "csv", ".parquet": "parquet", ".json": "json", ".orc": "orc"}


def _format(path: str, fmt: str | None) -> str:
    kind = fmt or FORMATS.get(os.path.splitext(path.rstrip("/"))[1].lower())
    if kind not in FORMATS.values():
        raise ValueError(f"unknown file format: {path}")
    return kind


def read_file(spark: SparkSession, path: str, schema=None, fmt: str | None = None, columns: Sequence[str] | None = None, **options) -> DataFrame:
    """Reads csv, parquet, json or orc by suffix; anything else raises."""
    kind = _format(path, fmt)
    reader = spark.read.options(**options)
    if kind == "csv":
        reader = reader.option("header", options.get("header", True))
    if kind == "json":
        reader = reader.option("multiLine", options.get("multiLine", True))
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.format(kind).load(path)
    return df.select(*columns) if columns else df


def save_file(df: DataFrame, path: str, fmt: str | None = None, mode: str = "errorifexists", partition_by: Sequence[str] = ()) -> None:
    kind = _format(path, fmt)
    writer = df.write.mode(mode)
    if kind == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.format(kind).save(path)


def export_summary(df: DataFrame, path: str) -> None:
    """One CSV file with a header, for result-sized summaries."""
    df.repartition(1).write.mode("overwrite").option("header", True).csv(path)


def copy_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Copies a table in slices (e.g. day x locality), replacing only the slices present in the frame."""
    rows = df.hint("rebalance", *partition_by)  # slices stay together, large ones are split by size at run time
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def run_template(spark: SparkSession, text: str, views: dict[str, DataFrame] | None = None, args: dict | None = None) -> DataFrame:
    """SQL text with named parameters (:name) over frames given as {view} placeholders; no string splicing of values."""
    return spark.sql(text, args=args or {}, **(views or {}))


def template_from_file(spark: SparkSession, path: str, views: dict[str, DataFrame] | None = None, args: dict | None = None) -> DataFrame:
    with open(path, encoding="utf-8") as f:
        return run_template(spark, f.read(), views, args)


def id_list(spark: SparkSession, path: str, key: str = "id") -> DataFrame:
    """Id list from CSV; the ids must be unique."""
    ids = spark.read.option("header", True).csv(path).select(F.col(key).cast("bigint").alias(key))
    if not ids.groupBy(key).count().filter("count > 1").isEmpty():
        raise ValueError(f"id list repeats values of {key}")
    return ids


def company_from_path(path: Column) -> Column:
    """File name up to the first underscore or dot."""
    return F.regexp_extract(path, r"([^/_.]+)[^/]*$", 1)


def label_row_folder(spark: SparkSession, folder: str, periods: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """Folder of CSVs with one label per row and one column per period -> (company, period, label columns).

    Labels are left-trimmed with spaces as underscores; figures may carry commas, ' M' or '-'.
    """
    raw = spark.read.option("header", True).csv(folder).withColumn("company", company_from_path(F.input_file_name()))
    first = raw.columns[0]
    label = F.regexp_replace(F.ltrim(F.col(first)), " ", "_")
    long = raw.select("company", label.alias("label"), *[F.col(f"`{p}`").alias(p) for p in periods]).unpivot(
        ["company", "label"], list(periods), "period", "raw"
    )
    value = money_text(null_tokens("raw"))
    return long.groupBy("company", "period").pivot("label", list(labels)).agg(F.first(value, ignorenulls=True))
