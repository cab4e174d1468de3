"""Small frame helpers shared by the operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def require_rows(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise ValueError("input frame has no rows")
    return df


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join in which null keys match; right keys are dropped. No keys: right must be one row."""
    if not keys:
        return left.join(right, F.lit(True), how)
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def dtype_of(df: DataFrame, column: str) -> str:
    return dict(df.dtypes)[column]


def shared_folder(spark) -> str:
    """The folder for intermediate tables: the one the cluster names in `spark.checkpoint.dir`.

    Only a local-mode session without that setting (tests) gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if spark.sparkContext.master.split("[")[0] != "local":  # local-cluster has executors of its own
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        global _local_folder
        if _local_folder is None:
            _local_folder = tempfile.mkdtemp(prefix="curbside-")
        folder = _local_folder
    return folder.rstrip("/")


_local_folder: str | None = None


def stable_checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage: write the frame once to the shared folder and read it back.

    The rows survive the loss of any executor, and the next plan starts from a plain scan.
    """
    path = f"{shared_folder(df.sparkSession)}/curbside-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sum_of(columns: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Hash-spread rows over spark.sql.shuffle.partitions tasks ahead of a CPU-heavy expansion.

    An explicit partition count is not coalesced at run time, so few but costly rows still use every core.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)
