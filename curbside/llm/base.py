"""Registry of the corpus queries, table readers and written intermediates."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def query(name: str, sql: str | None = None):
    """Registers a (spark, sf_dir) -> DataFrame query and, where SQL can express it, the equal SQL."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query: {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Scratch:
    """Tables written between the steps of one operator, in the folder that all executors share.

    `write` cuts lineage: a lost executor costs only the tasks that ran on it. `drop` deletes a table that no
    later step reads; what the returned frame still reads stays.
    """

    _own: str | None = None

    def __init__(self, spark: SparkSession, name: str):
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if spark.sparkContext.master.split("[")[0] != "local":
                raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
            Scratch._own = Scratch._own or tempfile.mkdtemp(prefix="corpus-")
            folder = Scratch._own
        self.spark = spark
        self.root = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path, compression=compression)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


    def settle(self) -> None:
        """Lets Spark delete shuffle files of steps whose results are written; it does so for plans nobody holds any more."""
        for _ in range(2):  # the first round may come before Spark's own listeners have let go
            gc.collect()
            self.spark._jvm.System.gc()
            time.sleep(0.0 if self.spark.sparkContext.master.split("[")[0] == "local" else 1.0)


@contextmanager
def rows_per_batch(spark: SparkSession, n: int) -> Iterator[None]:
    """For actions inside: record batches of n rows, where a row holds much data."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(n))
    try:
        yield
    finally:
        spark.conf.set(key, before)


TEXTS = 1000  # whole texts that a task turns to Python objects at once, where they are long


def slices(batches: Iterator[pa.RecordBatch], rows: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batches, or their parts of at most `rows` rows; empty ones are left out."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows or batch.num_rows or 1):
            yield batch.slice(start, rows or batch.num_rows)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, rows: int | None = None) -> DataFrame:
    """One record batch out for each one in, or for each `rows` rows of it; tasks never hold more than a batch."""

    def run(batches):
        for batch in slices(batches, rows):
            yield fn(batch)

    return df.mapInArrow(run, schema)


def clean_ids(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, whatever else the frame carries."""
    return df.select(*[F.col(f"`{c}`") for c in columns])
