"""Multiple-comparison correction over the p-values of one experiment (result-sized groups)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def benjamini_hochberg(
    results: DataFrame, keys: Sequence[str], confidence: float = 0.95, null_as_one: bool = False,
    pvalue: str = "pvalue",
) -> DataFrame:
    """Adds `pvalue_adj` and `is_significant_adj` per experiment.

    Null p-values are skipped, or counted as 1 with null_as_one.
    """
    p = F.coalesce(F.col(pvalue), F.lit(1.0)) if null_as_one else F.col(pvalue)
    df = results.withColumn("__p", p)
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    m = F.count("__p").over(part)
    # largest rank among equal p-values, so that ties share one value
    rank = F.count("__p").over(part.orderBy(F.asc_nulls_last("__p")))
    df = df.withColumn("__q", F.col("__p") * m / rank)
    downward = part.orderBy(F.desc_nulls_last("__p")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    adj = F.when(F.col("__p").isNotNull(), F.least(F.lit(1.0), F.min("__q").over(downward)))
    return df.withColumn("pvalue_adj", adj).withColumn(
        "is_significant_adj", (F.col("pvalue_adj") < 1 - confidence).cast("int")
    ).drop("__p", "__q")


def coloured(results: DataFrame, alpha: float = 0.01) -> DataFrame:
    """Rows that pass the adjusted level and have enough observations."""
    return results.filter((F.col("pvalue_adj") <= alpha) & (F.col("mde_ok") == 1))
