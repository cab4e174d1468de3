"""RFM segmentation per region: transform, optimal 1-D k-means per figure, code and segment lookup.

Users are counted in a fixed number of bins per (region, figure); the fit runs on those counts, so a large region
costs no more than a small one. Digits are expressions over the region's parameters.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import null_safe_join, stable_checkpoint

FIGURES = ("recency", "frequency", "monetary")

# Code (recency, frequency, monetary digits; 3 is best) -> (3-level segment, 5-level segment): fixed values.
SEGMENT_CODES = {
    "000": (0, 0), "001": (0, 0), "002": (0, 0), "003": (0, 1),
    "010": (0, 0), "011": (0, 0), "012": (0, 1), "013": (2, 2),
    "020": (0, 0), "021": (2, 2), "022": (2, 2), "023": (2, 3),
    "030": (4, 1), "031": (4, 3), "032": (4, 3), "033": (4, 4),
    "100": (0, 0), "101": (0, 0), "102": (0, 1), "103": (2, 2),
    "110": (0, 0), "111": (0, 0), "112": (0, 1), "113": (0, 2),
    "120": (2, 1), "121": (2, 2), "122": (2, 3), "123": (2, 3),
    "130": (4, 1), "131": (4, 2), "132": (4, 3), "133": (4, 4),
    "200": (0, 0), "201": (0, 0), "202": (2, 2), "203": (2, 3),
    "210": (0, 1), "211": (0, 1), "212": (0, 2), "213": (0, 3),
    "220": (2, 1), "221": (2, 2), "222": (2, 3), "223": (2, 3),
    "230": (4, 1), "231": (4, 3), "232": (4, 3), "233": (4, 4),
    "300": (0, 0), "301": (0, 1), "302": (2, 2), "303": (2, 2),
    "310": (0, 1), "311": (2, 2), "312": (2, 3), "313": (2, 2),
    "320": (2, 1), "321": (2, 2), "322": (2, 3), "323": (2, 3),
    "330": (2, 2), "331": (2, 3), "332": (2, 3), "333": (4, 4),
}


BINS = 1024  # equal-width bins of ln(x + 1) that a figure of a region is counted in


def code_table(spark) -> DataFrame:
    rows = [(c, a, b) for c, (a, b) in SEGMENT_CODES.items()]
    return spark.createDataFrame(rows, "code string, segment_3 int, segment_5 int")


def yeo_johnson(x: np.ndarray, lam: np.ndarray) -> np.ndarray:
    """Yeo-Johnson transform; the limits at lambda 0 and 2 are logarithms."""
    power = np.where(x >= 0, lam, 2 - lam)
    log = np.log1p(np.abs(x))
    flat = np.abs(power) < 1e-12
    return np.where(x >= 0, 1, -1) * np.where(flat, log, np.expm1(log * power) / np.where(flat, 1.0, power))


def best_lambda(x: np.ndarray, n: np.ndarray, grid: np.ndarray) -> tuple[float, float, float]:
    """Lambda of the grid with the largest likelihood of x counted n times (ties: the smallest), with mean and variance there."""
    y = yeo_johnson(x[None, :], grid[:, None])
    total = n.sum()
    mean = y @ n / total
    var = ((y - mean[:, None]) ** 2) @ n / total
    likelihood = -total / 2 * np.log(np.maximum(var, 1e-300)) + (grid - 1) * (n @ (np.sign(x) * np.log1p(np.abs(x))))
    k = int(np.argmax(likelihood))
    return float(grid[k]), float(mean[k]), float(var[k])


def optimal_cuts(z: np.ndarray, n: np.ndarray, k: int) -> list[int]:
    """Positions in ascending z where a new cluster begins: the k-means with the least squared distance, by dynamic programming.

    Fewer than k values are a cluster each. Of equally good cuts the first counts.
    """
    k = min(k, len(z))
    w, s, q = (np.concatenate([[0.0], np.cumsum(v)]) for v in (n, n * z, n * z * z))
    weight = w[None, 1:] - w[:-1, None]  # of values i..j
    upper = np.triu(np.ones((len(z), len(z)), bool))
    cost = np.where(upper, (q[None, 1:] - q[:-1, None]) - (s[None, 1:] - s[:-1, None]) ** 2 / np.where(upper, weight, 1.0), np.inf)
    best, came = cost[0].copy(), []
    for _ in range(1, k):
        tried = np.where(np.arange(len(z))[:, None] > 0, np.concatenate([[np.inf], best[:-1]])[:, None] + cost, np.inf)
        came.append(tried.argmin(0))
        best = tried.min(0)
    cuts, at = [], len(z) - 1
    for back in reversed(came):
        first = int(back[at])
        cuts.append(first)
        at = first - 1
    return cuts[::-1]


def _bin(x: Column, low: Column, high: Column) -> Column:
    """Number of the equal-width bin of [low, high]; one bin where all values are equal."""
    at = F.floor(F.try_divide(x - low, high - low) * BINS)
    return F.coalesce(F.least(F.greatest(at, F.lit(0)), F.lit(BINS - 1)), F.lit(0)).cast("int")


def _value(figure: str) -> Column:
    """ln(x + 1); null where the figure is null or not a number."""
    x = F.log1p(F.col(figure).cast("double"))
    return F.when(~F.isnan(x), x)


def rfm_parameters(source: DataFrame, key: str = "region_id", user: str = "driver_id", k: int = 4, min_users: int = 10) -> DataFrame:
    """(key, and for each figure <f>_low, <f>_high, <f>_cuts: bins where a new cluster begins) of regions with more than min_users users.

    Two passes over the users, each with a map-side combine: ranges of the figures, then counts in BINS bins. The fit
    (lambda on a grid of 0.1 over [-4, 4], refined to 0.005; standardised values; optimal one-dimensional clusters)
    sees at most BINS numbers of a region and figure, whatever its users.
    """
    ranges = [g(_value(f)).alias(f"{f}_{n}") for f in FIGURES for g, n in ((F.min, "low"), (F.max, "high"))]
    spans = stable_checkpoint(source.groupBy(key).agg(F.count(user).alias("__users"), *ranges).filter(F.col("__users") > min_users).drop("__users"))
    binned = null_safe_join(source.select(key, *FIGURES), spans, [key])
    cells = F.array(*[F.struct(F.lit(f).alias("figure"), _value(f).alias("x"), _bin(_value(f), F.col(f"{f}_low"), F.col(f"{f}_high")).alias("bin")) for f in FIGURES])
    counts = binned.select(key, F.explode(cells).alias("c")).select(key, "c.*").filter("x IS NOT NULL").groupBy(key, "figure", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("total"))
    coarse, fine = np.arange(-40, 41) / 10, np.arange(-20, 21) * 0.005

    def fit(group):
        group = group.sort_by("bin")
        n, bins = group.column("n").to_numpy().astype(np.float64), group.column("bin").to_numpy()
        x = group.column("total").to_numpy() / n
        lam, mean, var = best_lambda(x, n, np.round(best_lambda(x, n, coarse)[0] + fine, 3))
        z = (yeo_johnson(x, np.float64(lam)) - mean) / np.sqrt(var) if var > 0 else np.zeros(len(x))
        cuts = [int(bins[c]) for c in optimal_cuts(z, n, k)] if var > 0 else []
        return pa.table({key: group.column(key).slice(0, 1), "figure": group.column("figure").slice(0, 1), "cuts": pa.array([cuts], pa.list_(pa.int32()))})

    fitted = counts.groupBy(key, "figure").applyInArrow(fit, f"`{key}` {dict(source.dtypes)[key]}, figure string, cuts array<int>")
    wide = fitted.groupBy(key).agg(*[F.first(F.when(F.col("figure") == f, F.col("cuts")), ignorenulls=True).alias(f"{f}_cuts") for f in FIGURES])
    return stable_checkpoint(null_safe_join(spans, wide, [key], "left"))


def _at_most(limit: Column):
    return lambda c: c <= limit


def with_digits(source: DataFrame, parameters: DataFrame, key: str = "region_id", k: int = 4) -> DataFrame:
    """Adds <f>_segment_id, code and segments: a figure's cuts at or below its bin are counted. Recency digits descend.

    Regions without parameters, and users with a null figure, have a null code.
    """
    out = null_safe_join(source, parameters, [key], "left")
    for f in FIGURES:
        passed = F.size(F.filter(f"{f}_cuts", _at_most(_bin(_value(f), F.col(f"{f}_low"), F.col(f"{f}_high")))))
        digit = F.when(_value(f).isNotNull() & F.col(f"{f}_cuts").isNotNull(), passed)
        out = out.withColumn(f"{f}_segment_id", (k - 1 - digit if f == "recency" else digit).cast("int"))
    code = F.concat(*[F.col(f"{f}_segment_id").cast("string") for f in FIGURES])
    named = out.withColumn("code", code).select(*source.columns, *[f"{f}_segment_id" for f in FIGURES], "code")
    return named.join(F.broadcast(code_table(source.sparkSession)), "code", "left")  # 64 codes


def rfm_segments(source: DataFrame, key: str = "region_id", user: str = "driver_id", k: int = 4, min_users: int = 10) -> DataFrame:
    """Adds cluster digits and segments per user. Regions with min_users users or fewer get null segments.

    ln(x + 1) -> Yeo-Johnson -> standardise -> k-means(k) in one dimension; what is shipped to the users is the region's parameters.
    """
    return with_digits(source, rfm_parameters(source, key, user, k, min_users), key, k)


def segment_output(segments: DataFrame, date: str, levels: int = 5, key: str = "region_id", user: str = "driver_id") -> DataFrame:
    """Result projection: date, locality, user, three digits and the segment."""
    return segments.select(
        F.lit(date).cast("date").alias("date"), F.col(key).alias("locality_id"), F.col(user).alias("driver_id"),
        *[f"{f}_segment_id" for f in FIGURES], F.col(f"segment_{levels}").alias("segment_id"),
    )
