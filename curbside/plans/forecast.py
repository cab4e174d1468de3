"""Forecast per series: ridge on trend, changepoints, Fourier terms, event flags and regressors.

Features are Spark columns. One series is one group: a row per period, so its size is
bounded by the history's length, whatever the raw data's volume.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.temporal import drop_last_period

PERIOD_SECONDS = {"hour": 3600, "day": 86400}


@dataclass(frozen=True)
class ForecastSpec:
    """freq: hour or day; seasonality: period in days -> Fourier order; horizon in periods."""

    freq: str = "day"
    horizon: int = 7
    seasonality: dict[float, int] = field(default_factory=lambda: {7.0: 3})
    changepoints: int = 8
    regressors: tuple[str, ...] = ()
    flags: tuple[str, ...] = ()
    ridge: float = 1.0
    interval: float = 0.95
    version: str = "ridge_01"


# Horizons and frequencies of the job's variants.
HOURLY_VIEWS = ForecastSpec("hour", 168, {1.0: 8, 7.0: 3}, version="views_hourly")
HOURLY_DRIVERS = ForecastSpec("hour", 170, {1.0: 8, 7.0: 3}, version="drivers_hourly")
HOURLY_RIDES = ForecastSpec("hour", 169, {1.0: 8, 7.0: 3}, version="rides_hourly")
SHORT_HOURLY_VIEWS = ForecastSpec("hour", 49, {1.0: 8, 7.0: 3}, version="views_hourly_short")
DAILY_VIEWS = ForecastSpec("day", 7, {7.0: 3, 30.5: 3}, version="views_daily")


def history(df: DataFrame, keys: Sequence[str], ts: str, freq: str, value=None) -> DataFrame:
    """(keys, ds, y): rows (or a summed value) per period, without the newest, incomplete period."""
    y = F.count(F.lit(1)) if value is None else F.sum(value)
    series = df.groupBy(*keys, F.date_trunc(freq, ts).alias("ds")).agg(y.cast("double").alias("y"))
    return drop_last_period(series, "ds", keys)


def with_horizon(series: DataFrame, keys: Sequence[str], spec: ForecastSpec) -> DataFrame:
    """History plus `horizon` future periods with null y."""
    step = PERIOD_SECONDS[spec.freq]
    last = series.groupBy(*keys).agg(F.max("ds").alias("__last"))
    future = last.select(*keys, F.explode(F.sequence(F.lit(1), F.lit(spec.horizon))).alias("__i"), "__last").select(
        *keys, F.timestamp_add("SECOND", F.col("__i") * step, F.col("__last")).alias("ds"), F.lit(None).cast("double").alias("y")
    )
    return series.select(*keys, "ds", "y").unionByName(future)


def load_regressors(series: DataFrame, regressors: DataFrame, names: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Left join of the wanted regressor columns."""
    return series.join(regressors.select(*keys, "ds", *names), [*keys, "ds"], "left")


def features(df: DataFrame, keys: Sequence[str], spec: ForecastSpec, fill_missing: bool = True) -> DataFrame:
    """Adds the feature array: trend and changepoints scaled to the history, Fourier terms, flags, regressors."""
    bounds = df.filter(F.col("y").isNotNull()).groupBy(*keys).agg(F.min("ds").alias("__a"), F.max("ds").alias("__b"))
    out = df.join(bounds, list(keys)) if keys else df.join(bounds)
    seconds = lambda c: F.unix_timestamp(F.col(c)).cast("double")
    t = F.coalesce(F.try_divide(seconds("ds") - seconds("__a"), seconds("__b") - seconds("__a")), F.lit(0.0))
    cols = [F.lit(1.0), F.col("__t")]
    # changepoints sit in the first 80 percent of the history
    for i in range(1, spec.changepoints + 1):
        cols.append(F.greatest(F.lit(0.0), F.col("__t") - 0.8 * i / (spec.changepoints + 1)))
    days = seconds("ds") / 86400.0
    for period, order in spec.seasonality.items():
        for k in range(1, order + 1):
            angle = days * (2 * math.pi * k / period)
            cols += [F.sin(angle), F.cos(angle)]
    for name in (*spec.flags, *spec.regressors):
        c = F.col(name).cast("double")
        cols.append(F.coalesce(c, F.lit(0.0)) if fill_missing else c)
    return out.withColumn("__t", t).withColumn("features", F.array(*cols)).select(*keys, "ds", "y", "features")


def _fit_one(pdf: pd.DataFrame, ridge: float, interval: float) -> pd.DataFrame:
    known = pdf["y"].notna().to_numpy()
    x = np.array(pdf["features"].tolist(), dtype=float)
    y = pdf.loc[known, "y"].to_numpy(dtype=float)
    penalty = np.eye(x.shape[1]) * ridge
    penalty[0, 0] = 1e-9
    xk = x[known]
    beta = np.linalg.solve(xk.T @ xk + penalty, xk.T @ y)
    yhat = x @ beta
    low, high = np.quantile(y - yhat[known], [(1 - interval) / 2, (1 + interval) / 2])
    keep = [c for c in pdf.columns if c != "features"]
    return pdf[keep].assign(value=yhat, value_lower=yhat + low, value_upper=yhat + high)


def forecast(featured: DataFrame, keys: Sequence[str], spec: ForecastSpec) -> DataFrame:
    """(keys, ds, y, value, value_lower, value_upper) for history and horizon."""
    kinds = dict(featured.dtypes)
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + ["ds timestamp, y double, value double, value_lower double, value_upper double"])
    ridge, interval = spec.ridge, spec.interval
    return featured.groupBy(*keys).applyInPandas(lambda pdf: _fit_one(pdf, ridge, interval), schema)


def published(fitted: DataFrame, keys: Sequence[str], spec: ForecastSpec, now=None) -> DataFrame:
    """Result rows from `now` on (default: the horizon): negatives become 0, values are whole numbers."""
    rows = fitted.filter(F.col("y").isNull()) if now is None else fitted.filter(F.col("ds") >= F.lit(now).cast("timestamp"))
    whole = lambda c: F.bround(F.greatest(F.col(c), F.lit(0.0))).cast("bigint").alias(c)
    return rows.select(
        *keys, "ds", whole("value"), whole("value_lower"), whole("value_upper"), F.current_timestamp().alias("created_date"), F.lit(spec.version).alias("version")
    )


def weather_daily(hist: DataFrame, latest: DataFrame, ds: str = "ds", volume: str = "precipitation_volume") -> DataFrame:
    """Daily precipitation: history without its last day, then the latest forecast, as bands 0 / 1 / 2."""
    from ..functions.scalars import precipitation_band

    daily = hist.groupBy(F.to_date(ds).alias("ds")).agg(F.sum(volume).alias(volume))
    both = drop_last_period(daily, "ds").unionByName(latest.select(F.to_date(ds).alias("ds"), volume))
    return both.select("ds", volume, precipitation_band(volume).alias("precipitation_band"))
