"""Arrow UDFs over result-sized rows: tail probabilities, quantiles, sample sizes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dist


def _series(fn, *cols: pd.Series) -> pd.Series:
    out = fn(*(c.to_numpy(dtype=float, na_value=np.nan) for c in cols))
    return pd.Series(np.asarray(out, dtype=float)).where(lambda s: s.notna(), None).astype(object)


def _make(fn, arity: int):
    # one branch per arity: Arrow UDFs need a fixed, typed signature
    if arity == 1:
        @F.pandas_udf("double")
        def udf(a: pd.Series) -> pd.Series:
            return _series(fn, a)
    elif arity == 2:
        @F.pandas_udf("double")
        def udf(a: pd.Series, b: pd.Series) -> pd.Series:
            return _series(fn, a, b)
    elif arity == 3:
        @F.pandas_udf("double")
        def udf(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
            return _series(fn, a, b, c)
    else:
        @F.pandas_udf("double")
        def udf(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
            return _series(fn, a, b, c, d)
    return udf


def _col(v) -> Column:
    return v.cast("double") if isinstance(v, Column) else F.lit(float(v))


def _apply(fn, *args) -> Column:
    return _make(fn, len(args))(*(_col(a) for a in args))


def t_two_sided(t, df) -> Column:
    return _apply(dist.t_two_sided, t, df)


def t_quantile(q, df) -> Column:
    return _apply(dist.t_ppf, q, df)


def normal_two_sided(z) -> Column:
    return _apply(dist.norm_two_sided, z)


def normal_quantile(q) -> Column:
    return _apply(dist.norm_ppf, q)


def chi2_tail(x, df=1) -> Column:
    return _apply(dist.chi2_sf, x, df)


def t_sample_size(effect, power, alpha, ratio=1.0) -> Column:
    return _apply(dist.t_sample_size, effect, power, alpha, ratio)


def t_detectable_effect(n1, ratio, alpha, power) -> Column:
    return _apply(dist.t_detectable_effect, n1, ratio, alpha, power)


def gof_sample_size(effect, power, alpha) -> Column:
    return _apply(dist.gof_sample_size, effect, power, alpha)
