"""Deterministic hashing: salted splits, user buckets, resampling draws.

Draws depend only on (seed, key, replicate), so a lost executor recomputes the
same numbers, and results do not depend on partitioning. They use all 64 bits of
a key, whatever its type; `continued` makes the same bits on NumPy arrays.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

def crc_bucket(salt: str, *cols, modulo: int = 100) -> Column:
    """IEEE CRC-32 of the concatenated columns and salt, modulo `modulo`."""
    parts = [F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols]
    return F.pmod(F.crc32(F.concat(*parts, F.lit(salt))), F.lit(modulo)).cast("int")


def salted_split(salt: str, *cols, percent: int = 50) -> Column:
    """'B' below the percentage, else 'A'."""
    return F.when(crc_bucket(salt, *cols) < percent, F.lit("B")).otherwise(F.lit("A"))


def campaign_split(campaign, user, salt: str, percent) -> Column:
    """Boolean split of a campaign's users; `percent` may be a column."""
    share = percent if isinstance(percent, Column) else F.lit(percent)
    text = F.concat(campaign.cast("string"), F.lit("_"), user.cast("string"), F.lit(salt))
    return F.pmod(F.crc32(text), F.lit(100)) < share


def user_bucket(user: Column, n) -> Column:
    return F.pmod(F.xxhash64(user), n if isinstance(n, Column) else F.lit(int(n))).cast("int")


# Constants of the 64-bit xxHash: fixed values.
_P1, _P2, _P3, _P4, _P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5


def draw_key(col: Column, dtype: str) -> Column:
    """Integral keys of any width hash alike; other types go into the hash as they are."""
    return col.cast("bigint") if dtype in ("tinyint", "smallint", "int", "bigint") else col


def draw_bits(seed: int, *keys: Column) -> Column:
    """64 bits for (seed, keys), a counter-based generator: the hash of the seed, continued with each key."""
    return F.xxhash64(F.lit(seed).cast("bigint"), *keys)


def uniform(bits: Column) -> Column:
    """The upper 53 bits as a number in [0, 1)."""
    return F.shiftrightunsigned(bits, 11).cast("double") * F.lit(2.0**-53)


def draw(seed: int, key: Column, rep: Column) -> Column:
    """Uniform number in [0, 1) for (seed, key, rep)."""
    return uniform(draw_bits(seed, key, rep.cast("bigint")))


def continued(value: np.ndarray | int, bits: np.ndarray | int) -> np.ndarray:
    """What `draw_bits` gives when one more bigint key follows: NumPy arrays of 64 bits in, the same out."""
    u = np.uint64
    turned = lambda x, k: (x << u(k)) | (x >> u(64 - k))
    value, bits = (np.asarray(x).astype(np.int64).view(u) if np.asarray(x).dtype != u else np.asarray(x) for x in (value, bits))
    with np.errstate(over="ignore"):
        h = bits + u((_P5 + 8) % (1 << 64))
        h = h ^ (turned(value * u(_P2), 31) * u(_P1))
        h = turned(h, 27) * u(_P1) + u(_P4)
        h = (h ^ (h >> u(33))) * u(_P2)
        h = (h ^ (h >> u(29))) * u(_P3)
    return h ^ (h >> u(32))


def uniforms(bits: np.ndarray) -> np.ndarray:
    """`uniform` on NumPy bits."""
    return (bits >> np.uint64(11)).astype(np.float64) * 2.0**-53


# Poisson(1) cumulative probabilities P(N <= k), k = 0..9: fixed values.
POISSON_1_CDF = (
    0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462,
    0.9963401531726563, 0.9994058151824183, 0.999916758850712, 0.9999897508033253,
    0.999998874797402, 0.9999998885745217,
)


def poisson_weight(u: Column) -> Column:
    """Poisson(1) count by inverse CDF of a uniform draw."""
    return reduce(lambda acc, c: acc + (u >= F.lit(c)).cast("int"), POISSON_1_CDF, F.lit(0))
