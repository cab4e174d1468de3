"""Query registry: each entry pairs a Spark query with SQL another engine can run on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query: {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tables(spark: SparkSession, sf: str, *names: str) -> tuple[DataFrame, ...]:
    return tuple(table(spark, sf, n) for n in names)


def r(c, digits: int = 6) -> Column:
    """Rounded double, for comparison across engines."""
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col.cast("double"), digits)


def rounded(df: DataFrame, digits: int = 6, skip: tuple[str, ...] = ()) -> DataFrame:
    """Every double column rounded; other columns as they are."""
    return df.select(
        *[
            F.round(F.col(c), digits).alias(c) if t in ("double", "float") and c not in skip else F.col(c)
            for c, t in df.dtypes
        ]
    )


# Coordinates derived from ids, the same in both engines (doubles throughout).
LAT = "55.5D + (user_id % 97) / 970.0D"
LON = "37.3D + (event_id % 89) / 890.0D"
LAT_SQL = "55.5::DOUBLE + (user_id % 97) / 970.0::DOUBLE"
LON_SQL = "37.3::DOUBLE + (event_id % 89) / 890.0::DOUBLE"

# Offers: every event is an offer to user (driver) with action flags; nation = locality.
OFFERS_SQL = """offers AS (
  SELECT event_id, ts, user_id, event_type, value, user_id % 2 AS split, user_id % 25 AS locality,
         (event_type IN ('click','purchase'))::INT AS accept, (event_type = 'purchase')::INT AS trip,
         (event_type = 'error')::INT AS fraud,
         json_extract_string(props, '$.k')::INT AS k
  FROM events)"""


def offers(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events")
    return ev.select(
        "event_id", "ts", "user_id", "event_type", "value",
        (F.col("user_id") % 2).alias("split"), (F.col("user_id") % 25).alias("locality"),
        F.col("event_type").isin("click", "purchase").cast("int").alias("accept"),
        (F.col("event_type") == "purchase").cast("int").alias("trip"),
        (F.col("event_type") == "error").cast("int").alias("fraud"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


# --- statistics in SQL ----------------------------------------------------

def norm_p_sql(z: str, steps: int = 2000) -> str:
    """Two-sided normal tail by Simpson's rule over [0, |z|]."""
    h = f"(least(abs({z}), 12) / {steps})"
    total = (
        f"list_sum(list_transform(range(0, {steps + 1}), lambda i: (CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
        f" * exp(-pow(i * {h}, 2) / 2)))"
    )
    return f"greatest(0, 1 - 2 * {h} / 3 * {total} / sqrt(2 * pi()))"


def t_p_sql(t: str, df: str, steps: int = 4000) -> str:
    """Two-sided Student tail by Simpson's rule over [0, |t|]."""
    h = f"(least(abs({t}), 60) / {steps})"
    total = (
        f"list_sum(list_transform(range(0, {steps + 1}), lambda i: (CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
        f" * pow(1 + pow(i * {h}, 2) / ({df}), -(({df}) + 1) / 2)))"
    )
    const = f"exp(lgamma((({df}) + 1) / 2) - lgamma(({df}) / 2)) / sqrt(({df}) * pi())"
    return f"greatest(0, 1 - 2 * {h} / 3 * {total} * {const})"


def crc_sql(text: str) -> str:
    """IEEE CRC-32 of an ASCII text, a byte at a time."""
    table = []
    for v in range(256):
        for _ in range(8):
            v = v >> 1 ^ (0xEDB88320 if v & 1 else 0)
        table.append(v)
    letters = f"list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i::INT, 1))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {letters}), lambda c, b: xor(c >> 8, ({table}::BIGINT[])[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"


def bucket_sql(key: str, limit: str) -> str:
    """`functions.hashing.user_bucket` of a bigint key."""
    signed = f"list_transform([{hash_sql(None, key)}], lambda h: CASE WHEN h >= {2**63}::UHUGEINT THEN h::HUGEINT - {2**64}::HUGEINT ELSE h::HUGEINT END)[1]"
    return f"((({signed} % ({limit})) + ({limit})) % ({limit}))::BIGINT"


def hash_sql(seed: int | None, *keys: str) -> str:
    """The 64 bits of `functions.hashing.draw_bits` for bigint keys, as UHUGEINT; without a seed the plain hash of the keys."""
    from curbside.functions.hashing import _P1, _P2, _P3, _P4, _P5

    top = 2**64 - 1
    u = lambda n: f"{n}::UHUGEINT"
    let = lambda a, body: f"list_transform([{a}], lambda h: {body})[1]"
    times = lambda a, c: f"((({a}) * {u(c)}) & {u(top)})"
    turned = lambda a, k: let(f"({a}) * {u(1 << k)}", f"(h & {u(top)}) | (h >> 64)")
    mixed = lambda a, k: let(a, f"xor(h, h >> {k})")
    out = u(42)  # the hash begins here
    for key in keys if seed is None else (f"{seed}::BIGINT", *keys):
        value = f"(({key})::HUGEINT & {top}::HUGEINT)::UHUGEINT"
        h = f"xor((({out}) + {u((_P5 + 8) % 2**64)}) & {u(top)}, {times(turned(times(value, _P2), 31), _P1)})"
        h = f"(({times(turned(h, 27), _P1)} + {u(_P4)}) & {u(top)})"
        out = mixed(times(mixed(times(mixed(h, 33), _P2), 29), _P3), 32)
    return out


def draw_sql(seed: int, *keys: str) -> str:
    """The uniform draw of `functions.hashing.draw` for bigint keys."""
    return f"(({hash_sql(seed, *keys)} >> 11)::DOUBLE / 9007199254740992.0::DOUBLE)"


def poisson_sql(u: str) -> str:
    from curbside.functions.hashing import POISSON_1_CDF

    return "(" + " + ".join(f"({u} >= {c!r}::DOUBLE)::INT" for c in POISSON_1_CDF) + ")"


def ratio_sql(rows: str, keys: str = "metric") -> str:
    """CTEs st, mo, va, pr: delta-method statistics per pair from a frame (keys, split, x, y, n)."""
    k = f"{keys}, " if keys else ""
    using = f"USING ({k}split)"
    join = f"JOIN va b USING ({keys}) WHERE" if keys else ", va b WHERE"
    return f"""st AS (SELECT {k}split, count(*) AS b, sum(n)::DOUBLE AS n, sum(x) AS sx, sum(y) AS sy FROM {rows} GROUP BY ALL),
mo AS (SELECT {k}split, any_value(st.b) AS b, any_value(st.n) AS n, any_value(sx) AS sx, any_value(sy) AS sy, sum(pow(x - sx / st.n, 2)) / any_value(st.n) AS vx,
 sum(pow(y - sy / st.n, 2)) / any_value(st.n) AS vy, sum((x - sx / st.n) * (y - sy / st.n)) / any_value(st.n) AS c FROM {rows} r JOIN st {using} GROUP BY {k}split),
va AS (SELECT *, (vx / pow(sy / n, 2) + vy * pow(sx / n, 2) / pow(sy / n, 4) - 2 * (sx / n) * c / pow(sy / n, 3)) / n AS q FROM mo),
pr AS (SELECT {', '.join('a.' + c.strip() for c in keys.split(',')) + ', ' if keys else ''}a.split AS split_0, b.split AS split_1, a.sx / a.sy AS ratio_0, b.sx / b.sy AS ratio_1, b.sx / b.sy - a.sx / a.sy AS delta, sqrt(a.q + b.q) AS se,
 pow(a.q + b.q, 2) / (pow(a.q, 2) / (a.n - 1) + pow(b.q, 2) / (b.n - 1)) AS df FROM va a {join} a.split < b.split)"""


def bh_sql(frame: str, p: str = "pvalue", keys: str = "") -> str:
    """Subquery: frame plus pvalue_adj."""
    part = f"PARTITION BY {keys}" if keys else ""
    return f"""(SELECT * EXCLUDE (q_), least(1, min(q_) OVER ({part} ORDER BY {p} DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS pvalue_adj FROM
 (SELECT *, {p} * count({p}) OVER ({part}) / count({p}) OVER ({part} ORDER BY {p}) AS q_ FROM {frame}))"""
