"""Time-aware relational operators: sequences, neighbours, validity and schedule joins, spines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import null_safe_join
from ..functions.scalars import iso_weekday, minute_of_day, slot_start

FOREVER = "9999-12-31 00:00:00"


def _bucket(ts: str, grain: str) -> Column:
    return F.date_trunc(grain, F.col(ts))


def sequence_number(
    df: DataFrame, keys: Sequence[str], ts: str, tie: Sequence[str] = (), name: str = "rn", grain: str = "day"
) -> DataFrame:
    """row_number() over (partition by keys order by ts, tie) without one task per key.

    Rows are numbered inside (key, time bucket) and shifted by the count of the
    key's earlier buckets, so a key with a third of all rows is spread over its buckets.
    """
    keys, order = list(keys), [ts, *tie]
    tagged = df.withColumn("__b", _bucket(ts, grain))
    sizes = tagged.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__c"))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "__b", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__off"))
    inside = F.row_number().over(Window.partitionBy(*keys, "__b").orderBy(*order))
    numbered = null_safe_join(tagged.withColumn("__rn", inside), offsets, [*keys, "__b"])
    return numbered.withColumn(name, F.col("__rn") + F.col("__off")).drop("__b", "__rn", "__off")


def neighbours(
    df: DataFrame, keys: Sequence[str], ts: str, columns: Sequence[str], tie: Sequence[str] = (), grain: str = "day"
) -> DataFrame:
    """Adds prev_<c> and next_<c>: the values of the key's previous and next row in time.

    Neighbours inside a time bucket come from a window; across buckets the first and
    last row of each bucket (one aggregate) are lined up per key.
    """
    keys, order = list(keys), [ts, *tie]
    tagged = df.withColumn("__b", _bucket(ts, grain))
    position = F.struct(*order)
    row = F.struct(*columns)
    edges = tagged.groupBy(*keys, "__b").agg(
        F.min_by(row, position).alias("__first"), F.max_by(row, position).alias("__last")
    )
    line = Window.partitionBy(*keys).orderBy("__b")
    edges = edges.select(
        *keys, "__b", F.lag("__last").over(line).alias("__p"), F.lead("__first").over(line).alias("__n")
    )
    w = Window.partitionBy(*keys, "__b").orderBy(*order)
    joined = null_safe_join(
        tagged.withColumns({"__pi": F.lag(row).over(w), "__ni": F.lead(row).over(w)}), edges, [*keys, "__b"]
    )
    out = {}
    for c in columns:
        out[f"prev_{c}"] = F.coalesce(F.col("__pi"), F.col("__p"))[c]
        out[f"next_{c}"] = F.coalesce(F.col("__ni"), F.col("__n"))[c]
    return joined.withColumns(out).drop("__b", "__p", "__n", "__pi", "__ni")


def aligned_events(
    left: DataFrame, right: DataFrame, keys: Sequence[str], ts_left: str, ts_right: str,
    tie_left: Sequence[str] = (), tie_right: Sequence[str] = (), how: str = "inner",
) -> DataFrame:
    """Joins the n-th left event to the n-th right event of each key."""
    a = sequence_number(left, keys, ts_left, tie_left)
    b = sequence_number(right, keys, ts_right, tie_right)
    return a.join(b, [*keys, "rn"], how)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Latest row per key by (order): one mergeable aggregate, no sort of the key's rows."""
    others = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*others), F.struct(*order)).alias("__best")
    return df.groupBy(*keys).agg(best).select(*keys, "__best.*").select(*df.columns)


def latest_snapshot(df: DataFrame, created: str) -> DataFrame:
    """Rows of the newest snapshot."""
    newest = df.agg(F.max(created).alias("m"))
    return df.filter(F.col(created) == newest.select("m").scalar())


def current_version(dim: DataFrame, valid_to: str = "valid_to", infinity: str = FOREVER) -> DataFrame:
    return dim.filter(F.col(valid_to) == F.lit(infinity).cast("timestamp"))


def validity_join(
    facts: DataFrame, dim: DataFrame, keys: Sequence[str], ts: str, valid_from: str = "valid_from",
    valid_to: str = "valid_to", how: str = "inner",
) -> DataFrame:
    """Rows matched to the dimension version valid at their time: key equal, from <= ts < to.

    An equi join on the key with the range as residual predicate. The optimizer broadcasts the
    dimension when its size allows; otherwise runtime skew splitting handles hot keys.
    """
    d = dim.withColumnsRenamed({k: f"__k_{k}" for k in keys})
    cond = (F.col(ts) >= F.col(valid_from)) & (F.col(ts) < F.col(valid_to))
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"__k_{k}"))
    return facts.join(d, cond, how).drop(*[f"__k_{k}" for k in keys])


SLOT = 30  # minutes of a schedule slot


def week_slot(ts: str) -> Column:
    """Number of the half hour in the week, from Monday 00:00."""
    return ((iso_weekday(ts) - 1) * (1440 // SLOT) + F.floor(minute_of_day(ts) / SLOT)).cast("int")


def schedule_slots(schedule: DataFrame) -> DataFrame:
    """A row for each half hour that a schedule row touches: `__slot`, with the row's exact `__from` and `__until` minutes.

    The schedule has week_day, from_hour, from_minute, until_hour, until_minute; hour 24 is midnight. Rows without a
    weekday, or that end before they begin, have no slot.
    """
    start, end = F.col("from_hour") * 60 + F.col("from_minute"), F.col("until_hour") * 60 + F.col("until_minute")
    timed = schedule.withColumns({"__from": start, "__until": end}).filter(F.col("week_day").isNotNull() & (F.col("__until") > F.col("__from")))
    first = (F.col("week_day") - 1) * (1440 // SLOT)
    numbers = F.sequence(F.floor(F.col("__from") / SLOT).cast("int"), (F.ceil(F.col("__until") / SLOT) - 1).cast("int"))
    return timed.withColumn("__slot", F.explode(F.transform(numbers, lambda k: (first + k).cast("int"))))


def schedule_join(facts: DataFrame, schedule: DataFrame, ts: str, how: str = "inner", keys: Sequence[str] = ()) -> DataFrame:
    """Facts inside a weekly schedule: equal keys (such as the locality) and ISO weekday, from <= time of day < until.

    An equi join on (keys, half hour of the week): a fact has one such key, a schedule row one for each half hour it
    touches, and the exact times are tested only on what meets.
    """
    slots = schedule_slots(schedule).withColumnsRenamed({"__slot": "__s", **{k: f"__k_{k}" for k in keys}})
    f = facts.withColumns({"__slot": week_slot(ts), "__m": minute_of_day(ts)})
    cond = (F.col("__slot") == F.col("__s")) & (F.col("__m") >= F.col("__from")) & (F.col("__m") < F.col("__until"))
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"__k_{k}"))
    return f.join(slots, cond, how).drop("__slot", "__s", "__m", "__from", "__until", *[f"__k_{k}" for k in keys])


def retro_union(df: DataFrame, ts: str, date_from: str, date_until: str) -> DataFrame:
    """This window [from, until + 1) and the window one week before, tagged tw / lw."""
    start, end = F.lit(date_from).cast("date"), F.date_add(F.lit(date_until).cast("date"), 1)
    this = df.filter((F.col(ts) >= start) & (F.col(ts) < end)).withColumn("retro", F.lit("tw"))
    last = df.filter((F.col(ts) >= F.date_sub(start, 7)) & (F.col(ts) < F.date_sub(end, 7)))
    return this.unionByName(last.withColumn("retro", F.lit("lw")))


def state_seconds(
    log: DataFrame, keys: Sequence[str], ts: str, states: Sequence[str], tie: Sequence[str] = (), minutes: int = 15
) -> DataFrame:
    """Seconds per (keys, slot, states): each row lasts until the key's next row in its slot or the slot's end."""
    w = Window.partitionBy(*keys, "slot").orderBy(ts, *tie)
    end = F.unix_timestamp("slot") + minutes * 60
    until = F.coalesce(F.unix_timestamp(F.lead(ts).over(w)), end)
    lasted = log.withColumn("slot", slot_start(ts, minutes)).withColumn("seconds", until - F.unix_timestamp(F.col(ts)))
    return lasted.groupBy(*keys, "slot", *states).agg(F.sum("seconds").alias("seconds"))


def date_spine(spark, start: Column | str, end: Column | str, step: str = "interval 1 day", name: str = "ds") -> DataFrame:
    a = F.lit(start).cast("timestamp") if isinstance(start, str) else start
    b = F.lit(end).cast("timestamp") if isinstance(end, str) else end
    return spark.range(1).select(F.explode(F.sequence(a, b, F.expr(step))).alias(name))


def drop_last_period(df: DataFrame, ds: str, keys: Sequence[str] = ()) -> DataFrame:
    """Drops each series' newest (incomplete) period."""
    newest = df.groupBy(*keys).agg(F.max(ds).alias("__newest"))
    return null_safe_join(df, newest, keys).filter(F.col(ds) < F.col("__newest")).drop("__newest")


def lagged(df: DataFrame, keys: Sequence[str], ds: str, lags: dict[str, int]) -> DataFrame:
    """Regressors shifted by k periods: c -> c_sh_k. A series holds one row per period."""
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(ds)
    return df.withColumns({f"{c}_sh_{k}": F.lag(c, k).over(w) for c, k in lags.items()})


def half_hour_grid(df: DataFrame, ts: str) -> DataFrame:
    """Each hourly row twice: on the hour and half past."""
    doubled = df.withColumn("__m", F.explode(F.array(F.lit(0), F.lit(30))))
    return doubled.withColumn(ts, F.timestamp_add("MINUTE", F.col("__m"), F.col(ts))).drop("__m")


def event_flags(df: DataFrame, ds: str, calendar: DataFrame, flags: Sequence[str]) -> DataFrame:
    """0/1 columns per calendar flag: the date lies in one of the flag's [date_from, date_to) ranges.

    Ranges are expanded to days, so the join is an equi join and a doubly covered day counts once.
    """
    days = calendar.select(
        "flag",
        F.explode(F.sequence(F.col("date_from").cast("date"), F.date_sub(F.col("date_to").cast("date"), 1))).alias("__d"),
    )
    wide = days.groupBy("__d").agg(*[F.max((F.col("flag") == f).cast("int")).alias(f) for f in flags])
    out = df.withColumn("__day", F.to_date(ds)).join(wide, F.col("__day") == F.col("__d"), "left").drop("__day", "__d")
    return out.withColumns({f: F.coalesce(F.col(f), F.lit(0)) for f in flags})
