"""Column builders for the scalar expressions the jobs use."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- predicates -----------------------------------------------------------

def all_of(predicates: Iterable | None) -> Column:
    """AND of SQL texts or Columns; no predicates means true."""
    items = [F.expr(p) if isinstance(p, str) else p for p in (predicates or ())]
    return reduce(lambda a, b: a & b, items, F.lit(True))


def any_of(predicates: Iterable | None) -> Column:
    items = [F.expr(p) if isinstance(p, str) else p for p in (predicates or ())]
    return reduce(lambda a, b: a | b, items) if items else F.lit(True)


def flag(cond: Column) -> Column:
    """1 where the condition holds, else 0 (null counts as 0)."""
    return F.when(cond, 1).otherwise(0)


def contains_ci(col, needle: str) -> Column:
    return flag(F.lower(_c(col)).contains(needle.lower()))


# --- safe arithmetic ------------------------------------------------------

def ratio_or_zero(x, y) -> Column:
    """x / y with 0 for a zero or null denominator."""
    return F.coalesce(F.try_divide(_c(x).cast("double"), _c(y).cast("double")), F.lit(0.0))


def safe_ratio(x, y) -> Column:
    """x / y, null for a zero denominator."""
    return F.try_divide(_c(x).cast("double"), _c(y).cast("double"))


def lift(base, test) -> Column:
    """(test - base) / base; an infinite lift (zero base) becomes 0, 0/0 stays null."""
    b, t = _c(base).cast("double"), _c(test).cast("double")
    return F.when((b == 0) & (t != 0), F.lit(0.0)).otherwise(F.try_divide(t - b, b))


def clip(col, lo, hi) -> Column:
    return F.least(F.greatest(_c(col), F.lit(lo)), F.lit(hi))


def double_or_zero(col) -> Column:
    return F.coalesce(_c(col).try_cast("double"), F.lit(0.0))


def money_text(col) -> Column:
    """'1,234.5 M' style text to a number (M = millions); '-' and blanks become null."""
    text = F.regexp_replace(F.trim(_c(col)), ",", "")
    scale = F.when(text.endswith(" M"), 1e6).otherwise(1.0)
    return F.regexp_replace(text, " M$", "").try_cast("double") * scale


def null_tokens(col, tokens: Sequence[str] = ("\\N", "-", "TTM/current", "")) -> Column:
    return F.when(~_c(col).isin(list(tokens)), _c(col))


# --- banding --------------------------------------------------------------

def distance_band(km) -> Column:
    """Bands share their edges; the first match wins."""
    d = _c(km)
    return (
        F.when(d.between(0, 3), "0-3").when(d.between(3, 6), "3-6").when(d.between(6, 10), "6-10")
        .when(d > 10, ">10").otherwise("no data")
    )


def precipitation_band(volume) -> Column:
    v = _c(volume)
    return F.when(v < 1, 0).when(v < 20, 1).when(v >= 20, 2)


def long_trip(km, limit: float = 6.0) -> Column:
    return F.when(_c(km) > limit, "long").otherwise("short")


def attractive_payout(amount) -> Column:
    rest = F.pmod(_c(amount), F.lit(500))
    return flag((rest < 100) | (rest > 400))


def rate_bin(rate) -> Column:
    return F.bround(_c(rate), 1)


def to_fives(amount) -> Column:
    return 5 * F.bround(_c(amount) / 5)


# --- codes ----------------------------------------------------------------

def lookup(col, mapping: dict) -> Column:
    """Fixed mapping; unknown keys give null."""
    pairs = [F.lit(v) for kv in mapping.items() for v in kv]
    return F.element_at(F.create_map(*pairs), _c(col))


SEGMENT_NAMES = {0: "BOTTOM", 1: "LOW", 2: "MIDDLE", 3: "HIGH", 4: "TOP"}


def segment_name(col) -> Column:
    return lookup(_c(col).cast("int"), SEGMENT_NAMES)


def split_letter(col) -> Column:
    return F.char(_c(col).cast("int") + 65)


# Action codes of an offer: fixed values.
ACCEPT_CODES = (1, -2, 3, 4)
REJECT_CODES = (-1, -3)
FRAUD_CODES = (0, -4, -5)


def action_flags(col) -> dict[str, Column]:
    c = _c(col)
    return {
        "accept": flag(c.isin(*ACCEPT_CODES)),
        "reject": flag(c.isin(*REJECT_CODES)),
        "fraud": flag(c.isin(*FRAUD_CODES)),
    }


# --- text -----------------------------------------------------------------

def max_part(col, sep: str = "_") -> Column:
    """Largest integer of a separated list, e.g. '5_10' -> 10."""
    return F.array_max(F.transform(F.split(_c(col), sep), lambda x: x.cast("int")))


def label_text(col) -> Column:
    return F.regexp_replace(F.ltrim(_c(col)), " ", "_")


def first_token(col, sep: str = ",") -> Column:
    return F.split_part(_c(col), F.lit(sep), F.lit(1))


def camel_words(col) -> Column:
    return F.array_join(F.regexp_extract_all(_c(col), F.lit("([A-Z][a-z0-9]*)"), F.lit(1)), " ")


# --- time -----------------------------------------------------------------

def slot_start(ts, minutes: int) -> Column:
    """Start of the fixed-width slot that holds the timestamp."""
    width = minutes * 60
    seconds = F.unix_timestamp(_c(ts))
    return F.timestamp_seconds(seconds - F.pmod(seconds, F.lit(width)))


def minute_of_day(ts) -> Column:
    return F.hour(_c(ts)) * 60 + F.minute(_c(ts))


def iso_weekday(ts) -> Column:
    """Monday = 1 ... Sunday = 7."""
    return F.weekday(_c(ts)) + 1


def sunday_zero_weekday(ts) -> Column:
    return F.dayofweek(_c(ts)) - 1


def weekend_flag(ts, friday_counts: bool = False) -> Column:
    return flag(F.weekday(_c(ts)) >= (4 if friday_counts else 5))


def calendar_columns(ts) -> dict[str, Column]:
    c = _c(ts)
    return {
        "month": F.month(c),
        "quarter": F.quarter(c),
        "day_of_week": F.weekday(c),
        "day_name": F.date_format(c, "EEEE"),
    }


def local_time(ts, offset_seconds) -> Column:
    off = offset_seconds if isinstance(offset_seconds, Column) else F.lit(offset_seconds)
    return F.timestamp_add("SECOND", off, _c(ts))


def days_since(later, earlier) -> Column:
    return F.greatest(F.datediff(_c(later), _c(earlier)), F.lit(0))
