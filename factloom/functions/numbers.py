"""Numeric, vector and date functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round2(c: Column | str) -> Column:
    """Two places, halves towards plus infinity."""
    return F.floor(_c(c) * 100 + 0.5) / 100


def rounded(c: Column | str, places: int) -> Column:
    return F.floor(_c(c) * F.lit(10.0**places) + 0.5) / F.lit(10.0**places)


def number_text(c: Column | str) -> Column:
    """A number as plain decimal text, at most six places, no trailing zeros: the same on any engine."""
    text = _c(c).cast("decimal(38,6)").cast("string")
    return F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")


def number_from_text(c: Column | str) -> Column:
    """The first number of a text without separators, or null."""
    return F.nullif(F.regexp_extract(F.regexp_replace(_c(c), "[, ]", ""), r"(-?\d+(\.\d+)?)", 1), F.lit("")).try_cast("double")


def whole_number(c: Column | str) -> Column:
    """The number if the whole text is one (separators and a currency sign aside), else null."""
    text = F.regexp_replace(F.trim(_c(c)), r"^[$€£¥]\s*|\s*[$€£¥%]$", "")
    return F.when(text.rlike(r"^-?\d{1,3}(,\d{3})+(\.\d+)?$|^-?\d+(\.\d+)?$"), F.replace(text, F.lit(","), F.lit("")).try_cast("double"))


def sync_number(c: Column | str) -> Column:
    """For typed sinks: everything but [0-9.eE+-] goes; what is then no finite number is null."""
    x = F.nullif(F.regexp_replace(_c(c), "[^0-9.eE+-]", ""), F.lit("")).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column | str, b: Column | str) -> Column:
    """0 if the lengths differ or a vector is zero; exactly 1 for a vector and itself, since one root is taken of both squares."""
    a, b = _c(a), _c(b)
    n = F.sqrt(dot(a, a) * dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (n > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / n))).otherwise(0.0)


def semantic_boost(sim: Column | str) -> Column:
    sim = _c(sim)
    return F.when(sim > 0.25, F.least(F.lit(3.0), (sim - 0.25) * 7.5)).otherwise(0.0)


def centroid_boost(sim: Column | str) -> Column:
    sim = _c(sim)
    return F.when(sim > 0.3, F.least(F.lit(2.0), (sim - 0.3) * 5)).otherwise(0.0)


def clamp01(c: Column | str) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), _c(c)))


def cap_decision(spent: Column | str, cap: Column | str, fallback: Column | str) -> Column:
    """ok below the cap (or without one), else fallback if there is one, else block."""
    return F.when(_c(cap).isNull() | (_c(spent) < _c(cap)), "ok").when(_c(fallback), "fallback").otherwise("block")


def date_only(c: Column | str) -> Column:
    return F.date_format(_c(c).try_cast("timestamp_ntz"), "yyyy-MM-dd")


def month(c: Column | str) -> Column:
    return F.date_format(_c(c), "yyyy-MM")


def month_name(c: Column | str) -> Column:
    return F.date_format(_c(c), "yyyy-MM MMM")


def age_days(since: Column | str, now: Column | str) -> Column:
    """Days, with their fraction, between two timestamps."""
    micros = lambda c: F.unix_micros(_c(c).cast("timestamp"))
    return (micros(now) - micros(since)) / F.lit(86_400_000_000.0)


def loose_date(c: Column | str) -> Column:
    """YYYY-MM-DD from unpadded ISO dates, day-first slashes with a full year, and prose with a year; vague text is null."""
    c = F.trim(_c(c))
    iso = F.regexp_extract(c, r"^(\d{4}-\d{1,2}-\d{1,2})", 1)
    prose = F.regexp_replace(F.regexp_replace(c, r"(?<=\d)(st|nd|rd|th)\b", ""), ",", "")
    tries = [F.try_to_timestamp(iso, F.lit("y-M-d")), *(F.when(prose.rlike(r"\b\d{4}\b"), F.try_to_timestamp(prose, F.lit(f))) for f in ("MMMM d y", "d MMMM y", "MMM d y", "d MMM y", "d/M/y"))]
    return F.date_format(F.coalesce(*tries), "yyyy-MM-dd")


def token_cost(tokens_in: Column | str, tokens_out: Column | str, price_in: Column | str, price_out: Column | str) -> Column:
    """Dollars, six places, of token counts at prices a million; null without a price."""
    return F.floor((_c(tokens_in) * _c(price_in) + _c(tokens_out) * _c(price_out)) / 1e6 * 1e6 + 0.5) / 1e6
