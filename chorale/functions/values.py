"""Expressions that parse and clean single values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chorale import rules
from chorale.functions.text import squeeze

ISO = (
    r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,6})?)?([+-]\d{2}:?\d{2}(:?\d{2})?)?)?$"
)
OTHER_FORMATS = ["yyyyMMdd", "yyyy-M-d H:m:s", "yyyy-M-d", "d.M.yyyy", "d.M.yyyy H:m"]


def timestamp(text: Column, run_ts: Column) -> Column:
    """Accepted date forms as UTC timestamp; ``run_ts`` when none fits, so re-runs agree."""
    cleaned = F.replace(squeeze(text), F.lit("Z"), F.lit("+00:00"))
    iso = F.when(cleaned.rlike(ISO), F.replace(cleaned, F.lit(","), F.lit(".")))
    others = [F.try_to_timestamp(cleaned, F.lit(pattern)) for pattern in OTHER_FORMATS]
    return F.coalesce(iso.try_cast("timestamp"), *others, run_ts)


def week_key(moment: Column) -> Column:
    """Year and Monday-based week; days before the first Monday of a year are week 00."""
    week = F.floor((F.dayofyear(moment) + 6 - F.weekday(moment)) / 7).cast("int")
    return F.format_string("%04d-W%02d", F.year(moment), week)


def rating(text: Column) -> Column:
    """An integer clamped to 1..5; anything that is no plain integer is null."""
    digits = F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(text))
    sign = F.when(digits.startswith("-"), -1).otherwise(1)
    value = F.regexp_replace(digits, r"^[+-]?0*(?=\d)", "")
    size = F.when(F.length(value) > 1, 9).otherwise(value.try_cast("int"))
    clamped = F.greatest(F.lit(1), F.least(F.lit(5), sign * size))
    return F.when(digits.isNotNull(), clamped).cast("int")


def source(text: Column) -> Column:
    canonical = F.replace(F.lower(squeeze(text)), F.lit(" "), F.lit("_"))
    return F.when(canonical.isin(rules.SOURCES), canonical).otherwise(rules.DEFAULT_SOURCE)


def similarity(distance: Column) -> Column:
    """1 - distance within 0..1; no distance is no similarity (``greatest`` would skip the null)."""
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - distance))
    return F.when(distance.isNull(), 0.0).otherwise(bounded)


def clean_label(text: Column) -> Column:
    cleaned = F.btrim(squeeze(text), F.lit(" ."))
    return F.when(cleaned == "", "Untitled cluster").otherwise(F.left(cleaned, F.lit(80)))


def clean_summary(text: Column) -> Column:
    return F.left(squeeze(text), F.lit(400))


def clean_confidence(text: Column) -> Column:
    lowered = F.lower(squeeze(text))
    return F.when(lowered.isin("high", "medium", "low"), lowered).otherwise("medium")


def loose_boolean(text: Column, default: bool) -> Column:
    lowered = F.lower(squeeze(text))
    return (
        F.when(lowered.isin("true", "yes", "1"), True)
        .when(lowered.isin("false", "no", "0"), False)
        .otherwise(default)
    )


def failure_state(code: Column) -> Column:
    mapping = F.create_map(*[F.lit(v) for pair in rules.FAILURE_STATES.items() for v in pair])
    return F.coalesce(F.try_element_at(mapping, code), F.lit(rules.DEFAULT_FAILURE_STATE))


def fixed(value: Column, digits: int = 2) -> Column:
    """A number as text with exactly ``digits`` decimals."""
    return value.cast(f"decimal(38,{digits})").cast("string")


def exact(value: Column) -> Column:
    """A double as DECIMAL, so that a sum does not depend on the order of its rows."""
    return value.cast("decimal(28,9)")


def exact_mean(value: Column) -> Column:
    return F.sum(exact(value)).cast("double") / F.count(value)
