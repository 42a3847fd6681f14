"""Null-safe scalar expressions: cleaning, parsing, ratios, hashing, statuses."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentinels for missing categories and the words that mean "missing".
NULL_GROUP = "__NULL__"
MISSING_CATEGORY = "__MISSING__"
NULL_WORDS = ("", "nan", "none", "null", "na", "n/a")

# Metrics for which a lower value is better, and the status limits.
LOWER_IS_BETTER = (
    "brier_score",
    "ece",
    "error_rate",
    "false_positive_rate",
    "false_negative_rate",
)
LOWER_GREEN, LOWER_AMBER = 0.05, 0.15
HIGHER_GREEN, HIGHER_AMBER = 0.75, 0.50

MICROS_PER_DAY = 86_400_000_000.0


def normalize_text(value: Column) -> Column:
    """Trim white space; empty strings and words for "missing" become NULL."""
    trimmed = F.btrim(value.cast("string"), F.lit(" \t\n\r\f\v"))
    return F.when(~F.lower(trimmed).isin(*NULL_WORDS), trimmed)


def missing_as_category(value: Column) -> Column:
    return F.coalesce(normalize_text(value), F.lit(MISSING_CATEGORY))


def null_group(value: Column) -> Column:
    """NULL becomes a group of its own, as text."""
    return F.coalesce(value.cast("string"), F.lit(NULL_GROUP))


def parse_utc(value: Column) -> Column:
    """Timestamp from ISO text with or without fraction and zone offset; bad text gives NULL."""
    return value.try_cast("timestamp")


def days_between(start: Column, end: Column) -> Column:
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return micros / F.lit(MICROS_PER_DAY)


def to_number(value: Column) -> Column:
    """Double, or NULL for text that is no number and for NaN."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number), number)


def text_length(value: Column) -> Column:
    return F.length(F.coalesce(value, F.lit("")))


def nested_or_default(value: Column, default: str) -> Column:
    """A dotted field (``F.col("a.b.c")``), or the default where any step of it is missing."""
    return F.coalesce(value, F.lit(default))


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def zero_ratio(numerator: Column, denominator: Column) -> Column:
    """Ratio that is 0 where it is undefined."""
    return F.coalesce(safe_ratio(numerator, denominator), F.lit(0.0))


def finite(value: Column) -> Column:
    """Infinite values become NULL."""
    return F.when(F.abs(value) != F.lit(float("inf")), value)


def uniform(key: Column, salt: str) -> Column:
    """A repeatable number in [0, 1) from a key and a salt.

    It depends on nothing but its inputs, so a re-run task or another partitioning gives
    the same draw, which ``rand(seed)`` does not.
    """
    digest = F.md5(F.concat(key.cast("string"), F.lit(f":{salt}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def count_reached(value: Column, edges: Iterable[float], inclusive: bool = True) -> Column:
    """How many of the given edges the value has reached (``>=``) or passed (``>``)."""
    steps = [(value >= F.lit(e)) if inclusive else (value > F.lit(e)) for e in edges]
    return reduce(add, [s.cast("int") for s in steps])


def predicted(probability: Column, threshold: Column | float) -> Column:
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return (probability >= limit).cast("int")


def absolute_error(truth: Column, probability: Column) -> Column:
    return F.abs(truth.cast("double") - probability)


def status_of(metric: Column, value: Column, lower_is_better: Sequence[str] = LOWER_IS_BETTER) -> Column:
    """Traffic light for a metric; every metric outside the given list counts as higher-better."""

    def light(green: Column, amber: Column) -> Column:
        return F.when(green, "green").when(amber, "amber").otherwise("red")

    low = light(value <= LOWER_GREEN, value <= LOWER_AMBER)
    high = light(value >= HIGHER_GREEN, value >= HIGHER_AMBER)
    return (
        F.when(value.isNull() | F.isnan(value), "missing")
        .when(metric.isin(*lower_is_better), low)
        .otherwise(high)
    )


def first_present(df: DataFrame, names: Sequence[str]) -> Column:
    """The first of the named columns the table has, as a number; 0 where absent or missing."""
    for name in names:
        if name in df.columns:
            return F.coalesce(to_number(F.col(name)), F.lit(0.0))
    return F.lit(0.0)


def present(df: DataFrame, names: Sequence[str]) -> list[str]:
    """The named columns that the table has, in the given order."""
    return [n for n in names if n in df.columns]
