"""From raw issue records to a labelled table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalars import days_between, normalize_text, parse_utc, text_length
from plumbline.operators.quantiles import approx_quantiles, quantiles
from plumbline.session import stage

TARGET = "late_resolution"

# The configured feature and grouping columns.
CATEGORICAL_FEATURES = ["project_key", "issuetype", "priority"]
NUMERIC_FEATURES = ["summary_length", "description_length", "has_description", "created_year", "created_month"]
SUBGROUP_FEATURES = ["project_key", "issuetype", "priority"]


def flatten_documents(documents: DataFrame) -> DataFrame:
    """Eleven flat columns from nested documents; any missing sub-object gives NULL."""
    nested = {
        "project_key": "fields.project.key",
        "project_name": "fields.project.name",
        "issuetype": "fields.issuetype.name",
        "priority": "fields.priority.name",
        "status": "fields.status.name",
        "summary": "fields.summary",
        "description": "fields.description",
    }
    return documents.select(
        F.col("_id").cast("string").alias("_id"),
        normalize_text(F.col("key")).alias("key"),
        F.col("fields.created").alias("created"),
        F.col("fields.resolutiondate").alias("resolutiondate"),
        *[normalize_text(F.col(path)).alias(name) for name, path in nested.items()],
    )


def with_missing_columns(df: DataFrame, names: Sequence[str], dtype: str = "string") -> DataFrame:
    """Columns the table lacks are added as NULL."""
    absent = {n: F.lit(None).cast(dtype) for n in names if n not in df.columns}
    return df.withColumns(absent) if absent else df


def parse_dates(df: DataFrame, columns: Sequence[str] = ("created", "resolutiondate")) -> DataFrame:
    """Text columns become timestamps; columns that already are timestamps stay as they are."""
    text = [n for n, t in df.dtypes if n in columns and t == "string"]
    return df.withColumns({n: parse_utc(F.col(n)) for n in text}) if text else df


def with_date_features(df: DataFrame) -> DataFrame:
    created, resolved = F.col("created"), F.col("resolutiondate")
    valid = F.coalesce(resolved >= created, F.lit(False))
    return parse_dates(df).withColumns(
        {
            "created_year": F.year(created),
            "created_month": F.month(created),
            "is_resolved": resolved.isNotNull().cast("int"),
            "resolution_valid": valid.cast("int"),
            "time_to_resolution_days": F.when(valid, days_between(created, resolved)),
        }
    )


def with_text_features(df: DataFrame) -> DataFrame:
    """Lengths of the texts. A table without descriptions that has their lengths keeps these, and gets no such column."""
    measured = "description" not in df.columns and "description_length" in df.columns
    full = with_missing_columns(df, ["summary"] if measured else ["summary", "description"])
    description_length = F.col("description_length") if measured else text_length(F.col("description"))
    return full.withColumns(
        {
            "summary_length": text_length(F.col("summary")),
            "description_length": description_length,
            "has_description": (description_length > 0).cast("int"),
        }
    )


def label_threshold(
    df: DataFrame,
    method: str = "percentile",
    percentile: float = 75.0,
    days: float = 30.0,
    approx: bool = False,
) -> Column:
    """The duration above which a record counts as late, as a column (a scalar subquery).

    The percentile is exact unless ``approx`` is set. A table without any valid duration
    fails at run time.
    """
    duration = F.col("time_to_resolution_days")
    if method == "fixed_days":
        valid = df.agg(F.count(duration).alias("n"))
        value = F.when(F.col("n") > 0, F.lit(float(days)))
    elif method == "percentile":
        find = approx_quantiles if approx else quantiles
        # Durations alone are written, as an exact quantile reads them more than once.
        known = df.select(duration) if approx else stage(df.select(duration), "durations")
        valid = find(known, [], duration, [percentile / 100.0]).agg(F.first(F.col("quantiles")[0]).alias("v"))
        value = F.col("v")
    else:
        raise ValueError("method must be 'percentile' or 'fixed_days'")
    failure = F.raise_error(F.lit("no valid durations to derive the label from")).cast("double")
    return valid.select(F.coalesce(value, failure).alias("threshold")).scalar()


def with_label(df: DataFrame, threshold: Column | float) -> DataFrame:
    """1 where the duration is above the threshold, 0 where not, NULL where unknown."""
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    duration = F.col("time_to_resolution_days")
    labelled = df.withColumn("late_threshold_days", limit)
    late = F.when(duration.isNotNull(), (duration > F.col("late_threshold_days")).cast("int"))
    return labelled.withColumn(TARGET, late)


def prepare(df: DataFrame, **label_options) -> DataFrame:
    """Dates, text lengths and label for a flat issue table.

    The table is written once before the label: the threshold and the labelled rows read it from
    there, and what ``df`` is made of is not worked out again.
    """
    dated = stage(with_text_features(with_date_features(df)), "dated")
    return with_label(dated, label_threshold(dated, **label_options))


def labelled_rows(df: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    return df.dropna(subset=[TARGET, *also])
