"""Data-quality profile and cleaning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.scalars import missing_as_category, null_group, to_number
from plumbline.operators.prepare import TARGET
from plumbline.operators.quantiles import column_quantiles

CAP_QUANTILE = 0.99


def _comparable(df: DataFrame, name: str) -> Column:
    """A short text that is equal for equal values: long strings count by their digest."""
    if dict(df.dtypes)[name] in ("string", "binary"):
        return F.md5(F.col(name))
    return F.col(name).cast("string")


def value_counts(df: DataFrame, columns: Sequence[str], digest: bool = False) -> DataFrame:
    """Rows per (column, value) for several columns in one pass; NULL is a value."""
    cells = [(_comparable(df, c) if digest else F.col(c).cast("string")).alias(c) for c in columns]
    long = df.select(*cells).unpivot([], list(columns), "column", "value")
    return long.groupBy("column", "value").agg(F.count("*").alias("count"))


def quality_summary(df: DataFrame, approx: bool = False) -> DataFrame:
    """Type, rows, nulls and distinct values of every column."""
    columns = df.columns
    frame = df.sparkSession.createDataFrame(df.dtypes, "column string, dtype string")
    if approx:
        long = df.select(*[_comparable(df, c).alias(c) for c in columns]).unpivot([], columns, "column", "value")
        stats = long.groupBy("column").agg(
            F.count("*").alias("rows"),
            F.count_if(F.col("value").isNull()).alias("null_count"),
            F.approx_count_distinct("value").alias("distinct_count"),
        )
    else:
        stats = value_counts(df, columns, digest=True).groupBy("column").agg(
            F.sum("count").alias("rows"),
            F.sum(F.when(F.col("value").isNull(), F.col("count")).otherwise(0)).alias("null_count"),
            F.count("value").alias("distinct_count"),
        )
    filled = frame.join(stats, "column", "left").na.fill(0, ["rows", "null_count", "distinct_count"])
    size = F.greatest(F.col("rows"), F.lit(1).cast("long")).cast("double")
    return filled.select(
        "column",
        "dtype",
        "rows",
        "null_count",
        (F.col("null_count") / size).alias("null_rate"),
        "distinct_count",
        (F.col("distinct_count") / size).alias("distinct_rate"),
    )


def top_values(counts: DataFrame, top: int, by: Sequence[str] = ("column",), count: str = "count") -> DataFrame:
    """The most frequent values per column. Spark cuts to ``top`` before the shuffle as well."""
    order = W.partitionBy(*by).orderBy(F.col(count).desc(), F.col("value"))
    return counts.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= top).drop("_r")


def category_distribution(df: DataFrame, columns: Sequence[str], top: int = 50) -> DataFrame:
    """The most frequent values of each column with their share of all rows."""
    named = [c for c in columns if c in df.columns]
    filled = df.select(*[null_group(F.col(c)).alias(c) for c in named])
    total = df.agg(F.count("*").cast("double").alias("n")).scalar()
    best = top_values(value_counts(filled, named), top)
    return best.select("column", "value", "count", (F.col("count") / total).alias("rate"))


def time_distribution(df: DataFrame) -> DataFrame:
    return (
        df.groupBy("created_year", "created_month")
        .agg(F.count("*").alias("issues_count"))
        .orderBy("created_year", "created_month")
    )


def row_digest(df: DataFrame) -> Column:
    """One text per distinct row content."""
    return F.md5(F.to_json(F.struct(*[F.col(c) for c in df.columns])))


def duplicate_count(df: DataFrame, key: str | None = "key") -> Column:
    """Aggregate: rows beyond the first of each key, or of each row content without a key."""
    if key and key in df.columns:
        distinct = F.count_distinct(F.col(key)) + F.coalesce(F.max(F.col(key).isNull().cast("long")), F.lit(0))
    else:
        distinct = F.count_distinct(row_digest(df))
    return F.count("*") - distinct


def quality_snapshot(df: DataFrame, scenario: str, key: str | None = "key", target: str = TARGET) -> DataFrame:
    """One row about a whole table."""
    nulls = sum((F.count_if(F.col(c).isNull()) for c in df.columns), start=F.lit(0).cast("long"))
    cells = F.count("*").cast("double") * len(df.columns)
    missing_target = F.avg(F.col(target).isNull().cast("double")) if target in df.columns else F.lit(None).cast("double")
    return df.agg(
        F.lit(scenario).alias("scenario"),
        F.count("*").alias("rows"),
        F.lit(len(df.columns)).alias("columns"),
        nulls.alias("total_nulls"),
        F.try_divide(nulls.cast("double"), cells).alias("mean_null_rate"),
        missing_target.alias("target_null_rate"),
        duplicate_count(df, key).alias("duplicate_count"),
    )


def normalize_categories(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Words for "missing", empty text and NULL become one category."""
    named = [c for c in columns if c in df.columns]
    return df.withColumns({c: missing_as_category(F.col(c)) for c in named})


def quantile_map(df: DataFrame, columns: Sequence[str], prob: float, approx: bool = False) -> Column:
    """One quantile of each column, as a scalar map from column name to value."""
    found = column_quantiles(df, columns, [prob], approx)
    pairs = F.map_from_entries(F.collect_list(F.struct("column", F.col("quantiles")[0])))
    return found.agg(pairs.alias("m")).scalar()


def cap_outliers(df: DataFrame, columns: Sequence[str], upper: float = CAP_QUANTILE, approx: bool = False) -> DataFrame:
    """Numeric columns are limited to [0, their upper quantile]."""
    named = [c for c in columns if c in df.columns]
    limits = quantile_map(df, named, upper, approx)
    with_limits = df.withColumn("_caps", limits)
    capped = {}
    for c in named:
        cap, number = F.try_element_at(F.col("_caps"), F.lit(c)), to_number(F.col(c))
        inside = F.when(number.isNotNull(), F.least(F.greatest(number, F.lit(0.0)), cap))
        capped[c] = F.when(cap.isNotNull(), inside).otherwise(F.col(c).try_cast("double"))
    return with_limits.withColumns(capped).drop("_caps")


def keep_last(df: DataFrame, key: str | None = "key", created: str | None = "created", id_column: str = "id") -> DataFrame:
    """The latest row of each key; without a key, one of each set of equal rows.

    A NULL time counts as latest. It is an aggregate, not a window: copies of a key fold
    together before the shuffle, so a key with very many copies does not fill one task.
    """
    if not key or key not in df.columns:
        return df.dropDuplicates()
    rank = [F.col(created).isNull(), F.col(created)] if created and created in df.columns else []
    latest = F.max_by(F.struct(*df.columns), F.struct(*rank, F.col(id_column)))
    return df.groupBy(key).agg(latest.alias("_row")).select("_row.*")


def clean(
    df: DataFrame,
    categorical: Sequence[str],
    numeric: Sequence[str],
    key: str | None = "key",
    approx: bool = False,
) -> DataFrame:
    """Normalised categories, capped numbers, one row per key."""
    return keep_last(cap_outliers(normalize_categories(df, categorical), numeric, approx=approx), key)


def cleaning_actions(before: DataFrame, after: DataFrame, key: str = "key", target: str = TARGET) -> DataFrame:
    """What the cleaning steps did: rows before and after, and rows without a label."""
    spark = before.sparkSession
    # The step names and details of the report.
    steps = [
        ("normalize_categorical_missing_values", "Normaliza strings vacíos y valores nulos categóricos como __MISSING__."),
        ("cap_numeric_outliers", "Limita variables numéricas al percentil 99 para reducir el efecto de outliers extremos."),
        ("remove_duplicate_keys", f"Elimina duplicados por clave si existe la columna {key}."),
        ("preserve_unresolved_target_nulls", "Mantiene filas sin target para análisis de calidad, aunque se excluyen del entrenamiento."),
    ]
    log = spark.createDataFrame(steps, "step string, detail string")
    n_before = before.agg(F.count("*").alias("n")).scalar()
    stats = after.agg(F.struct(F.count("*").alias("n"), F.count_if(F.col(target).isNull()).alias("open")).alias("s")).scalar()
    log = log.withColumns({"_before": n_before, "_after": stats})
    removed = F.col("step") == "remove_duplicate_keys"
    return log.select(
        "step",
        "detail",
        F.when(removed, F.col("_before")).alias("rows_before"),
        F.when(removed, F.col("_after.n")).alias("rows_after"),
        F.when(removed, F.col("_before") - F.col("_after.n")).alias("rows_removed"),
        F.when(F.col("step") == "preserve_unresolved_target_nulls", F.col("_after.open")).alias("affected_rows"),
    )
