"""Long-form KPI tables for monitoring."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.scalars import LOWER_IS_BETTER, finite, status_of

# KPI, family, definition and reading.
KPI_CATALOG = [
    ("precision", "Rendimiento", "Proporción de predicciones positivas que eran realmente positivas.", "Mayor es mejor"),
    ("recall", "Rendimiento", "Proporción de positivos reales detectados por el modelo.", "Mayor es mejor"),
    ("f1", "Rendimiento", "Media armónica entre precision y recall.", "Mayor es mejor"),
    ("pr_auc", "Rendimiento", "Área bajo la curva precision-recall; útil con clases desbalanceadas.", "Mayor es mejor"),
    ("roc_auc", "Rendimiento", "Capacidad de ranking entre positivos y negativos.", "Mayor es mejor"),
    ("brier_score", "Calibración", "Error cuadrático medio de las probabilidades predichas.", "Menor es mejor"),
    (
        "ece",
        "Calibración",
        "Expected Calibration Error; distancia entre probabilidad predicha y frecuencia observada.",
        "Menor es mejor",
    ),
    ("positive_rate_true", "Datos", "Proporción real de clase positiva.", "Depende del contexto"),
    ("positive_rate_predicted", "Modelo", "Proporción de casos marcados como positivos por el modelo.", "Depende del contexto"),
    ("delta_f1", "Robustez", "Cambio de F1 frente al escenario de referencia.", "Cerca de cero o positivo"),
    ("delta_ece", "Robustez", "Cambio de ECE frente al escenario de referencia.", "Cerca de cero o negativo"),
]


@dataclass
class ReportTable:
    """A report, its identifying columns, and the numbers that give the order its rows were written in."""

    source: str
    table: DataFrame | None
    ids: Sequence[str]
    order: Sequence[str] = field(default_factory=tuple)


def numeric_columns(df: DataFrame, besides: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in besides]


def melt(report: ReportTable, table_ord: int, lower_is_better: Sequence[str] = LOWER_IS_BETTER) -> DataFrame:
    """One row per report row and numeric column, with status and place of writing."""
    df = report.table
    if not report.order:
        raise ValueError(f"{report.source} needs the columns that tell which row was written last")
    ids = [c for c in report.ids if c in df.columns]
    kpis = numeric_columns(df, [*ids, *report.order])
    place = F.array(*[F.col(c).cast("double") for c in report.order])
    wide = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in kpis], place.alias("_row"))
    long = wide.unpivot([*ids, "_row"], kpis, "kpi", "value")
    column_ord = F.array_position(F.array(*[F.lit(k) for k in kpis]), F.col("kpi"))
    return long.select(
        *ids,
        "kpi",
        "value",
        F.lit(report.source).alias("source_table"),
        status_of(F.col("kpi"), F.col("value"), lower_is_better).alias("status"),
        F.struct(F.lit(table_ord).alias("table_ord"), column_ord.alias("column_ord"), F.col("_row").alias("row")).alias("ordinal"),
    )


def kpi_long(reports: Sequence[ReportTable], lower_is_better: Sequence[str] = LOWER_IS_BETTER) -> DataFrame:
    """All reports in one long table; reports that do not exist are skipped."""
    parts = [melt(r, i, lower_is_better) for i, r in enumerate(reports) if r.table is not None]
    if not parts:
        raise ValueError("none of the reports exists")
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part, allowMissingColumns=True)
    return result


def kpi_snapshot(long: DataFrame, lower_is_better: Sequence[str] = LOWER_IS_BETTER) -> DataFrame:
    """Last, least, greatest and mean value per KPI; "last" means written last, not latest in time."""
    known = long.where(F.col("value").isNotNull())
    stats = known.groupBy(F.col("kpi").alias("metric")).agg(
        F.max_by("value", "ordinal").alias("latest_value"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
        F.avg("value").alias("mean_value"),
    )
    status = status_of(F.col("metric"), F.col("latest_value"), lower_is_better)
    values = ["latest_value", "min_value", "max_value", "mean_value"]
    return stats.withColumn("status", status).withColumns({v: finite(F.col(v)) for v in values})


def kpi_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KPI_CATALOG, "kpi string, family string, definition string, interpretation string")


def with_catalog(long: DataFrame) -> DataFrame:
    """Each KPI row with its family and reading. The catalogue is a constant of a dozen rows."""
    return long.join(F.broadcast(kpi_catalog(long.sparkSession)), "kpi", "left")


def value_column(df: DataFrame) -> Column:
    return F.col("value").try_cast("double")
