"""Feature selection, imputation, scaling and encoding."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexerModel, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.scalars import to_number
from plumbline.operators.profile import value_counts
from plumbline.operators.prepare import TARGET
from plumbline.operators.quantiles import column_quantiles

# Columns that give the outcome away, words that mark identifiers and free
# text, and the number of distinct values up to which text counts as a category.
OUTCOME_COLUMNS = ["_split", "resolutiondate", "time_to_resolution_days"]
IDENTIFIER_WORDS = [
    "id",
    "url",
    "self",
    "avatar",
    "email",
    "account",
    "display",
    "description",
    "summary",
    "body",
    "comment",
]
MOST_LEVELS = 50
MOST_CODES = 100_000


def looks_like_identifier(name: str) -> bool:
    return any(word in name.lower() for word in IDENTIFIER_WORDS)


def feature_profile(
    df: DataFrame,
    target: str = TARGET,
    exclude: Sequence[str] = (),
    most_levels: int = MOST_LEVELS,
    approx: bool = False,
) -> DataFrame:
    """Every column with its role: ``numeric``, ``categorical`` or ``dropped``.

    Outcome columns are dropped, numbers kept, and text kept where it has few values and its
    name does not look like an identifier or free text.
    """
    excluded = {target, *OUTCOME_COLUMNS, *exclude}
    rows, to_count = [], []
    for place, f in enumerate(df.schema.fields):
        if f.name in excluded:
            role = "dropped"
        elif isinstance(f.dataType, (T.NumericType, T.BooleanType)):
            role = "numeric"
        elif looks_like_identifier(f.name):
            role = "dropped"
        else:
            role = None
            to_count.append(f.name)
        rows.append((place, f.name, role))
    frame = df.sparkSession.createDataFrame(rows, "position int, column string, role string")
    if not to_count:
        return frame.withColumn("distinct_count", F.lit(None).cast("long"))
    if approx:
        counts = df.select(
            F.inline(
                F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in to_count])
            )
        )
        levels = counts.groupBy("column").agg(F.approx_count_distinct("value").alias("distinct_count"))
    else:
        levels = value_counts(df, to_count, digest=True).groupBy("column").agg(F.count("value").alias("distinct_count"))
    few = F.coalesce(F.col("distinct_count"), F.lit(0)) <= most_levels
    role = F.coalesce("role", F.when(few, "categorical").otherwise("dropped"))
    return frame.join(levels, "column", "left").select("position", "column", role.alias("role"), "distinct_count")


def select_features(df: DataFrame, target: str = TARGET, **options) -> tuple[list[str], list[str]]:
    """Numeric and categorical feature names, in column order."""
    profile = feature_profile(df, target, **options).orderBy("position").collect()
    return (
        [r.column for r in profile if r.role == "numeric"],
        [r.column for r in profile if r.role == "categorical"],
    )


def most_frequent(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The most frequent value of each column, the one that sorts first on ties."""
    counts = value_counts(df, columns).where(F.col("value").isNotNull())
    value = F.col("value")
    return counts.groupBy("column").agg(F.min_by(value, F.struct(-F.col("count"), value)).alias("value"))


def category_levels(df: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    """The values of each column, most frequent first, to be one-hot encoded.

    The values become model state, so they are read to the driver; more of them than a model
    can hold is an error.
    """
    counts = value_counts(df, columns).where(F.col("value").isNotNull())
    rows = counts.limit(MOST_CODES + 1).collect()
    if len(rows) > MOST_CODES:
        raise ValueError(f"more than {MOST_CODES} values to encode in {list(columns)}")
    levels: dict[str, list[str]] = {c: [] for c in columns}
    for row in sorted(rows, key=lambda x: (-x["count"], x["value"])):
        levels[row["column"]].append(row["value"])
    return levels


def medians(df: DataFrame, columns: Sequence[str], approx: bool = False) -> DataFrame:
    return column_quantiles(df, columns, [0.5], approx).select("column", F.col("quantiles")[0].alias("value"))


def fill_categories(df: DataFrame, values: dict[str, str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(v)) for c, v in values.items()})


def fill_numbers(df: DataFrame, values: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.coalesce(to_number(F.col(c)), F.lit(v)) for c, v in values.items()})


def moments(df: DataFrame, columns: Sequence[str]) -> Column:
    """Mean and population deviation (1 where it is 0) of each column, as one scalar struct."""
    parts = []
    for c in columns:
        deviation = F.stddev_pop(c)
        parts += [F.avg(c).alias(f"{c}_mean"), F.when(deviation == 0, 1.0).otherwise(deviation).alias(f"{c}_scale")]
    return df.agg(F.struct(*parts).alias("m")).scalar()


def standardize(df: DataFrame, columns: Sequence[str], fitted_on: DataFrame | None = None) -> DataFrame:
    """(x - mean) / population deviation."""
    with_moments = df.withColumn("_m", moments(df if fitted_on is None else fitted_on, columns))
    scaled = {c: (F.col(c) - F.col(f"_m.{c}_mean")) / F.col(f"_m.{c}_scale") for c in columns}
    return with_moments.withColumns(scaled).drop("_m")


def one_hot_columns(df: DataFrame, column: str, levels: Sequence[str]) -> DataFrame:
    """A 0/1 column per level; other values and NULL give zeros everywhere."""
    value = F.col(column).cast("string")
    return df.withColumns({f"{column}={v}": F.coalesce(value == v, F.lit(False)).cast("int") for v in levels})


@dataclass(frozen=True)
class FeatureModel:
    """Fitted imputation, scaling and encoding. Holds one value or list per column."""

    categorical: list[str]
    numeric: list[str]
    fills: dict
    means: dict
    scales: dict
    encoder: PipelineModel

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``features``; the columns of the table stay as they are."""
        cats = {
            f"_cat_{c}": F.coalesce(F.col(c).cast("string"), F.lit(self.fills.get(c, ""))) for c in self.categorical
        }
        nums = {
            f"_num_{c}": (F.coalesce(to_number(F.col(c)), F.lit(self.fills[c])) - self.means[c]) / self.scales[c]
            for c in self.numeric
        }
        staged = self.encoder.transform(df.withColumns({**cats, **nums}))
        return staged.select(*df.columns, "features")


def fit_features(
    train: DataFrame, categorical: Sequence[str], numeric: Sequence[str], approx: bool = False
) -> FeatureModel:
    """Fit on the training rows: most frequent value and one-hot codes, median and scale.

    Numeric columns without any value are left out. Values unseen in training get a zero code.
    """
    fills: dict = {}
    levels = category_levels(train, categorical) if categorical else {}
    fills.update({c: found[0] for c, found in levels.items() if found})
    if numeric:
        fills.update({r.column: r.value for r in medians(train, numeric, approx).collect()})
    numeric = [c for c in numeric if c in fills]
    means, scales = {}, {}
    if numeric:
        filled = train.select(*[F.coalesce(to_number(F.col(c)), F.lit(fills[c])).alias(c) for c in numeric])
        row = filled.select(F.lit(1)).limit(1).select(moments(filled, numeric).alias("m")).first().m
        means = {c: row[f"{c}_mean"] for c in numeric}
        scales = {c: row[f"{c}_scale"] for c in numeric}
    named = [f"_cat_{c}" for c in categorical]
    stages, parts = [], [f"_num_{c}" for c in numeric]
    if named:
        indexed, coded = [f"_idx{c}" for c in named], [f"_hot{c}" for c in named]
        stages = [
            *[
                StringIndexerModel.from_labels(levels[c], inputCol=f"_cat_{c}", outputCol=f"_idx_cat_{c}", handleInvalid="keep")
                for c in categorical
            ],
            OneHotEncoder(inputCols=indexed, outputCols=coded, dropLast=True),
        ]
        parts = [*coded, *parts]
    stages.append(VectorAssembler(inputCols=parts, outputCol="features"))
    cats = [F.lit(fills.get(c, "")).alias(f"_cat_{c}") for c in categorical]
    nums = [F.lit(0.0).alias(f"_num_{c}") for c in numeric]
    encoder = Pipeline(stages=stages).fit(train.select(*cats, *nums))
    return FeatureModel(list(categorical), numeric, fills, means, scales, encoder)
