"""Controlled damage to a table: missing values, noise, bias, possible worlds.

Whether a row is hit depends on a hash of its id, so a scenario is the same on every run,
and a task that is run again does the same again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalars import uniform
from plumbline.operators.lookup import attach
from plumbline.operators.prepare import TARGET
from plumbline.operators.profile import value_counts
from plumbline.operators.selection import exact_fraction, sample_rows, with_dense_rank

# The scenarios with their type and rate.
DEGRADATION_SCENARIOS = [
    ("baseline", "none", 0.0),
    ("priority_null_10", "priority_null", 0.10),
    ("priority_null_20", "priority_null", 0.20),
    ("priority_null_30", "priority_null", 0.30),
    ("description_loss_20", "description_loss", 0.20),
    ("description_loss_40", "description_loss", 0.40),
    ("priority_noise_20", "priority_noise", 0.20),
    ("priority_noise_40", "priority_noise", 0.40),
    ("positive_class_undersample_50", "positive_undersample_train", 0.50),
]

# What each of these scenarios does, as the report says it.
SCENARIO_TEXTS = {
    "baseline": "Datos originales preparados, sin degradación artificial.",
    "priority_null_10": "Se elimina priority en el 10% de train y test.",
    "priority_null_20": "Se elimina priority en el 20% de train y test.",
    "priority_null_30": "Se elimina priority en el 30% de train y test.",
    "description_loss_20": "Se simula pérdida textual en el 20% de train y test poniendo description_length=0 y has_description=0.",
    "description_loss_40": "Se simula pérdida textual en el 40% de train y test poniendo description_length=0 y has_description=0.",
    "priority_noise_20": "Se cambia aleatoriamente priority en el 20% de train y test.",
    "priority_noise_40": "Se cambia aleatoriamente priority en el 40% de train y test.",
    "positive_class_undersample_50": "Se conserva solo el 50% de ejemplos positivos en entrenamiento; el test no se altera.",
}
BIAS_SCENARIOS = [
    "baseline",
    "sample_bias_underrepresent_minority",
    "measurement_bias_description_loss",
    "measurement_bias_priority_missing",
    "historical_label_bias_minority",
    "historical_label_bias_majority",
]
KEEP_MINORITY, FLIP_MINORITY, FLIP_MAJORITY = 0.35, 0.30, 0.15
GROUP_CANDIDATES = ["project_key", "issuetype", "priority", "status"]
LEAST_GROUPS = 3

TEXT_FEATURES = ["description_length", "has_description"]
MASK_BITS = 63


def hit(id_column: str | Column, salt: str, rate: float | Column) -> Column:
    """True for a share ``rate`` of the rows."""
    key = F.col(id_column) if isinstance(id_column, str) else id_column
    return uniform(key, salt) < (rate if isinstance(rate, Column) else F.lit(float(rate)))


def random_nulls(df: DataFrame, column: str, rate: float, salt: str = "null", id_column: str = "id") -> DataFrame:
    return df.withColumn(column, F.when(~hit(id_column, salt, rate), F.col(column)))


def text_loss(df: DataFrame, rate: float, salt: str = "text", id_column: str = "id") -> DataFrame:
    lost = hit(id_column, salt, rate)
    named = [c for c in TEXT_FEATURES if c in df.columns]
    return df.withColumns({c: F.when(lost, F.lit(0)).otherwise(F.col(c)) for c in named})


def observed_values(df: DataFrame, column: str, salt: str) -> DataFrame:
    """The distinct values of a column, numbered 0..n-1 in hashed order: ``rank``, ``n``."""
    distinct = df.select(column).where(F.col(column).isNotNull()).distinct()
    return with_dense_rank(distinct, [], column, salt)


def category_noise(
    df: DataFrame,
    column: str,
    struck: Column,
    salt: str = "noise",
    key: Column | None = None,
    id_column: str = "id",
    source: DataFrame | None = None,
) -> DataFrame:
    """Where ``struck``, the value is replaced by a uniform draw from those in ``source``.

    The source is the table itself unless given. The draw may be the old value again. A
    column without any value stays as it is.
    """
    if column not in df.columns:
        return df
    key = F.col(id_column) if key is None else key
    values = observed_values(df if source is None else source, column, salt)
    total = values.agg(F.max("n").alias("n")).scalar()
    drawn = df.withColumn("_draw", F.when(struck, F.floor(uniform(key, f"{salt}-draw") * total)))
    options = values.select(F.col("rank").alias("_draw"), F.col(column).alias("_new"))
    noisy = attach(drawn, options, ["_draw"])
    return noisy.withColumn(column, F.coalesce("_new", column)).drop("_draw", "_new").select(*df.columns)


def undersample_positives(
    df: DataFrame, keep_rate: float, where: Column | None = None, salt: str = "keep", id_column: str = "id"
) -> DataFrame:
    """Positives survive with the given rate; other rows, and rows outside ``where``, stay."""
    hurt = (F.col(TARGET) == 1) if where is None else ((F.col(TARGET) == 1) & where)
    return df.where(~F.coalesce(hurt, F.lit(False)) | hit(id_column, salt, keep_rate))


def _alternatives(names: Sequence[tuple]) -> Column:
    return F.array(
        *[
            F.struct(F.lit(n).alias("scenario"), F.lit(t).alias("degradation_type"), F.lit(r).alias("degradation_rate"))
            for n, t, r in names
        ]
    )


def degradation_scenarios(
    df: DataFrame, scenarios: Sequence[tuple] = tuple(DEGRADATION_SCENARIOS), id_column: str = "id"
) -> DataFrame:
    """Every row once per scenario, damaged as that scenario says. Needs a ``split`` column.

    All scenarios are one plan over one scan. Each has its own draws.
    """
    spread = df.select("*", F.inline(_alternatives(scenarios)))
    key = F.concat_ws("-", F.col(id_column).cast("string"), F.col("scenario"))
    kind = F.col("degradation_type")
    struck = hit(key, "degrade", F.col("degradation_rate"))
    noisy = spread
    if any(t == "priority_noise" for _, t, _ in scenarios):
        noisy = category_noise(spread, "priority", (kind == "priority_noise") & struck, "degrade", key, source=df)
    blank = (kind == "priority_null") & struck
    lost = (kind == "description_loss") & struck
    damaged = noisy.withColumns(
        {
            "priority": F.when(~blank, F.col("priority")),
            **{c: F.when(lost, F.lit(0)).otherwise(F.col(c)) for c in TEXT_FEATURES if c in df.columns},
        }
    )
    dropped = (
        (kind == "positive_undersample_train") & (F.col("split") == "train") & (F.col(TARGET) == 1) & ~struck
    )
    return damaged.where(~dropped)


def scenario_text(scenario: Column, texts: Mapping[str, str] = SCENARIO_TEXTS) -> Column:
    """What a degradation scenario does, in the words of the report; NULL for one without a text."""
    cells = [F.struct(F.lit(name), F.lit(text)) for name, text in texts.items()]
    return F.try_element_at(F.map_from_entries(F.array(*cells)), scenario)


def choose_group(df: DataFrame, candidates: Sequence[str] = tuple(GROUP_CANDIDATES)) -> DataFrame:
    """One row: the first candidate column with three or more values, its rarest and most
    frequent value. Ties go to the value that sorts first."""
    named = [c for c in candidates if c in df.columns]
    counts = value_counts(df, named).where(F.col("value").isNotNull())
    rank = F.array_position(F.array(*[F.lit(c) for c in named]), F.col("column"))
    value, count = F.col("value"), F.col("count")
    stats = counts.groupBy("column").agg(
        F.count("*").alias("distinct_values"),
        F.min_by(value, F.struct(count, value)).alias("minority_group"),
        F.min_by(value, F.struct(-count, value)).alias("majority_group"),
    )
    eligible = stats.where(F.col("distinct_values") >= LEAST_GROUPS)
    first = F.min_by(F.struct(F.col("column").alias("group_feature"), "minority_group", "majority_group"), rank)
    return eligible.agg(first.alias("c")).where(F.col("c").isNotNull()).select("c.*")


def chosen_group(df: DataFrame, candidates: Sequence[str] = tuple(GROUP_CANDIDATES)) -> tuple[str, str, str]:
    row = choose_group(df, candidates).first()
    if row is None:
        raise ValueError("no grouping column has three or more values")
    return row.group_feature, row.minority_group, row.majority_group


def bias_predicates(
    train: DataFrame,
    group: str,
    minority: str,
    majority: str,
    scenarios: Sequence[str] = tuple(BIAS_SCENARIOS),
    id_column: str = "id",
) -> dict[str, Column]:
    """Which rows each of the scenarios touches, as predicates: exact counts, chosen by hash."""
    same = F.col(group).cast("string")
    rare, common = F.coalesce(same == minority, F.lit(False)), F.coalesce(same == majority, F.lit(False))
    label = F.col(TARGET)

    def exact(scenario: str, where: Column, size, salt: str) -> Column:
        return exact_fraction(train, where, size, id_column, salt) if scenario in scenarios else F.lit(False)

    def kept(n: int) -> int:
        return min(n, max(1, int(n * KEEP_MINORITY)))

    under, minor, major = BIAS_SCENARIOS[1], BIAS_SCENARIOS[4], BIAS_SCENARIOS[5]
    return {
        "minority": rare,
        "kept_minority": exact(under, rare, kept, "keep-minority"),
        "flip_to_0": exact(minor, rare & (label == 1), lambda n: int(n * FLIP_MINORITY), "flip-minority"),
        "flip_to_1": exact(major, common & (label == 0), lambda n: int(n * FLIP_MAJORITY), "flip-majority"),
    }


def bias_scenarios(
    train: DataFrame,
    group: str,
    minority: str,
    majority: str,
    scenarios: Sequence[str] = tuple(BIAS_SCENARIOS),
    id_column: str = "id",
) -> DataFrame:
    """Every training row once per bias scenario, changed as that scenario says."""
    unknown = set(scenarios) - set(BIAS_SCENARIOS)
    if unknown:
        raise ValueError(f"unknown scenarios: {sorted(unknown)}")
    touched = bias_predicates(train, group, minority, majority, scenarios, id_column)
    marked = train.withColumns({f"_{n}": p for n, p in touched.items()})
    spread = marked.withColumn("scenario", F.explode(F.array(*[F.lit(s) for s in scenarios])))
    now = F.col("scenario")
    kept = ~((now == "sample_bias_underrepresent_minority") & F.col("_minority") & ~F.col("_kept_minority"))
    silent = (now == "measurement_bias_description_loss") & F.col("_minority")
    changes = {c: F.when(silent, F.lit(0)).otherwise(F.col(c)) for c in TEXT_FEATURES if c in train.columns}
    if "priority" in train.columns:
        blank = (now == "measurement_bias_priority_missing") & F.col("_minority")
        changes["priority"] = F.when(~blank, F.col("priority"))
    changes[TARGET] = (
        F.when((now == "historical_label_bias_minority") & F.col("_flip_to_0"), 0)
        .when((now == "historical_label_bias_majority") & F.col("_flip_to_1"), 1)
        .otherwise(F.col(TARGET))
    )
    return spread.where(kept).withColumns(changes).drop(*[f"_{n}" for n in touched])


def possible_worlds(
    rows: DataFrame,
    train: DataFrame,
    categorical: Sequence[str],
    numeric: Sequence[str],
    worlds: int = 20,
    id_column: str = "id",
) -> DataFrame:
    """``worlds`` copies of the rows in which each missing value is drawn from the training rows.

    A draw picks one training row with a value in that column, so categories come up as often
    as they do in training. Training rows are numbered per column; the draws, few beside them,
    look their number up. A column without training values stays missing. Columns without
    gaps are not touched, and only training values of the others are numbered.
    """
    columns = [c for c in [*categorical, *numeric] if c in rows.columns and c in train.columns]
    spread = rows.withColumn("world_id", F.explode(F.sequence(F.lit(1), F.lit(worlds))))
    gaps = rows.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first() if columns else {}
    columns = [c for c in columns if gaps[c] > 0]
    if not columns:
        return spread
    cells = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
    )
    donors = train.select(F.col(id_column).alias("_donor"), F.inline(cells)).where(F.col("value").isNotNull())
    ranked = with_dense_rank(donors, ["column"], "_donor", "worlds")
    totals = donors.groupBy("column").agg(F.count("*").alias("n"))
    by_column = totals.agg(F.map_from_entries(F.collect_list(F.struct("column", "n"))).alias("m")).scalar()

    holes = spread.select(id_column, "world_id", F.inline(cells)).where(F.col("value").isNull()).drop("value")
    key = F.concat_ws("-", F.col(id_column).cast("string"), F.col("world_id").cast("string"), F.col("column"))
    draws = holes.withColumn(
        "rank", F.floor(uniform(key, "world-draw") * F.try_element_at(by_column, F.col("column")))
    )
    filled = draws.join(ranked.select("column", "rank", "value"), ["column", "rank"])
    per_row = filled.groupBy(id_column, "world_id").agg(
        F.map_from_entries(F.collect_list(F.struct("column", "value"))).alias("_drawn")
    )
    joined = spread.join(per_row, [id_column, "world_id"], "left")
    types = dict(rows.dtypes)
    complete = {
        c: F.coalesce(F.col(c), F.try_element_at(F.col("_drawn"), F.lit(c)).cast(types[c])) for c in columns
    }
    return joined.withColumns(complete).drop("_drawn")


def world_spread(
    predictions: DataFrame, baseline: DataFrame | None = None, id_column: str = "id", most_worlds: int | None = None
) -> DataFrame:
    """Spread of a row's probability over its worlds, beside the baseline probability.

    Where worlds are numbered from 0 to at most ``most_worlds``, and that is below ``MASK_BITS``, they are counted in a mask of bits: a
    row's worlds then fold into one before the shuffle, and not one for each world. Other numbers are an error then.
    """
    p, world = "predicted_probability", F.col("world_id")
    if most_worlds is None or most_worlds >= MASK_BITS:
        distinct = F.count_distinct(world)
    else:
        wrong = F.raise_error(F.concat(F.lit("world beyond the stated number: "), world.cast("string"))).cast("long")
        bit = F.when(world.between(0, most_worlds), F.expr("shiftleft(1L, cast(world_id as int))")).when(world.isNotNull(), wrong)
        distinct = F.coalesce(F.bit_count(F.bit_or(bit)).cast("long"), F.lit(0).cast("long"))
    summary = predictions.groupBy(id_column).agg(
        distinct.alias("worlds"),
        F.avg(p).alias("mean_probability"),
        F.stddev_samp(p).alias("std_probability"),
        F.min(p).alias("min_probability"),
        F.max(p).alias("max_probability"),
    )
    summary = summary.withColumn("probability_range", F.col("max_probability") - F.col("min_probability"))
    return summary if baseline is None else summary.join(baseline, id_column, "left")


def world_sensitivity(spread: DataFrame, worlds: int) -> DataFrame:
    """Overall sensitivity: mean deviation, 95th percentile and maximum of the range."""
    from plumbline.operators.quantiles import quantiles

    p95 = quantiles(spread, [], F.col("probability_range"), [0.95]).agg(F.first(F.col("quantiles")[0]).alias("q"))
    totals = spread.agg(
        F.count("*").alias("sample_rows"),
        F.avg("std_probability").alias("mean_probability_std"),
        F.max("probability_range").alias("max_probability_range"),
    )
    return totals.select(
        "sample_rows",
        F.lit(worlds).alias("worlds"),
        "mean_probability_std",
        p95.scalar().alias("p95_probability_range"),
        "max_probability_range",
    )


def world_sample(test: DataFrame, size: int = 1000, id_column: str = "id") -> DataFrame:
    return sample_rows(test, size, id_column, "world-sample")
