"""Rows by position: cut points, exact-k samples, splits and time bins.

A global position needs no global sort. The row at a position is found by narrowing: count
rows per slice of the order's value range, keep the one slice that holds the position, and
repeat until few rows are left. A step narrows all positions of all keys (classes, seeds)
together: it is one scan that returns a bounded number of counts to the driver. The found
rows then split the table with comparisons, without moving a single row.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.scalars import uniform
from plumbline.operators.lookup import attach
from plumbline.session import stage

SLICES = 4096
LEAST_SLICES = 64
TEXT_BOUNDS = 64
BUCKET_ROWS = 50_000
SORT_AT_MOST = 200_000

# Classes whose cuts are written into a predicate; the cuts of more are a table.
LITERAL_CLASSES = 20


class TooManyKeys(ValueError):
    """More keys than cuts may be written into an expression."""


@dataclass(frozen=True)
class Cut:
    """A row of an order: the values of the ordering columns at one position."""

    values: tuple

    def up_to(self, order: Sequence[Column]) -> Column:
        """True for rows at or before the cut in the given order."""
        return not_after(order, [F.lit(v) for v in self.values])


def not_after(order: Sequence[Column], values: Sequence[Column]) -> Column:
    """True for rows at or before the row with the given values in an order."""
    result = order[-1] <= values[-1]
    for column, value in list(zip(order, values))[-2::-1]:
        result = (column < value) | ((column == value) & result)
    return result


@dataclass(frozen=True)
class _Box:
    """The rows of a key between the least and greatest values of the ordering columns.

    The first columns are alike in all rows of the box. ``depth`` is the first one that is not,
    and all rows of the key with values between its bounds are in the box.
    """

    key: tuple
    rows: int
    low: tuple
    high: tuple

    @property
    def depth(self) -> int | None:
        return next((i for i, (a, b) in enumerate(zip(self.low, self.high)) if a != b), None)

    def holds(self, keys: Sequence[str], names: Sequence[str]) -> Column:
        inside = F.lit(True)
        for name, value in zip(keys, self.key):
            inside = inside & (F.col(name) == F.lit(value))
        for name, a, b in list(zip(names, self.low, self.high))[: self.depth + 1]:
            inside = inside & ((F.col(name) == F.lit(a)) if a == b else F.col(name).between(F.lit(a), F.lit(b)))
        return inside

    def slot(self, names: Sequence[str], slices: int, bounds: Sequence[str]) -> Column:
        """The slice of a row of the box: never falling along the order, and not alike at both ends."""
        name, low, high = names[self.depth], self.low[self.depth], self.high[self.depth]
        if isinstance(low, str):
            past = [(F.col(name) > F.lit(b)).cast("long") for b in bounds]
            return sum(past[1:], past[0])
        if isinstance(low, int):
            # As decimals, since two 64-bit numbers may be more than 2^63 apart.
            width = -(-(high - low + 1) // slices)
            above = F.col(name).cast("decimal(20,0)") - F.lit(Decimal(low))
            return F.floor(above / F.lit(Decimal(width))).cast("long")
        if not isinstance(low, float):
            raise TypeError(f"ordering columns must be numbers or text: {name}")
        width = high / slices - low / slices
        if width == 0:
            return (F.col(name) > F.lit(low)).cast("long")
        return F.least(F.floor((F.col(name) - F.lit(low)) / F.lit(width)), F.lit(slices - 1)).cast("long")


def _ends(names: Sequence[str]) -> list[Column]:
    """Count, least and greatest values of the ordering columns."""
    low = [F.min(n).alias(f"_low{i}") for i, n in enumerate(names)]
    high = [F.max(n).alias(f"_high{i}") for i, n in enumerate(names)]
    return [F.count("*").alias("_rows"), *low, *high]


def _box(key: tuple, row: Row, names: Sequence[str]) -> _Box:
    low, high = [tuple(row[f"{side}{i}"] for i in range(len(names))) for side in ("_low", "_high")]
    return _Box(key, row["_rows"], low, high)


def _by_box(boxes: Sequence[_Box], found: Callable[[_Box, int], Column]) -> Column:
    """An expression of its own for each box, chosen by the column ``_box``."""
    result = F.when(F.col("_box") == 0, found(boxes[0], 0))
    for i, box in enumerate(boxes[1:], start=1):
        result = result.when(F.col("_box") == i, found(box, i))
    return result


def _text_bounds(inside: DataFrame, boxes: Sequence[_Box], names: Sequence[str]) -> dict[int, list[str]]:
    """For each box whose next column is text, some of its texts in order, the lowest among them.

    Next to the lowest, these are the texts with the smallest of some hashes: a draw among the
    distinct texts that comes back in one row for each box.
    """
    texts = {i: b.low[b.depth] for i, b in enumerate(boxes) if isinstance(b.low[b.depth], str)}
    if not texts:
        return {}
    value = _by_box(boxes, lambda box, i: F.col(names[box.depth]) if i in texts else F.lit(None).cast("string"))
    scope = inside.where(F.col("_box").isin(*texts)).select("_box", value.alias("_v"))
    drawn = [F.min(F.struct(F.xxhash64("_v", F.lit(i)), "_v"))["_v"].alias(f"v{i}") for i in range(TEXT_BOUNDS)]
    rows = scope.groupBy("_box").agg(*drawn).collect()
    return {r["_box"]: sorted({texts[r["_box"]], *r[1:]}, key=str.encode) for r in rows}


def _narrowed(
    rows: DataFrame, keys: Sequence[str], names: Sequence[str], wanted: dict[_Box, list[int]]
) -> dict[_Box, dict[int, tuple[_Box, int]]]:
    """For each position in each box, the slice that holds it, as a box, and the position in there."""
    boxes = list(wanted)
    slices = max(LEAST_SLICES, min(SLICES, 4 * SLICES // len(boxes)))
    inside = _with_box(rows, keys, names, boxes)
    bounds = _text_bounds(inside, boxes, names)
    slot = _by_box(boxes, lambda box, i: box.slot(names, slices, bounds.get(i, ())))
    counts = inside.groupBy("_box", slot.alias("_slot")).agg(*_ends(names)).collect()
    found: dict[_Box, dict[int, tuple[_Box, int]]] = {box: {} for box in boxes}
    before: dict[int, int] = defaultdict(int)
    for row in sorted(counts, key=lambda r: (r["_box"], r["_slot"])):
        box, start = boxes[row["_box"]], before[row["_box"]]
        for position in wanted[box]:
            if start <= position < start + row["_rows"]:
                found[box][position] = (_box(box.key, row, names), position - start)
        before[row["_box"]] = start + row["_rows"]
    return found


def _with_box(rows: DataFrame, keys: Sequence[str], names: Sequence[str], boxes: Sequence[_Box]) -> DataFrame:
    """The rows in any of the boxes, which do not overlap, with the number of theirs."""
    number = F.when(boxes[0].holds(keys, names), 0)
    for i, box in enumerate(boxes[1:], start=1):
        number = number.when(box.holds(keys, names), i)
    return rows.withColumn("_box", number).where(F.col("_box").isNotNull())


def _sorted_rows(
    rows: DataFrame, keys: Sequence[str], names: Sequence[str], wanted: dict[_Box, list[int]]
) -> dict[_Box, dict[int, Cut]]:
    """The rows at positions of boxes that are small enough to be sorted."""
    boxes = list(wanted)
    place = F.row_number().over(W.partitionBy("_box").orderBy(*names)) - 1
    ranked = _with_box(rows, keys, names, boxes).withColumn("_place", place)
    chosen = _by_box(boxes, lambda box, i: F.col("_place").isin(*wanted[box]))
    found: dict[_Box, dict[int, Cut]] = {box: {} for box in boxes}
    for row in ranked.where(chosen).select("_box", "_place", *names).collect():
        found[boxes[row["_box"]]][row["_place"]] = Cut(tuple(row[n] for n in names))
    return found


def keyed_cuts(
    rows: DataFrame,
    keys: Sequence[str],
    names: Sequence[str],
    positions: Callable[[dict[tuple, int]], dict[tuple, Sequence[int]]],
    sort_at_most: int = SORT_AT_MOST,
    most_keys: int = LITERAL_CLASSES,
) -> dict[tuple, list[Cut | None]]:
    """The rows at zero-based positions of each key's order; None beyond its end.

    ``positions`` is told the rows per key and names the positions wanted in each. Rows with a null
    key belong to no key. The ordering columns ``names`` must be finite numbers or text (in the order
    of its UTF-8 bytes), free of nulls, with something unique last. All keys and positions are
    narrowed together, so the number of jobs does not hang on how many there are.
    """
    known = rows.dropna(subset=list(keys)) if keys else rows
    ends = known.groupBy(*keys).agg(*_ends(names)).limit(most_keys + 1).collect()
    if len(ends) > most_keys:
        raise TooManyKeys(f"more than {most_keys} values of {', '.join(keys)}")
    whole = {tuple(r[k] for k in keys): r for r in ends if r["_rows"]}
    asked = positions({key: r["_rows"] for key, r in whole.items()})
    result: dict[tuple, list[Cut | None]] = {key: [None] * len(p) for key, p in asked.items()}
    # Open: the box in which each wanted position lies, its place in there, and where the answer goes.
    open_at: dict[_Box, dict[int, list[tuple]]] = defaultdict(lambda: defaultdict(list))
    for key, places in asked.items():
        for i, position in enumerate(places):
            if key in whole and 0 <= position < whole[key]["_rows"]:
                open_at[_box(key, whole[key], names)][position].append((key, i))
    while open_at:
        small, large = {}, {}
        for box, places in open_at.items():
            if box.depth is None:
                for key, i in (a for answers in places.values() for a in answers):
                    result[key][i] = Cut(box.low)
            else:
                (small if box.rows <= sort_at_most else large)[box] = sorted(places)
        if small and not large:
            for box, cuts in _sorted_rows(known, keys, names, small).items():
                for position, cut in cuts.items():
                    for key, i in open_at[box][position]:
                        result[key][i] = cut
            small = {}
        following: dict[_Box, dict[int, list[tuple]]] = defaultdict(lambda: defaultdict(list))
        for box in small:
            following[box] = open_at[box]
        for box, parts in (_narrowed(known, keys, names, large) if large else {}).items():
            for position, (part, place) in parts.items():
                following[part][place].extend(open_at[box][position])
        open_at = following
    return result


def cuts_by_size(
    df: DataFrame,
    order: Sequence[Column],
    positions: Callable[[int], Sequence[int]],
    sort_at_most: int = SORT_AT_MOST,
) -> list[Cut | None]:
    """The rows at positions that depend on the number of rows; None beyond the end of the order."""
    names = [f"_o{i}" for i in range(len(order))]
    rows = df.select(*[c.alias(n) for c, n in zip(order, names)])
    return keyed_cuts(rows, [], names, lambda counts: {(): positions(counts.get((), 0))}, sort_at_most)[()]


def cut_points(
    df: DataFrame,
    order: Sequence[Column],
    positions: Sequence[int],
    sort_at_most: int = SORT_AT_MOST,
) -> list[Cut | None]:
    """The rows at the given zero-based positions of an order; None beyond its end.

    The rules for ordering columns are those of ``keyed_cuts``.
    """
    return cuts_by_size(df, order, lambda _: positions, sort_at_most)


def first_share(
    df: DataFrame,
    order: Sequence[Column],
    size: Callable[[int], int],
    sort_at_most: int = SORT_AT_MOST,
) -> Column:
    """A predicate that is true for exactly the first ``size(n)`` of the ``n`` rows of an order."""
    chosen: list[int] = []

    def last(rows: int) -> list[int]:
        chosen.append(size(rows))
        return [chosen[0] - 1]

    cut = cuts_by_size(df, order, last, sort_at_most)[0]
    if chosen[0] <= 0:
        return F.lit(False)
    return cut.up_to(order) if cut else F.lit(True)


def first_k(
    df: DataFrame,
    order: Sequence[Column],
    k: int,
    sort_at_most: int = SORT_AT_MOST,
) -> Column:
    """A predicate that is true for exactly the first ``k`` rows of an order."""
    return first_share(df, order, lambda _: k, sort_at_most) if k > 0 else F.lit(False)


def hashed_order(id_column: str, salt: str) -> list[Column]:
    """A random-looking but repeatable order of the rows."""
    return [uniform(F.col(id_column), salt), F.col(id_column)]


def exact_fraction(
    df: DataFrame,
    where: Column,
    size: Callable[[int], int],
    id_column: str = "id",
    salt: str = "sample",
) -> Column:
    """A predicate for exactly ``size(n)`` of the ``n`` rows that meet ``where``, chosen by hash."""
    chosen = first_share(df.where(where), hashed_order(id_column, salt), size)
    return F.coalesce(where, F.lit(False)) & chosen


def sample_rows(df: DataFrame, n: int, id_column: str = "id", salt: str = "sample") -> DataFrame:
    """Exactly ``n`` rows (all where there are fewer), the same ones on every run."""
    if n <= 0 or df.count() <= n:
        return df
    return df.where(first_k(df, hashed_order(id_column, salt), n))


def split_sizes(counts: dict, test_size: float) -> dict:
    """Test rows per class: their sum is ``ceil(n * test_size)``, shared out by largest remainder."""
    total = sum(counts.values())
    train = total - math.ceil(total * test_size)
    shares = {c: divmod(n * train, total) for c, n in counts.items()}
    spare = train - sum(whole for whole, _ in shares.values())
    favoured = sorted(shares, key=lambda c: (-shares[c][1], c))[:spare]
    return {c: counts[c] - shares[c][0] - (c in favoured) for c in counts}


def stratified_tests(
    df: DataFrame,
    label: str,
    seeds: Sequence[int],
    test_size: float = 0.2,
    id_column: str = "id",
    sort_at_most: int = SORT_AT_MOST,
    literal_classes: int = LITERAL_CLASSES,
) -> list[Column]:
    """For each seed, a predicate for the test rows of a stratified split: an exact share of each class.

    All classes and seeds are cut together. Rows without a label are in no test part. ``TooManyKeys``
    is raised beyond ``literal_classes`` classes, for which there is ``stratified_split``.
    """
    orders = [hashed_order(id_column, f"split{seed}") for seed in seeds]
    draws = [F.struct(F.lit(i).alias("_seed"), *[c.alias(f"_o{j}") for j, c in enumerate(o)]) for i, o in enumerate(orders)]
    rows = df.select(F.col(label).alias("_class"), F.inline(F.array(*draws)))

    def last(counts: dict[tuple, int]) -> dict[tuple, list[int]]:
        classes = {c: n for (c, seed), n in counts.items() if seed == 0}
        sizes = split_sizes(classes, test_size)
        return {(c, i): [sizes[c] - 1] for c in classes for i in range(len(orders)) if sizes[c]}

    most = literal_classes * len(orders)
    cuts = keyed_cuts(rows, ["_class", "_seed"], ["_o0", "_o1"], last, sort_at_most, most)
    tests = [F.lit(False)] * len(orders)
    for (value, i), (cut,) in sorted(cuts.items()):
        tests[i] = tests[i] | ((F.col(label) == F.lit(value)) & cut.up_to(orders[i]))
    return [F.coalesce(test, F.lit(False)) for test in tests]


def stratified_test(
    df: DataFrame,
    label: str,
    test_size: float = 0.2,
    id_column: str = "id",
    seed: int = 42,
) -> Column:
    """The predicate of ``stratified_tests`` for one seed."""
    return stratified_tests(df, label, [seed], test_size, id_column)[0]


def class_cuts(
    df: DataFrame,
    label: str,
    test_size: float = 0.2,
    id_column: str = "id",
    seed: int = 42,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """The last test row of each class of a stratified split: label, ``_last_u``, ``_last_id``.

    For any number of classes, as a table. Rows are counted per class and bucket of the hashed order,
    and only the bucket that holds a class's last test row is sorted. Classes without a test row have
    no row.
    """
    rows = df.where(F.col(label).isNotNull()).select(F.col(label).alias("_class"), F.col(id_column).alias("_id"))
    classes = stage(rows.groupBy("_class").agg(F.count("*").alias("_n")), "classes")
    total = classes.agg(F.sum("_n")).first()[0] or 0
    if not total:
        empty = rows.select(F.col("_class").alias(label), F.lit(0.0).alias("_last_u"), F.col("_id").alias("_last_id"))
        return empty.where(F.lit(False))
    train = total - math.ceil(total * test_size)
    # Exact in decimals: rows times training rows may pass 2^63.
    share = F.col("_n").cast("decimal(19,0)") * F.lit(Decimal(train))
    left = (share % F.lit(Decimal(total))).cast("long")
    whole = ((share - left) / F.lit(Decimal(total))).cast("long")
    sized = classes.select("_class", "_n", left.alias("_left"), whole.alias("_whole"))
    spare = train - sized.agg(F.sum("_whole")).first()[0]
    favoured = first_k(sized, [-F.col("_left"), F.col("_class")], spare)
    sized = sized.select("_class", (F.col("_n") - F.col("_whole") - favoured.cast("long")).alias("_size"))

    buckets = -(-total // bucket_rows)
    hashed = rows.withColumn("_u", uniform(F.col("_id"), f"split{seed}"))
    hashed = hashed.withColumn("_bucket", F.floor(F.col("_u") * F.lit(float(buckets))).cast("long"))
    counts = hashed.groupBy("_class", "_bucket").agg(F.count("*").alias("_c"))
    up_to = F.sum("_c").over(W.partitionBy("_class").orderBy("_bucket"))
    counts = counts.withColumn("_before", up_to - F.col("_c")).join(sized, "_class")
    in_bucket = (F.col("_before") < F.col("_size")) & (F.col("_size") <= F.col("_before") + F.col("_c"))
    last = counts.where(in_bucket).select("_class", "_bucket", (F.col("_size") - F.col("_before")).alias("_place"))
    inside = W.partitionBy("_class", "_bucket").orderBy("_u", "_id")
    ranked = attach(hashed, last, ["_class", "_bucket"], "inner").withColumn("_row", F.row_number().over(inside))
    found = ranked.where(F.col("_row") == F.col("_place"))
    return found.select(F.col("_class").alias(label), F.col("_u").alias("_last_u"), F.col("_id").alias("_last_id"))


def stratified_split(
    df: DataFrame,
    label: str,
    test_size: float = 0.2,
    id_column: str = "id",
    seed: int = 42,
    literal_classes: int = LITERAL_CLASSES,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """The rows with their side of a stratified split in ``split``, for any number of classes.

    The cuts of few classes are a predicate; those of more are a table joined by class. Both give the
    same rows. Rows without a label are training rows.
    """
    try:
        tests = stratified_tests(df, label, [seed], test_size, id_column, literal_classes=literal_classes)
        return with_split(df, tests[0])
    except TooManyKeys:
        cuts = class_cuts(df, label, test_size, id_column, seed, bucket_rows)
    order = hashed_order(id_column, f"split{seed}")
    test = not_after(order, [F.col("_last_u"), F.col("_last_id")])
    return with_split(attach(df, cuts, [label]), F.coalesce(test, F.lit(False))).select(*df.columns, "split")


def with_split(df: DataFrame, test: Column) -> DataFrame:
    return df.withColumn("split", F.when(test, "test").otherwise("train"))


def time_order(created: str = "created", id_column: str = "id") -> list[Column]:
    return [F.unix_micros(F.col(created).cast("timestamp")), F.col(id_column)]


def temporal_train(
    df: DataFrame, test_fraction: float = 0.2, id_column: str = "id", sort_at_most: int = SORT_AT_MOST
) -> Column:
    """A predicate for the training rows of a temporal split: the earliest ``int(n * (1 - f))``."""
    return first_share(df, time_order(id_column=id_column), lambda n: int(n * (1 - test_fraction)), sort_at_most)


def positional_bin_sizes(rows: int, bins: int) -> list[int]:
    """Last position of each bin when positions 0..n-1 are cut at their own quantiles."""
    return [max(rows - 1, 0) * b // bins for b in range(1, bins)]


def with_time_bins(
    df: DataFrame, bins: int = 5, id_column: str = "id", sort_at_most: int = SORT_AT_MOST
) -> DataFrame:
    """Equal-count bins in time order: ``period`` (1..bins) and ``time_bin`` (its label)."""
    order = time_order(id_column=id_column)
    cuts = cuts_by_size(df, order, lambda n: positional_bin_sizes(n, bins), sort_at_most)
    period = F.lit(bins)
    for number, cut in reversed(list(enumerate(cuts, start=1))):
        if cut:
            period = F.when(cut.up_to(order), number).otherwise(period)
    return df.withColumn("period", period).withColumn("time_bin", F.concat(F.lit("period_"), F.col("period")))


def with_dense_rank(
    df: DataFrame,
    keys: Sequence[str],
    id_column: str = "id",
    salt: str = "rank",
    buckets: int | None = None,
) -> DataFrame:
    """Number the rows of each key 0..n-1 in hashed order: columns ``rank`` and ``n``.

    Rows are sorted per (key, bucket), and hashing keeps these groups even, whatever the data. There
    is a bucket for every ``BUCKET_ROWS`` rows unless ``buckets`` says otherwise. The bucket offsets
    are broadcast if they are few enough, and joined by shuffle if not.
    """
    keys = list(keys)
    buckets = buckets or max(1, -(-df.count() // BUCKET_ROWS))
    hashed = df.withColumn("_u", uniform(F.col(id_column), salt))
    hashed = hashed.withColumn("_bucket", F.floor(F.col("_u") * F.lit(float(buckets))).cast("int"))
    per_key = W.partitionBy(*keys)
    offsets = hashed.groupBy(*keys, "_bucket").agg(F.count("*").alias("_c"))
    offsets = offsets.select(
        *keys,
        "_bucket",
        F.sum("_c").over(per_key).alias("n"),
        (F.sum("_c").over(per_key.orderBy("_bucket")) - F.col("_c")).alias("_offset"),
    )
    inside = W.partitionBy(*keys, "_bucket").orderBy("_u", id_column)
    ranked = hashed.withColumn("_row", F.row_number().over(inside))
    joined = attach(ranked, offsets, [*keys, "_bucket"], "inner")
    return joined.withColumn("rank", F.col("_offset") + F.col("_row") - 1).drop("_u", "_bucket", "_row", "_offset")
