"""Forests of decision trees, grown side by side on all rows and kept as tables of nodes.

Trees need no data from each other, so no level of a tree is a job of its own. The encoded rows are written once,
feature by feature, as the ranks of their values, into files of the shared folder that tasks map into memory. A task
grows its trees one after the other: all nodes of a level that have together up to ``LEVEL_ROWS`` rows at a time, and a
larger node in slices of its rows. Beside the mapped files it holds some 10 bytes for each training row.
Bootstrap draws, tried features and random thresholds hang on the seed and the number of the tree, and rows are put in
one order first, so a task that runs again grows the same trees.

The fitted model is a table of nodes. All rows of a table are scored with it, whatever their number.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.prepare import TARGET
from plumbline.operators.selection import sample_rows
from plumbline.session import scratch_path, stage

# Labelled rows that a fit takes, at most; None for all.
FIT_ROWS = None
# Rows, and cells of rows and features, that a task takes at a time; bins of values that it counts at a time.
LEVEL_ROWS, LEVEL_CELLS = 200_000, 16_000_000
# Rows of a written part, at most.
PART_ROWS = 200_000
BINS_AT_ONCE = 1 << 22
# From so many rows on, values that lie close are counted by value, not sorted.
COUNTED_ROWS = 100_000
# Nodes of an Arrow batch, and nodes in one file of several trees.
BATCH_NODES, FILE_NODES = 100_000, 2_000_000
# Rows that follow one tree at a time, and trees that lie in one file.
SCORED_ROWS = 10_000
TREES_AT_ONCE = 8
# Levels between two looks at which rows have come to a leaf.
LEVELS_AT_ONCE = 4

NODES = "tree int, node int, feature int, threshold double, left_node int, right_node int, probability double, rows long"
# Columns of a file of trees, one after the other. ``child`` has two places for each node: right, then left.
PACKED = [("probability", "f8", 1), ("threshold", "f4", 1), ("feature", "i4", 1), ("child", "i4", 2), ("root", "i4", 1)]
# Written rows: a file for each part of their order, and a file for each feature.
PARTS = "part long, path string, rows long, sizes binary"
COLUMNS = "feature long, path string, kind string, distinct long"
_KINDS = [pa.int32()] * 3 + [pa.float64()] + [pa.int32()] * 2 + [pa.float64(), pa.int64()]

# Workers get these functions by value, so that executors need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Forest:
    """What to grow. With ``random_thresholds`` trees are extremely randomised: one random threshold
    per tried feature and node, and no bootstrap; otherwise the best threshold of each tried feature."""

    trees: int = 200
    seed: int = 42
    least_leaf: int = 1
    max_depth: int = 30
    weighted: bool = False
    random_thresholds: bool = False
    fit_rows: int | None = FIT_ROWS
    # Features that a split tries (the root of their number, if None), and whether rows are drawn with replacement.
    tried: int | None = None
    bootstrap: bool | None = None

    def fit(self, table: DataFrame, label: str = TARGET, id_column: str = "id") -> ForestModel:
        """Grow the trees on the rows of a table with ``features`` (a vector), the label and, if ``weighted``, ``weight``."""
        spark = table.sparkSession
        rows = table if self.fit_rows is None else sample_rows(table, self.fit_rows, id_column, "fit")
        weight = F.col("weight").cast("double") if self.weighted else F.lit(1.0)
        encoded = rows.select(
            vector_to_array(F.col("features"), "float32").alias("x"),
            F.col(label).cast("double").alias("y"),
            weight.alias("w"),
            F.col(id_column).alias("id"),
        )
        encoded = encoded.withColumn("place", F.xxhash64("id", "x", "y", "w")).drop("id")
        columns, labels = _written(encoded, rows.count())
        if not columns:
            return ForestModel(spark.createDataFrame([], NODES))
        trees = spark.range(0, self.trees, 1, min(self.trees, 4 * spark.sparkContext.defaultParallelism))
        return ForestModel(stage(trees.mapInArrow(_grow_trees(self, columns, labels), NODES), "forest"))


@dataclass
class ForestModel:
    """A fitted forest: ``nodes`` has a row per node; leaves have feature -1 and no threshold.

    A row goes to ``left_node`` if its feature is at most the threshold. For scoring, the nodes are packed
    into files of the shared folder, which tasks map into memory a few trees at a time: neither the
    driver nor a worker holds a forest.
    """

    nodes: DataFrame
    _files: list[str] | None = field(default=None, repr=False)

    def transform(self, table: DataFrame) -> DataFrame:
        """The table without its ``features``, with ``y_prob``: the mean over the trees of the leaf's share of class 1."""
        if self._files is None:
            folder = scratch_path(table.sparkSession, "trees")
            nodes, last = self.nodes.agg(F.count("*"), F.max("tree")).first()
            at_once = max(1, min(TREES_AT_ONCE, FILE_NODES * ((last or 0) + 1) // max(1, nodes)))
            blocks = self.nodes.groupBy(F.floor(F.col("tree") / F.lit(at_once)).alias("block"))
            packed = blocks.applyInArrow(_pack(folder), "block long, path string")
            self._files = [r.path for r in sorted(packed.collect())]
        kept = [c for c in table.columns if c != "features"]
        rows = table.select(*kept, vector_to_array(F.col("features"), "float32").alias("_x"))
        schema = table.select(*kept, F.lit(0.0).alias("y_prob")).schema
        return rows.mapInArrow(_score(self._files, kept), schema)


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


@dataclass(frozen=True)
class _Column:
    """A feature's file: its sorted values, then the ranks of all rows; of the labels, all labels and then all weights."""

    path: str
    kind: str
    distinct: int
    rows: int

    def read(self) -> tuple[np.ndarray, np.ndarray]:
        held = _bytes_of(self.path)
        first = "f8" if self.kind == "f8" else "f4"
        end = self.distinct * np.dtype(first).itemsize
        return held[:end].view(first), held[end:].view(self.kind)


def _written(encoded: DataFrame, rows: int) -> tuple[list[_Column], _Column | None]:
    """The rows in the order of ``place`` as a file per feature, and one of labels and weights."""
    spark = encoded.sparkSession
    width = encoded.select(F.size("x").alias("n")).first()
    if width is None:
        return [], None
    number = 1 + rows // max(1, min(PART_ROWS, LEVEL_CELLS // max(1, width.n)))
    share = F.col("place").cast("double") / F.lit(2.0**64) + F.lit(0.5)
    part = F.least(F.floor(share * F.lit(float(number))), F.lit(number - 1)).cast("long")
    folder = scratch_path(spark, "rows")
    groups = encoded.withColumn("part", part).groupBy("part")
    parts = sorted(groups.applyInArrow(_write_part(folder), PARTS).collect())
    wanted = spark.range(0, width.n + 1, 1, min(width.n + 1, 4 * spark.sparkContext.defaultParallelism))
    made = sorted(wanted.mapInArrow(_write_columns(parts, width.n, folder), COLUMNS).collect())
    total = sum(p.rows for p in parts)
    *columns, labels = [_Column(c.path, c.kind, c.distinct, total) for c in made]
    return columns, labels


def _write_part(folder: str):
    """Features one after the other, whole numbers below 256 in a byte each, then labels and weights."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("place")
        x = _matrix(group.column("x"))
        path, sizes = f"{folder}/part-{key[0].as_py()}-{uuid.uuid4().hex}", []
        with _new_file(path) as out:
            for j in range(x.shape[1]):
                column = np.ascontiguousarray(x[:, j])
                with np.errstate(invalid="ignore"):
                    short = column.astype(np.uint8)
                short = short if np.array_equal(short, column) else column
                out.write(short.tobytes())
                sizes.append(short.itemsize)
            for name in ("y", "w"):
                out.write(group.column(name).to_numpy().astype("f8").tobytes())
        found = {"part": [key[0].as_py()], "path": [path], "rows": [len(group)], "sizes": [bytes(sizes)]}
        return pa.table(found, schema=pa.schema([("part", pa.int64()), ("path", pa.string()), ("rows", pa.int64()), ("sizes", pa.binary())]))

    return run


def _write_columns(parts: list, width: int, folder: str):
    """For each number of a feature its file; that after the last feature is the number of labels and weights."""

    def pieces(j: int) -> Iterator[np.ndarray]:
        for part in parts:
            sizes = np.frombuffer(part.sizes, dtype=np.uint8).astype(np.int64)
            kind = "f8" if j >= width else "u1" if sizes[j] == 1 else "f4"
            begin = int(sizes[:j].sum()) * part.rows + max(0, j - width) * 8 * part.rows
            yield _bytes_of(part.path, begin, part.rows * np.dtype(kind).itemsize).view(kind)

    def write(j: int) -> tuple[int, str, str, int]:
        path = f"{folder}/column-{j}-{uuid.uuid4().hex}"
        if j == width:
            with _new_file(path) as out:
                for piece in (*pieces(j), *pieces(j + 1)):
                    out.write(piece.tobytes())
            return j, path, "f8", sum(part.rows for part in parts)
        distinct, pending = np.empty(0, dtype=np.float32), []
        for piece in pieces(j):
            pending.append(np.unique(piece).astype(np.float32))
            if sum(map(len, pending)) > len(distinct):
                distinct, pending = np.unique(np.concatenate([distinct, *pending])), []
        distinct = np.unique(np.concatenate([distinct, *pending])) if pending else distinct
        kind = "u1" if len(distinct) <= 1 << 8 else "u2" if len(distinct) <= 1 << 16 else "i4"
        with _new_file(path) as out:
            out.write(distinct.tobytes())
            for piece in pieces(j):
                out.write(np.searchsorted(distinct, piece.astype(np.float32)).astype(kind).tobytes())
        return j, path, kind, len(distinct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for j in batch.column(0).to_pylist():
                cells = [[v] for v in write(j)]
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(cells, kinds)], names=[f.split()[0] for f in COLUMNS.split(", ")]
                )

    return run


def _grow_trees(spec: Forest, columns: list[_Column], labels: _Column):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            for tree in batch.column(0).to_pylist():
                held = held or [*zip(*(c.read() for c in columns)), labels.read()]
                values, codes, (y, w) = held
                found = grow_columns(codes, values, y, w, spec, tree)
                for a in range(0, len(found[0]), BATCH_NODES):
                    arrays = [pa.array(c[a : a + BATCH_NODES], k, from_pandas=True) for c, k in zip(found, _KINDS)]
                    yield pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in NODES.split(", ")])

    return run


def _ranked(x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The ranks of the values of each feature, in the shortest type that holds them, and the sorted values."""
    pairs = [np.unique(x[:, j], return_inverse=True) for j in range(x.shape[1])]
    longest = max((len(distinct) for distinct, _ in pairs), default=0)
    codes = np.empty(x.shape, dtype=np.uint16 if longest <= 1 << 16 else np.int32)
    for j, (_, ranks) in enumerate(pairs):
        codes[:, j] = ranks
    return codes, [distinct.astype(np.float64) for distinct, _ in pairs]


def grow(x, codes, values, y, w, spec: Forest, tree: int) -> list[np.ndarray]:
    """The columns of ``NODES`` of one tree. ``codes`` are the ranks of ``x`` within each feature's sorted ``values``."""
    return grow_columns(list(codes.T), [v.astype(x.dtype) for v in values], y, w, spec, tree)


def grow_columns(codes, values, y, w, spec: Forest, tree: int) -> list[np.ndarray]:
    """The columns of ``NODES`` of one tree, from the ranks and the sorted values of each feature."""
    n, width = len(y), len(codes)
    draw = np.random.default_rng([spec.seed, tree])
    bootstrap = not spec.random_thresholds if spec.bootstrap is None else spec.bootstrap
    times = _drawn(draw, n) if bootstrap else np.ones(n, dtype=np.uint16)
    data = _Data(codes, values, y, w, times, spec, min(spec.tried or max(1, int(width**0.5)), width), draw)
    most = max(1, min(LEVEL_ROWS, LEVEL_CELLS // width))
    kind = np.int32 if n < 1 << 31 else np.int64
    # The rows of the nodes of a level, node after node; those of the next level take their place from the front.
    rows = np.concatenate([(a + np.flatnonzero(times[a : a + LEVEL_ROWS])).astype(kind) for a in range(0, n, LEVEL_ROWS)])
    sizes, made, levels = np.array([len(rows)]), 0, []
    for depth in range(spec.max_depth + 1):
        ends, m, kept, parts, following = np.cumsum(sizes), len(sizes), 0, [], []
        a = 0
        while a < m:
            start = int(ends[a] - sizes[a])
            b = max(a + 1, int(np.searchsorted(ends, start + most, side="right")))
            mine = rows[start : int(ends[b - 1])]
            step = _large_node if len(mine) > most else _nodes
            *found, next_rows, next_sizes = step(data, mine, sizes[a:b], depth < spec.max_depth)
            rows[kept : kept + len(next_rows)] = next_rows
            kept += len(next_rows)
            parts.append(found)
            following.append(next_sizes)
            a = b
        feature, threshold, probability, count = (np.concatenate(c) for c in zip(*parts))
        inner, first = feature >= 0, made + m
        left = np.full(m, -1)
        left[inner] = first + 2 * np.arange(inner.sum())
        levels.append((made + np.arange(m), feature, threshold, left, np.where(inner, left + 1, -1), probability, count))
        if not inner.any():
            break
        made, sizes, rows = first, np.concatenate(following), rows[:kept]
    node, *others = (np.concatenate(c) for c in zip(*levels))
    return [np.full(len(node), tree), node, *others]


@dataclass(frozen=True)
class _Data:
    """What all nodes of a tree share: ranks and values of the features, labels, weights and draws of the rows."""

    codes: list
    values: list
    y: np.ndarray
    w: np.ndarray
    times: np.ndarray
    spec: Forest
    tried: int
    draw: np.random.Generator

    def weights(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Draws and weights of rows, as doubles."""
        count = self.times[rows].astype(np.float64)
        return count, self.w[rows] * count

    def summed(self, rows: np.ndarray) -> tuple[np.ndarray, ...]:
        """What is added up on a side. Without weights of their own rows weigh as often as they were drawn, and are
        added up once."""
        count, weight = self.weights(rows)
        ones = weight * self.y[rows]
        return (weight, ones, count) if self.spec.weighted else (count, ones)


def _drawn(draw: np.random.Generator, n: int) -> np.ndarray:
    """How often each of ``n`` rows is drawn, with replacement."""
    times = np.zeros(n, dtype=np.uint16)
    for a in range(0, n, 5 * LEVEL_ROWS):
        np.add.at(times, draw.integers(0, n, min(5 * LEVEL_ROWS, n - a)), 1)
    return times


def _nodes(data: _Data, rows: np.ndarray, sizes: np.ndarray, deeper: bool):
    """Feature, threshold, share of class 1 and rows of some nodes; the rows of the next level and of its nodes."""
    m = len(sizes)
    of, starts = np.repeat(np.arange(m), sizes), np.cumsum(sizes) - sizes
    times, y = data.times[rows].astype(np.int64), data.y[rows]
    weight = data.w[rows] * times
    total, ones = np.add.reduceat(weight, starts), np.add.reduceat(weight * y, starts)
    count, positives = np.add.reduceat(times, starts), np.add.reduceat(times * y, starts)
    feature, threshold = np.full(m, -1), np.full(m, np.nan)
    next_rows, next_sizes = rows[:0], sizes[:0]
    mixed = (positives > 0) & (positives < count) & (count >= 2 * data.spec.least_leaf)
    if mixed.any() and deeper:
        mine = mixed[of]
        held_rows, held_of = rows[mine], (np.cumsum(mixed) - 1)[of[mine]]
        found, limits, above = _splits(data, held_rows, held_of)
        feature[mixed], threshold[mixed] = found, limits
        inner = found >= 0
        if inner.any():
            mine = inner[held_of]
            side = 2 * (np.cumsum(inner) - 1)[held_of[mine]] + above[mine]
            next_rows = held_rows[mine][np.argsort(side, kind="stable")]
            next_sizes = np.bincount(side, minlength=2 * int(inner.sum()))
    return feature, threshold, ones / total, count, next_rows, next_sizes


def _splits(data: _Data, rows, of) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature and threshold of each node (-1 where no split leaves enough rows on both sides), and the rows above the
    threshold. ``of`` is sorted."""
    values, tried, least_leaf = data.values, data.tried, data.spec.least_leaf
    m = int(of[-1]) + 1
    starts = np.searchsorted(of, np.arange(m))
    largest = max(len(v) for v in values)
    held = np.empty((len(rows), len(values)), dtype=np.uint16 if largest <= 1 << 16 else np.int32)
    for j, codes in enumerate(data.codes):
        held[:, j] = codes.take(rows)
    low, high = np.minimum.reduceat(held, starts, axis=0), np.maximum.reduceat(held, starts, axis=0)
    # Features are tried in a random order; those that are constant in a node come last.
    order = data.draw.random(low.shape)
    order[low == high] += 1
    chosen = np.argsort(order, axis=1)[:, :tried]
    summed = data.summed(rows)
    totals = _three([np.add.reduceat(v, starts) for v in summed])
    feature, threshold, cut = np.full(m, -1), np.full(m, np.nan), np.zeros(m, dtype=np.int64)
    if data.spec.random_thresholds:
        limits, cuts = _random_cuts(data, chosen, *(np.take_along_axis(v, chosen, axis=1) for v in (low, high)))
        below = np.take_along_axis(held, chosen[of], axis=1) <= cuts[of]
        sums = _three([np.add.reduceat(v[:, None] * below, starts, axis=0) for v in summed])
        gain = _gain(*sums, *[t[:, None] for t in totals], least_leaf)
        best = np.argmax(gain, axis=1)
        at = np.arange(m)
        found = gain[at, best] > -np.inf
        feature, threshold = np.where(found, chosen[at, best], -1), np.where(found, limits[at, best], np.nan)
        cut = cuts[at, best]
        return feature, threshold, held[np.arange(len(rows)), feature[of]] > cut[of]
    # Rows of each node, once per tried feature and in the order of its values.
    slots = of[:, None] * tried + np.arange(tried)
    keys = (slots * largest + np.take_along_axis(held, chosen[of], axis=1)).ravel()
    if len(rows) > COUNTED_ROWS and m * tried * largest <= 4 * len(keys):
        weighed = [np.bincount(keys, np.repeat(v, tried), m * tried * largest) for v in summed]
        keys = np.flatnonzero(weighed[-1] if data.spec.weighted else weighed[0])
        weighed = [v[keys] for v in weighed]
    else:
        keys, order = _in_order(keys, m * tried * largest)
        row = order // tried
        weighed = [v[row] for v in summed]
    slot = keys // largest
    bounds = np.flatnonzero((keys[1:] != keys[:-1]) & (slot[1:] == slot[:-1]))
    begin = np.searchsorted(slot, slot[bounds])
    sums = []
    for v in weighed:
        running = np.concatenate([[0.0], np.cumsum(v)])
        sums.append(running[bounds + 1] - running[begin])
    sums = _three(sums)
    node = slot[bounds] // tried
    gain = _gain(*sums, *[t[node] for t in totals], least_leaf)
    best = np.full(m, -np.inf)
    np.maximum.at(best, node, gain)
    hits = np.flatnonzero((gain == best[node]) & (gain > -np.inf))
    nodes, first = np.unique(node[hits], return_index=True)
    at = bounds[hits[first]]
    feature[nodes] = chosen[nodes, slot[at] % tried]
    cut[nodes], upper = keys[at] % largest, keys[at + 1] % largest
    threshold[nodes] = (_values_at(values, feature[nodes], cut[nodes]) + _values_at(values, feature[nodes], upper)) / 2
    return feature, threshold, held[np.arange(len(rows)), feature[of]] > cut[of]


def _by_feature(feature: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each feature and its places in a flat array."""
    order = np.argsort(feature, kind="stable")
    found, starts = np.unique(feature[order], return_index=True)
    yield from zip(found.tolist(), np.split(order, starts[1:]))


def _values_at(values: list, feature: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The values of ranks of features, as doubles."""
    flat, found = code.ravel(), np.empty(code.size)
    for j, at in _by_feature(feature.ravel()):
        found[at] = values[j][flat[at]]
    return found.reshape(code.shape)


def _random_cuts(data: _Data, chosen, low, high) -> tuple[np.ndarray, np.ndarray]:
    """Random thresholds between the lowest and the highest ranks, and the greatest ranks that are not above them."""
    lowest, highest = _values_at(data.values, chosen, low), _values_at(data.values, chosen, high)
    limits = lowest + data.draw.random(lowest.shape) * (highest - lowest)
    limits = np.where(limits >= highest, lowest, limits)
    flat, cuts = _not_above(limits).ravel(), np.empty(limits.size, dtype=np.int64)
    for j, at in _by_feature(chosen.ravel()):
        cuts[at] = np.searchsorted(data.values[j], flat[at], side="right") - 1
    return limits, cuts.reshape(limits.shape)


def _not_above(exact: np.ndarray) -> np.ndarray:
    """The greatest single-precision numbers that are not above some doubles."""
    single = exact.astype(np.float32)
    return np.where(single > exact, np.nextafter(single, np.float32(-np.inf)), single)


def _large_node(data: _Data, rows: np.ndarray, sizes: np.ndarray, deeper: bool):
    """What ``_nodes`` gives for one node of many rows, which are taken in slices."""
    slices = [rows[a : a + LEVEL_ROWS] for a in range(0, len(rows), LEVEL_ROWS)]
    total = ones = count = positives = 0.0
    for part in slices:
        times, weight = data.weights(part)
        y = data.y[part]
        total, ones = total + weight.sum(), ones + (weight * y).sum()
        count, positives = count + times.sum(), positives + (times * y).sum()
    feature, threshold, cut = -1, np.nan, 0
    if deeper and 0 < positives < count and count >= 2 * data.spec.least_leaf:
        totals = [total, ones, count] if data.spec.weighted else [count, positives, count]
        feature, threshold, cut = _split_large(data, slices, totals)
    next_rows, next_sizes = rows[:0], sizes[:0]
    if feature >= 0:
        above = np.concatenate([data.codes[feature][part] > cut for part in slices])
        next_rows = np.concatenate([rows[~above], rows[above]])
        next_sizes = np.array([len(rows) - above.sum(), above.sum()])
    return np.array([feature]), np.array([threshold]), np.array([ones / total]), np.array([int(count)]), next_rows, next_sizes


def _split_large(data: _Data, slices: list[np.ndarray], totals: list) -> tuple[int, float, int]:
    """Feature, threshold and greatest rank below it of the best split of a node, or -1."""
    ends = [[(c[part].min(), c[part].max()) for part in slices] for c in data.codes]
    low = np.array([min(a for a, _ in e) for e in ends], dtype=np.int64)
    high = np.array([max(b for _, b in e) for e in ends], dtype=np.int64)
    order = data.draw.random((1, len(low)))[0]
    order[low == high] += 1
    chosen = np.argsort(order)[: data.tried]
    summed = len(data.summed(slices[0][:0]))
    best, feature, cut, upper = -np.inf, -1, 0, 0
    if data.spec.random_thresholds:
        limits, cuts = _random_cuts(data, chosen[None], low[chosen][None], high[chosen][None])
        sums = np.zeros((summed, len(chosen)))
        for part in slices:
            below = np.stack([data.codes[j][part] <= c for j, c in zip(chosen, cuts[0])])
            sums += [below @ v for v in data.summed(part)]
        gain = _gain(*_three(list(sums)), *totals, data.spec.least_leaf)
        at = int(np.argmax(gain))
        return (int(chosen[at]), float(limits[0, at]), int(cuts[0, at])) if gain[at] > -np.inf else (-1, np.nan, 0)
    for j in chosen:
        before, next_wanted = np.zeros(summed), False
        for a in range(int(low[j]), int(high[j]) + 1, BINS_AT_ONCE):
            bins = min(BINS_AT_ONCE, int(high[j]) + 1 - a)
            sums, drawn = np.zeros((summed, bins)), np.zeros(bins, dtype=bool)
            for part in slices:
                code = data.codes[j][part].astype(np.int64) - a
                inside = (code >= 0) & (code < bins)
                code = code[inside]
                drawn[code] = True
                for total, v in zip(sums, data.summed(part)):
                    total += np.bincount(code, v[inside], bins)
            present = np.flatnonzero(drawn)
            if not len(present):
                continue
            if next_wanted:
                upper, next_wanted = a + int(present[0]), False
            running = before[:, None] + np.cumsum(sums[:, present], axis=1)
            before = running[:, -1].copy()
            # There are rows above each value but the highest.
            gain = _gain(*_three(list(running)), *totals, data.spec.least_leaf)
            gain[a + present >= high[j]] = -np.inf
            at = int(np.argmax(gain))
            if gain[at] > best:
                best, feature, cut = gain[at], int(j), a + int(present[at])
                next_wanted = at + 1 == len(present)
                upper = cut if next_wanted else a + int(present[at + 1])
    if feature < 0:
        return -1, np.nan, 0
    return feature, (float(data.values[feature][cut]) + float(data.values[feature][upper])) / 2, cut


def _three(sums: list[np.ndarray]) -> list[np.ndarray]:
    """Sums of weights, of weights of class 1 and of rows, where the first may be those of the rows."""
    return sums if len(sums) == 3 else [*sums, sums[0]]


def _in_order(keys: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys below ``limit`` in order, and the places they come from; equal keys keep their order."""
    bits = max(1, len(keys).bit_length())
    if limit.bit_length() + bits > 62:
        order = np.argsort(keys, kind="stable")
        return keys[order], order
    # Key and place as one number: sorting numbers is several times as fast as sorting places by number.
    both = (keys << bits) | np.arange(len(keys))
    both.sort()
    return both >> bits, both & ((1 << bits) - 1)


def _gain(weight, ones, count, all_weight, all_ones, all_count, least_leaf: int) -> np.ndarray:
    """What grows as the weighted Gini impurity of both sides falls; minus infinity for sides with too few rows."""
    rest, rest_ones = all_weight - weight, all_ones - ones
    allowed = (count >= least_leaf) & (all_count - count >= least_leaf) & (weight > 0) & (rest > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        sides = (ones**2 + (weight - ones) ** 2) / weight + (rest_ones**2 + (rest - rest_ones) ** 2) / rest
    return np.where(allowed, sides, -np.inf)


def _linked(group: pa.Table) -> dict[str, np.ndarray]:
    """The columns of ``PACKED`` for some trees, tree by tree, with the places of children; leaves lead to themselves."""
    group = group.sort_by([("tree", "ascending"), ("node", "ascending")])
    columns = {c: group.column(c).to_numpy() for c in group.column_names}
    roots = np.flatnonzero(columns["node"] == 0)
    base = np.repeat(roots, np.diff([*roots, len(group)]))
    leaf = columns["feature"] < 0
    own = np.arange(len(leaf))
    child = [np.where(leaf, own, base + columns[c]) for c in ("right_node", "left_node")]
    # Features are single precision: one is at most the threshold if at most the single-precision number next below.
    exact = np.where(leaf, np.inf, columns["threshold"])
    found = {"probability": columns["probability"], "threshold": _not_above(exact), "feature": np.where(leaf, 0, columns["feature"])}
    found |= {"child": np.stack(child, axis=1).ravel(), "root": columns["node"] == 0}
    return {name: found[name].astype(kind) for name, kind, _ in PACKED}


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in there."""
    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    if path.startswith("/"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def _new_file(path: str) -> pa.NativeFile:
    system, at = _opened(path)
    system.create_dir(at.rsplit("/", 1)[0])
    return system.open_output_stream(at)


def _bytes_of(path: str, begin: int = 0, size: int | None = None) -> np.ndarray:
    """Bytes of a file, mapped into memory where it is on a local path."""
    system, at = _opened(path)
    if isinstance(system, fs.LocalFileSystem):
        held = np.asarray(np.memmap(at, dtype=np.uint8, mode="r"))
        return held[begin : None if size is None else begin + size]
    with system.open_input_file(at) as source:
        return np.frombuffer(source.read_at(source.size() - begin if size is None else size, begin), dtype=np.uint8)


def _pack(folder: str):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        # A name of its own for each attempt, so that no task writes to a file that another one reads.
        path = f"{folder}/{key[0].as_py()}-{uuid.uuid4().hex}"
        with _new_file(path) as out:
            for column in _linked(group).values():
                out.write(column.tobytes())
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "path": [path]})

    return run


def _read_trees(path: str) -> dict[str, np.ndarray]:
    """The columns of packed nodes, mapped into memory where the file is on a local path."""
    held = _bytes_of(path)
    sizes = [np.dtype(kind).itemsize * each for _, kind, each in PACKED]
    ends = np.cumsum(sizes) * (len(held) // sum(sizes))
    return {name: np.asarray(part).view(kind) for (name, kind, _), part in zip(PACKED, np.split(held, ends[:-1]))}


def _reached(nodes: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """For each row and tree, the probability of the leaf that the row reaches."""
    feature, threshold, child = nodes["feature"], nodes["threshold"], nodes["child"]
    flat, width = np.ascontiguousarray(x).ravel(), x.shape[1]
    trees = []
    for root in np.flatnonzero(nodes["root"]):
        reached = np.full(len(x), root, dtype=np.int32)
        moving, here, first = np.arange(len(x)), reached, np.arange(len(x)) * width
        while len(moving):
            for _ in range(LEVELS_AT_ONCE):
                before = here
                below = flat.take(first + feature.take(here)) <= threshold.take(here)
                here = child.take(2 * here + below)
            # Rows that have come to a leaf are followed no further.
            reached[moving] = here
            on = np.flatnonzero(here != before)
            moving, here, first = moving[on], here[on], first[on]
        trees.append(nodes["probability"].take(reached))
    return np.stack(trees, axis=1)


def _score(files: list[str], kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, parts = _matrix(batch.column("_x")), []
            for path in files if len(batch) else ():
                nodes = _read_trees(path)
                parts.append(np.concatenate([_reached(nodes, x[a : a + SCORED_ROWS]) for a in range(0, len(x), SCORED_ROWS)]))
                del nodes
            out = np.concatenate(parts, axis=1).mean(axis=1) if parts else np.empty(0)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(out)], names=[*kept, "y_prob"])

    return run
