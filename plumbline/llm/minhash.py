"""Near-duplicate classes by ProbMinHash, banding and exact verification.

Every shingle of five words is an element with a weight that grows with its count. It sends
arrivals, a Poisson process of that rate, to random slots; the first arrival at a slot gives its
signature value. Arrivals are only drawn up to the time by which all slots are expected to be
filled, and further only where one is not: a long text draws few more than a short one. Two
signatures agree in a slot with the probability Jaccard similarity of the weighted sets.

Links are defined on the shingle sets without weights, and the probability Jaccard similarity of a
text and a copy in which a passage is repeated may be far below that of the sets. So a text with
repeated shingles has a second signature with all weights 1, whose agreement is the Jaccard
similarity of the sets, and is filed under the bands of both. Agreement is counted on signatures
with weights 1 only.

Texts with the same words are one node. Nodes that share a band are a bucket; in each bucket all are
compared with the smallest one, on signatures and then on their whole shingle sets. Links give
components. A bucket that still has several components is compared across these, in blocks, so that
no link between different texts is lost that the bands could show; pairs inside a component are never
needed. Components are found by alternating star contraction in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import travels
from plumbline.session import stage

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 30, 5
SLOTS = BANDS * ROWS

# Chance at which a link may have less agreement than is asked for.
MISSED = 1e-6

# Nodes of a bucket that are compared in one task at a time, from each side.
BLOCK = 1_024

# Shingles that a task works on at a time.
PIECE = 1 << 18

U = np.uint64
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=U)

# A-Z in lower case; digits, letters and all that is not ASCII make up words.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

travels(__name__)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads them evenly."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class Shingler:
    """Shingle hashes of texts; each distinct word is hashed once."""

    def __init__(self, size: int = SHINGLE) -> None:
        self.size, self.codes, self.hashes = size, {}, []

    def shingles(self, words: list[bytes]) -> np.ndarray:
        """Hashes of all runs of ``size`` words; fewer words, but not none, are one run."""
        if not words:
            return np.zeros(0, dtype=U)
        codes = self.codes
        for word in words:
            if word not in codes:
                codes[word] = len(self.hashes)
                self.hashes.append(xxhash.xxh3_64_intdigest(word))
        h = np.array([self.hashes[codes[w]] for w in words], dtype=U)
        size = min(self.size, len(h))
        total = np.zeros(len(h) - size + 1, dtype=U)
        for i in range(size):
            total = mix(total * _ODD[1] + h[i : len(h) - size + 1 + i])
        if len(self.hashes) > 300_000:
            self.codes, self.hashes = {}, []
        return total


def _gap(elements: np.ndarray, weights: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Time from an element's arrival number ``step`` to the next: exponential, with its weight as rate."""
    draw = mix(elements + (U(2) * step.astype(U) + U(1)) * _ODD[0])
    return -np.log1p(-(draw >> U(11)).astype(np.float64) * 2.0**-53) / weights


def signatures(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int, slots: int = SLOTS) -> np.ndarray:
    """ProbMinHash signatures (n x slots) of n weighted sets with at least one element each.

    ``elements`` are the distinct hashes of each set, ``owner`` the number of the set. The arrivals
    of an element hang on its hash alone, apart from the rate. Each set has a time up to which
    arrivals are drawn; it is doubled for the few sets that have an empty slot then.
    """
    signature, first = np.zeros(n * slots, dtype=U), np.full(n * slots, np.inf)
    horizon = slots * (np.log(slots) + 5) / np.bincount(owner, weights=weights, minlength=n)
    at, step = np.arange(len(elements)), np.zeros(len(elements), dtype=np.int64)
    time = _gap(elements, weights, step)
    while len(at):
        waiting = []
        while len(at):
            due = time <= horizon[owner[at]]
            waiting.append((at[~due], time[~due], step[~due]))
            at, time, step = at[due], time[due], step[due]
            slot = owner[at] * slots + (mix(elements[at] + (U(2) * step.astype(U) + U(2)) * _ODD[1]) % U(slots)).astype(np.int64)
            np.minimum.at(first, slot, time)
            wins = first[slot] == time
            signature[slot[wins]] = elements[at[wins]]
            step = step + 1
            time = time + _gap(elements[at], weights[at], step)
        unfilled = np.isinf(first.reshape(n, slots)).any(axis=1)
        horizon[unfilled] *= 2
        at, time, step = (np.concatenate([w[i] for w in waiting]) for i in range(3))
        more = unfilled[owner[at]]
        at, time, step = at[more], time[more], step[more]
    return signature.reshape(n, slots)


def least_agreement(similarity: float, slots: int = SLOTS, missed: float = MISSED) -> float:
    """Agreement that signatures with weights 1 of sets with that Jaccard similarity, or a higher one,
    stay below with a chance of at most ``missed``.

    The arrivals at each slot are a Poisson process of their own, so slots agree independently and
    their number is binomial.
    """
    total, least = 0.0, 0
    while least < slots:
        total += comb(slots, least) * similarity**least * (1.0 - similarity) ** (slots - least)
        if total > missed:
            break
        least += 1
    return least / slots


def weighted(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles and their weights, 1 + ln(count)."""
    elements, counts = np.unique(shingles, return_counts=True)
    return elements, 1.0 + np.log(counts)


NODES = "row_no long, doc_id long, text_key long, w1 long, w2 long, signature binary, bands array<long>"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler = Shingler()

    def band_keys(table: np.ndarray) -> np.ndarray:
        keys = np.zeros((len(table), BANDS), dtype=U)
        for row in range(ROWS):
            keys = mix(keys + table[:, row::ROWS] * _ODD[row])
        return mix(keys + np.arange(BANDS, dtype=U)).view(np.int64)

    def signed(sets: list[tuple], some: list[int], plain: bool) -> np.ndarray:
        elements, weights = (np.concatenate([sets[i][k] for i in some]) for k in (0, 1))
        owner = np.repeat(np.arange(len(some)), [len(sets[i][0]) for i in some])
        return signatures(elements, np.ones(len(weights)) if plain else weights, owner, len(some))

    def made(batch: pa.RecordBatch, digests: list[bytes], sets: list[tuple]) -> pa.RecordBatch:
        filled = [i for i, (e, _) in enumerate(sets) if len(e)]
        texts, bands = [None] * len(sets), [None] * len(sets)
        if filled:
            table = signed(sets, filled, plain=True)
            # Two bytes of each value are enough to count agreeing slots.
            short = table.astype(np.uint16)
            for i, s, k in zip(filled, short, band_keys(table)):
                texts[i], bands[i] = s.tobytes(), k.tolist()
        # Where no shingle is repeated, both signatures are the same.
        repeated = [i for i in filled if sets[i][1].max() > 1.0]
        if repeated:
            for i, k in zip(repeated, band_keys(signed(sets, repeated, plain=False))):
                bands[i] = list(dict.fromkeys([*bands[i], *k.tolist()]))
        hashes = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
        columns = [batch.column(c) for c in ("row_no", "doc_id", "text_key")]
        columns += [pa.array(np.ascontiguousarray(hashes[:, i])) for i in (0, 1)]
        columns += [pa.array(texts, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in NODES.split(", ")])

    for batch in batches:
        begin, size, digests, sets = 0, 0, [], []
        for i, text in enumerate(batch.column("text")):
            words = words_of(text.as_py())
            digests.append(xxhash.xxh3_128_digest(b" ".join(words)))
            sets.append(weighted(shingler.shingles(words)))
            size += len(words)
            if size > PIECE:
                yield made(batch.slice(begin, i + 1 - begin), digests, sets)
                begin, size, digests, sets = i + 1, 0, [], []
        if sets:
            yield made(batch.slice(begin), digests, sets)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler = Shingler()
    for batch in batches:
        sets = [np.unique(shingler.shingles(words_of(t.as_py()))).tobytes() for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], names=["node", "elements"])


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays of distinct numbers."""
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int(np.count_nonzero(b[at] == a))
    return both / (len(a) + len(b) - both)


def _similar(first: pa.Array, second: pa.Array) -> pa.Array:
    pairs = zip(first, second)
    return pa.array([jaccard(np.frombuffer(a.as_buffer(), dtype=U), np.frombuffer(b.as_buffer(), dtype=U)) for a, b in pairs], pa.float64())


def _agreement(first: pa.Array, second: pa.Array) -> pa.Array:
    a, b = (np.frombuffer(b"".join(x.as_py() for x in s), dtype=np.uint16).reshape(-1, SLOTS) for s in (first, second))
    return pa.array((a == b).mean(axis=1) if len(a) else np.zeros(0), pa.float64())


def _blocks(exact: bool, least: float, similarity: float):
    """Sorted by group: names of groups with an open pair or, with their sets, the links of each group."""

    def work(group, nodes: list, comps: list, sigs: list, sets: list) -> list[tuple]:
        table = np.frombuffer(b"".join(sigs), dtype=np.uint16).reshape(-1, SLOTS)
        root = {c: c for c in comps}

        def find(c):
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        links = []
        for i in range(len(nodes) - 1):
            agree = (table[i + 1 :] == table[i]).mean(axis=1)
            for j in np.flatnonzero(agree >= least) + i + 1:
                a, b = find(comps[i]), find(comps[j])
                if a == b:
                    continue
                if not exact:
                    return [(group, None, None)]
                if jaccard(*(np.frombuffer(sets[k], dtype=U) for k in (i, j))) >= similarity:
                    root[max(a, b)] = min(a, b)
                    links.append((group, min(nodes[i], nodes[j]), max(nodes[i], nodes[j])))
        return links

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["block", "node", "comp", "signature"] + ["elements"] * exact
        group, held = None, []

        def out(rows: list[tuple]) -> pa.RecordBatch:
            types = [pa.int64()] * 3
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["block", "a", "b"])

        def close() -> list[tuple]:
            columns = list(zip(*held))
            return work(group, *columns[:3], columns[3] if exact else [])

        for batch in batches:
            found = []
            for block, *row in zip(*[batch.column(c).to_pylist() for c in names]):
                if block != group:
                    if held:
                        found += close()
                    group, held = block, []
                held.append(row)
            yield out(found)
        if held:
            yield out(close())

    return run


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """``node, root`` for every node of the links (``a``, ``b``), root being the smallest node it is joined with.

    Alternates large-star and small-star contraction until nothing changes; every step is a table
    written to the shared folder.
    """

    def mark(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    edges = stage(links.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).where("a <> b").distinct(), name)
    before = mark(edges)
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = stage(large.unionByName(least.where("m < u").select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct(), name)
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(smallest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stage(moved.unionByName(smallest.select("a", F.col("m").alias("b"))).distinct(), name)
        after = mark(edges)
        if after == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = after


def _labelled(members: DataFrame, comps: DataFrame) -> DataFrame:
    joined = members.join(comps, "node", "left")
    return joined.withColumn("comp", F.coalesce("root", "node")).drop("root")


def _mixed_blocks(live: DataFrame, comps: DataFrame, block: int) -> DataFrame:
    """``block, node, comp``: nodes of buckets with several components, dealt out so that all pairs across meet.

    The largest component of a bucket meets the rest of the bucket block by block; the rest, if it
    is more than a block, also meets itself. A bucket with one large component and few strangers
    thus takes rows in proportion to its size.
    """
    named = stage(_labelled(live.select("bucket", "node"), comps), "labelled")
    per_comp = named.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
    shape = per_comp.groupBy("bucket").agg(
        F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("size"), F.count("*").alias("comps")
    )
    shape = stage(shape.where("comps > 1"), "mixed")
    parts = lambda n: F.ceil(n / F.lit(block)).cast("int")
    cells = named.join(shape, "bucket").select(
        "bucket",
        "node",
        "comp",
        (F.col("comp") == F.col("top.comp")).alias("inner"),
        parts(F.col("top.n")).alias("n_in"),
        parts(F.col("size") - F.col("top.n")).alias("n_out"),
    )
    own = F.pmod(F.xxhash64("node"), F.when(F.col("inner"), F.col("n_in")).otherwise(F.col("n_out"))).cast("int")
    to = lambda n: F.sequence(F.lit(0), n - 1)
    across = F.when(
        F.col("inner"), F.transform(to(F.col("n_out")), lambda o: F.struct(F.lit(0).alias("k"), o.alias("x"), own.alias("y")))
    ).otherwise(F.transform(to(F.col("n_in")), lambda i: F.struct(F.lit(0).alias("k"), own.alias("x"), i.alias("y"))))
    among = F.when(
        ~F.col("inner") & (F.col("n_out") > 1),
        F.transform(to(F.col("n_out")), lambda o: F.struct(F.lit(1).alias("k"), F.least(own, o).alias("x"), F.greatest(own, o).alias("y"))),
    ).otherwise(F.array().cast("array<struct<k:int,x:int,y:int>>"))
    dealt = cells.select("bucket", "node", "comp", F.inline(F.concat(across, among)))
    return dealt.select(F.xxhash64("bucket", "k", "x", "y").alias("block"), "node", "comp")


def find_classes(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    similarity: float = SIMILARITY,
    block: int = BLOCK,
) -> DataFrame:
    """One row per document row: ``row_no, doc_id, text_key, class_id, class_size, kept``.

    Words are what ASCII other than digits and letters separates, A-Z in lower case. Rows with the
    same words are in one class, also all that have none (NULL counts as empty); different texts are
    linked if the Jaccard similarity of their sets of five-word shingles is ``similarity`` or more (a
    shorter text is one shingle), and a class is what links join. ``class_id`` is the smallest id in
    the class; the row with it stays, of repeated rows one (NULL ids come last). Other columns are
    ignored; an empty table gives no rows.

    A link is missed only if no band of the sets agrees, for which the chance at 0.8 is below one in
    100,000, or if too few slots do, for which it is below one in 1,000,000.
    """
    least = least_agreement(similarity)
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row_no"),
        F.col(id_column).cast("long").alias("doc_id"),
        F.xxhash64(text).alias("text_key"),
        text.cast("binary").alias("text"),
    )
    signed = stage(rows.mapInArrow(_sign, NODES), "signatures")
    same_words = signed.groupBy("w1", "w2").agg(F.min("row_no").alias("node"))
    named = stage(signed.select("row_no", "doc_id", "text_key", "w1", "w2").join(same_words, ["w1", "w2"]), "nodes")
    nodes = signed.join(same_words.select(F.col("node").alias("row_no")), "row_no", "left_semi").withColumnRenamed("row_no", "node")
    nodes = stage(nodes.where(F.col("signature").isNotNull()), "node-signatures")

    banded = nodes.select("node", F.explode("bands").alias("bucket"))
    sizes = stage(banded.groupBy("bucket").agg(F.min("node").alias("pivot"), F.count("*").alias("size")).where("size > 1"), "buckets")
    live = stage(banded.join(sizes, "bucket"), "live")
    pairs = live.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    sigs = nodes.select("node", "signature")

    def with_both(pairs: DataFrame, values: DataFrame, column: str) -> DataFrame:
        for side in ("b", "a"):
            pairs = pairs.join(values.select(F.col("node").alias(side), F.col(column).alias(f"{column}_{side}")), side)
        return pairs

    agreement, similar = F.arrow_udf(_agreement, "double"), F.arrow_udf(_similar, "double")
    likely = with_both(pairs, sigs, "signature").where(agreement("signature_a", "signature_b") >= least)
    likely = stage(likely.select("a", "b"), "likely")

    def sets_of(wanted: DataFrame, name: str) -> DataFrame:
        """Shingle sets of some nodes; the texts are read again and only the wanted ones go on."""
        keys = nodes.join(wanted, "node", "left_semi").select("node", F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
        keys = stage(keys, f"{name}-keys")
        found = docs.select(F.col(id_column).cast("long").alias("doc_id"), text.alias("text")).withColumn("text_key", F.xxhash64("text"))
        same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))
        found = found.join(keys.hint("shuffle_hash"), same).dropDuplicates(["node"])
        return stage(found.select("node", F.col("text").cast("binary").alias("text")).mapInArrow(_sets, "node long, elements binary"), name)

    ends = likely.select(F.col("a").alias("node")).union(likely.select(F.col("b").alias("node"))).distinct()
    sets = sets_of(ends, "sets")
    links = with_both(likely, sets, "elements").where(similar("elements_a", "elements_b") >= similarity).select("a", "b")
    comps = components(links)

    dealt = stage(_mixed_blocks(live, comps, block), "blocks").join(sigs, "node")
    schema = "block long, a long, b long"
    ordered = dealt.select("block", "node", "comp", "signature").repartition("block").sortWithinPartitions("block")
    doubtful = stage(ordered.mapInArrow(_blocks(False, least, similarity), schema).select("block").distinct(), "doubtful")
    if not doubtful.isEmpty():
        open_blocks = stage(dealt.join(doubtful, "block"), "open-blocks")
        more_sets = sets_of(open_blocks.select("node").distinct(), "more-sets")
        filled = open_blocks.join(more_sets, "node").select("block", "node", "comp", "signature", "elements")
        filled = filled.repartition("block").sortWithinPartitions("block")
        more = filled.mapInArrow(_blocks(True, least, similarity), schema).select("a", "b")
        comps = components(more.unionByName(comps.select(F.col("node").alias("a"), F.col("root").alias("b"))))

    rows = _labelled(named.select("row_no", "doc_id", "text_key", "node"), comps)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row_no")).alias("best")
    classes = stage(rows.groupBy("comp").agg(best, F.count("*").alias("class_size")), "classes")
    joined = rows.join(classes, "comp")
    return joined.select(
        "row_no",
        "doc_id",
        "text_key",
        F.col("best.doc_id").alias("class_id"),
        "class_size",
        (F.col("row_no") == F.col("best.row_no")).alias("kept"),
    )


def keep_one(docs: DataFrame, classes: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One document of each class, with all its columns: the one that ``find_classes`` keeps.

    Rows to drop are written and joined by id and text. Rows that are repeated as a whole share
    both; of these, one is taken.
    """
    per_key = classes.groupBy("doc_id", "text_key").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    per_key = stage(per_key.where(~F.col("kept") | (F.col("n") > 1)), "dropped")
    per_key = per_key.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "kept")
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        F.col(id_column).cast("long").alias("_doc"),
        F.xxhash64(F.coalesce(F.col(text_column), F.lit(""))).alias("_text"),
    )
    same = F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_key"))
    rest = packed.join(per_key.hint("shuffle_hash"), same, "left_anti").select("_row.*")
    repeated = per_key.where("kept")
    if repeated.isEmpty():
        return rest
    once = packed.join(repeated.hint("shuffle_hash"), same).dropDuplicates(["_doc", "_text"]).select("_row.*")
    return rest.unionByName(once)
