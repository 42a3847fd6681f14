import math
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import EDGES, documents, empty
from pyspark.sql import functions as F

from plumbline.llm import lang_id as L

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def test_held_out_accuracy_of_text_alone(spark, docs):
    """Fitted on even ids; on odd ones the declared language is hidden."""
    odd = F.col("doc_id") % 2 == 1
    shown = docs.withColumn("told", F.when(~odd, F.col("lang")))
    found = L.identify(shown, F.col("text"), F.col("told")).where(odd)
    right = found.agg(F.avg((F.col("_language.language") == F.col("lang")).cast("double"))).first()[0]
    assert right > 0.97


def test_keeps_clean_documents(spark, docs):
    kept = L.document_languages(docs).where("_language.accepted")
    assert kept.count() >= docs.count() * 0.995


def test_wrong_declaration_is_outweighed_by_text(spark, docs):
    lied = docs.withColumn("told", F.when(F.col("doc_id") % 10 == 0, F.lit("es")).otherwise(F.col("lang")))
    long = lied.where("doc_id % 10 = 0 and n_chars > 500 and lang <> 'es'").select("doc_id")
    found = L.identify(lied, F.col("text"), F.col("told")).join(long, "doc_id", "left_semi")
    assert found.where("_language.language = lang").count() >= 0.97 * found.count() > 20


def test_evidence_decides_where_text_does_not(spark, docs):
    """Three letters alone tell nothing: tag, suffix and host do."""
    short = spark.createDataFrame(
        [(1, "la", "fr-CA", None, None), (2, "la", None, "es", None), (3, "la", None, None, "www.x.de"), (4, "la", None, None, "new.x.de")],
        "doc_id long, text string, told string, suffix string, host string",
    )
    known = docs.select("doc_id", "text", F.col("lang").alias("told"), F.lit(None).cast("string").alias("suffix"), F.lit("h").alias("host"))
    site = docs.where("lang = 'de'").limit(30).select(
        (F.col("doc_id") + 10_000).alias("doc_id"), "text", F.lit("de").alias("told"), F.lit(None).cast("string").alias("suffix"), F.lit("www.x.de").alias("host")
    )
    every = known.unionByName(site).unionByName(short.withColumn("doc_id", -F.col("doc_id")))
    domain = F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)
    found = L.identify(every, F.col("text"), F.col("told"), F.col("suffix"), F.col("host"), domain).where("doc_id < 0")
    got = {-r.doc_id: r._language.language for r in found.collect()}
    # The fourth host is new: its prior is that of its domain.
    assert got == {1: "fr", 2: "es", 3: "de", 4: "de"}


def test_edges(spark):
    rows = EDGES + [(50, "这是一个中文句子，没有别的语言。" * 20, None, None), (51, "A.", "en", "a"), (52, "12 34 !!", "en", "a")]
    got = {r.doc_id: r._language for r in L.document_languages(documents(spark, rows)).collect()}
    for doc_id in (1, 2, 3, 52):
        assert (got[doc_id].language, got[doc_id].accepted) == ("und", False)
    assert got[50].language == "und" and not got[50].accepted
    assert got[51].language == "en" and got[4].language == "en" and got[None].language == "en"


def test_pages(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    found = L.page_languages(pages)
    assert found.count() == pages.count() and found.where("_language.accepted").count() == pages.count()


def test_empty_table(spark):
    assert L.document_languages(empty(spark)).count() == 0


def test_keep_accepted(spark):
    """All columns stay as they are, also one called like the result."""
    docs = documents(spark)
    found = L.document_languages(docs).where("_language.accepted")
    kept = L.keep_accepted(docs)
    assert kept.columns == docs.columns and {r._language for r in kept.collect()} == {"x"}
    key = lambda r: (str(r.doc_id), str(r.text))
    assert sorted(map(key, kept.collect())) == sorted(map(key, found.collect()))
    assert L.keep_accepted(empty(spark)).count() == 0


def brute(rows):
    """(doc_id, language, probability) of (doc_id, text, lang, source) rows."""
    fold = lambda b: chr(b + 32) if 65 <= b <= 90 else chr(b) if 97 <= b <= 122 or b >= 128 else " "

    def trigrams(text):
        folded = "".join(fold(b) for b in text.encode())
        return [t for t in (folded[i : i + 3] for i in range(len(folded) - 2)) if t != "   "], any(c != " " for c in folded)

    places = {}

    def bucket(gram):
        if gram not in places:
            data = pa.array([gram.encode("latin-1")], pa.binary())
            upper = L.trigram_buckets(data)[0]
            places[gram] = int(upper[0])
        return places[gram]

    rows = [(i, t or "", x, s) for i, t, x, s in rows]
    models = {}
    for x in L.LANGUAGES:
        counts = Counter()
        for t, n in Counter(t for _, t, y, _ in rows if y == x).items():
            for g in trigrams(t)[0]:
                counts[bucket(g)] += n.bit_length()
        total = sum(counts.values()) + 0.5 * L.BUCKETS
        models[x] = lambda b, counts=counts, total=total: math.log((counts[b] + 0.5) / total)
    domain = lambda s: ".".join(s.split(".")[-2:]) if s and "." in s else None
    known = [(s, x) for _, _, x, s in rows if s is not None and x in L.LANGUAGES]
    corpus = {x: (sum(y == x for _, y in known) + 1) / (len(known) + len(L.LANGUAGES)) for x in L.LANGUAGES}

    def shrunk(counted, towards):
        return {x: (counted.count(x) + L.HOST_WEIGHT * towards[x]) / (len(counted) + L.HOST_WEIGHT) for x in L.LANGUAGES}

    def prior(s):
        if s is None:
            return dict.fromkeys(L.LANGUAGES, 1 / len(L.LANGUAGES))
        parent = shrunk([x for t, x in known if domain(t) == domain(s)], corpus) if domain(s) else corpus
        return shrunk([x for t, x in known if t == s], parent)

    def told(tag, x, right):
        return 0.0 if tag not in L.LANGUAGES else math.log(right if tag == x else (1 - right) / (len(L.LANGUAGES) - 1))

    out = []
    for i, text, tag, s in rows:
        grams, letters = trigrams(text)
        scores = {}
        for x in L.LANGUAGES if letters else ():
            evidence = told(tag, x, L.DECLARED_RIGHT) + told(L.SUFFIX_LANGUAGE.get(s.split(".")[-1]) if s else None, x, L.SUFFIX_RIGHT)
            scores[x] = math.log(prior(s)[x]) + evidence + L.TEMPER * sum(models[x](bucket(g)) for g in grams)
        scores["und"] = L.TEMPER * L.FOREIGN * len(grams) + math.log(L.FOREIGN_PRIOR)
        best = max(scores, key=scores.get)
        out.append((i, best, 1 / sum(math.exp(v - scores[best]) for v in scores.values())))
    return out


def test_posterior_by_brute_force(spark):
    parts = {
        "de": "der Hund und die Katze gehen durch den Wald", "en": "the dog and the cat walk through the wood",
        "es": "el perro y el gato van por el bosque", "fr": "le chien et le chat vont dans la foret",
    }
    rng = np.random.default_rng(1)
    hosts = ["plain", "a.site.de", "b.site.de", "www.x.fr", "c.x.fr", None, "src7", "n.co.uk"]
    rows = []
    for i in range(160):
        x = L.LANGUAGES[rng.integers(4)]
        words = parts[x].split()
        text = " ".join(rng.choice(words, rng.integers(1, 4)))
        lang = [x, x, None, L.LANGUAGES[rng.integers(4)], "xx"][rng.integers(5)]
        rows.append((i, text, lang, hosts[rng.integers(len(hosts))]))
    rows += [(200 + i, rows[0][1], "de", "plain") for i in range(80)] + [(300, None, "en", "plain"), (301, "la", None, "new.x.fr"), (302, "¿é", "es", "x.es")]
    got = {r.doc_id: r._language for r in L.document_languages(documents(spark, rows)).collect()}
    wanted = brute(rows)
    assert len(got) == len(wanted)
    for i, language, probability in wanted:
        assert got[i].language == language and abs(got[i].probability - probability) < 1e-3, (i, got[i], language, probability)


def test_copies_do_not_fill_the_sample(spark):
    """Thousands of copies are drawn as one text and weigh as much as a few."""
    rows = [(i, f"the cat number {i} walks through the wood", "en", "a") for i in range(50)]
    table = lambda n: documents(spark, rows + [(100 + i, rows[0][1], "en", "a") for i in range(n)])
    fit = lambda n: L.fit_texts(table(n).select(F.col("lang").alias("label"), "text"), sample_rows=100)
    alone, many = fit(0), fit(5000)
    assert np.array_equal(fit(5000), fit(8190)) and np.abs(alone - many).max() < 1.5


def test_scoring_takes_little_memory_at_a_time():
    """The arrays made of one slice of texts."""
    texts = pa.array(["Wort und Satz " * 180] * 2000).cast(pa.binary())
    begin, end = next(L.slices(texts, L.SCORED_BYTES))
    tracemalloc.start()
    L.trigram_buckets(texts.slice(begin, end - begin))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10 << 20
