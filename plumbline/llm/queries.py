"""The registered queries of this package: name, Spark callable, and SQL for DuckDB where there is one."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import (
    alignment,
    bpe,
    chat,
    decontaminate,
    exact,
    lang_id,
    lines,
    minhash,
    ngram_lm,
    packing,
    periods,
    secret_scan,
    warc_zip,
)
from plumbline.llm.common import SPACES, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return register


@query(
    "op7_exact_dedup",
    r"""with t as (
      select doc_id, length(coalesce(text, '')) as n,
             sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) as text_sha256 from documents),
    w as (select *, first_value(doc_id) over (partition by text_sha256 order by n desc, doc_id) as keep_id,
                 count(*) over (partition by text_sha256) as group_size from t)
    select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from w""",
)
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.deduplicate(table(spark, sf_dir, "documents")).drop("n_chunks")


_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op5_decontaminate",
    rf"""with d as (
      select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') as w from documents),
    b as (select item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') as w from benchmark),
    g as (select item_id, len(w[i:i + 9]) as k, array_to_string(w[i:i + 9], ' ') as gram
          from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from b where len(w) > 0)),
    ks as (select distinct k from g),
    p as (select doc_id, k, s, array_to_string(w[s:s + k - 1], ' ') as gram
          from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as s from d, ks)),
    h as (select distinct doc_id, p.k, s, item_id from p join g on p.gram = g.gram and p.k = g.k),
    c as (select doc_id, count(distinct x) as n from (select doc_id, unnest(range(s, s + k)) as x from h) group by 1),
    i as (select doc_id, count(*) as n, string_agg(v, ',' order by v) as v
          from (select distinct doc_id, cast(item_id as varchar) as v from h) group by 1)
    select d.doc_id, len(w) as n_words, coalesce(c.n, 0) as n_hit, coalesce(i.n, 0) as n_items,
           sha256(coalesce(i.v, '')) as items_sha256, c.n is not null as contaminated
    from d left join c on d.doc_id = c.doc_id left join i on d.doc_id = i.doc_id""",
)
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.digest(found)


@query("op8_secrets")
def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents")))


_TRIMMED = "trim({0}, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13))"


@query(
    "op3_line_dedup",
    f"""with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
    l as (select doc_id, unnest(range(1, len(ls) + 1)) as i, unnest(ls) as line from d),
    k as (select *, {_LOWER.format(_TRIMMED.format("line"))} as key from l),
    h as (select key, max(doc_id) as keeper from k where length(key) >= 40
          group by key having count(distinct doc_id) >= 5),
    j as (select k.*, h.key is not null and k.doc_id <> h.keeper as gone from k left join h on k.key = h.key)
    select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
           sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256
    from j group by doc_id""",
)
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lines.digests(docs, lines.keep_bitmaps(docs))


_PROBE = "</s>[INST] ok [/INST]"


# Opening and closing marks together have 15 (system), 13 (user) and 7 characters. A text is escaped if it has a
# control string, or an escape character where it would count as one.
_CONTROL = r"<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]|<s>|</s>|\[ROLE |\[/ROLE\]"


@query(
    "op4_chat_format",
    rf"""with c as (
      select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
      union all values (-7, 0, 'user', '{_PROBE}'), (-7, 1, 'assistant', '{_PROBE}')),
    l as (select *, case role when 'system' then 15 when 'user' then 13 else 7 end + length(text)
                    + case when regexp_matches(text, '{_CONTROL}|␛␛|␛$')
                           then len(regexp_extract_all(text, '␛|{_CONTROL}')) else 0 end as n from c)
    select conv_id, count(*) as n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
           coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
           sha256(coalesce(string_agg(text, '' order by turn, text) filter (where role = 'assistant'), '')) as loss_sha256,
           sum(n)::bigint as formatted_chars
    from l group by conv_id""",
)
def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(_PROBE).alias("text"),
    )
    return chat.read_back(chat.format_conversations(turns.unionByName(probe)))


_BIT = " + ".join(f"{16 >> i} * cast(substr(b, 5 * i + {i + 1}, 1) as int)" for i in range(5))


@query(
    "op6_warc_zip",
    f"""with p as (select page_id, coalesce(html, '') as html from pages),
    d as (select page_id, strlen(html) as payload_bytes, cast(cast(unhex(sha1(html)) as bit) as varchar) as b,
                 max(page_id) over (partition by html) as owner from p)
    select page_id, payload_bytes,
           array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + {_BIT}, 1)), '')
             as payload_digest,
           case when page_id = owner then 'response' else 'revisit' end as record_type,
           case when page_id <> owner then owner end as refers_to
    from d""",
)
def op6_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc_zip.write_pages(table(spark, sf_dir, "pages"))
    records = warc_zip.read_archives(archives, with_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op9_ngram_lm")
def op9_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score_documents(table(spark, sf_dir, "documents"))


def _languages(found: DataFrame, key: str) -> DataFrame:
    return found.select(key, "_language.language", F.round("_language.probability", 6).alias("probability"), "_language.accepted")


@query("op10_language_id")
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _languages(lang_id.document_languages(table(spark, sf_dir, "documents")), "doc_id")


@query("page_language_id")
def page_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _languages(lang_id.page_languages(table(spark, sf_dir, "pages")), "page_id")


@query("op2_minhash")
def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.find_classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "class_size", "kept")


def tokenizer_json(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return Path(public_tokenizers.path(name)).read_text()


@query("op1_bpe")
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_json(), full=False)


@query("op11_packing")
def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_json("byte_bpe_50k.json"), full=False)


def repeat_blocks(docs: DataFrame) -> DataFrame:
    """``doc_id, text``; in every tenth document by a hash of its id, a block of words is repeated from some word on."""
    split = F.array_remove(F.split(F.coalesce("text", F.lit("")), f"{SPACES}+"), "")
    hashed = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", F.when(hashed % 10 == 0, split).alias("w"), F.floor(hashed / 10).alias("g"))
    n = F.size("w")
    rows = rows.withColumn("a", (F.col("g") % F.greatest(n, F.lit(1))).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    a, p = F.col("a"), F.col("p")
    block = F.slice("w", a + 1, p)
    turned = F.slice(F.flatten(F.array_repeat(block, F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    text = F.array_join(F.concat(F.slice("w", F.lit(1), a), turned), " ")
    return rows.select("doc_id", F.coalesce(text, F.col("text")).alias("text"))


@query("op12_periods")
def op12_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.detect_runs(repeat_blocks(table(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = found.select("*", periods.best_run(F.col("runs")).alias("best"))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query("op13_alignment")
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes()
    return alignment.align_tokenizers(
        table(spark, sf_dir, "documents"), tokenizer_json("byte_bpe_50k.json"), model, full=False
    )
