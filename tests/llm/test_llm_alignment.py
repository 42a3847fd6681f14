"""Alignment against both libraries on whole texts, with plain set operations."""

from collections import Counter
from hashlib import sha256
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from llm_cases import EDGES, LONG, documents, empty
from tokenizers import Tokenizer

from plumbline.llm import alignment, queries

TEXTS = [
    "a▁b ▁ x",
    " leading",
    "two  spaces   and trailing ",
    "<s> </s> <unk> <|endoftext|><0x41>",
    "中文字没有空格" * 300,
    "x\ty\nz\r\n\x00 \x1c\x85 ",
    "naïve café ﬁ ① 😀😀",
    "AbCdEfGhIjKlMnOp0123456789" * 200,
    "▁",
    "the the the the",
]
ROWS = EDGES + [(100 + i, t, "en", "a") for i, t in enumerate(TEXTS)] + [(200 + i, f"the word {i} again", "en", "a") for i in range(60)]


@pytest.fixture(scope="module")
def files():
    return queries.tokenizer_json("byte_bpe_50k.json"), Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes()


def byte_pieces(tokenizer):
    """Bytes of each id by the rule of byte-level vocabularies."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    table = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    return lambda i: bytes(table[c] for c in tokenizer.id_to_token(i))


def expected(rows, files):
    a = Tokenizer.from_str(files[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_proto=files[1])
    bytes_a = byte_pieces(a)

    def bytes_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    docs = []
    for doc, text, *_ in rows:
        want = (" " + (text or "")).encode()
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        parts_a, parts_b = [bytes_a(i) for i in ids_a], [bytes_b(i) for i in ids_b]
        if b"".join(parts_a) != want or b"".join(parts_b) != want:
            docs.append((doc, [], [], [], []))
            continue
        ends_a, ends_b = np.cumsum([len(p) for p in parts_a]).tolist(), np.cumsum([len(p) for p in parts_b]).tolist()
        shared, groups, i, j = sorted(set(ends_a) & set(ends_b)), [], 0, 0
        place_a, place_b = ({e: n + 1 for n, e in enumerate(ends)} for ends in (ends_a, ends_b))
        for end in shared:
            to_a, to_b = place_a[end], place_b[end]
            groups.append((ids_a[i:to_a], ids_b[j:to_b]))
            i, j = to_a, to_b
        links, i, j = [], 0, 0
        while i < len(ids_a) and j < len(ids_b):
            links.append((ids_a[i], ids_b[j]))
            end = min(ends_a[i], ends_b[j])
            i, j = i + (ends_a[i] == end), j + (ends_b[j] == end)
        docs.append((doc, ids_a, ids_b, groups, links))
    counts = Counter(pair for *_, links in docs for pair in set(links))
    most = {}
    for (x, _), n in counts.items():
        most[x] = max(most.get(x, 0), n)
    out = []
    for doc, ids_a, ids_b, groups, links in docs:
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        best = sum(counts[p] == most[p[0]] for p in links)
        digest = sha256(shown.encode()).hexdigest() if ids_a else ""
        out.append((doc, len(ids_a), len(ids_b), len(groups), len(links), best, sum(counts[p] for p in links), shown, digest))
    return sorted(out, key=str)


@pytest.mark.parametrize("most_sent", [alignment.MOST_SENT, 50, 0])
def test_documents(spark, files, most_sent):
    rows = [r for r in ROWS if r[1] != LONG]
    got = alignment.align_tokenizers(documents(spark, rows), *files, most_sent=most_sent).collect()
    want = expected(rows, files)
    assert sorted(map(tuple, got), key=str) == want
    assert sum(w[1] == 0 for w in want) >= 4 and any(w[3] < min(w[1], w[2]) for w in want)


def test_long_text(spark, files):
    rows = [r for r in EDGES if r[1] == LONG]
    got = alignment.align_tokenizers(documents(spark, rows), *files).collect()
    assert sorted(map(tuple, got), key=str) == expected(rows, files)


def test_division():
    """Random cuts of both sides: the groups lie between the shared ends, whatever the shares."""
    draw = np.random.default_rng(4)
    for share in (0.0, 0.02, 0.3, 0.9, 1.0):
        for size in (1, 2, 3, 10, 500):
            parts = [np.sort(draw.choice(np.arange(1, size), int((size - 1) * f), replace=False)) for f in (0.6, 0.6)]
            common = parts[0][draw.random(len(parts[0])) < share]
            ends_a = np.union1d(parts[0], [size])
            ends_b = np.union1d(np.union1d(np.setdiff1d(parts[1], parts[0]), common), [size])
            found = alignment.shared_groups(ends_a, ends_b, np.array([0, len(ends_a)]), np.array([0, len(ends_b)]))
            assert ends_a[found[:, 1] - 1].tolist() == np.intersect1d(ends_a, ends_b).tolist()
            assert (ends_a[found[:, 1] - 1] == ends_b[found[:, 3] - 1]).all()
            assert (found[1:, [0, 2]] == found[:-1, [1, 3]]).all() and (found[0, [0, 2]] == 0).all()


def test_empty_table(spark, files):
    assert alignment.align_tokenizers(empty(spark), *files).count() == 0


def test_query(spark, files):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = queries.QUERIES["op13_alignment"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(*w[:7], w[8]) for w in expected(rows, files)], key=str)
