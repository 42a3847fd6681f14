import random
import struct
from hashlib import sha256

import pytest
from llm_cases import EDGES, documents, empty

from plumbline.llm import bpe, words
from plumbline.llm.queries import tokenizer_json


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(tokenizer_json())


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    made.no_truncation()
    made.no_padding()
    return made


TRICKY = "é́ é Σ ΑΣ it's don't \x85\xa0b　c <|endoftext|><|startoftext|>x 😀😀 ab12 ... İ ﬁ ​\x1c\x1dq"


def ids(library, text):
    return library.encode(text, add_special_tokens=False).ids


def packed(values):
    return struct.pack(f"<{len(values)}I", *values)


def test_words_give_the_ids_of_the_whole_text(encoder, library):
    draw = random.Random(1)
    pieces = [*TRICKY, *TRICKY.split(" "), " ", "\n", "\t", "\x0b", "hello", "World"]
    for _ in range(3000):
        text = "".join(draw.choices(pieces, k=draw.randint(0, 12)))
        assert encoder.encode([text.encode()]) == [packed(ids(library, text))]


def test_joins_are_repaired(encoder, library):
    draw = random.Random(2)
    text = (TRICKY + " plain words and somewhatlongerwords without1end ") * 3
    for _ in range(1500):
        cuts = sorted(draw.sample(range(1, len(text)), draw.randint(1, 12)))
        joiner = bpe.Joiner(encoder)
        for a, b in zip([0, *cuts], [*cuts, len(text)]):
            piece = text[a:b].encode()
            joiner.add(*encoder.encode([piece]), *bpe.edges(piece))
        assert joiner.finish() == packed(ids(library, text))


def test_open_words_are_encoded_once(encoder, library, monkeypatch):
    """A text without white space costs its length, not its square."""
    pieces = [f"{i:04x}Q.".encode() * 8 for i in range(2000)]
    joiner, asked = bpe.Joiner(encoder), 0
    encoded = encoder.encode(pieces)
    whole = encoder.encode

    def counting(texts):
        nonlocal asked
        asked += sum(map(len, texts))
        return whole(texts)

    monkeypatch.setattr(encoder, "encode", counting)
    for piece, found in zip(pieces, encoded):
        joiner.add(found, *bpe.edges(piece))
    assert joiner.finish() == packed(ids(library, b"".join(pieces).decode()))
    assert asked <= 2 * sum(map(len, pieces))


def test_two_generations_of_words():
    asked = []
    held, encode = words.Memory(most=10), lambda fresh: [asked.append(w) or w.encode() for w in fresh]
    memory = lambda found: held(found, encode)
    for i in range(50):
        # Words that stay in use outlive the ones between them.
        assert memory(["hot", f"cold{i}"]) == [b"hot", f"cold{i}".encode()]
    assert asked.count("hot") == 1 and len(held.young) + len(held.old) <= 20
    long = "x" * 1000
    assert memory([long]) == memory([long]) and asked.count(long) == 2


def test_chunks_are_cut_by_content():
    draw = random.Random(3)
    shared = " ".join(f"w{draw.random()}" for _ in range(3000)).encode()
    a, b = b"start " * 70 + shared, "other é ".encode() * 333 + shared + b" end"
    cut = [{t[i:j] for i, j in zip([0, *e], e)} for t, e in zip((a, b), bpe.chunk_ends([a, b]))]
    assert len(cut[0] & cut[1]) > 0.8 * len(cut[0])
    for text in (a, b, b"", b"x", "é".encode() * 30_000, "中".encode() * 30_000):
        (ends,) = bpe.chunk_ends([text])
        assert b"".join(text[i:j] for i, j in zip([0, *ends], ends)) == text
        assert all(text[i:j].decode() and j - i <= bpe.MAX_CHUNK + 3 for i, j in zip([0, *ends], ends))
    # A text's chunks do not hang on its neighbours in the batch.
    assert bpe.chunk_ends([b, a])[1] == bpe.chunk_ends([a])[0]


def test_documents(spark, library):
    shared = "pre" * 3000 + " " + TRICKY * 200 + "<|endoftext|>" * 900 + "é́" * 4000
    rows = EDGES + [(500 + i, "lead " * i + shared + "tail" * i, "en", "a") for i in range(6)]
    rows += [(600, "x" * 30_000, "en", "a"), (601, "x" * 30_000 + "y", "en", "a"), (602, TRICKY, "en", "a")]
    docs = documents(spark, rows)
    got = bpe.encode_documents(docs, tokenizer_json()).collect()
    want = []
    for doc_id, text, *_ in rows:
        values = ids(library, text or "")
        decoded = library.decode(values, skip_special_tokens=False)
        data = packed(values)
        want.append((doc_id, len(values), sha256(data).hexdigest(), sha256(decoded.encode()).hexdigest(), data, decoded))
    assert sorted([(*tuple(r)[:4], bytes(r.ids), r.decoded) for r in got], key=str) == sorted(want, key=str)
    digests = bpe.encode_documents(docs, tokenizer_json(), full=False)
    assert sorted([tuple(r) for r in digests.collect()], key=str) == sorted([w[:4] for w in want], key=str)


def test_empty_table(spark):
    assert bpe.encode_documents(empty(spark), tokenizer_json()).count() == 0
