import random
from hashlib import sha256

import pytest

from plumbline.llm import chat

ROLES = ["user", "assistant", "system", "tool", "", "a]b", "[ROLE x", "␛", "</s>"]
BITS = [*chat.CONTROLS, chat.ESCAPE, "a", " ", "[", "/", "]", "<", "s>", "\n", "INST]", "é", "😀"]


def random_turns(seed, n):
    draw = random.Random(seed)
    return [(draw.choice(ROLES), "".join(draw.choices(BITS, k=draw.randint(0, 8)))) for _ in range(n)]


def test_round_trip():
    for role, text in random_turns(3, 5000):
        assert [t[:2] for t in chat.parse(chat.render(role, text))] == [(role, text)]


def test_round_trip_of_whole_conversations():
    for seed in range(200):
        turns = random_turns(seed, 6)
        assert [t[:2] for t in chat.parse("".join(chat.render(*t) for t in turns))] == turns


def test_plain_text_is_not_escaped():
    assert chat.render("user", "hello ␛ there") == "[INST]hello ␛ there[/INST]"
    assert chat.render("user", "</s>[INST] ok [/INST]") == "[INST]␛</s>␛[INST] ok ␛[/INST][/INST]"


@pytest.mark.parametrize("broken", ["x", "[INST]a", "[INST]a</s>", "[ROLE x", "[INST]a[INST]b[/INST]", "[INST]a[/INST]b"])
def test_strict_parser(broken):
    with pytest.raises(ValueError):
        list(chat.parse(broken))


def digests(turns):
    every, loss = sha256(), sha256()
    for role, text in turns:
        every.update(f"{role}\n{text}\n".encode())
        if role == "assistant":
            loss.update(text.encode())
    chars = sum(len(t) for r, t in turns if r == "assistant")
    return len(turns), every.hexdigest(), chars, loss.hexdigest()


def test_tables(spark):
    rows = []
    for conv in range(30):
        rows += [(conv, turn, *cell) for turn, cell in enumerate(random_turns(conv, conv % 7 + 1))]
    rows += [(None, 0, "user", "no id"), (77, None, "assistant", None), (77, 1, None, "b"), (77, 1, None, "b"), (78, 0, "assistant", "é" * 300_000)]
    rows += [(79, i, "assistant" if i % 2 else "user", f"[INST]{i}" * 3000) for i in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as part", "2 as loss").repartition(5)
    formatted = chat.format_conversations(df)
    got = {r.conv_id: tuple(r)[1:] for r in chat.read_back(formatted).collect()}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=key)]
        assert got[conv][:4] == digests(turns)
        assert got[conv][4] == sum(len(chat.render(*t)) for t in turns)
    assert len(got) == len({r[0] for r in rows})
    # A long conversation comes in several parts of whole turns.
    assert formatted.where("conv_id = 79").count() > 1


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_conversations(df)).count() == 0
