"""Chat formatting with a grammar that is checked by reading every rendered turn back.

A conversation is rendered as turn after turn, each between an opening and a closing mark:

    turn   := open text close
    open   := "<<SYS>>" | "[INST]" | "<s>"  | "[ROLE " name "]"
    close  := "<</SYS>>" | "[/INST]" | "</s>" | "[/ROLE]"

In a text, the escape character makes the control string (or escape character) behind it plain.
A text is first rendered as it is; the rendering is parsed, and only if the recovered turn is not
the source are the conflicting strings escaped, and the check is made again.

Conversations are streamed in the order of their turns, so a very long one is never held as a
whole: it is written in several parts, each of whole turns.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import travels

# The marks of the template.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER_OPEN, OTHER_CLOSE = "[ROLE ", "[/ROLE]"
ESCAPE = "␛"

CONTROLS = [mark for pair in MARKS.values() for mark in pair] + [OTHER_OPEN, OTHER_CLOSE]
CONTROL = "|".join(re.escape(c) for c in CONTROLS)
TOKENS = re.compile(f"{ESCAPE}({ESCAPE}|{CONTROL})|({CONTROL})")
# In the name of a role only the bracket that ends it, and the escape character, are escaped.
ROLE_ESCAPED = re.compile(f"{ESCAPE}(.)", re.S)
ROLE_NAME = re.compile(f"((?:{ESCAPE}.|[^{ESCAPE}\\]])*)\\]", re.S)

# Characters after which a part of a long conversation is closed.
PART_CHARS = 1 << 20

travels(__name__)


def escape(text: str) -> str:
    return re.sub(f"{ESCAPE}|{CONTROL}", lambda m: ESCAPE + m[0], text)


def unescape(text: str) -> str:
    return TOKENS.sub(lambda m: m[1] or m[0], text)


def parse(rendered: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn; start and end bound the escaped text. ValueError if it is no conversation."""
    closes = {opening: (role, closing) for role, (opening, closing) in MARKS.items()}
    at = 0
    while at < len(rendered):
        for opening, (role, closing) in closes.items():
            if rendered.startswith(opening, at):
                at += len(opening)
                break
        else:
            if not rendered.startswith(OTHER_OPEN, at):
                raise ValueError("a turn must begin with a mark")
            name = ROLE_NAME.match(rendered, at + len(OTHER_OPEN))
            if not name:
                raise ValueError("unfinished role")
            role, closing, at = ROLE_ESCAPED.sub(r"\1", name[1]), OTHER_CLOSE, name.end()
        start = at
        while True:
            found = TOKENS.search(rendered, at)
            if not found:
                raise ValueError("a turn has no end")
            at = found.end()
            if found[2] is not None:
                break
        if found[2] != closing:
            raise ValueError("another mark inside a turn")
        yield role, unescape(rendered[start : found.start()]), start, found.start()


def _framed(role: str, text: str) -> str:
    if role in MARKS:
        return f"{MARKS[role][0]}{text}{MARKS[role][1]}"
    name = re.sub(f"[{ESCAPE}\\]]", lambda m: ESCAPE + m[0], role)
    return f"{OTHER_OPEN}{name}]{text}{OTHER_CLOSE}"


def render(role: str, text: str) -> str:
    """The turn as text from which ``parse`` gives exactly this role and text."""
    for candidate in (text, escape(text)):
        rendered = _framed(role, candidate)
        try:
            if [turn[:2] for turn in parse(rendered)] == [(role, text)]:
                return rendered
        except ValueError:
            pass
    raise ValueError(f"role cannot be rendered: {role!r}")


FORMATTED = "conv_id long, part int, formatted string, loss array<struct<start:int,end:int>>"


def _format(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("formatted", pa.string()), ("loss", span)])
    conv, part, pieces, length, loss, out, begun = None, 0, [], 0, [], [], False

    def close() -> None:
        nonlocal part, pieces, length, loss
        out.append((conv, part, "".join(pieces), loss))
        part, pieces, length, loss = part + 1, [], 0, []

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t.type) for i, t in enumerate(schema)], schema=schema)
        out.clear()
        return batch

    for batch in batches:
        for conv_id, role, text in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "role", "text")]):
            if not begun or conv_id != conv:
                if begun and pieces:
                    close()
                conv, part, begun = conv_id, 0, True
            turn = render(role, text)
            if role == "assistant":
                opening, closing = MARKS[role]
                loss.append({"start": length + len(opening), "end": length + len(turn) - len(closing)})
            pieces.append(turn)
            length += len(turn)
            if length >= PART_CHARS:
                close()
        yield flush()
    if begun and pieces:
        close()
        yield flush()


def format_conversations(turns: DataFrame) -> DataFrame:
    """``conv_id, part, formatted, loss``: the text of each conversation with the spans the loss is taken on.

    Joined by ``part``, ``formatted`` is the conversation; parts hold whole turns, and nearly all
    conversations have one. ``loss`` bounds the assistant texts in code points of the part. NULL
    texts and roles are empty; a NULL ``conv_id`` is a conversation of its own. Turns with equal
    numbers (NULL first) go by role, then text; repeated rows are repeated turns. Other columns
    are ignored, an empty table gives no rows.
    """
    cells = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    ordered = cells.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(_format, FORMATTED)


def _read_back(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    out, state = [], None

    def close() -> None:
        conv, n, turns, chars, loss, total = state
        out.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), total))

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)
        out.clear()
        return batch

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "part", "formatted", "loss")]
        for conv, part, formatted, spans in zip(*columns):
            if part == 0:
                if state:
                    close()
                state = [conv, 0, sha256(), 0, sha256(), 0]
            for role, text, _, _ in parse(formatted):
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
            for span in spans:
                plain = unescape(formatted[span["start"] : span["end"]])
                state[3] += len(plain)
                state[4].update(plain.encode())
            state[5] += len(formatted)
        yield flush()
    if state:
        close()
        yield flush()


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of turns and loss text, recovered from the formatted text alone.

    Takes the table as ``format_conversations`` gives it: the parts of a conversation follow each
    other in one partition.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.mapInArrow(_read_back, schema)
