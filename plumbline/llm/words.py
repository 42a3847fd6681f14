"""Token ids of texts, word by word, for vocabularies in which no token runs over the space before a word.

A text is cut before each single space that a word follows. Both kinds of tokenizer here treat
what stands between such cuts independently (byte-level: the pre-tokenizer always starts anew
there; sentence pieces: no piece has a space behind another character), so each distinct word of a
slice is looked up once, and only words that a task has not met go to the tokenizer. Texts with
other white space around a cut are encoded whole.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from plumbline.llm.common import travels

# Words that a task remembers in each of two generations, and characters of the longest one.
MEMORY_WORDS, LONGEST_WORD = 200_000, 100

# The split pattern of byte-level vocabularies, and the mark of a space in sentence pieces.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE_MARK = "▁"

# A space, or the start, that is followed by white space or by the end.
UNEVEN = r"(?:\A| )(?:[\s\x0b\x1c-\x1f\p{Z}\x{85}]|\z)"

travels(__name__)


class Memory:
    """Ids of words, as bytes of little-endian unsigned 32-bit numbers.

    Words that are met again move to the young generation; when that is full, the old one goes.
    """

    def __init__(self, most: int = MEMORY_WORDS) -> None:
        self.most = most
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def __call__(self, words: list[str], encode: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """Ids of distinct words; ``encode`` gives those of unknown ones."""
        found = list(map(self.young.get, words))
        missing = [i for i, ids in enumerate(found) if ids is None]
        if len(self.young) + len(missing) > self.most:
            self.old, self.young = self.young, {}
        fresh = []
        for i in missing:
            ids = self.old.get(words[i])
            if ids is None:
                fresh.append(i)
            else:
                found[i] = self.young[words[i]] = ids
        if fresh:
            for i, ids in zip(fresh, encode([words[i] for i in fresh])):
                found[i] = ids
                if len(words[i]) <= LONGEST_WORD:
                    self.young[words[i]] = ids
        return found


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers ``start, start + 1, ...`` of each range, one after the other."""
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(int(counts.sum()))


def byte_of_character() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(others)}}


class Words:
    """What both tokenizers share: encoding of texts by their distinct words."""

    # Whether the first word is encoded as if a space stood before it.
    leading = True
    token_bytes: list[bytes]

    def whole(self, text: str) -> list[int]:
        """Ids of a whole text (with a space before it, if ``leading``)."""
        raise NotImplementedError

    def later_words(self, words: list[str]) -> list[bytes]:
        """Ids of words that follow a space."""
        raise NotImplementedError

    def uneven(self, texts: pa.Array) -> np.ndarray:
        return pc.match_substring_regex(texts, UNEVEN).to_numpy(zero_copy_only=False)

    def __init__(self) -> None:
        self.memory, self.firsts = Memory(), Memory()

    def first_words(self, words: list[str]) -> list[bytes]:
        return [np.array(self.whole(w), dtype="<u4").tobytes() for w in words]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and the number of ids of each text."""
        whole = self.uneven(texts)
        ids, counts = self._by_words(texts.filter(pa.array(~whole)))
        if not whole.any():
            return ids, counts
        apart = [np.array(self.whole(t), dtype=np.uint32) for t in texts.filter(pa.array(whole)).to_pylist()]
        all_counts = np.empty(len(texts), dtype=np.int64)
        all_counts[~whole], all_counts[whole] = counts, [len(x) for x in apart]
        starts = np.empty(len(texts), dtype=np.int64)
        both = np.concatenate([counts, all_counts[whole]])
        begins = np.cumsum(both) - both
        starts[~whole], starts[whole] = begins[: len(counts)], begins[len(counts) :]
        return np.concatenate([ids, *apart])[spread(starts, all_counts)], all_counts

    def _by_words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        split = pc.split_pattern(texts, " ")
        begins = split.offsets.to_numpy().astype(np.int64)
        coded = split.flatten().dictionary_encode()
        begins -= begins[0]
        codes = coded.indices.to_numpy().astype(np.int64)
        words = coded.dictionary.to_pylist()
        found = self.memory(words, self.later_words)
        if not self.leading:
            # First words are words of another kind, numbered behind the others.
            kinds, inverse = np.unique(codes[begins[:-1]], return_inverse=True)
            codes[begins[:-1]] = len(words) + inverse
            found = found + self.firsts([words[k] for k in kinds], self.first_words)
        store = np.frombuffer(b"".join(found), dtype="<u4")
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        starts = np.cumsum(sizes) - sizes
        counts = sizes[codes]
        totals = np.concatenate([[0], np.cumsum(counts)])
        return store[spread(starts[codes], counts)], np.diff(totals[begins])


class ByteLevelWords(Words):
    """A byte-level BPE file of the tokenizers library.

    With ``plain_specials`` the strings of special tokens are ordinary text. Where the ids of the
    vocabulary are the ranks of its merges, words are encoded from the ranks, otherwise by the library.
    """

    def __init__(self, tokenizer_json: str, leading: bool, plain_specials: bool) -> None:
        self.leading, self.source, self.plain_specials = leading, tokenizer_json, plain_specials
        settings = json.loads(tokenizer_json)
        specials = {t["content"]: t["id"] for t in settings["added_tokens"]}
        self.specials = [] if plain_specials else [t["content"] for t in settings["added_tokens"]]
        vocabulary = {w: i for w, i in settings["model"]["vocab"].items() if w not in specials}
        table = byte_of_character()
        self.token_bytes = [b""] * (1 + max([*vocabulary.values(), *specials.values()]))
        for token, i in vocabulary.items():
            self.token_bytes[i] = bytes(map(table.__getitem__, token))
        for token, i in specials.items():
            self.token_bytes[i] = token.encode()
        self.after_space = np.array([t[:1] == b" " for t in self.token_bytes])
        self.ranked = None
        made = [settings["model"]["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m)) for m in settings["model"]["merges"]]
        if settings["pre_tokenizer"] and settings["pre_tokenizer"].get("use_regex") and not settings["normalizer"]:
            if None not in made and all(a < b for a, b in zip(made, made[1:])):
                import tiktoken

                ranks = {self.token_bytes[i]: i for i in vocabulary.values()}
                self.ranked = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        super().__init__()

    @cached_property
    def tokenizer(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        made = Tokenizer.from_str(self.source)
        made.no_truncation()
        made.no_padding()
        made.encode_special_tokens = self.plain_specials
        return made

    def by_library(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def plain(self, text: str) -> list[int]:
        return self.by_library(text) if self.ranked is None else self.ranked.encode_ordinary(text)

    def whole(self, text: str) -> list[int]:
        text = " " + text if self.leading else text
        return self.by_library(text) if any(s in text for s in self.specials) else self.plain(text)

    def later_words(self, words: list[str]) -> list[bytes]:
        ids = np.array(self.plain(" " + " ".join(words)), dtype="<u4")
        begins = np.flatnonzero(self.after_space[ids])
        if len(begins) != len(words):
            raise AssertionError("each word must begin with a token of its own")
        ends = [*begins[1:].tolist(), len(ids)]
        data = ids.tobytes()
        return [data[4 * a : 4 * b] for a, b in zip(begins.tolist(), ends)]

    def uneven(self, texts: pa.Array) -> np.ndarray:
        out = super().uneven(texts)
        for s in self.specials:
            out = out | pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        return out


class PieceWords(Words):
    """A SentencePiece model that puts a space before each text and keeps all white space."""

    def __init__(self, model: bytes) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_proto=model)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.token_bytes = [
            bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(SPACE_MARK, " ").encode()
            for i, p in enumerate(pieces)
        ]
        self.independent = not any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces)
        super().__init__()

    def whole(self, text: str) -> list[int]:
        return self.model.encode(text)

    def later_words(self, words: list[str]) -> list[bytes]:
        return [np.array(ids, dtype="<u4").tobytes() for ids in self.model.encode(words, num_threads=1)]

    def uneven(self, texts: pa.Array) -> np.ndarray:
        if not self.independent:
            return np.ones(len(texts), dtype=bool)
        # A space mark in the text becomes a space and may grow together with its neighbours.
        return super().uneven(texts) | pc.match_substring(texts, SPACE_MARK).to_numpy(zero_copy_only=False)
