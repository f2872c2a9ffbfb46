"""Ids of whole texts by public tokenizers, from words that are encoded once.

A text may be cut before any single space that stands between two characters that are no white space: byte-level
pre-tokens never reach over such a place, and neither does a piece of which only the beginning is a space.  So a text's
ids are those of its words, each with the space before it.  A word is encoded by the library when a task first meets
it, many new words in one call; :class:`Words` numbers the words and keeps what came out, within a fixed size.  A tokenizer for which the cuts
do not hold gets whole texts.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Public vocabularies; the path is a parameter wherever a tokenizer is used.
BYTE_MODEL = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters that are cut into words at once.
BLOCK = 6_000_000
#: Size of what a task keeps of the words it has met (characters, each word counting for ``WORD`` more): some 600,000 words, which
#: take 130 MB with their ids and 220 MB with their alignments; longer words are not kept.
ROOM = 64_000_000
WORD = 100
LONG = 200
#: Words that are encoded in one call.
CALL = 2_000
_CUT = re.compile(r"(?<=\S) (?=\S)")
_EDGE = re.compile(r"  |[^\S ] | [^\S ]|\s$")


def blocks(text: str) -> Iterator[str]:
    """A text of any length in parts of at most about ``BLOCK`` characters, unless a word is longer, cut where it may be."""
    begin = 0
    while len(text) - begin > BLOCK and (found := _CUT.search(text, begin + BLOCK)):
        yield text[begin : found.start()]
        begin = found.end()
    yield text[begin:] if begin else text


def groups(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Texts in groups of about ``BLOCK`` characters, each with its first row; a longer text is alone, in blocks.

    Null is empty; what is no UTF-8 is replaced.
    """
    group: list[str] = []
    begin = size = 0
    for i, x in enumerate(texts.cast(pa.large_binary())):
        text = (x.as_py() or b"").decode(errors="replace")
        if group and size + len(text) > BLOCK:
            yield begin, group
            group, begin, size = [], i, 0
        group.append(text)
        size += len(text)
    if group:
        yield begin, group


class Ragged:
    """Rows of values of different lengths, in one array."""

    def __init__(self, kind):
        self.flat, self.used = np.zeros(1024, kind), 0
        self.at, self.sizes, self.n = np.zeros(1024, np.int64), np.zeros(1024, np.int64), 0

    def add(self, rows: list[bytes]) -> None:
        self.extend(np.frombuffer(b"".join(rows), self.flat.dtype), np.array([len(x) for x in rows], np.int64) // self.flat.itemsize)

    def extend(self, new: np.ndarray, sizes: np.ndarray) -> None:
        """Rows of these sizes, their values one after another."""
        self.flat = _room(self.flat, self.used + len(new))
        self.at, self.sizes = _room(self.at, self.n + len(sizes)), _room(self.sizes, self.n + len(sizes))
        self.flat[self.used : self.used + len(new)] = new
        self.at[self.n : self.n + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.sizes[self.n : self.n + len(sizes)] = sizes
        self.used, self.n = self.used + len(new), self.n + len(sizes)

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of ``rows`` one after another, and how many each has."""
        sizes = self.sizes[rows]
        ends = sizes.cumsum()
        at = np.repeat(self.at[rows] - ends + sizes, sizes)
        at += np.arange(len(at))
        return self.flat[at], sizes

    def keep(self, rows: np.ndarray) -> None:
        """Only ``rows`` stay, numbered anew."""
        flat, sizes = self.take(rows)
        self.flat, self.used, self.sizes, self.n = flat, len(flat), sizes, len(rows)
        self.at = sizes.cumsum() - sizes


def _room(x: np.ndarray, n: int) -> np.ndarray:
    return x if n <= len(x) else np.concatenate([x, np.zeros(max(n, 2 * len(x)) - len(x), x.dtype)])


class Words:
    """Numbers of the words of texts.  ``learn`` appends values of new words to its columns, ``keep`` leaves given rows of them."""

    def __init__(self, learn: Callable[[list[str], bool], None], keep: Callable[[np.ndarray], None], bare: bool):
        """``bare``: texts are encoded without a space before them, so their first words are words of another kind."""
        self.learn, self.keep, self.bare = learn, keep, bare
        self.row: dict[str, int] = {}
        self.first: dict[str, int] = {}
        self.n = self.size = 0
        self.met: tuple[list[str], list[str]] = [], []

    def _add(self, words: list[str], bare: bool) -> range:
        self.learn(words, bare)
        self.n += len(words)
        self.size += sum(map(len, words)) + WORD * len(words)
        return range(self.n - len(words), self.n)

    def _meet(self, words: list[str], row: dict[str, int], bare: bool) -> np.ndarray:
        new = [w for w in words if w not in row]
        plain = [w for w in new if w and w == w.strip()]
        if plain:
            row.update(zip(plain, self._add(plain, bare), strict=True))
        if len(plain) < len(new):
            # White space beside a space is no place to cut.
            row.update((w, -1) for w in set(new).difference(plain))
        return np.fromiter(map(row.__getitem__, words), np.int64, len(words))

    def _fit(self) -> None:
        """A full store keeps the words of the last call."""
        if self.size <= ROOM:
            return
        words, firsts = ([w for w in met if len(w) <= LONG and row[w] >= 0] for met, row in zip(self.met, (self.row, self.first), strict=True))
        self.keep(np.array([self.row[w] for w in words] + [self.first[w] for w in firsts], np.int64))
        self.n = len(words) + len(firsts)
        self.row, self.first = {w: i for i, w in enumerate(words)}, {w: i for i, w in enumerate(firsts, len(words))}
        self.size = sum(map(len, words)) + sum(map(len, firsts)) + WORD * self.n

    def of(self, texts: list[str], begin: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """The rows of all words, and how many words each text has; ``begin``: these are not later blocks of a text."""
        self._fit()
        lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        words = pc.dictionary_encode(lists.flatten())
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        rows = self._meet(distinct, self.row, False)[words.indices.to_numpy()]
        at = lists.offsets.to_numpy()
        firsts: list[str] = []
        if self.bare and begin:
            heads = [t.partition(" ")[0] for t in texts]
            firsts = list(dict.fromkeys(heads))
            self._meet(firsts, self.first, True)
            rows[at[:-1]] = [self.first[w] for w in heads]
        self.met = distinct, firsts
        sizes = np.diff(at)
        if len(rows) and rows.min() < 0:
            parts = np.split(rows, at[1:-1])
            for i, part in enumerate(parts):
                if len(part) and part.min() < 0:
                    parts[i] = self._careful(texts[i], begin)
            rows, sizes = np.concatenate(parts), np.array([len(x) for x in parts])
        return rows, sizes

    def _careful(self, text: str, begin: bool) -> np.ndarray:
        words = _CUT.split(text)
        return np.r_[self._add(words[:1], self.bare and begin), self._add(words[1:], False) if len(words) > 1 else []].astype(np.int64)


class Bytes:
    """A byte-level tokenizer of the ``tokenizers`` library."""

    def __init__(self, model: str, special: bool):
        """``special``: whether strings of special tokens inside texts become these tokens."""
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_str(model)
        self.library.encode_special_tokens = not special
        spec = json.loads(model)
        pre = spec.get("pre_tokenizer") or {}
        self.cuts = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec["model"].get("dropout")
        self.special = [x["content"] for x in spec.get("added_tokens", [])] if special else []
        byte = byte_letters()
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        added = {x["content"] for x in spec.get("added_tokens", [])}
        self.bytes = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = token.encode() if token in added or not all(c in byte for c in token) else bytes(byte[c] for c in token)
        self.sizes = np.array([len(x) for x in self.bytes], np.int64)
        self.kind = id_type(len(self.bytes))

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, self.kind) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def bare(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after another, and how many each has."""
        return _flat(self.whole(words), self.kind)

    def spaced(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same with a space before each word."""
        return _in_calls(words, lambda text: self.whole([text])[0], lambda ws: self.whole([f" {w}" for w in ws]), self.sizes, self.kind)


class Pieces:
    """A SentencePiece model that puts a space before each text."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = range(self.library.get_piece_size())
        self.bytes = [
            bytes([int(self.library.id_to_piece(i)[3:5], 16)]) if self.library.is_byte(i)
            else b"" if self.library.is_control(i)
            else self.library.id_to_piece(i).replace("▁", " ").encode()
            for i in ids
        ]
        self.sizes = np.array([len(x) for x in self.bytes], np.int64)
        self.kind = id_type(len(self.bytes))
        # Cuts hold if a piece has spaces at its beginning only, and if text is not changed: two spaces stay two.
        inner = any(" " in self.library.id_to_piece(i).replace("▁", " ").lstrip(" ") for i in ids)
        self.cuts = not inner and self.library.encode("a  a ") == [*self.library.encode("a"), *self.library.encode(" a ")]

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, self.kind) for x in self.library.encode(texts, num_threads=1)]

    def spaced(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after another, and how many each has; the library puts the space before each."""
        return _in_calls(words, lambda text: self.whole([text[1:]])[0], self.whole, self.sizes, self.kind)


def _flat(ids: list[np.ndarray], kind) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([np.zeros(0, kind), *ids]), np.array([len(x) for x in ids], np.int64)


def _in_calls(words: list[str], joined, each, sizes: np.ndarray, kind) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words that are encoded as one text where its bytes tell which ids belong to which word, else one by one."""
    flat, numbers = [np.zeros(0, kind)], [np.zeros(0, np.int64)]
    for begin in range(0, len(words), CALL):
        part = words[begin : begin + CALL]
        text = " " + " ".join(part)
        # White space at a word's edge would meet the space beside it.
        found = None if _EDGE.search(text) else _parted(text, part, joined(text), sizes)
        ids, n = _flat(each(part), kind) if found is None else found
        flat.append(ids)
        numbers.append(n)
    return np.concatenate(flat), np.concatenate(numbers)


def _parted(text: str, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    ends = sizes[ids].cumsum()
    raw = np.frombuffer(text.encode(), np.uint8)
    want = np.r_[np.flatnonzero(raw == 0x20)[1:], len(raw)]
    if len(want) != len(words):  # spaces inside words
        want = np.cumsum([len(w.encode()) + 1 for w in words])
    at = ends.searchsorted(want)
    if not len(ids) or ends[-1] != want[-1] or not np.array_equal(ends[np.minimum(at, len(ends) - 1)], want):
        return None
    return ids, np.diff(at, prepend=-1)


def id_type(n: int) -> np.dtype:
    """The smallest type for ids under ``n``."""
    return np.dtype("<u2" if n <= 1 << 16 else "<u4")


def byte_letters() -> dict[str, int]:
    """The letter of each byte in byte-level vocabularies: printable ones stand for themselves, the others follow from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(2)
def byte_tokenizer(model: str, special: bool) -> Bytes:
    return Bytes(model, special)


@lru_cache(2)
def piece_tokenizer(model: bytes) -> Pieces:
    return Pieces(model)


def read(path: str) -> bytes:
    """A vocabulary file, on the driver; tasks get it as a broadcast of its size."""
    with open(path, "rb") as file:
        return file.read()
