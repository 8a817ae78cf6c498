"""Byte-level BPE of whole texts in front of a memo of chunks, and the ids' binary form."""

from __future__ import annotations

import json
import re
from array import array
from codecs import charmap_decode
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from tokenizers import Tokenizer

#: A run of ASCII white space and what follows up to the next one. The word pattern always cuts
#: between a visible character and white space, so such chunks are encoded alone.
CHUNK = re.compile(rb"[\t-\r ]*[^\t-\r ]+|[\t-\r ]+")
#: A step from wider white space (no-break space, line separator ...) to ASCII white space lies inside
#: one run of white space, which a token may span; texts that have one are cut by the second pattern.
WIDE = rb"(?:(?<=\xc2[\x85\xa0])|(?<=\xe1\x9a\x80)|(?<=\xe2\x80[\x80-\x8a\xa8\xa9\xaf])|(?<=\xe2\x81\x9f)|(?<=\xe3\x80\x80))[\t-\r ]"
WIDE_STEP = re.compile(rb"[\x80-\xaf]" + WIDE)
WIDE_CHUNK = re.compile(rb"[\t-\r ]*[^\t-\r ]+(?:" + WIDE + rb"[\t-\r ]*[^\t-\r ]*)*|[\t-\r ]+")
#: Fixed value: the word pattern of this kind of vocabulary (public, given with the tokenizer).
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Entries of each of a memo's two generations, per worker: the bound of its memory.
MEMO = 250_000
#: The same pattern over ASCII bytes, what is frequent first (a word or number can't begin with an apostrophe).
ASCII_WORD = re.compile(rb" ?[A-Za-z]+| ?[0-9]+|'(?:[stmd]|re|ve|ll)| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+")
#: A letter of the upper half of Latin-1 in UTF-8, text that has nothing else beyond ASCII, and its words (possessive: long ones take no memory).
LATIN = rb"\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]"
LATIN_TEXT = re.compile(rb"[\0-\x7f]*(?:" + LATIN + rb"[\0-\x7f]*)*+")
LATIN_WORD = re.compile(ASCII_WORD.pattern.replace(rb"[A-Za-z]+", rb"(?:[A-Za-z]+|" + LATIN + rb")++").replace(rb"[^\sA-Za-z0-9]", rb"[^\sA-Za-z0-9\x80-\xff]"))
#: A chunk that is one word.
LONE_WORD = re.compile(rb" [A-Za-z]*(?:" + LATIN + rb"[A-Za-z]*)*+")


@lru_cache(1)
def byte_letters() -> str:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return "".join(chr(b) if b in plain else chr(next(rest)) for b in range(256))


def words(data: bytes) -> list[bytes]:
    """A chunk's words."""
    if data.isascii():
        return ASCII_WORD.findall(data)
    return LATIN_WORD.findall(data) if LATIN_TEXT.fullmatch(data) else [w.encode() for w in WORD.findall(data.decode())]


class Memo(dict):
    """What ``make`` gives for a key, remembered for the ``size`` keys last made and those used of the ``size`` before."""

    def __init__(self, make, size: int = MEMO):
        super().__init__()
        self.make, self.size, self.before = make, size, {}

    def __missing__(self, key):
        value = self.before.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.size:
            self.before = dict(self)
            self.clear()
        self[key] = value
        return value


class TextEncoder:
    """Ids of a text as little-endian unsigned 32-bit integers. Special tokens in a text are found as the library finds them."""

    def __init__(self, path: str, memo: int = MEMO):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = {t["content"]: array("I", [t["id"]]).tobytes() for t in spec["added_tokens"]}
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.chunks = Memo(self.chunk, memo)

    def chunk(self, data: bytes) -> bytes:
        raise NotImplementedError

    def plain(self, text: str) -> bytes:
        data = text.encode()
        cut = CHUNK if data.isascii() or not WIDE_STEP.search(data) else WIDE_CHUNK
        return b"".join(map(self.chunks.__getitem__, cut.findall(data)))

    def encode(self, text: str) -> bytes:
        if self.marks and any(mark in text for mark in self.special):
            return b"".join(self.special[part] if part in self.special else self.plain(part) for part in self.marks.split(text))
        return self.plain(text)


class LibraryEncoder(TextEncoder):
    """The ``tokenizers`` library's BPE model over words, each distinct word encoded once."""

    def __init__(self, path: str, memo: int = MEMO):
        super().__init__(path, memo)
        self.model, self.letters = Tokenizer.from_file(path).model, byte_letters()
        self.parts = Memo(lambda word: self.chunks.get(word) or self.word(word), memo)

    def word(self, word: bytes) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(charmap_decode(word, "strict", self.letters)[0])]).tobytes()

    def chunk(self, data: bytes) -> bytes:
        if LONE_WORD.fullmatch(data):
            return self.word(data)
        return b"".join(map(self.parts.__getitem__, words(data)))


@lru_cache(2)
def library_encoder(path: str, memo: int = MEMO) -> LibraryEncoder:
    """One per worker process."""
    return LibraryEncoder(path, memo)


def id_lists(raw: list[bytes]) -> pa.Array:
    """Binary ids as a list column of integers."""
    offsets = np.zeros(len(raw) + 1, np.int32)
    np.cumsum([len(r) // 4 for r in raw], out=offsets[1:])
    values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(raw))])
    return pa.ListArray.from_arrays(pa.array(offsets), values)
