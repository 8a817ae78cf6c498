"""BPE encoding and decoding with forced boundaries.

A pair of bytes that never stands inside any token of the vocabulary marks a certain cut: no merge
can join its two sides. Every text is cut there, each fragment is merged alone, and the fragments'
ids are joined. Where no token holds ASCII white space after another byte, the outer fragments are
chunks whose ids are remembered; a vocabulary with such tokens (space, no-break space, space ...)
takes whole texts. Inside either the word pattern and the remaining pairs cut further.
"""

from __future__ import annotations

import heapq
import json
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from runloom.llm.common import extend, texts
from runloom.llm.encoders import Memo, TextEncoder, byte_letters, words

#: Bytes of ids decoded at once, if no single row has more.
SLICE = 1 << 20
SPACE = frozenset(b"\t\n\v\f\r ")


def _spec(path: str) -> dict:
    with open(path, encoding="utf-8") as file:
        return json.load(file)


def _bytes_of_letters() -> dict[str, int]:
    return {letter: b for b, letter in enumerate(byte_letters())}


class Vocabulary:
    """Ids of tokens as bytes, merges by rank, and the pairs that stand inside a token."""

    def __init__(self, path: str):
        spec, byte_of = _spec(path), _bytes_of_letters()
        self.ids = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = (bytes(byte_of[c] for c in part) for part in (merge.split(" ") if isinstance(merge, str) else merge))
            self.rank[self.ids[left], self.ids[right]] = (rank, self.ids[left + right])
        self.bytes = [self.ids[bytes([b])] for b in range(256)]
        self.inside = np.zeros((256, 256), bool)
        for token in self.ids:
            for a, b in zip(token, token[1:]):
                self.inside[a, b] = True

    def merge(self, fragment: bytes) -> list[int]:
        """Ids of a fragment: the pair of lowest rank first, the leftmost of equals, in n log n."""
        ids = [self.bytes[b] for b in fragment]
        after, before = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
        queue = [(*self.rank[pair][:1], i, pair) for i, pair in enumerate(zip(ids, ids[1:])) if pair in self.rank]
        heapq.heapify(queue)
        while queue:
            _, i, pair = heapq.heappop(queue)
            j = after[i]
            if ids[i] != pair[0] or j < 0 or ids[j] != pair[1]:
                continue
            ids[i], ids[j] = self.rank[pair][1], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (new := (ids[k], ids[after[k]])) in self.rank:
                    heapq.heappush(queue, (self.rank[new][0], k, new))
        return [i for i in ids if i >= 0]


class ForcedBoundaryEncoder(TextEncoder):
    def __init__(self, path: str):
        super().__init__(path)
        self.vocabulary = Vocabulary(path)
        inside = self.vocabulary.inside
        space = np.isin(np.arange(256), list(SPACE))
        self.spaced = not inside[~space][:, space].any()
        self.inside = inside.tolist()
        self.fragments = Memo(lambda fragment: array("I", self.vocabulary.merge(fragment)).tobytes())

    def plain(self, text: str) -> bytes:
        return super().plain(text) if self.spaced else self.chunk(text.encode())

    def chunk(self, data: bytes) -> bytes:
        out, inside = [], self.inside
        for raw in words(data):
            start = 0
            for i in range(1, len(raw)):
                if not inside[raw[i - 1]][raw[i]]:
                    out.append(self.fragments[raw[start:i]])
                    start = i
            out.append(self.fragments[raw[start:]])
        return b"".join(out)


@lru_cache(2)
def encoder(path: str) -> ForcedBoundaryEncoder:
    """One per worker process."""
    return ForcedBoundaryEncoder(path)


@lru_cache(2)
def token_bytes(path: str) -> pa.Array:
    """Bytes of every id; decoding needs neither merges nor pairs."""
    spec, byte_of = _spec(path), _bytes_of_letters()
    tokens = {i: bytes(byte_of[c] for c in token) for token, i in spec["model"]["vocab"].items()}
    tokens |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
    return pa.array([tokens.get(i, b"") for i in range(max(tokens) + 1)], pa.large_binary())


def encode(df: DataFrame, tokenizer: str, text: str = "text", into: str = "ids") -> DataFrame:
    """``df`` with the whole text's ids in ``into``: binary, little-endian unsigned 32-bit integers.

    A null or empty text has no ids. Equal rows get equal ids; an input column named ``into`` is
    replaced, other columns are kept; an empty table gives an empty one.
    """

    def compute(column):
        made = encoder(tokenizer)
        return [pa.array([made.encode(t) for t in texts(column)], pa.binary())]

    return extend(df, [text], [T.StructField(into, T.BinaryType())], compute)


def _texts_of(rows: list[bytes], vocabulary: pa.Array) -> list[str]:
    """Texts of some rows' ids: their tokens' bytes lie in one buffer, cut where the rows end."""
    tokens = vocabulary.take(pa.array(np.frombuffer(b"".join(rows), "<u4")))
    if not len(tokens):
        return [""] * len(rows)
    ends, data = np.frombuffer(tokens.buffers()[1], np.int64)[: len(tokens) + 1], memoryview(tokens.buffers()[2] or b"")
    at = ends[np.concatenate([[0], np.cumsum([len(r) // 4 for r in rows])])].tolist()
    return [str(data[a:b], "utf-8", "replace") for a, b in zip(at, at[1:])]


def decode(df: DataFrame, tokenizer: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``df`` with the text of binary ``ids`` in ``into``; bytes that are no UTF-8 become U+FFFD, null ids an empty text."""

    def compute(column):
        vocabulary, out, held, size = token_bytes(tokenizer), [], [], 0
        for row in column:
            held.append(row.as_py() or b"")
            size += len(held[-1])
            if size >= SLICE:
                out += _texts_of(held, vocabulary)
                held, size = [], 0
        return [pa.array(out + _texts_of(held, vocabulary), pa.string())]

    return extend(df, [ids], [T.StructField(into, T.StringType())], compute)
