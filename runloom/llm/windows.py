"""Bounded-space online packing of token ids into windows.

Every partition reads its documents once and keeps a fixed number of open windows. Full windows of a
document's own ids are sequences at once; what is left of it goes into the open window that it fits
tightest. Where none fits and no further window may be opened, the fullest is emitted, its gap closed with
the first ids of the document in hand. At the end of a partition its open windows are poured together
until one is left. Those, one a partition, are laid end to end and cut into sequences.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left, insort
from codecs import charmap_decode
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from runloom.llm.common import stored
from runloom.llm.encoders import Memo, byte_letters

#: Open windows of a partition.
OPEN = 64

PLACED = "part int, doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence bigint, offset bigint, ids binary"


#: The word pattern of this kind of vocabulary (public, given with the tokenizer), over lower-cased text.
ASCII_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: Latin letters are composed already and lower-cased one by one; other text, control characters, other white space
#: and marks of special tokens are left to the library.
OTHER = re.compile("[\x00-\x1f\x7f-\xa0\xad\u0250-\U0010ffff]|<\\|")


class WordEncoder:
    """Ids of a text as little-endian unsigned 32-bit integers, for vocabularies that drop white space.

    The words' pattern has no white space and composition never crosses it, so what lies between two ASCII
    white-space characters is encoded alone. Such a piece is cut by the pattern and its words go to the
    library's model; pieces with anything but Latin letters, digits and signs go to the library whole.
    Both are remembered in memos of bounded size.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model, self.letters = self.library.model, byte_letters()
        self.chunks, self.words = Memo(self.chunk), Memo(self.word)

    def word(self, word: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(charmap_decode(word.encode(), "strict", self.letters)[0])]).tobytes()

    def chunk(self, piece: bytes) -> bytes:
        text = piece.decode()
        if OTHER.search(text):
            return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        lowered = text.lower()
        return b"".join(map(self.words.__getitem__, ASCII_WORD.findall(lowered) if text.isascii() else WORD.findall(lowered)))

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.chunks.__getitem__, text.encode().split()))


@lru_cache(2)
def word_encoder(path: str) -> WordEncoder:
    """One per worker process."""
    return WordEncoder(path)


class Packer:
    """The open windows of one partition; ``rows`` takes the pieces of emitted sequences.

    A piece is (doc_id, start, ids, doc_tokens), a window a list of pieces.
    """

    def __init__(self, size: int, keep: int):
        self.size, self.keep, self.emitted = size, keep, 0
        self.free: list[tuple[int, int]] = []  # (free ids, window), tightest first
        self.windows: dict[int, list] = {}
        self.opened = 0
        self.rows: list[tuple] = []

    def emit(self, pieces: list, sequence: int | None) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            length = len(ids) // 4
            self.rows.append((doc_id, start, length, zlib.crc32(ids), total, sequence, offset, ids if sequence is None else None))
            offset += length

    def close(self, pieces: list) -> None:
        self.emit(pieces, self.emitted)
        self.emitted += 1

    def document(self, doc_id, ids: bytes) -> None:
        total, step = len(ids) // 4, 4 * self.size
        whole = total // self.size
        for k in range(whole):
            self.close([(doc_id, k * self.size, ids[k * step : (k + 1) * step], total)])
        if total % self.size:
            self.place((doc_id, whole * self.size, ids[whole * step :], total))

    def place(self, piece: tuple, keep: int | None = None) -> None:
        """Best fit. Where none fits: a new window if there are fewer than ``keep``, else the fullest takes what it can hold and goes."""
        doc_id, start, ids, total = piece
        while True:
            length = len(ids) // 4
            k = bisect_left(self.free, (length, -1))
            if k < len(self.free):
                space, name = self.free.pop(k)
                self.windows[name].append((doc_id, start, ids, total))
                if space > length:
                    insort(self.free, (space - length, name))
                else:
                    self.close(self.windows.pop(name))
                return
            if len(self.free) < (self.keep if keep is None else max(1, keep)):
                self.windows[self.opened] = [(doc_id, start, ids, total)]
                insort(self.free, (self.size - length, self.opened))
                self.opened += 1
                return
            space, name = self.free.pop(0)
            self.windows[name].append((doc_id, start, ids[: 4 * space], total))
            self.close(self.windows.pop(name))
            start, ids = start + space, ids[4 * space :]

    def finish(self) -> None:
        """Pour the emptiest windows into the others until one is left, which goes out without a number."""
        while len(self.free) > 1:
            _, name = self.free.pop()
            for piece in self.windows.pop(name):
                self.place(piece, len(self.free))
        for _, name in self.free:
            self.emit(self.windows.pop(name), None)
        self.free = []


def place(docs: DataFrame, tokenizer: str, size: int, end_id: int, keep: int) -> DataFrame:
    """The pieces of every row's ids, by partition: numbered sequences that are full, and one window that is not."""
    end = end_id.to_bytes(4, "little")
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    names = [f.split()[0] for f in PLACED.split(", ")]

    def run(batches):
        packer, part = Packer(size, keep), 0

        def out():
            rows, packer.rows = packer.rows, []
            columns = zip(*rows) if rows else [[]] * len(kinds)
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            return pa.RecordBatch.from_arrays([pa.array([part] * len(rows), pa.int32()), *arrays], names=names)

        encoder = word_encoder(tokenizer)
        for batch in batches:
            if batch.num_rows:
                part = batch.column(2)[0].as_py()
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                packer.document(doc_id, encoder.encode(text or "") + end)
            yield out()
        packer.finish()
        yield out()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.spark_partition_id().alias("part"))
    return rows.mapInArrow(run, PLACED)


def merge(rest: DataFrame, size: int) -> DataFrame:
    """``rest`` (the open windows of all partitions) end to end, cut into sequences of ``size`` ids.

    The last, shorter one is cut into sequences whose lengths are powers of two, largest first, which need no
    padding. One row a partition is gathered for the places of the windows.
    """
    lengths = rest.groupBy("part").agg(F.sum("length").alias("in_part"))
    everything = Window.partitionBy()
    places = lengths.select("part", (F.sum("in_part").over(Window.orderBy("part")) - F.col("in_part")).alias("before"), F.sum("in_part").over(everything).alias("total"))
    rows = rest.join(places, "part").withColumn("at", F.col("before") + F.col("offset"))
    full = F.expr(f"total - total % {size}")
    tail = F.expr(f"total % {size}")
    powers = F.array(*[full + tail - tail % F.lit(1 << k) for k in range(size.bit_length())])
    multiples = F.expr(f"array(at - at % {size}, least(at - at % {size} + {size}, total - total % {size}))")
    rows = rows.withColumn("borders", F.array_sort(F.array_distinct(F.concat(multiples, powers))))
    end = F.col("at") + F.col("length")
    rows = rows.withColumn("cuts", F.concat(F.array("at"), F.filter("borders", lambda b: (b > F.col("at")) & (b < end)), F.array(end)))
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.size("cuts") - 2)))
    rows = rows.withColumns({"a": F.get("cuts", F.col("k")), "b": F.get("cuts", F.col("k") + 1)})
    rows = rows.withColumn("border", F.array_max(F.filter("borders", lambda b: b <= F.col("a"))))
    ids = F.substring("ids", (4 * (F.col("a") - F.col("at")) + 1).cast("int"), (4 * (F.col("b") - F.col("a"))).cast("int"))
    return rows.select(
        "doc_id", (F.col("start") + F.col("a") - F.col("at")).alias("start"), (F.col("b") - F.col("a")).alias("length"), F.crc32(ids).alias("ids_crc32"),
        "doc_tokens", (-1 - F.col("border")).alias("sequence_id"), (F.col("a") - F.col("border")).alias("offset"),
    )


def pack_windows(docs: DataFrame, tokenizer: str, size: int = 4096, end_id: int = 2, keep: int = OPEN) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece of ``docs`` (doc_id, text).

    A document's ids are those of its whole text and ``end_id``; a null, empty or blank text has the end id alone.
    Each row is a document of its own, so ids may be null or repeated; windows that are equally tight are taken
    in the order they were opened. All sequences have ``size`` ids, but for those of the last remainder, fewer
    than log2(size) + 1, whose lengths are powers of two. An empty table has no pieces. Other columns are left
    aside. A task holds ``keep`` windows and one Arrow batch.
    """
    placed = stored(place(docs, tokenizer, size, end_id, keep), "windows")
    done = placed.filter("sequence IS NOT NULL").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.shiftleft(F.col("part").cast("long"), 40) + F.col("sequence")).alias("sequence_id"), "offset"
    )
    return done.unionByName(merge(placed.filter("sequence IS NULL"), size))
