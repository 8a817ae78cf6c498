"""Best-fit packing by a grouping genetic algorithm.

Documents become pieces of at most ``size`` tokens; full pieces are sequences of their own, and the
short ones are dealt by hash into blocks of bounded size. Each block is evolved on islands: a
solution's genes are its bins. Crossover injects whole well-filled bins of one parent into the other,
drops the bins that then hold a document twice, and fills the space left and new bins with the displaced
documents, as tightly as two or three of them can. Between epochs the best solution of each island
migrates to the next one, and the best of all islands is the block's packing. A block is evolved until it
has as few bins as a lower bound proves necessary, or its crossovers are spent.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runloom.llm.common import stored, texts
from runloom.llm.encoders import library_encoder

#: Short pieces in a block, the bound of one evolving task's items.
BLOCK = 8_192
#: Crossovers of an island in an epoch: so many for each bin above the block's bound, and the most of them.
ISLANDS, EPOCHS, SOLUTIONS, CROSSOVERS, MOST = 2, 3, 4, 4, 32
#: A bin is filled by two pieces that leave at most so much, or by a large one and what then fits.
SLACK = 16

PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
])


def pieces(docs: DataFrame, tokenizer: str, size: int = 1024, end_id: int = 2) -> DataFrame:
    """The pieces of every whole text's ids with ``end_id`` at the end; a null text has the end id alone.

    A document of more than ``size`` ids is cut so that only its first piece is shorter.
    """
    end = end_id.to_bytes(4, "little")

    def run(batches):
        for batch in batches:
            encoder, out = library_encoder(tokenizer), []
            for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                raw = encoder.encode(text) + end
                total = len(raw) // 4
                cuts = [0, *range(total % size or size, total + 1, size)]
                out += [(doc_id, k, a, b - a, zlib.crc32(raw[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            columns = zip(*out) if out else [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=PIECES.names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


class Bins:
    """Bins under best fit: a bit set of the free spaces that occur finds the tightest bin at once."""

    def __init__(self, size: int):
        self.size, self.free, self.by_free, self.mask = size, [], [[] for _ in range(size + 1)], 0

    def add(self, free: int) -> int:
        self.free.append(free)
        self._file(len(self.free) - 1)
        return len(self.free) - 1

    def _file(self, b: int) -> None:
        self.by_free[self.free[b]].append(b)
        self.mask |= 1 << self.free[b]

    def put(self, length: int) -> int:
        fits = self.mask >> length
        if not fits:
            return self.add(self.size - length)
        space = length + (fits & -fits).bit_length() - 1
        b = self.by_free[space].pop()
        if not self.by_free[space]:
            self.mask &= ~(1 << space)
        self.free[b] -= length
        self._file(b)
        return b


def best_fit(lengths: list[int], order, size: int) -> np.ndarray:
    bins, at = Bins(size), np.empty(len(lengths), np.int32)
    for i in order:
        at[i] = bins.put(lengths[i])
    return at


class Rest:
    """Pieces not yet placed, by length: a bit set of the lengths and its mirror tell which pairs add up to a space."""

    def __init__(self, lengths: list[int], items, size: int):
        self.size, self.by_length, self.mask, self.mirror = size, [[] for _ in range(size + 1)], 0, 0
        for i in items:
            self.by_length[lengths[i]].append(i)
        for x in {lengths[i] for i in items}:
            self.mask |= 1 << x
            self.mirror |= 1 << (size - x)

    def take(self, length: int) -> int:
        i = self.by_length[length].pop()
        if not self.by_length[length]:
            self.mask ^= 1 << length
            self.mirror ^= 1 << (self.size - length)
        return i

    def pair(self, space: int) -> int:
        """The longer of two pieces that fill ``space``, 0 if there are none."""
        both, half = self.mask & (self.mirror >> (self.size - space)), space // 2
        if 2 * half == space and both >> half & 1 and len(self.by_length[half]) < 2:
            both ^= 1 << half
        return both.bit_length() - 1 if both else 0

    def fill(self, space: int) -> list[int]:
        """Pieces that fill ``space`` about as far as it can be."""
        out = []
        while fits := self.mask & ((2 << space) - 1):
            most, least = fits.bit_length() - 1, (fits & -fits).bit_length() - 1
            if most < space:
                roomy = 3 * least <= space
                sums = range(min(space, 2 * most), max(most, space - SLACK if roomy else 0), -1)
                total, longer = next(((s, x) for s in sums if (x := self.pair(s))), (0, 0))
                if longer:
                    out += [self.take(longer), self.take(total - longer)]
                    space -= total
                    continue
                if roomy:
                    most = (fits & ((2 << (space - 2 * least)) - 1)).bit_length() - 1
            out.append(self.take(most))
            space -= most
        return out


def tight_fit(lengths: list[int], order, size: int, at: np.ndarray, free=()) -> np.ndarray:
    """``at`` with the pieces of ``order`` placed: in bins by ``free`` space, then in new ones that they open in this order."""
    rest, number = Rest(lengths, order, size), len(free)
    for space, b in sorted((space, b) for b, space in enumerate(free) if space):
        if not rest.mask:
            break
        for i in rest.fill(space):
            at[i] = b
    for i in order:
        if rest.by_length[lengths[i]]:  # any piece of the length, they are alike
            for j in (rest.take(lengths[i]), *rest.fill(size - lengths[i])):
                at[j] = number
            number += 1
    return at


def least_bins(lengths: np.ndarray, size: int) -> int:
    """A bound: pieces too long to share a bin and what the rest needs beside them (Martello and Toth), or how many fit a bin at most."""
    n = np.bincount(lengths, minlength=size + 1)
    count, total = np.r_[0, np.cumsum(n)], np.r_[0, np.cumsum(n * np.arange(size + 1))]  # of those shorter than the index
    small = np.arange(size // 2 + 1)
    half, large = size // 2 + 1, size - small + 1
    halves, room = count[large] - count[half], (count[large] - count[half]) * size - (total[large] - total[half])
    beside = np.maximum(0, -((room - (total[half] - total[small])) // size))
    return max(int((count[size + 1] - count[large] + halves + beside).max()), -(-len(lengths) // (size // int(lengths.min()))) if len(lengths) else 0)


def quality(lengths: np.ndarray, at: np.ndarray, size: int) -> tuple[int, float]:
    """Smaller is better: bins, then minus the mean square of their fill."""
    fill = np.bincount(at, lengths)
    return len(fill), -float(((fill / size) ** 2).mean()) if len(fill) else 0.0


def crossover(lengths: np.ndarray, into: np.ndarray, source: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """``into`` with about a fifth of the well-filled bins of ``source`` injected whole."""
    fill = np.bincount(source, lengths)
    injected = (fill >= np.quantile(fill, 0.25)) & (rng.random(len(fill)) < 0.2)
    moved = injected[source]
    hit = np.zeros(int(into.max()) + 1, bool)
    hit[into[moved]] = True  # bins that now hold a document twice
    # the emptiest bins go as well, or nothing would ever change there
    own = np.bincount(into, lengths)
    hit |= own <= np.quantile(own, 0.02)
    displaced = hit[into] & ~moved
    free, at = [], np.empty(len(lengths), np.int32)
    kept = ~displaced & ~moved
    for part, mask in ((source, moved), (into, kept)):
        used = np.bincount(part[mask], lengths[mask]).astype(int)
        at[mask] = len(free) + (np.cumsum(used > 0) - 1)[part[mask]]
        free += (size - used[used > 0]).tolist()
    loose = np.flatnonzero(displaced)
    return tight_fit(lengths.tolist(), disordered(lengths, loose, rng), size, at, free)


def disordered(lengths: np.ndarray, items: np.ndarray, rng: np.random.Generator) -> list[int]:
    """The longest first, but for chance: from none to one that puts pieces of a third of the length first."""
    return items[np.argsort(-lengths[items] * rng.uniform(rng.uniform(0.3, 1), 1, len(items)), kind="stable")].tolist()


def evolve(lengths: np.ndarray, solutions: list[np.ndarray], size: int, rng: np.random.Generator) -> list[np.ndarray]:
    """The best solutions after some crossovers, best first. Lengths are in descending order."""
    items = lengths.tolist()
    if not solutions:
        solutions.append(best_fit(items, range(len(items)), size))
    bound, every = least_bins(lengths, size), np.arange(len(items))
    ranked = sorted(((quality(lengths, s, size), k, s) for k, s in enumerate(solutions)), key=lambda x: x[:2])
    while len(ranked) < SOLUTIONS and ranked[0][0][0] > bound:
        order = disordered(lengths, every, rng)
        at = tight_fit(items, order, size, np.empty(len(items), np.int32))
        ranked = sorted([*ranked, (quality(lengths, at, size), len(ranked), at)], key=lambda x: x[:2])
    for k in range(MOST):
        if k >= CROSSOVERS * (ranked[0][0][0] - bound):
            break
        a, b = rng.choice(len(ranked), 2, replace=False)
        child = crossover(lengths, ranked[min(a, b)][2], ranked[max(a, b)][2], size, rng)
        ranked = sorted([*ranked, (quality(lengths, child, size), SOLUTIONS + len(solutions) + k, child)], key=lambda x: x[:2])[:SOLUTIONS]
    return [s for _, _, s in ranked]


def pack(cut: DataFrame, size: int = 1024) -> DataFrame:
    """``cut`` (stored pieces: piece_key unique, length) with sequence_id and offset.

    A sequence's pieces fill it from 0 without a gap; its number says nothing. Only numbers and lengths
    move: an island is a row of arrays over its block's pieces.
    """
    short = cut.filter(F.col("length") < size).select("piece_key", "length")
    blocks = max(1, math.ceil(short.count() / BLOCK))
    item = F.struct((-F.col("length")).alias("minus"), "piece_key")
    dealt = short.groupBy(F.pmod(F.xxhash64("piece_key"), F.lit(blocks)).alias("block")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    state = dealt.select(
        "block", F.col("items.piece_key").alias("keys"), F.transform("items", lambda x: -x["minus"]).alias("lengths"),
        F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), F.array().cast("array<array<int>>").alias("solutions"),
    )
    fields = "block bigint, keys array<bigint>, lengths array<bigint>, island int, solutions array<array<int>>, bins bigint"
    for epoch in range(EPOCHS):

        def run(batches, epoch=epoch):
            for batch in batches:
                rows = batch.to_pylist()
                for row in rows:
                    rng = np.random.default_rng([row["block"], row["island"], epoch])
                    lengths = np.array(row["lengths"], np.int64)
                    found = evolve(lengths, [np.array(s, np.int32) for s in row["solutions"]], size, rng)
                    row["solutions"], row["bins"] = [s.tolist() for s in found], quality(lengths, found[0], size)[0]
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

        arrow = pa.schema([
            ("block", pa.int64()), ("keys", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("island", pa.int32()),
            ("solutions", pa.list_(pa.list_(pa.int32()))), ("bins", pa.int64()),
        ])
        evolved = state.select("block", "keys", "lengths", "island", "solutions").repartition("block", "island").mapInArrow(run, fields)
        if epoch + 1 < EPOCHS:
            met = evolved.groupBy("block").agg(F.first("keys").alias("keys"), F.first("lengths").alias("lengths"), F.array_sort(F.collect_list(F.struct("island", "solutions"))).alias("all"))
            elite = F.col("all")[(F.col("island") + 1) % ISLANDS]["solutions"][0]
            state = met.select("block", "keys", "lengths", "all", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"))
            state = state.withColumn("solutions", F.concat(F.col("all")[F.col("island")]["solutions"], F.array(elite)))
    best = evolved.groupBy("block").agg(F.min_by(F.struct("keys", "lengths", F.col("solutions")[0].alias("at")), F.struct("bins", "island")).alias("best")).select("block", "best.*")

    def lay_out(batches):
        for batch in batches:
            for row in batch.to_pylist():
                lengths, at = np.array(row["lengths"], np.int64), np.array(row["at"], np.int64)
                order = np.argsort(at, kind="stable")
                ends = np.cumsum(lengths[order])
                first = np.r_[True, at[order][1:] != at[order][:-1]]
                offset = np.empty(len(at), np.int64)
                offset[order] = ends - lengths[order] - np.maximum.accumulate(np.where(first, ends - lengths[order], 0))
                yield pa.RecordBatch.from_arrays([pa.array(row["keys"], pa.int64()), pa.array((row["block"] << 24) + at, pa.int64()), pa.array(offset, pa.int64())], names=["piece_key", "sequence_id", "offset"])

    placed = best.mapInArrow(lay_out, "piece_key bigint, sequence_id bigint, offset bigint")
    joined = cut.join(placed, "piece_key", "left")
    return joined.withColumn("sequence_id", F.coalesce("sequence_id", -1 - F.col("piece_key"))).withColumn("offset", F.coalesce("offset", F.lit(0).cast("long")))


def pack_documents(docs: DataFrame, tokenizer: str, size: int = 1024, end_id: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of ``docs`` (doc_id, text).

    Ids may be null or repeated: each row is a document of its own. An empty table has no pieces.
    """
    cut = stored(pieces(docs, tokenizer, size, end_id).withColumn("piece_key", F.monotonically_increasing_id()), "pieces")
    return pack(cut, size).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
