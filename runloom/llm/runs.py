"""Periodic runs of words by longest common extensions on suffix trees.

A run is a stretch of words with a smallest period q that no neighbouring word extends keeping q. Every
run holds a Lyndon root: the longest Lyndon word at some place, under the order of words or its reverse.
Such a word ends where the next smaller suffix begins, so the places of the suffixes in a suffix tree
give all candidates. Each is extended to the right by the longest common extension of its two ends, the
depth of a lowest common ancestor in Ukkonen's tree of the words, and to the left by that in the tree of
the reversed words. Ancestors are found by range minima over the trees' Euler tours.

A run of at least ``least`` words repeats ``least // 2`` consecutive words at the distance of its period,
so all its words lie in grams of that length which occur twice in the text. Stretches of such grams are
all that goes into the trees; words outside can't belong to a run or extend one.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runloom.llm.common import extend

#: Words that share a pair of trees; a longer text has a pair of its own.
TOGETHER = 40_000
#: Steps of an Euler tour with a minimum of their own.
STRIDE = 32

RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])


class SuffixTree:
    """Ukkonen's suffix tree of symbols 1 .. ``kinds`` - 1, which a 0 follows."""

    def __init__(self, symbols: list[int], kinds: int):
        self.n, self.kinds = len(symbols), kinds
        text = [*symbols, 0]
        edge: dict[int, int] = {}
        begin, end, link = [0], [0], [0]
        whole = len(text)
        at = along = length = waiting = 0
        for i, symbol in enumerate(text):
            waiting += 1
            unlinked = 0
            while waiting:
                if not length:
                    along = i
                key = at * kinds + text[along]
                child = edge.get(key)
                if child is None:
                    edge[key] = len(begin)
                    begin.append(i)
                    end.append(whole)
                    link.append(0)
                    if unlinked:
                        link[unlinked] = at
                        unlinked = 0
                else:
                    first = begin[child]
                    span = end[child] - first
                    if length >= span:
                        along += span
                        length -= span
                        at = child
                        continue
                    if text[first + length] == symbol:
                        length += 1
                        if unlinked:
                            link[unlinked] = at
                        break
                    fork = len(begin)
                    edge[key] = fork
                    begin += (first, i)
                    end += (first + length, whole)
                    link += (0, 0)
                    begin[child] = first + length
                    edge[fork * kinds + text[first + length]] = child
                    edge[fork * kinds + symbol] = fork + 1
                    if unlinked:
                        link[unlinked] = fork
                    unlinked = fork
                waiting -= 1
                if at:
                    at = link[at]
                elif length:
                    length -= 1
                    along = i - waiting + 1
        self._tour(edge, begin, end)

    def _tour(self, edge: dict[int, int], begin: list[int], end: list[int]) -> None:
        """Euler tours over the nodes' depths in symbols: children in the order of their symbols, and after the 0 in the reverse order."""
        keys = np.fromiter(edge.keys(), np.int64, len(edge))
        nodes = np.fromiter(edge.values(), np.int64, len(edge))
        parent, symbol = keys // self.kinds, keys % self.kinds
        span = np.array(end, np.int64) - np.array(begin, np.int64)
        for backwards in (True, False):
            shown = np.where(symbol == 0, 0, self.kinds - symbol) if backwards else symbol
            order = np.lexsort((shown, parent))
            first = np.searchsorted(parent[order], np.arange(len(begin) + 1)).tolist()
            children, lengths = nodes[order].tolist(), span.tolist()
            depths, leaves, tour, place = [0] * len(begin), [], [], [0] * (self.n + 1)
            path, turn = [0], first[:]
            total = self.n + 1
            while path:
                node = path[-1]
                k = turn[node]
                if not backwards:
                    tour.append(depths[node])
                if k < first[node + 1]:
                    turn[node] = k + 1
                    child = children[k]
                    depths[child] = depths[node] + lengths[child]
                    path.append(child)
                else:
                    if first[node] == k:
                        suffix = total - depths[node]
                        place[suffix] = len(tour) - 1
                        leaves.append(suffix)
                    path.pop()
            rank = np.empty(self.n + 1, np.int64)
            rank[leaves] = np.arange(self.n + 1)
            if backwards:
                self.falling = rank
            else:
                self.rising = rank
        self.place = np.array(place, np.int64)
        depth = np.array(tour, np.int32)
        blocks = -(-len(depth) // STRIDE)
        self.depth = np.full(blocks * STRIDE, np.iinfo(np.int32).max, np.int32)
        self.depth[: len(depth)] = depth
        square = self.depth.reshape(blocks, STRIDE)
        self.up_to = np.minimum.accumulate(square, axis=1).ravel()
        self.down_to = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
        self.over = [square.min(axis=1)]
        while 2 << (len(self.over) - 1) <= blocks:
            low, half = self.over[-1], 1 << (len(self.over) - 1)
            self.over.append(np.minimum(low[: len(low) - half], low[half:]))

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols from ``i`` and from ``j`` on are the same: the depth of the leaves' lowest common ancestor."""
        a, b = self.place[i], self.place[j]
        a, b = np.minimum(a, b), np.maximum(a, b)
        first, last = a // STRIDE, b // STRIDE
        low = np.minimum(self.down_to[a], self.up_to[b])
        near = np.flatnonzero(first == last)
        if len(near):
            x, y = a[near], b[near]
            found = self.depth[x]
            for k in range(1, STRIDE):
                found = np.where(x + k <= y, np.minimum(found, self.depth[np.minimum(x + k, y)]), found)
            low[near] = found
        far = np.flatnonzero(last - first > 1)
        if len(far):
            x, y = first[far] + 1, last[far]
            level = np.frexp((y - x).astype(np.float64))[1] - 1
            for k in np.unique(level).tolist():
                at = level == k
                row = self.over[k]
                low[far[at]] = np.minimum(low[far[at]], np.minimum(row[x[at]], row[y[at] - (1 << k)]))
        return low.astype(np.int64)


def next_smaller(rank: np.ndarray) -> np.ndarray:
    """For each suffix but the last the place of the next smaller one: the end of its longest Lyndon word."""
    ranks = rank.tolist()
    after, open_ = [0] * len(ranks), []
    for i, r in enumerate(ranks):
        while open_ and ranks[open_[-1]] > r:
            after[open_.pop()] = i
        open_.append(i)
    return np.array(after[:-1], np.int64)


def tree_runs(symbols: list[int], kinds: int, least: int) -> np.ndarray:
    """(start, length, period) of the runs of at least ``least`` symbols, in order of start and period."""
    n = len(symbols)
    tree = SuffixTree(symbols, kinds)
    pairs = []
    for rank in (tree.rising, tree.falling):
        ends = next_smaller(rank)
        pairs.append(np.arange(n) * (n + 1) + ends)
    pairs = np.unique(np.concatenate(pairs))
    i, j = pairs // (n + 1), pairs % (n + 1)
    right = tree.extension(i, j)
    del tree, rank
    left = SuffixTree(symbols[::-1], kinds).extension(n - i, n - j)
    period, start = j - i, i - left
    length = period + left + right
    kept = (length >= least) & (length >= 2 * period)
    return np.unique(np.stack([start[kept], period[kept], length[kept]], axis=1), axis=0)[:, [0, 2, 1]]


def repeated_stretches(ids: np.ndarray, gram: int) -> np.ndarray:
    """(begin, end) of the stretches of words that lie in grams occurring twice; equal hashes only add stretches."""
    none = np.empty((0, 2), np.int64)
    if len(ids) < 2 * gram:
        return none
    grams = np.zeros(len(ids) - gram + 1, np.uint64)
    for k in range(gram):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + ids[k : len(ids) - gram + 1 + k]
    ordered = np.sort(grams)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return none
    hits = np.flatnonzero(np.isin(grams, np.unique(twice)))
    change = np.zeros(len(ids) + 1, np.int32)
    np.add.at(change, hits, 1)
    np.add.at(change, hits + gram, -1)
    covered = np.concatenate([[False], np.cumsum(change[:-1]) > 0, [False]])
    edges = np.flatnonzero(covered[1:] != covered[:-1])
    found = edges.reshape(-1, 2)
    return found[found[:, 1] - found[:, 0] >= 2 * gram]


class Finder:
    """Runs of texts, whose repeated stretches are gathered until a pair of trees pays."""

    def __init__(self, least: int):
        self.least, self.found = least, []
        self._clear()

    def _clear(self) -> None:
        self.names, self.symbols, self.owner = defaultdict(count(2, 2).__next__), [], []

    def add(self, words: list[bytes]) -> None:
        """One text. Words get numbers from 2 on, by twos; odd numbers separate stretches."""
        index = len(self.found)
        self.found.append([])
        if len(words) < self.least:
            return
        ids = np.fromiter(map(self.names.__getitem__, words), np.uint64, len(words))
        for begin, end in repeated_stretches(ids, self.least // 2).tolist():
            self.symbols += ids[begin:end].tolist()
            self.owner.append((len(self.symbols) - (end - begin), index, begin))
            self.symbols.append(2 * len(self.owner) + 1)
        if len(self.symbols) > TOGETHER or len(self.names) > 25 * TOGETHER:
            self.solve()

    def solve(self) -> None:
        if self.symbols:
            # separators are unique, so no run holds one
            kinds, symbols = np.unique(np.array(self.symbols), return_inverse=True)
            runs = tree_runs((symbols + 1).tolist(), len(kinds) + 1, self.least)
            at = np.searchsorted([o[0] for o in self.owner], runs[:, 0], side="right") - 1
            for k, (start, length, period) in zip(at.tolist(), runs.tolist()):
                place, index, begin = self.owner[k]
                self.found[index].append((start - place + begin, length, period))
        self._clear()


def text_runs(texts: list[list[bytes]], least: int = 12) -> list[list[tuple[int, int, int]]]:
    """The runs of each text's words, in order of start and period."""
    finder = Finder(least)
    for words in texts:
        finder.add(words)
    finder.solve()
    return finder.found


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by single spaces, without those that a run contains after its first period."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()])


def with_runs(docs: DataFrame, least: int = 12) -> DataFrame:
    """``docs`` with ``runs`` (start, length, period of words from 0, in order of start and period) and ``collapsed``.

    Words are what ASCII white space separates. ``least`` (4 at least) is a run's fewest words; a run also
    has two periods. A null, empty or blank text has no run and an empty ``collapsed``. Each row is a text
    of its own, so repeated rows get equal results; an empty table gives none. Columns of these names are
    replaced, all others kept. A task holds one Arrow batch, and some 350 bytes for each word of the
    longest stretch that repeats itself.
    """
    if least < 4:
        raise ValueError("a run has at least four words")
    fields = [T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())]

    def compute(column):
        split = [(t or "").encode().split() for t in column.to_pylist()]
        found = text_runs(split, least)
        flat = np.array([r for runs in found for r in runs], np.int64).reshape(-1, 3)
        offsets = np.zeros(len(found) + 1, np.int32)
        np.cumsum([len(runs) for runs in found], out=offsets[1:])
        values = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], names=RUN.names)
        texts = pa.array([collapsed(words, runs) for words, runs in zip(split, found)], pa.binary()).cast(pa.string())
        return [pa.ListArray.from_arrays(pa.array(offsets), values), texts]

    return extend(docs, ["text"], fields, compute)


def plant(doc_id: str = "doc_id", text: str = "text"):
    """The text, for every tenth checksum of an id with words that repeat from some place on.

    With h the unsigned CRC-32 of the id in decimal, g = h div 10 and n words: if h is divisible by 10,
    each word i >= a is word a + (i - a) % p, with a = g % n and p = 1 + (n - a) div (3 + g % 8). A null id or text
    stays as it is.
    """
    check = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    words = F.filter(F.split(text, r"[ \t-\r]+"), lambda w: w != "")

    def repeat(row):
        all_, g, n = row["words"], row["g"], F.size(row["words"]).cast("long")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + g % 8))

        def one(bound):
            return F.transform(bound["words"], lambda w, i: F.when(i >= bound["a"], F.get(bound["words"], (bound["a"] + (i - bound["a"]) % bound["p"]).cast("int"))).otherwise(w))

        return F.array_join(F.get(F.transform(F.array(F.struct(all_.alias("words"), a.alias("a"), p.alias("p"))), one), F.lit(0)), " ")

    bound = F.array(F.struct(words.alias("words"), F.floor(check / 10).alias("g")))
    changed = F.get(F.transform(bound, lambda row: F.when(F.size(row["words"]) > 0, repeat(row)).otherwise("")), F.lit(0))
    return F.when((check % 10 == 0) & F.col(text).isNotNull(), changed).otherwise(F.col(text))
