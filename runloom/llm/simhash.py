"""SimHash near-duplicates with pivot distance tables.

A document's fingerprint has a bit set where more than half of its shingles' hashes have it. Every
distinct fingerprint carries its Hamming distances to many reference fingerprints. Two fingerprints
within ``distance`` bits agree on two of five bit ranges at least, so they meet in one of ten tables;
there the pairs whose pivot distances differ by more than ``distance`` in any coordinate are
discarded (the triangle inequality), and only the survivors are compared. A block gives a spanning
forest of its links, never its pairs, and contraction joins the forests to components.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runloom.llm.common import extend, stored, texts

#: Reference fingerprints: hashes of their number. Eight distances fit in one column.
PIVOTS = [xxhash.xxh64_intdigest(f"pivot {i}") for i in range(16)]
#: Bit ranges of which two of five are equal in any linked pair.
RANGES = [(0, 13), (13, 26), (26, 39), (39, 52), (52, 64)]
MASKS = [sum(((1 << b) - (1 << a)) for a, b in pair) for pair in combinations(RANGES, 2)]
#: Fingerprints of one table key that a task compares; a larger group is cut into pieces that meet pairwise.
BLOCK = 4_096


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """A bit is 1 if more than half of the shingles' hashes have it; no words: 0; fewer than ``words``: the whole sequence is one shingle."""
    parts = text.encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not parts:
        return 0
    data = b" ".join(parts)
    starts = list(accumulate((len(p) + 1 for p in parts), initial=0))
    width = min(words, len(parts))
    hashes = [xxhash.xxh64_intdigest(data[a : b - 1], seed) for a, b in zip(starts, starts[width:])]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = np.array(hashes[at : at + 65_536], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprint(df: DataFrame, text: str = "text", into: str = "simhash") -> DataFrame:
    """``df`` with the fingerprint of the whole text (null: no words) as a signed long; an input column ``into`` is replaced."""
    return extend(df, [text], [T.StructField(into, T.LongType())], lambda column: [pa.array([_signed(fingerprint(t)) for t in texts(column)], pa.int64())])


def pivot_table(fingerprints: DataFrame) -> DataFrame:
    """Hamming distances to the pivots, eight to a long, as ``near`` (0 to 7) and ``far`` (8 to 15)."""
    distance = lambda p: F.bit_count(F.col("simhash").bitwiseXOR(F.lit(_signed(p)))).cast("long")

    def packed(pivots: list[int]) -> Column:
        out = distance(pivots[0])
        for i, p in enumerate(pivots[1:], 1):
            out = out.bitwiseOR(F.shiftleft(distance(p), 8 * i))
        return out

    return fingerprints.withColumn("near", packed(PIVOTS[:8])).withColumn("far", packed(PIVOTS[8:]))


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the links beside the smallest node of its component, itself left out."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def block_links(run: np.ndarray, own: np.ndarray, across: np.ndarray, prints: np.ndarray, pivots: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside each run. Rows are sorted by run and first pivot distance.

    ``across``: the run compares two pieces of a large group, so only rows of different ``own`` meet.
    """
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    live, step = np.arange(len(run)), 0
    while len(live):
        step += 1
        live = live[live + step < len(run)]
        other = live + step
        # sorted by the first coordinate: once it is too far apart, it stays so
        live = live[(run[live] == run[other]) & (pivots[other, 0] - pivots[live, 0] <= distance)]
        i, j = live, live + step
        meet = ~across[i] | (own[i] != own[j])
        i, j = i[meet], j[meet]
        for k in range(1, pivots.shape[1]):
            close = np.abs(pivots[i, k] - pivots[j, k]) <= distance
            i, j = i[close], j[close]
        near = np.bitwise_count(prints[i] ^ prints[j]) <= distance
        a, b = np.concatenate([a, prints[i[near]].view(np.int64)]), np.concatenate([b, prints[j[near]].view(np.int64)])
        if len(a) > 1_000_000:
            a, b = _stars(a, b)
    return _stars(a, b)


def links(fingerprints: DataFrame, distance: int = 3) -> DataFrame:
    """Links (a, b) that connect exactly what lies within ``distance`` bits, from distinct fingerprints ``simhash``.

    A key with more than ``BLOCK`` fingerprints is cut by hash into pieces, and each pair of pieces is
    a group of its own, so no task holds more than two pieces.
    """
    if distance > 3:
        raise ValueError("two of five bit ranges agree up to three differing bits only")
    table = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("simhash").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(MASKS)]))
    keyed = pivot_table(fingerprints.select("simhash")).select("simhash", "near", "far", table.alias("k")).select("simhash", "near", "far", "k.t", "k.key")
    large = keyed.groupBy("t", "key").count().filter(F.col("count") > BLOCK).select("t", "key", F.ceil(F.col("count") / BLOCK).cast("int").alias("pieces"))
    cut = keyed.join(large, ["t", "key"], "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    cut = cut.withColumn("own", F.pmod(F.xxhash64("simhash"), F.col("pieces")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    cut = cut.select("t", "key", F.least("own", "with").alias("p"), F.greatest("own", "with").alias("q"), "own", "simhash", "near", "far")
    # most keys have one fingerprint: they are sorted past each other, not grouped one by one
    dealt = cut.repartition("t", "key", "p", "q").sortWithinPartitions("t", "key", "p", "q", F.col("near").bitwiseAND(F.lit(255)))

    def run(batches):
        def solve(rows: pa.Table) -> pa.RecordBatch:
            t, key, p, q, own = (rows[n].to_numpy() for n in ("t", "key", "p", "q", "own"))
            new = np.ones(len(t), bool)
            new[1:] = (t[1:] != t[:-1]) | (key[1:] != key[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])
            pivots = np.concatenate([np.ascontiguousarray(rows[n].to_numpy()).view(np.uint8).reshape(-1, 8) for n in ("near", "far")], axis=1).astype(np.int16)
            a, b = block_links(np.cumsum(new), own, p != q, np.ascontiguousarray(rows["simhash"].to_numpy()).view(np.uint64), pivots, distance)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([held, rows]).combine_chunks() if held is not None and held.num_rows else rows
            last = [rows[n].to_numpy() for n in ("t", "key", "p", "q")]
            same = np.logical_and.reduce([c == c[-1] for c in last]) if rows.num_rows else np.zeros(0, bool)
            start = int(np.argmax(same)) if rows.num_rows else 0
            held = rows.slice(start)
            if start:
                yield solve(rows.slice(0, start).combine_chunks())
        if held is not None and held.num_rows:
            yield solve(held.combine_chunks())

    return dealt.mapInArrow(run, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with a link; nodes are named by the hash of their fingerprint.

    In each round every node merges into its smallest neighbour, if that is smaller, and links are
    renamed. Hashed names are in random order, so a round leaves a constant share of the nodes and
    rounds grow with the logarithm. Each round is written to shared storage.
    """
    edges = stored(edges.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b")).distinct(), "links")
    roots = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low"))
        parents = stored(low.select(F.col("a").alias("node"), F.least("a", "low").alias("root")), "parents")
        if roots is None:
            roots = parents
        else:
            step = parents.select(F.col("node").alias("root"), F.col("root").alias("next"))
            roots = stored(roots.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "roots")
        to = lambda side: parents.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root"))
        moved = edges.join(to("a"), "a").join(to("b"), "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b"))
        edges = stored(moved.filter("a <> b").distinct(), "links")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")) if roots is None else roots


def classes(prints: DataFrame, distance: int = 3) -> DataFrame:
    """simhash, first_id (smallest doc_id of the fingerprint), root (the component's name) and component_id (smallest doc_id reachable) from rows (doc_id, simhash).

    Null ids are never the smallest; a component of null ids only has a null component_id.
    """
    found = stored(prints.groupBy("simhash").agg(F.min("doc_id").alias("first_id")), "fingerprints").withColumn("node", F.xxhash64("simhash"))
    rooted = found.join(components(links(found, distance)), "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rooted.join(smallest, "root").select("simhash", "first_id", "root", "component_id")


def near_duplicates(docs: DataFrame, distance: int = 3) -> DataFrame:
    """doc_id, simhash and component_id of every row of ``docs`` (doc_id, text); repeated rows stay repeated."""
    prints = stored(with_fingerprint(docs.select("doc_id", "text")).select("doc_id", "simhash"), "simhash")
    return prints.join(classes(prints, distance).select("simhash", "component_id"), "simhash").select("doc_id", "simhash", "component_id")


def keep_first(docs: DataFrame, distance: int = 3) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id, one of them if it is repeated.

    Columns stay as they are; a component of null ids keeps one of
    its rows. Texts are written once with their fingerprint and moved once, by document.
    """
    own = docs.select(*[F.col(f"`{c}`").alias(f"{c}__own" if c.lower() == "simhash" else c) for c in docs.columns])
    names = [F.col(f"`{c}`").alias(c.removesuffix("__own") if c.lower() == "simhash__own" else c) for c in own.columns]
    marked = stored(with_fingerprint(own), "marked")
    prints = marked.select("doc_id", "simhash")
    order = F.struct(F.col("first_id").isNull(), "first_id", "simhash")
    one = classes(prints, distance).groupBy("root").agg(F.min(order).alias("one"))
    one = stored(one.select(F.col("one.first_id").alias("doc_id"), "one.simhash"), "kept")
    kept = marked.join(one.filter(F.col("doc_id").isNotNull()), ["doc_id", "simhash"], "left_semi").dropDuplicates(["doc_id", "simhash"])
    without = marked.filter(F.col("doc_id").isNull()).join(one.filter(F.col("doc_id").isNull()), "simhash", "left_semi").dropDuplicates(["simhash"])
    return kept.unionByName(without).select(*names)
