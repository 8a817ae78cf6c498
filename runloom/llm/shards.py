"""Sharding by histogram sort.

Rows are ordered by (hash of the text, doc_id). Passes over a narrow table count exact bytes and rows
between candidate boundaries; cells around a wanted boundary get new, closer probes until it is within
tolerance or a single key is left. The splitters then give every row its range, one exchange brings
ranges together, and a row's exact rank in the whole order decides its shard and slot. Equal texts
stand together; a large group of them is cut by doc_id, so no range holds it whole.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runloom.llm.common import stored

#: Probes of one pass, the bound of what the driver sees and broadcasts at a time.
PROBES = 65_536
#: Bytes a range should have, and the most ranges, the bound of the splitters.
RANGE_BYTES, RANGES = 8 << 20, 8_192


@dataclass
class Node:
    """A stretch of keys under probes: ``kind`` h probes hashes, d document ids of one hash."""

    number: int
    kind: str
    low: int
    step: int
    rows: int  # rows and weight before the stretch
    weight: float


@dataclass
class Cell:
    """What lies between two probes of a node; ``child`` is the node that probes it further."""

    node: int
    pos: int
    rows: int
    before: int
    child: Node | None = None


def _hash() -> Column:
    """62 bits, so that differences fit."""
    return F.shiftrightunsigned(F.xxhash64("__text"), 2)


def _id() -> Column:
    """The id's order in 62 bits, null first; ids that fall together are told apart by the final sort."""
    return F.shiftright(F.coalesce("__id", F.lit(-(1 << 63))), 2)


def _position() -> Column:
    return F.expr("cast((case when __kind = 'h' then __h else __d end - __low) div __step as int)")


def _descend(rows: DataFrame, level: list[tuple], fields: str, how: str) -> DataFrame:
    """Join the cells of a level; they are ``PROBES`` rows at most."""
    cells = rows.sparkSession.createDataFrame(level, f"__node int, __pos int, {fields}")
    return rows.withColumn("__pos", _position()).join(F.broadcast(cells), ["__node", "__pos"], how)


def _enter(rows: DataFrame, root: Node) -> DataFrame:
    return rows.withColumns({"__node": F.lit(0), "__kind": F.lit("h"), "__low": F.lit(root.low).cast("long"), "__step": F.lit(root.step).cast("long")})


def _child(found: DataFrame, names: list[str]) -> DataFrame:
    return found.select(*names, F.col("__to").alias("__node"), F.col("__to_kind").alias("__kind"), F.col("__to_low").alias("__low"), F.col("__to_step").alias("__step"))


CHILD = "__to int, __to_kind string, __to_low bigint, __to_step bigint"


def _spec(node: Node | None) -> tuple:
    return (node.number, node.kind, node.low, node.step) if node else (None, None, None, None)


def splitters(keys: DataFrame, shards: int, tolerance: float, range_weight: float, whole: float = 0):
    """The first node, levels of cells, ranks at which ranges begin, and ranks at which shards begin, from ``keys`` (__h, __d, __w)."""
    total, count, low, high = keys.agg(F.coalesce(F.sum("__w"), F.lit(0)), F.count(F.lit(1)), F.min("__h"), F.max("__h")).first()
    starts = [0] * shards
    if not count:
        return None, [], [], starts
    parts = min(max(1, math.ceil(total / (shards * range_weight))), max(1, RANGES // shards)) * shards
    wanted = [(k * total / shards, tolerance * total / shards, k) for k in range(1, shards)] + [(k * total / parts, total / parts / 2, None) for k in range(1, parts)]
    probes = min(PROBES, max(4_096, 16 * parts))
    root = Node(0, "h", low, max(1, -(-(high - low + 1) // probes)), 0, 0)
    rows, levels, edges, made = _enter(keys, root), [], {0}, 1
    active = {0: (root, wanted)}
    while active:
        pos = _position()
        counts = rows.withColumn("__pos", pos).groupBy("__node", "__pos").agg(F.count(F.lit(1)), F.sum("__w"), F.min("__h"), F.max("__h"), F.min("__d"), F.max("__d"))
        by_node: dict[int, list] = {}
        for node, at, *facts in counts.collect():
            by_node.setdefault(node, []).append((at, *facts))
        level, following = [], {}
        probes = max(16, PROBES // max(1, sum(len(w) for _, w in active.values())))
        for number, (node, targets) in active.items():
            cells, before, weight, table = [], node.rows, node.weight, []
            for at, n, w, h0, h1, d0, d1 in sorted(by_node[number]):
                cells.append(Cell(number, at, n, before))
                table.append((weight, before, n, w, h0, h1, d0, d1))
                before, weight = before + n, weight + w
            ends = [row[0] for row in table]
            for target, slack, shard in targets:
                i = max(0, bisect_right(ends, target) - 1)
                under, rank, n, w, h0, h1, d0, d1 = table[i]
                if shard is not None and h0 == h1:  # one text, equal sizes: the rank is known
                    cut = round(target - under) * n // w if w > whole * total / shards else n * round((target - under) / w)
                    starts[shard] = rank + min(n, cut)
                elif min(target - under, under + w - target) <= slack or (h0 == h1 and d0 == d1):
                    at = rank if target - under <= under + w - target else rank + n
                    if shard is None:
                        edges.add(at)
                    else:
                        starts[shard] = at
                else:
                    if cells[i].child is None:
                        kind, a, b = ("h", h0, h1) if h0 < h1 else ("d", d0, d1)
                        cells[i].child = Node(made, kind, a, max(1, -(-(b - a + 1) // probes)), rank, under)
                        following[made] = (cells[i].child, [])
                        made += 1
                    following[cells[i].child.number][1].append((target, slack, shard))
            level += cells
        levels.append(level)
        active = following
        if active:
            inner = [(c.node, c.pos, *_spec(c.child)) for c in level if c.child]
            rows = _child(_descend(rows, inner, CHILD, "inner"), ["__h", "__d", "__w"])
    return root, levels, sorted(e for e in edges if e < count), starts


def shard(df: DataFrame, shards: int, law: str = "bytes", tolerance: float = 0.001, whole: float = 0.01, range_bytes: int = RANGE_BYTES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with size (UTF-8 bytes plus 16), shard and slot (gapless from 0 in each shard).

    ``law`` ``bytes``: sizes of shards differ by ``tolerance`` of a shard or by one row; ``rows``:
    counts differ by one at most. Equal texts stay in one shard unless together they exceed ``whole`` of a
    shard (law ``bytes``). A null text has no bytes and a hash of its own; null ids come first;
    rows equal in text and id take neighbouring slots. With fewer rows than shards some stay empty.
    Input columns size, shard and slot are replaced, all others kept.
    """
    if law not in ("bytes", "rows"):
        raise ValueError(f"no such law: {law}")
    kept = [c for c in df.columns if c.lower() not in ("size", "shard", "slot")]
    size = (F.coalesce(F.octet_length("__text"), F.lit(0)) + 16).cast("long")
    base = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias("__text"), F.col(f"`{doc_id}`").cast("long").alias("__id")).withColumn("size", size)
    keyed = base.withColumns({"__h": _hash(), "__d": _id()})
    weight = F.col("size") if law == "bytes" else F.lit(1).cast("long")
    keys = stored(keyed.select("__h", "__d", weight.alias("__w")), "shard-keys")
    root, levels, edges, starts = splitters(keys, shards, tolerance if law == "bytes" else 0, range_bytes if law == "bytes" else range_bytes // 4_096, whole if law == "bytes" else 0)
    if not levels:
        return base.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")}).select(*kept, "size", "shard", "slot")
    spark, names = df.sparkSession, [*kept, "__id", "size", "__h", "__d"]
    rows = _enter(keyed.drop("__text"), root).withColumn("__range", F.lit(None).cast("int"))
    for level in levels:
        table = [(c.node, c.pos, None if c.child else bisect_right(edges, c.before) - 1, *_spec(c.child)) for c in level]
        found = _descend(rows, table, f"__leaf int, {CHILD}", "left")
        rows = _child(found.withColumn("__range", F.coalesce("__range", "__leaf")), [*names, "__range"])
    ranges = []
    for number, first in enumerate(edges):
        end = edges[number + 1] if number + 1 < len(edges) else math.inf
        opened = bisect_right(starts, first) - 1
        ranges.append((number, first, opened, [starts[opened], *[s for s in starts[opened + 1 :] if s < end]]))
    order = Window.partitionBy("__range").orderBy("__h", F.col("__id").asc_nulls_first())
    ranked = rows.withColumn("__at", F.row_number().over(order)).join(F.broadcast(spark.createDataFrame(ranges, "__range int, __first bigint, __shard int, __starts array<bigint>")), "__range")
    ranked = ranked.withColumn("__at", F.col("__first") + F.col("__at") - 1).withColumn("__starts", F.filter("__starts", lambda s: s <= F.col("__at")))
    return ranked.select(*kept, "size", (F.col("__shard") + F.size("__starts") - 1).cast("int").alias("shard"), (F.col("__at") - F.array_max("__starts")).alias("slot"))
