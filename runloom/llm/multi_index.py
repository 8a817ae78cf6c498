"""Nearest neighbours by inner product with an inverted multi-index.

Each half of a vector is quantised by centroids of its own, so a cell is a pair of centroids and few
centroids make many cells. A query walks the pairs in ascending order of summed distance (minus the
halves' inner products with the centroids) with a heap, until the cells it has opened hold a share of
all vectors, and what these cells hold is reranked on the original vectors in double precision.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors the centroids are fitted on (the smallest by hash of the id), the bound of what the driver sees.
SAMPLE = 16_384
#: Vectors in a block and queries in a batch: the bound of what a reranking task holds.
BLOCK, BATCH = 16_384, 4_096
#: Queries whose cells one task finds.
WALKS = 64


@dataclass(frozen=True)
class Index:
    """Distinct vectors with their smallest ids and cell, the centroids of both halves, and the vectors per cell."""

    vectors: DataFrame
    halves: tuple[np.ndarray, np.ndarray]
    counts: np.ndarray


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vec (doubles) of the rows that take part: no null, zero or non-finite vector, and the most common length."""
    vec = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(math.inf)))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long"), vec.alias("vec"))
    rows = rows.filter(finite & F.exists("vec", lambda x: x != 0))
    sizes = rows.groupBy(F.size("vec").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    return rows.filter(F.size("vec") == sizes[0]["size"]) if sizes else rows


def _nearest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmin((centroids * centroids).sum(1)[None] - 2 * points @ centroids.T, axis=1)


def _centroids(points: np.ndarray, count: int, rounds: int = 12) -> np.ndarray:
    made = np.unique(points, axis=0)
    made = made[np.random.default_rng(0).choice(len(made), min(count, len(made)), replace=False)]
    for _ in range(rounds):
        at = _nearest(points, made)
        size = np.bincount(at, minlength=len(made))
        total = np.zeros_like(made)
        np.add.at(total, at, points)
        made = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], made)
    return made


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def build(rows: DataFrame, keep: int, centroids: int = 64) -> Index | None:
    """Index every usable row. Of equal vectors only the ``keep`` smallest ids can ever be among the nearest, so only they stay."""
    sample = np.array([r[0] for r in rows.select("vec").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()])
    if not len(sample):
        return None
    half = sample.shape[1] // 2
    halves = (_centroids(sample[:, :half], centroids), _centroids(sample[:, half:], centroids))
    width = len(halves[1])
    by_vector = Window.partitionBy("vec").orderBy("vec_id")
    distinct = rows.withColumn("at", F.dense_rank().over(by_vector)).filter(F.col("at") <= keep).groupBy("vec").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))

    def assign(batches):
        for batch in batches:
            x = _matrix(batch.column(0))
            cell = _nearest(x[:, :half], halves[0]) * width + _nearest(x[:, half:], halves[1]) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32), pa.int32())], names=["vec", "ids", "cell"])

    vectors = distinct.mapInArrow(assign, "vec array<double>, ids array<bigint>, cell int")
    counts = np.zeros(len(halves[0]) * width, np.int64)
    for cell, n in vectors.groupBy("cell").count().collect():
        counts[cell] = n
    return Index(vectors, halves, counts)


def walk(costs: tuple[np.ndarray, np.ndarray], counts: np.ndarray, wanted: int) -> list[int]:
    """Cells in ascending summed cost until those opened hold ``wanted`` vectors: a pair enters the heap once both pairs before it are out."""
    order = [np.argsort(c, kind="stable") for c in costs]
    first, second = (c[o].tolist() for c, o in zip(costs, order))
    rows, columns, width = order[0].tolist(), order[1].tolist(), len(costs[1])
    reached, heap, out, found = [0] * len(rows), [(first[0] + second[0], 0, 0)], [], 0
    while heap and found < wanted:
        _, i, j = heapq.heappop(heap)
        reached[i] = j + 1
        if size := int(counts[cell := rows[i] * width + columns[j]]):
            out.append(cell)
            found += size
        if i + 1 < len(rows) and reached[i + 1] == j:
            heapq.heappush(heap, (first[i + 1] + second[j], i + 1, j))
        if j + 1 < width and (i == 0 or reached[i - 1] > j + 1):
            heapq.heappush(heap, (first[i] + second[j + 1], i, j + 1))
    return out


def search(index: Index, queries: DataFrame, top: int, share: float = 0.6) -> DataFrame:
    """query_id, rank, vec_id and score of each query's ``top`` nearest found, its own id left out.

    ``share`` is the part of all distinct vectors a query opens. Vectors are dealt to blocks of whole
    cells (a larger cell to several blocks), queries to the blocks they open, in batches; a task holds
    one block and one batch and gives at most ``top`` rows a query. Ties go to the smaller vec_id.
    """
    halves, counts = index.halves, index.counts
    half, width = halves[0].shape[1], len(halves[1])
    wanted = max(top + 1, math.ceil(share * int(counts.sum())))
    pieces = np.maximum(1, -(-counts // BLOCK))
    first = np.zeros(len(counts), np.int64)
    block, fill = 0, 0
    for cell in np.flatnonzero(counts).tolist():
        if fill and fill + counts[cell] > BLOCK:
            block, fill = block + 1, 0
        first[cell] = block
        fill += int(counts[cell])
        if pieces[cell] > 1:
            block, fill = block + int(pieces[cell]), 0
    asking = queries.select("vec_id", "vec").dropDuplicates(["vec_id"])
    n_queries = asking.count()
    batches_of_queries = max(1, math.ceil(n_queries / BATCH))

    def dealt(query: int) -> int:
        """A query's batch: by a hash, as ids may all be multiples of one number."""
        return (((query * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF) >> 33) % batches_of_queries

    def place(batches):
        for batch in batches:
            cell = np.asarray(batch.column(2))
            ids = np.array([i[0] for i in batch.column(1).to_pylist()], np.int64)
            at = pa.array((first[cell] + ids % pieces[cell]).astype(np.int32), pa.int32()) if len(cell) else pa.array([], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, at], names=["vec", "ids", "cell", "block"])

    def open_cells(batches):
        for batch in batches:
            x, out = _matrix(batch.column(1)), []
            for query, vec in zip(batch.column(0).to_pylist(), x):
                cells = np.array(walk((-(halves[0] @ vec[:half]), -(halves[1] @ vec[half:])), counts, wanted), np.int64)
                spread = np.concatenate([np.stack([first[cells] + k, cells], 1)[pieces[cells] > k] for k in range(int(pieces[cells].max()))])
                for b in np.unique(spread[:, 0]).tolist():
                    out.append((b, dealt(query), query, vec.tolist(), spread[spread[:, 0] == b, 1].astype(np.int32).tolist()))
            yield pa.RecordBatch.from_pylist([dict(zip(("block", "batch", "query_id", "vec", "cells"), row)) for row in out], schema=opened)

    opened = pa.schema([("block", pa.int32()), ("batch", pa.int64()), ("query_id", pa.int64()), ("vec", pa.list_(pa.float64())), ("cells", pa.list_(pa.int32()))])

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            left, right = left.combine_chunks(), right.combine_chunks()
            x, q = _matrix(left["vec"].combine_chunks()), _matrix(right["vec"].combine_chunks())
            names, column = np.unique(np.asarray(left["cell"]), return_inverse=True)
            ids, queries, cells = left["ids"].to_pylist(), right["query_id"].to_pylist(), right["cells"].to_pylist()
            longest = float(np.sqrt((x * x).sum(1).max()))
            for start in range(0, len(q), 256):
                score = q[start : start + 256] @ x.T
                for i, row in enumerate(score):
                    opened_here = np.isin(names, cells[start + i], assume_unique=True)
                    row[~opened_here[column]] = -np.inf
                    # all that may tie with the last one kept, whatever the matrix product rounds
                    least = np.partition(row, -top - 1)[-top - 1] - 1e-12 * x.shape[1] * longest * float(np.linalg.norm(q[start + i])) if len(row) > top + 1 else -np.inf
                    best = np.flatnonzero((row >= least) & (row > -np.inf))
                    exact = (x[best] * q[start + i]).sum(1)
                    found = sorted({(-s, v) for s, b in zip(exact.tolist(), best.tolist()) for v in ids[b] if v != queries[start + i]})[:top]
                    out["query_id"] += [queries[start + i]] * len(found)
                    out["vec_id"] += [v for _, v in found]
                    out["score"] += [-s for s, _ in found]
        return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})

    placed = index.vectors.mapInArrow(place, "vec array<double>, ids array<bigint>, cell int, block int")
    placed = placed.withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(batches_of_queries - 1)).cast("array<bigint>")))
    # the walks are the work of a query, so they are spread over many tasks however small the queries are
    asked = asking.repartition(max(1, math.ceil(n_queries / WALKS)), "vec_id").mapInArrow(open_cells, "block int, batch bigint, query_id bigint, vec array<double>, cells array<int>")
    found = placed.groupBy("block", "batch").cogroup(asked.groupBy("block", "batch")).applyInArrow(rerank, "query_id bigint, vec_id bigint, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int"))
    return ranked.filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, every: int, top: int, share: float = 0.6, centroids: int = 64) -> DataFrame:
    """Search ``vectors`` (vec_id, embedding) for the rows whose vec_id ``every`` divides.

    Null ids take no part. Repeated rows of one id count once as a query and once as a candidate.
    No usable row gives no result; other columns are ignored.
    """
    rows = usable(vectors)
    index = build(rows, top + 1, centroids)
    if index is None:
        return rows.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    return search(index, rows.filter(F.col("vec_id") % every == 0), top, share)
