"""Token ids in ORC files: run-length encoded integers, row indexes, Bloom filters on document ids.

Rows are in ascending document order across files and inside them, so a range of documents is a
range of stripes and a single document is found through file, stripe and row-group statistics and
the Bloom filter. Every stripe can be read alone.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runloom.llm.common import extend, texts
from runloom.llm.encoders import id_lists, library_encoder

#: Chunks remembered by a worker, in each of two generations: a task holds little else.
MEMO = 400_000
FILE = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("part_start", T.LongType()),
    T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())),
])


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, stripe_bytes: int = 64 << 20, row_index_stride: int = 1000) -> None:
    """Write the ids of every whole text, ``end_id`` last, in ascending doc_id order (null ids first, equal ids by text).

    Texts are dealt by ranges of (doc_id, hash of the text), so many rows of one id spread as long as
    their texts differ. A null text is empty and has the end id alone. Other columns are not stored.
    """
    spark = docs.sparkSession
    digest = F.xxhash64("text")
    order = [F.col("doc_id").asc_nulls_first(), digest, F.col("text")]
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange(count, *order[:2]).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    end = end_id.to_bytes(4, "little")

    def run(batches):
        encoder, start = library_encoder(tokenizer, MEMO), 0
        for batch in batches:
            raw = [encoder.encode(t) + end for t in texts(batch.column(1))]
            sizes = [len(r) // 4 for r in raw]
            starts = []
            for size in sizes:
                starts.append(start)
                start += size
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(0), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), id_lists(raw)], names=FILE.names)

    (
        ordered.mapInArrow(run, FILE)
        .write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option("orc.create.index", "true")
        .option("orc.row.index.stride", str(row_index_stride)).option("orc.stripe.size", str(stripe_bytes)).option("compression", "lz4").orc(path)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids of the files. Filters on doc_id reach the stripes.

    One row per file carries the ids of the files before it; nothing else is gathered.
    """
    rows = spark.read.schema(FILE).orc(path)
    sizes = rows.groupBy("part").agg(F.sum("n_tokens").alias("in_part"))
    before = sizes.select("part", (F.sum("in_part").over(Window.orderBy("part")) - F.col("in_part")).alias("before"))
    return rows.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("part_start")).alias("start"), F.size("ids").cast("long").alias("n_tokens"), "ids")


def with_crc(df: DataFrame, ids: str = "ids", into: str = "ids_crc32") -> DataFrame:
    """``df`` with the unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers."""

    def compute(column):
        flat, at = column.values, column.offsets.to_numpy()
        data = memoryview(flat.buffers()[1])[4 * flat.offset :] if len(flat) else memoryview(b"")
        return [pa.array([zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.int64())]

    return extend(df, [ids], [T.StructField(into, T.LongType())], compute)
