"""Helpers shared by the operators: shared storage and Arrow columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``, which driver and executors share.

    Only a single-process session without that setting (a test) gets a folder of its own.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to shared storage and read from there: lineage ends, lost executors cost nothing."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def extend(df: DataFrame, needs: list[str], fields: list[T.StructField], compute: Callable[..., list]) -> DataFrame:
    """``df`` with ``fields`` added, computed from Arrow columns ``needs`` batch by batch.

    ``compute`` gets one array per needed column and returns one array per field. Input columns
    named like an added field are replaced; all others are kept.
    """
    added = {f.name.lower() for f in fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in added]
    place = {f.name.lower(): i for i, f in enumerate(kept)}
    extra = [n for n in needs if n.lower() not in place]
    source = df.select(*[F.col(f"`{f.name}`") for f in kept], *[F.col(f"`{n}`").alias(f"__need_{i}") for i, n in enumerate(extra)])
    at = [place[n.lower()] if n.lower() in place else len(kept) + extra.index(n) for n in needs]
    names, width = [f.name for f in kept] + [f.name for f in fields], len(kept)

    def run(batches):
        for batch in batches:
            new = compute(*[batch.column(i) for i in at])
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *new], names=names)

    return source.mapInArrow(run, T.StructType([*kept, *fields]))


def texts(column: pa.Array) -> list[str]:
    """The column's texts, null as empty."""
    return [t or "" for t in column.to_pylist()]


def by_size(rows: list[str], count: int, letters: int = 4_000_000) -> Iterator[list[str]]:
    """Consecutive rows, at most ``count`` and ``letters`` together; a longer text stands alone."""
    held, size = [], 0
    for row in rows:
        if held and (len(held) == count or size + len(row) > letters):
            yield held
            held, size = [], 0
        held.append(row)
        size += len(row)
    if held:
        yield held
