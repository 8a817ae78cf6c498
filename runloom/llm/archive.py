"""A content-addressed WARC archive.

Payload bytes are stored once under their SHA-256, the exact header of every record beside them, and
a join on the digest gives the original records back. Both tables are bucketed by digest, so the join
moves no payload. Digests with very many records keep their headers in a third table; their few
payloads are dealt out in salted copies when they are read, so no task holds a whole hot group.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.llm.common import shared_folder

#: Records of one payload from which its headers are dealt out, and the number of copies then used.
HOT, SALTS = 10_000, 32
#: Fixed value: the profile a WARC 1.1 revisit record names for equal payloads.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Archive:
    """Names of the archive's tables in the session's catalog; their files lie in shared storage."""

    payloads: str
    headers: str
    hot_headers: str


def _record_id(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">"))


def _header(date: str) -> Column:
    """The record's header, which ends with the empty line."""
    url = F.regexp_replace(F.col("url"), r"[\x00-\x20\x7f]", "")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    revisit = F.col("owner").isNotNull()
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", _record_id(F.col("page_id"))),
        F.coalesce(line("WARC-Target-URI", url), F.lit("")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", _record_id(F.col("owner"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html")),
        line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("size")).cast("string")),
        F.lit("\r\n"),
    )


def write(pages: DataFrame, min_bytes: int = 1000, date: str = "2024-01-01T00:00:00Z") -> Archive:
    """Archive ``pages`` (page_id, url, html).

    Of equal payloads of at least ``min_bytes`` the record with the largest page_id is the response
    and the others revisit it; smaller payloads are responses, though stored once as well. A null html
    is an empty payload, a null url leaves its line out, a null page_id is never the largest (if a
    group has no other, all are responses). Repeated rows of the largest page_id are each a response.
    """
    spark, name = pages.sparkSession, uuid.uuid4().hex
    made = Archive(*(f"llm_archive_{kind}_{name}" for kind in ("payloads", "headers", "hot")))
    folder, buckets = shared_folder(spark, "archive"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    payload = F.coalesce(F.encode(F.col("html"), "UTF-8"), F.lit(b""))
    records = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    stored = records.groupBy("digest").agg(F.first("payload").alias("payload"), F.max("page_id").alias("largest"), F.count(F.lit(1)).alias("copies"))
    save = lambda df, kind: df.write.bucketBy(buckets, "digest").sortBy("digest").option("path", f"{folder}/{kind}").option("compression", "zstd").saveAsTable(getattr(made, kind))
    save(stored.withColumn("size", F.length("payload")), "payloads")
    facts = spark.table(made.payloads).select("digest", "largest", "copies", "size")
    linked = records.select("page_id", "url", "digest").join(facts, "digest")
    revisits = (F.col("size") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("largest"))
    headers = linked.withColumn("owner", F.when(revisits, F.col("largest"))).select("digest", "copies", F.col("page_id").alias("salted_by"), _header(date).alias("header"))
    save(headers.filter(F.col("copies") < HOT).select("digest", "header"), "headers")
    hot = headers.filter(F.col("copies") >= HOT).select("digest", F.pmod(F.xxhash64("salted_by"), F.lit(SALTS)).cast("int").alias("salt"), "header")
    hot.write.option("path", f"{folder}/hot").option("compression", "zstd").saveAsTable(made.hot_headers)
    return made


def restore(spark: SparkSession, archive: Archive) -> DataFrame:
    """header, payload and the whole WARC record of every record; a payload that isn't its digest's fails the read."""
    checked = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("digest"))).cast("binary"))
    payloads = spark.table(archive.payloads)
    plain = spark.table(archive.headers).join(payloads.filter(F.col("copies") < HOT).select("digest", checked.alias("payload")), "digest")
    dealt = payloads.filter(F.col("copies") >= HOT).select("digest", checked.alias("payload")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hot = spark.table(archive.hot_headers).join(dealt, ["digest", "salt"])
    rows = plain.select("header", "payload").unionByName(hot.select("header", "payload"))
    body = F.when(F.col("header").startswith("WARC/1.1\r\nWARC-Type: revisit"), F.lit(b"")).otherwise(F.col("payload"))
    return rows.withColumn("record", F.concat(F.encode("header", "UTF-8"), body, F.lit(b"\r\n\r\n")))


def fields(restored: DataFrame) -> DataFrame:
    """page_id, record_type and refers_to as the headers say, with header, payload and record."""
    page = lambda name: F.regexp_extract("header", rf"\r\n{name}: <urn:page:(-?\d+)>\r\n", 1)
    number = lambda value: F.when(value != "", value).cast("long")
    return restored.select(
        number(page("WARC-Record-ID")).alias("page_id"), F.regexp_extract("header", r"\r\nWARC-Type: (\w+)\r\n", 1).alias("record_type"),
        number(page("WARC-Refers-To")).alias("refers_to"), "header", "payload", "record",
    )


def export(restored: DataFrame, path: str) -> None:
    """Plain WARC files: each record with the two line ends that close it."""
    restored.select(F.concat("header", F.when(F.col("header").contains("WARC-Type: revisit"), F.lit("")).otherwise(F.decode("payload", "UTF-8")))).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)
