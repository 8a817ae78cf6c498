"""The operators' registered queries: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.llm import archive, bpe, line_quality, multi_index, packing, runs, sampling, shards, simhash, token_files, toxicity, variants, windows
from runloom.llm.common import shared_folder, table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]):
    QUERIES[build.__name__] = build
    return build


@query
def op1_shards(spark: SparkSession, folder: str) -> DataFrame:
    rows = shards.shard(table(spark, folder, "documents").select("doc_id", "text"), 40)
    crc = F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    return rows.select("doc_id", "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op2_bpe(spark: SparkSession, folder: str) -> DataFrame:
    rows = bpe.decode(bpe.encode(table(spark, folder, "documents").select("doc_id", "text"), TOKENIZER).select("doc_id", "ids"), TOKENIZER)
    n_tokens = F.expr("length(ids) div 4")
    return rows.select("doc_id", n_tokens.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


@query
def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), TOKENIZER, size=1024, end_id=2)


@query
def op8_archive(spark: SparkSession, folder: str) -> DataFrame:
    rows = archive.fields(archive.restore(spark, archive.write(table(spark, folder, "pages"))))
    return rows.select("page_id", F.length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "record_type", "refers_to")


ORACLE["op8_archive"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT html, max(page_id) AS largest FROM p GROUP BY html)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN strlen(html) >= 1000 AND page_id <> largest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN strlen(html) >= 1000 AND page_id <> largest THEN largest END AS refers_to
FROM p JOIN g USING (html)
"""


@query
def op9_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_folder(spark, "token-files")
    token_files.write(table(spark, folder, "documents"), path, TOKENIZER)
    return token_files.with_crc(token_files.read(spark, path)).select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    rows = toxicity.score(docs, toxicity.train(docs, table(spark, folder, "labels"), parts=5, held_out=0))
    return rows.select("doc_id", (toxicity.remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op5_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return multi_index.nearest(table(spark, folder, "embeddings"), every=20, top=20)


@query
def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    rows = simhash.near_duplicates(table(spark, folder, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op7_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.with_successor(table(spark, folder, "documents"))


@query
def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    rows = line_quality.score(docs, line_quality.train(docs, table(spark, folder, "labels"), parts=4, held_out=2))
    return rows.select("doc_id", (toxicity.remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op11_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", runs.plant().alias("text"))
    rows = runs.with_runs(docs, least=12).select("doc_id", "runs", "collapsed")
    longest = F.get(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("minus"), r["start"].alias("start"), r["period"].alias("period")))), F.lit(0))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws("", F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    rows = rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("one"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length = -F.col("one.minus")
    return rows.select("doc_id", "n_runs", "one.start", length.alias("length"), "one.period", F.floor(1000 * length / F.col("one.period")).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


@query
def op12_windows(spark: SparkSession, folder: str) -> DataFrame:
    return windows.pack_windows(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), size=4096, end_id=2)


@query
def op13_variants(spark: SparkSession, folder: str) -> DataFrame:
    return variants.group_variants(table(spark, folder, "documents"), every=199, least=6, fewest=5, times=5)
