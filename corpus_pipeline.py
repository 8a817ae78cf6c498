"""The corpus pipeline: toxicity, quality, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; ``run`` writes it to shared storage and
hands it to the next one as its docs. All but the last keep the columns of documents, whatever their names.

Null texts count as empty ones in every stage. Rows are judged one by one, so repeated rows share their fate in the first two
stages; of repeated rows the third keeps one. Rows without an id are judged by their text. An empty table stays empty, and
without labels the first two stages keep every row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.llm import line_quality, packing, simhash, toxicity
from runloom.llm.common import stored, table
from runloom.llm.queries import TOKENIZER

#: A document goes if it is toxic with this probability, or of good quality with less than that.
TOXIC, GOOD = 0.5, 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` less those that the toxicity models reject; the models learn from the labels of what is there."""
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), into="__toxic")
    return scored.filter(F.col("__toxic") < TOXIC).drop("__toxic")


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` less those that the line classifier rejects."""
    scored = line_quality.score(docs, line_quality.train(docs, table(spark, sf_dir, "labels")), into="__good")
    return scored.filter(F.col("__good") >= GOOD).drop("__good")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id."""
    return simhash.keep_first(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, with their sequences."""
    return packing.pack_documents(docs, TOKENIZER)


STAGES = [("toxicity", drop_toxic), ("quality", drop_poor), ("near_duplicates", drop_near_copies), ("packing", pack)]
#: The models of the first two stages can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLE = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
