"""Training corpus pipeline: each stage works on what the one before kept.

``STAGES`` lists the stages; each takes ``(spark, docs, sf_dir)`` and returns a
DataFrame, which is written as a table on shared files and read again as the
``docs`` of the next stage. All but the last return the columns of ``documents``.
Each stage takes nulls, empty texts, repeated rows and empty tables as the
operator that it calls does; see there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from blackspot.llm import language
from blackspot.llm.common import documents, id_back
from blackspot.llm.decontaminate import benchmark, drop_contaminated
from blackspot.llm.exact_dedup import keep_unique
from blackspot.llm.pieces import round_trip
from blackspot.llm.simhash import keep_one
from blackspot.runtime import cut


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model knows; it learns from the labelled rows that are not held out."""
    return language.keep_known(docs, language.fit(docs, ~language.held_out()))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id."""
    return keep_unique(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id."""
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return drop_contaminated(docs, benchmark(spark, sf_dir))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, text``: the token ids of every text, and the text that they decode to."""
    return round_trip(docs).select(id_back(F.col("doc")).alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), "ids", "text")


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup),
          ("decontaminate", decontaminate), ("sentencepiece", tokens)]
#: Language labels and tokens have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), replaces=docs)
    return STAGES[-1][1](spark, docs, sf_dir)
