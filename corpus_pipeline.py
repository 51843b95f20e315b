"""From documents to packed sequences: language ID, exact dedup, near-duplicate join, decontamination, packing.

Each stage takes all that its predecessor kept; all but the last give the columns of documents. A stage first numbers
its rows and decides on these numbers, so null ids, ids of several texts and repeated rows are rows like others; of equal rows the first stays."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lodestar.llm import decontamination, exact_dedup, jaccard_join, language_id, packing
from lodestar.llm.common import materialize, small, table

#: A document is rejected if it has no letters, or if its best language has less than this share of belief.
LEAST_BELIEF = 0.5
#: The number of a row within a stage.
ROW = "_lodestar_row"


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with numbers of rows, written once so that they stay."""
    return materialize(docs.withColumn(ROW, F.monotonically_increasing_id()))


def _keep(numbered: DataFrame, dropped: DataFrame) -> DataFrame:
    """The documents without the rows whose numbers are in dropped, which is broadcast if it is small."""
    return numbered.join(small(materialize(dropped.select(ROW)), 16), ROW, "left_anti").drop(ROW)


def _first() -> Column:
    """Where one of several rows stays: the smallest id, null ids last, then the first row."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col(ROW))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = _numbered(docs)
    model = language_id.train(docs.where(~language_id.held_out()))
    found = language_id.identify(docs, model, ROW)
    return _keep(docs, found.where((F.col("lang_pred") == language_id.UNKNOWN) | (F.col("score") < LEAST_BELIEF)))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = _numbered(docs)
    found = exact_dedup.exact_duplicates(docs.select(_first().alias("first"), "text"), "first")
    return _keep(docs, found.where("not kept").select(F.col("first")[ROW].alias(ROW)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links connect, the one with the smallest id stays."""
    docs = _numbered(docs)
    found = materialize(jaccard_join.similar_documents(docs, size=5, percent=80, id_col=ROW).select(ROW, "component_id"))
    several = found.where(F.col("component_id") != F.col(ROW)).select("component_id").distinct()
    linked = materialize(found.join(small(several, 16), "component_id", "left_semi"))
    named = materialize(docs.select("doc_id", ROW).join(small(linked, 24), ROW))
    best = named.groupBy("component_id").agg(F.min(_first())[ROW].alias("best"))
    return _keep(docs, named.join(small(best, 24), "component_id").where(F.col("best") != F.col(ROW)))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = _numbered(docs)
    return _keep(docs, decontamination.find_items(docs, table(spark, sf_dir, "benchmark"), id_col=ROW).where("n_hit > 0"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language ID", language), ("exact dedup", dedup), ("n-gram Jaccard join", near_dedup), ("benchmark decontamination", decontaminate), ("packing", pack)]

#: Language models and tokenizers can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
