"""Corpus pipeline: raw documents to token ids, one operator for each stage.

Each stage takes (spark, docs, sf_dir), works on all documents it is given and returns a DataFrame, which is
written as Parquet and read again as the next one's `docs`. All but the last return the columns of documents.

Defined results: of an empty table every stage makes an empty one; extra columns are dropped; doc_id may be null or repeated.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempograph.llm import bpe, decontaminate, jaccard_join, pii, quality_classifier
from tempograph.llm.common import numbered, stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _keep(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The documents whose doc_id, null too, and text are in `kept` (doc_id, text_hash)."""
    rows = kept.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_text"))
    return docs.hint("merge").join(rows, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_text")), "left_semi")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; null and empty texts are scored like others, repeated rows stay or go together."""
    judged = quality_classifier.quality(docs, table(spark, sf_dir, "labels"), keep=COLUMNS)
    return judged.filter("predicted = 1").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of smallest doc_id; of several rows of that doc_id the one whose number
    (`common.numbered`) is least, and of equal rows one. Documents without words stay, each doc_id and text once."""
    rows, _, plain = numbered(docs)
    if plain:
        first = jaccard_join.link_components(docs).filter("doc_id = component_id").select(F.col("doc_id").alias("_n"))
        return docs.hint("merge").join(first, F.col("doc_id") == F.col("_n"), "left_semi").select(*COLUMNS)
    first = jaccard_join.link_rows(rows).filter("n = component").select("n")
    kept = rows.hint("merge").join(first, "n", "left_semi").select("doc_id", F.xxhash64("text").alias("text_hash"))
    return _keep(docs, kept).withColumn("_place", F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(*COLUMNS[2:]))).filter("_place = 1").select(*COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go; repeated rows stay or go together."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return _keep(docs, found.filter("n_hit = 0")).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to a word for its kind. As many rows come out as went in; a null text stays null."""
    return pii.redact(docs, pii.personal_data(docs)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row's text, with hashes of the ids and of the text they decode to; null has no ids."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.digest(bpe.round_trip(docs, path))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("personal_data", personal_data), ("tokens", tokens)]

#: A trained classifier and byte-pair encoding can't be written as SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
