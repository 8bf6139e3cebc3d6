"""From raw documents to training sequences: identify languages, score quality, drop near-copies, mask personal data, pack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contourlake.llm import jaccard, langid, packing, pii, quality
from contourlake.llm.common import materialize, table

#: Fixed columns of the documents table, which all stages but the last return.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those that the calibrated model rejects, or without a letter, go."""
    model = langid.train_language_id(docs, ~langid.held_out(4, 2))
    return langid.keep_identified(docs.select(*COLUMNS), model)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores at least 0.5."""
    model = quality.train_quality(docs, table(spark, sf_dir, "labels"), ~langid.held_out(3, 1))
    return quality.keep_good(docs.select(*COLUMNS), model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-copies: the one with the smallest id, one without an id only where no other has one.

    Rows are told apart by a written number: ids may be null or repeated.
    """
    rows = materialize(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")), "rows")
    classes = jaccard.near_duplicates(rows, doc_id="row", row="row").select(F.col("doc_id").alias("row"), "class_id")
    firsts = rows.select("doc_id", "row").join(classes, "row").groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"))
    return rows.join(firsts.select("first.row"), "row", "left_semi").select(*COLUMNS)


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with personal data replaced by its kind; n_chars follows the new text."""
    found = materialize(pii.find(docs, keep=COLUMNS), "spans")
    return pii.redact(found, pii.fit(found)).select(*COLUMNS).withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("pii", mask_pii),
    ("packing", pack),
]

#: Learnt models and token ids can't be written in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
