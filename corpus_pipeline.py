"""A corpus pipeline over `documents`: five stages, each over all that the one before it kept.

The rules of each stage are those of its operator: rejected by the quality classifier, lines that
stand earlier, all but the least id of a group of near copies (five words, similarity 0.8),
benchmark passages, and token ids of what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm import bpe, classifier, contamination, line_dedup, ngram_join
from loam.llm.queries import tokenizer_path
from loam.llm.shared import sent_if_small
from loam.session import ship, table, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels that aren't held out, predicts as label 1."""
    stats = written(classifier.add_statistics(docs.select("doc_id", "text")), "stats")
    model = classifier.train(stats, table(spark, sf_dir, "labels"))
    return classifier.score_texts(docs, model).where("predicted = 1").select(docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand earlier up to one word (short lines: one character); one of which nothing is left goes."""
    left = line_dedup.dedup_lines(docs).where(F.col("text").isNull() | (F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each component of near copies."""
    ship(spark)
    groups = ngram_join.join_components(docs.select("doc_id", "text"), words=5, percent=80)
    dropped = written(groups.where("component_id <> doc_id").select("doc_id").distinct(), "dropped")
    return docs.join(sent_if_small(dropped, 40), "doc_id", "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover less than a twentieth."""
    return contamination.find_contamination(docs, table(spark, sf_dir, "benchmark")).where("not contaminated").select(docs.columns)


def bpe_round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of them and of what they decode to."""
    ship(spark)
    coded = bpe.round_trip(docs, tokenizer_path("byte_bpe_50k.json"), ids="ids")
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard", ngram_jaccard),
    ("decontamination", decontamination),
    ("bpe", bpe_round_trip),
]

#: SQL can express neither the classifier nor the tokenizer; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage; every stage's result is written and read again."""
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
