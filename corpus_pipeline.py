"""A training corpus from documents: quality scores, quality rules, near-duplicates, source mixture, token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows the one before it kept; all but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.llm import classifier, mixing, ngrams, pieces, rules
from framewise.llm.common import new_path, prepare, remove, scratch, table
from framewise.llm.queries import MIX_EPOCHS, MIX_SEED, MIX_WEIGHTS, piece_model

#: The mixture takes as many tokens as the stage is given: over-full sources are cut, scarce ones repeated.
SHARE = 1.0
#: SQL cannot express the learned stages; tests/llm holds run() against brute force.
ORACLE_SQL = None


def aside(docs: DataFrame, *used: str) -> DataFrame:
    """All columns of ``docs`` under names that no operator gives, and those a stage uses: an extra column may have any name."""
    return docs.select(*[F.col(f"`{c}`").alias(f"__keep{i}") for i, c in enumerate(docs.columns)], *used)


def back(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col(f"__keep{i}").alias(c) for i, c in enumerate(docs.columns)])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least one half."""
    prepare(spark)
    kept = [f"__keep{i}" for i in range(len(docs.columns))]
    scored = classifier.score_quality(aside(docs, "doc_id", "text"), table(spark, sf_dir, "labels"), keep=kept)
    return back(scored.where("predicted = 1"), docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base test nor a learned rule rejects; the rules are learned from labels of all documents."""
    prepare(spark)
    learned = rules.fit_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    counted = rules.with_counts(docs.select("*", F.struct(*[f"`{c}`" for c in docs.columns]).alias("__doc")), keep=["__doc"])
    return counted.where(rules.verdict(learned)).select("__doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    prepare(spark)
    return ngrams.one_of_each_class(docs).select(*[f"`{c}`" for c in docs.columns])


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture's documents, a row for each epoch."""
    rows = aside(docs, "doc_id", "lang", "source").withColumn("n_tokens", mixing.count_words(F.col(f"__keep{docs.columns.index('text')}")))
    rows = rows.withColumn("domain", mixing.source_domain(F.col("source")))
    return back(mixing.mix(rows, MIX_WEIGHTS, SHARE, MIX_EPOCHS, MIX_SEED), docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text."""
    prepare(spark)
    return pieces.sentencepiece_digests(docs, piece_model())


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", source_mixture),
    ("SentencePiece encoding and decoding", sentencepiece),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written as Parquet in the shared folder and read again; it goes once the next is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        path = new_path(spark, f"stage{i}")
        with scratch(spark):  # what a stage saved on its way is of no use once its result is written, and so is what it read
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
