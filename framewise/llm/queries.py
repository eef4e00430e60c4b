"""The queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, classifier, embeddings, main_text, mixing, negatives, ngrams, packing, periods, pieces, rules, unigram, warc
from .common import prepare, save, table

#: The mixture of op6: weights by node, the part of all tokens it takes, and how often a row may be taken.
MIX_WEIGHTS = {"domain": {"domain0": 4, "domain1": 3, "domain2": 2, "*": 1}, "lang": {"en": 4, "*": 2}, "source": {}}
MIX_SHARE, MIX_EPOCHS, MIX_SEED = 0.6, 2, 17


def piece_model() -> str:
    """The public SentencePiece model's place on this machine and the executors."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return classifier.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return main_text.extract_main_text(table(spark, sf_dir, "pages"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return warc.archive_and_read(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return unigram.token_counts(table(spark, sf_dir, "documents"), piece_model())


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", mixing.source_domain(F.col("source")).alias("domain"), mixing.count_words(F.col("text")).alias("n_tokens"))
    return mixing.mix(save(docs, "mix-tokens"), MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS, MIX_SEED).select("doc_id", "domain", "lang", "source", "n_tokens", "epoch")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    out = rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return pieces.sentencepiece_digests(table(spark, sf_dir, "documents"), piece_model())


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return ngrams.near_duplicate_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    given = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    probe = [spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"),
        F.lit(said).alias("text")) for i, role in enumerate(("user", "assistant"))]
    read = chat.read_chats(chat.format_chats(given.unionByName(probe[0]).unionByName(probe[1])))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid",
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of rows whose id is divisible by 7 are moved on first; rows whose id is divisible by 50 are anchors."""
    prepare(spark)
    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.mine_hard_negatives(rows, F.col("vec_id") % 50 == 0)


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text, of which a tenth, by a hash of doc_id, becomes periodic from some word on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    chosen = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("words"), F.floor(h / 10).alias("g"))
    chosen = chosen.withColumn("n", F.size("words").cast("long")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    chosen = chosen.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    periodic = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.get(F.col("words"), place(i).cast("int"))), " ")
    return chosen.select("doc_id", F.when(F.col("n") > 0, periodic).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    found = periods.periodic_runs(with_planted_periods(table(spark, sf_dir, "documents")))
    longest = F.get(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period")))), F.lit(0))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    out = found.select("doc_id", "runs", "collapsed_sha256", longest.alias("top"), F.sha2(listed, 256).alias("runs_sha256"))
    out = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("top.start").alias("start"), (-F.col("top.l")).alias("length"), F.col("top.period").alias("period"), "runs_sha256", "collapsed_sha256")
    return out.withColumn("exponent_milli", F.expr("1000 * length div period"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    prepare(spark)
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_quality_classifier, op2_html_extraction, op3_warc, op4_embedding_near_dedup, op5_token_counts, op6_mixing, op7_quality_rules, op8_sentencepiece,
        op9_ngram_jaccard_join, op10_chat_formatting, op11_hard_negatives, op12_periodic_runs, op13_packing, pipeline)
    return {f.__name__: f for f in found}
