"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftnet.llm import align, ann, chat, decontaminate, html, packing, phrases, quality, rules, sharding, simhash, spans


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of three sentences have 16 words at least, but for short texts and ends of texts: of ten words, phrases that clean documents share by chance count too."""
    return spans.dedup_substrings(_read(spark, sf_dir, "documents"), words=16).select("doc_id", "text", "n_sentences", "n_removed")


def op2_chat_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    return chat.digest(chat.expand(turns.unionByName(more)))


def op3_kk_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(_read(spark, sf_dir, "documents"), 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.dedup_lines(_read(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op5_genetic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"))


def op6_anisotropic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = ann.usable(_read(spark, sf_dir, "embeddings"))
    return ann.search(vectors, vectors.where("vec_id % 20 = 0"), 20)


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.label(_read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op9_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return scored.select("doc_id", "expected_grade", "tail_probability", "accepted")


def op11_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.judge(_read(spark, sf_dir, "documents"))
    return judged.select("doc_id", *rules.BASE, "base_failed", "kept")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrases.ranked(phrases.mine(_read(spark, sf_dir, "documents")))
    return found.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(_read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_chat_prefix_targets, op3_kk_sharding, op4_line_dedup, op5_genetic_packing, op6_anisotropic_search, op7_simhash_dedup, op8_decontamination, op9_html_layout, op10_quality_classifier, op11_rule_cascade, op12_collocations, op13_token_alignment)}
