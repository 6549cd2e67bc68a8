"""The ``opN_*`` queries: each operator on the whole table it is meant for."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logmold.llm import ball_tree, bpe
from logmold.llm.conversation_trie import prefix_trie
from logmold.llm.credential_links import find_secrets
from logmold.llm.decontaminate import find_leaks
from logmold.llm.hamming_dedup import near_duplicates
from logmold.llm.lattice_lm import score_documents
from logmold.llm.license_index import scan
from logmold.llm.line_templates import drop_templates
from logmold.llm.resampling import resample
from logmold.llm.robust_rules import judge
from logmold.llm.sentence_spans import drop_repeats
from logmold.llm.url_rules import judge_urls

PIECES = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_templates(_table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", F.size("dropped_lines").alias("n_dropped"), F.array_join("dropped_lines", ",").alias("dropped"), "text")


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


def op4_minhash_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("k1", "k2")


def op6_credential_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op7_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_table(spark, sf_dir, "documents"), PIECES)


def op8_robust_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance2")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), RANKS)


def op10_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeats(_table(spark, sf_dir, "documents")).withColumn("removed", F.array_join("removed", ","))


def op11_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(_table(spark, sf_dir, "conversations")).withColumn("depth", F.col("depth").cast("long"))


def op13_license_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_importance": op1_importance,
    "op2_line_templates": op2_line_templates,
    "op3_url_rules": op3_url_rules,
    "op4_minhash_hamming": op4_minhash_hamming,
    "op5_decontaminate": op5_decontaminate,
    "op6_credential_links": op6_credential_links,
    "op7_lattice": op7_lattice,
    "op8_robust_rules": op8_robust_rules,
    "op9_bpe": op9_bpe,
    "op10_sentence_spans": op10_sentence_spans,
    "op11_ball_tree": op11_ball_tree,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_license_index": op13_license_index,
}
