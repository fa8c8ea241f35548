"""The registered query of each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.llm import skip_chain
from faultlens.llm.bloom_dedup import exact_groups
from faultlens.llm.common import table
from faultlens.llm.harmonic_packing import pack_documents
from faultlens.llm.host_suffixes import extract_main_text
from faultlens.llm.kd_shards import shard_documents
from faultlens.llm.line_runs import dedup_lines
from faultlens.llm.merkle_pivot import merkle_manifest, siblings
from faultlens.llm.nn_descent import embedding_groups
from faultlens.llm.piece_agenda import encode_and_decode
from faultlens.llm.simhash import near_duplicates
from faultlens.llm.threshold_search import top_inner_products
from faultlens.llm.token_alignment import score_alignments, sha256_of_groups
from faultlens.llm.weak_toxicity import HELD_OUT, fit, fold_of, score_documents


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents, by patterns and by the skip-chain field."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = skip_chain.find_personal_data(documents, skip_chain.fit(documents))
    base = F.filter("spans", lambda span: span["base"])

    def count(n: int, kind: str):
        of_kind = F.filter("spans", lambda span: span["base"] & (span["kind"] == n))
        return F.size(of_kind).cast("bigint").alias(f"n_{kind}")

    counts = [count(n, kind) for n, kind in enumerate(skip_chain.KINDS)]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(skip_chain.spans_text(base), 256).alias("base_sha256"),
        skip_chain.spans_text(F.col("spans")).alias("spans"),
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 24 shards of near equal bytes."""
    return shard_documents(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose fingerprints differ in at most two bits."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of embeddings at a cosine of 0.95 or more."""
    return embedding_groups(table(spark, sf_dir, "embeddings"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents equal up to white space."""
    return exact_groups(table(spark, sf_dir, "documents"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    found = extract_main_text(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("bigint"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines many of them share."""
    kept = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents by the agenda encoder, and what they decode to."""
    documents = table(spark, sf_dir, "documents")
    found = encode_and_decode(documents, public_tokenizers.path("piece_bpe_32k.model"))
    return found.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed into sequences of 2048 ids."""
    documents = table(spark, sf_dir, "documents")
    pieces = pack_documents(documents, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.withColumn("ids", F.crc32("ids")).withColumnRenamed("ids", "ids_crc32")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, learned from four of five folds of the labels."""
    documents = table(spark, sf_dir, "documents")
    model = fit(documents, table(spark, sf_dir, "labels"))
    scored = score_documents(documents.select("doc_id", "text"), model)
    held_out = F.coalesce(fold_of() == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of every fiftieth embedding."""
    return top_inner_products(table(spark, sf_dir, "embeddings"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents in two vocabularies, aligned, and how common their pairs are."""
    files = map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    found = score_alignments(table(spark, sf_dir, "documents"), *files, written=sha256_of_groups)
    return found.withColumnRenamed("groups", "groups_sha256")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, some of them tampered with."""
    found = merkle_manifest(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"),
        "folded_root",
        "verified",
    )


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_sharding": op2_sharding,
    "op3_simhash": op3_simhash,
    "op4_embeddings": op4_embeddings,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_html": op6_html,
    "op7_line_dedup": op7_line_dedup,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_packing": op9_packing,
    "op10_toxicity": op10_toxicity,
    "op11_topk": op11_topk,
    "op12_alignment": op12_alignment,
    "op13_merkle": op13_merkle,
}
