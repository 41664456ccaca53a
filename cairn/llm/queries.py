"""Registered queries of this subpackage, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import bpe, hadamard, hnsw, huffman, language, line_dedup, ngram_join, oracles, packing, prefix_trie, quality, rules, secret_scan, toxicity
from cairn.llm.common import read, tokenizer_path


def _scored(docs: DataFrame, score: str, threshold: float) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    return docs.select("doc_id", quality.held_out().alias("held_out"), F.col(score).alias("score"), (F.col(score) >= threshold).cast("int").alias("predicted"))


def op1_quality_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return _scored(quality.classify(docs, labels), "quality_score", 0.3)


def op2_bpe_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("byte_bpe_50k.json")
    docs = bpe.decode(bpe.encode(read(spark, sf_dir, "documents"), path), path, digest=True)
    return docs.select("doc_id", (F.octet_length("ids") / bpe.width(path)).cast("long").alias("n_tokens"), "ids_sha256", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op3_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_report(read(spark, sf_dir, "documents"), short=True)


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(read(spark, sf_dir, "documents"))


def op5_crf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = rules.apply(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return docs.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op7_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op8_toxicity_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return _scored(toxicity.classify(docs, labels), "toxicity", 0.5)


def op9_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = huffman.round_trip(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return docs.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_secret_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = secret_scan.find(read(spark, sf_dir, "documents")).drop("text")
    spans = F.col("secret_spans")
    return docs.select("doc_id", *[secret_scan.of_kind(spans, k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
                       F.sha2(secret_scan.joined(spans, True).cast("binary"), 256).alias("base_sha256"), secret_scan.joined(spans, False).alias("spans"))


def op11_zfast_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.report(*prefix_trie.rebuilt(prefix_trie.turns_of(read(spark, sf_dir, "conversations"))))


def op12_language_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = language.identify(read(spark, sf_dir, "documents"))
    return docs.select("doc_id", quality.held_out().alias("held_out"), "lang_pred", "score", "distance", "rejected")


def op13_hadamard_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hadamard.report(read(spark, sf_dir, "embeddings"), hadamard.CENTROIDS, hadamard.ROUNDS, 3)


QUERIES = {f.__name__: f for f in (op1_quality_ftrl, op2_bpe_words, op3_fuzzy_lines, op4_ngram_jaccard, op5_crf_lines, op6_best_fit_packing, op7_hnsw, op8_toxicity_automata, op9_huffman_ids, op10_secret_crf,
                                   op11_zfast_trie, op12_language_centroids, op13_hadamard_clusters)}
ORACLE: dict[str, str] = {"op11_zfast_trie": oracles.PREFIX_NODES, "op13_hadamard_clusters": oracles.clusters(hadamard.ROUNDS, hadamard.CENTROIDS, 3)}
