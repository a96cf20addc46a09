"""The registered queries of the training-data operators and, where SQL can express one, its SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, embedding_join, fingerprints, html_text, lm_score, near_dedup, packing, pii, prefix_trie, ranked_search, token_counts, toxicity
from ._common import table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), max_tokens=4096, end_id=1)


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lm_score.score(docs, lm_score.fit(docs))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents")).drop("node", "kept")


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digest_chats(chat.format_chats(turns))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    personal, secret = F.filter("found", lambda s: s["kind"] < 4), F.filter("found", lambda s: s["kind"] == 4)
    counts = [pii.count_kind("base", k).alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS[:4])]
    spans = F.array_sort(F.concat("base", personal), pii.by_start)
    return found.select("doc_id", *counts, F.sha2(pii.spell(F.col("base")), 256).alias("base_sha256"), pii.spell(spans).alias("spans"), F.size(personal).cast("bigint").alias("n_found"), pii.spell(secret).alias("secrets"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.top_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations")).drop("enter_at", "exit_at")


def op13_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_join.near_vectors(table(spark, sf_dir, "embeddings"), similarity=0.9)


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_toxicity": op3_toxicity,
    "op4_document_fingerprints": op4_document_fingerprints,
    "op5_token_counts": op5_token_counts,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_html_extraction": op9_html_extraction,
    "op10_pii": op10_pii,
    "op11_ranked_search": op11_ranked_search,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_embedding_near_dedup": op13_embedding_near_dedup,
}

ORACLE_SQL: dict[str, str] = {"op11_ranked_search": ranked_search.SQL, "op12_prefix_trie": prefix_trie.SQL, "op13_embedding_near_dedup": embedding_join.SQL}
