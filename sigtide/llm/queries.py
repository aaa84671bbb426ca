"""The queries of the operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigtide.llm import (
    audit, crosstok, decontam, embed, licenses, ngram, packing, quality, secretscan, sql, tokens, toolcalls, urls,
    wrappers)


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def vocabulary() -> str:
    """The byte-level BPE file of the queries."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return embed.near_duplicates(_table(spark, sf, "embeddings"))


def jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return ngram.links(_table(spark, sf, "documents"))


def tool_calls(spark: SparkSession, sf: str) -> DataFrame:
    calls, results = toolcalls.conversation_calls(_table(spark, sf, "conversations"))
    return toolcalls.sort_calls(toolcalls.link(calls, results))


def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    return tokens.token_counts(docs, vocabulary()).select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > tokens.LIMIT).alias("over_limit"))


def benchmark_report(spark: SparkSession, sf: str) -> DataFrame:
    return decontam.report(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))


def secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    return secretscan.scan(docs, columns=("n_assign", "n_access", "n_hex", "base_sha256", "spans")).drop(
        "text")


def url_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    pages = _table(spark, sf, "pages").select("page_id", "url")
    return urls.judge(pages, urls.spam_list(pages)).drop("url")


def license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.scan(_table(spark, sf, "documents").select("doc_id", "text")).drop("text")


def pack(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(_table(spark, sf, "documents"), vocabulary())


def quality_scores(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    model = quality.fit(docs, _table(spark, sf, "labels"))
    return quality.score(docs, model).select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def cross_tokenizer(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    return crosstok.scored(_table(spark, sf, "documents").select("doc_id", "text"), vocabulary(),
                           public_tokenizers.path("piece_bpe_32k.model"))


def page_texts(spark: SparkSession, sf: str) -> DataFrame:
    return wrappers.main_text(_table(spark, sf, "pages").select("page_id", "url", "html"))


def filter_audit(spark: SparkSession, sf: str) -> DataFrame:
    return audit.interactions(audit.mask_counts(
        _table(spark, sf, "documents").select("doc_id", "text", "lang"), _table(spark, sf, "labels")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {
        "op1_embedding_near_dedup": near_dedup,
        "op2_ngram_jaccard_join": jaccard_join,
        "op3_tool_call_linking": tool_calls,
        "op4_token_counts": token_counts,
        "op5_benchmark_decontamination": benchmark_report,
        "op6_secret_scan": secret_scan,
        "op7_url_filter": url_verdicts,
        "op8_license_scan": license_scan,
        "op9_packing": pack,
        "op10_quality_classifier": quality_scores,
        "op11_cross_tokenizer_alignment": cross_tokenizer,
        "op12_html_extraction": page_texts,
        "op13_filter_interactions": filter_audit,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    """SQL for what SQL can express; the others are tested against brute force."""
    return sql.oracle_sql()
