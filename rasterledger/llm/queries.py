"""Registered queries of the numbered operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from rasterledger.llm import exact_dedup, hard_negatives, licenses, line_dedup
from rasterledger.llm.quality_rules import MEASURES, verdict_sql, verdicts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op2_packing")
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rasterledger.llm.packing import packed

    return packed(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


@query("op4_token_counts")
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rasterledger.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


@query("op7_byte_bpe")
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rasterledger.llm.byte_bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"))


@query("op6_quality_rules", verdict_sql())
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(table(spark, sf_dir, "documents")).select("doc_id", *MEASURES, "base_failed", "kept")


@query("op8_exact_dedup", exact_dedup.SQL)
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


@query("op10_simhash")
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rasterledger.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op3_license_scan", licenses.scan_sql())
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scanned(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "sentence_ids", "licenses", "unmatched_ids")


@query("op5_page_text")
def op5_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rasterledger.llm.page_text import main_text

    return main_text(table(spark, sf_dir, "pages"))


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rasterledger.llm.toxicity import scored

    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op1_suffix_dedup")
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rasterledger.llm.suffix_dedup import repeat_report

    return repeat_report(table(spark, sf_dir, "documents"))


@query("op11_line_dedup", line_dedup.SQL)
def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_duplicates(table(spark, sf_dir, "documents"))


@query("op12_hard_negatives", hard_negatives.SQL)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


@query("op13_token_alignment")
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rasterledger.llm.token_alignment import aligned_documents

    return aligned_documents(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))
