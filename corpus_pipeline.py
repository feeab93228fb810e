"""Cleaning of a document corpus in stages, each of one operator; stages write Parquet."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rasterledger.llm.exact_dedup import exact_duplicates
from rasterledger.llm.packing import packed
from rasterledger.llm.quality_rules import MEASURES, verdicts
from rasterledger.llm.queries import table, tokenizer
from rasterledger.llm.simhash import near_duplicates
from rasterledger.llm.suffix_dedup import cut_repeats
from rasterledger.llm.texts import spare
from rasterledger.session import use_checkpoint_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no quality rule; columns named like a measure keep their values."""
    clashing = {c: spare(f"_own_{c}", docs.columns) for c in docs.columns if c in (*MEASURES, "base_failed", "kept")}
    judged = verdicts(docs.withColumnsRenamed(clashing)).where("kept")
    return judged.drop(*clashing).withColumnsRenamed({own: c for c, own in clashing.items()}).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row with the largest id; of rows without an id one of each text that no other row has.

    Rows of one id with different texts are different documents.
    """
    found = exact_duplicates(docs).where("group_size > 1 and not kept")
    dropped = found.select(_text_key("doc_id", "text_sha256").alias("_key")).distinct()
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    digest = F.sha2(F.translate(F.coalesce("text", F.lit("")), upper, upper.lower()), 256)
    keyed = docs.withColumn("_key", _text_key("doc_id", digest))
    return keyed.join(dropped, "_key", "left_anti").dropDuplicates(["_key"]).select(*docs.columns)


def _text_key(row_id: str, digest: Column | str) -> Column:
    """An id, which may be missing, and a digest as one join key."""
    return F.concat_ws(":", F.coalesce(F.col(row_id).cast("string"), F.lit("none")), digest)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by SimHash fingerprints that differ in two bits or fewer the one with the smallest id."""
    dropped = near_duplicates(docs).where("doc_id <> component_id").select("doc_id")
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the strings of 200 bytes that stand at more than one place.

    An id is expected to have one text here, as copies of a row are gone.
    """
    cut = cut_repeats(docs).select(F.col("doc_id").alias("_id"), "left").dropDuplicates(["_id"])
    met = docs.join(cut, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    text = F.coalesce("left", "text")
    changed = F.col("left").isNotNull()
    met = met.withColumns({"text": text, "n_chars": F.when(changed, F.char_length(text).cast("long")).otherwise(F.col("n_chars"))})
    return met.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, in sequences of 2048 ids."""
    return packed(docs, tokenizer("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("suffix_dedup", repeats),
    ("packing", packing),
]

#: No SQL: fingerprints, graph components and tokenizers are beyond one statement.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents; each but the last is written and read again.

    Stage tables go to a new folder below the checkpoint folder that the session names.
    """
    folder = os.path.join(use_checkpoint_dir(spark), f"stages-{uuid.uuid4().hex}")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
