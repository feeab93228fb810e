"""Pairing of records by key and the joins between result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from rasterledger.functions.scalars import normalise_split
from rasterledger.operators.checks import (
    examples,
    raise_if_any,
    require_columns,
    require_unique,
)

SPLITS = ("train", "validation", "test")


def normalised_key(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn(key, F.lower(F.trim(F.col(key).cast("string"))))


def duplicate_keys(df: DataFrame, key: str, value: str) -> DataFrame:
    """Every (key, value) of keys with several rows, with the number of rows that have both.

    Counts are combined before the shuffle, and a key's values stay rows of their own, so no
    task holds a key as a whole.
    """
    pairs = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("rows"))
    several = pairs.groupBy(key).agg(F.sum("rows").alias("_rows")).where("_rows > 1")
    return pairs.join(several.drop("_rows"), key)


def side_counts(images: DataFrame, masks: DataFrame, key: str) -> DataFrame:
    """Rows of each key on either side, (key, images, masks), in one pass over both."""
    both = images.select(key, F.lit(1).alias("_i"), F.lit(0).alias("_m")).unionByName(
        masks.select(key, F.lit(0).alias("_i"), F.lit(1).alias("_m"))
    )
    return both.groupBy(key).agg(F.sum("_i").alias("images"), F.sum("_m").alias("masks"))


def strict_pairs(images: DataFrame, masks: DataFrame, key: str = "image_id") -> DataFrame:
    """Pairing of which every key must have exactly one row on either side."""
    wrong = side_counts(images, masks, key).where("images <> 1 or masks <> 1")
    if not wrong.isEmpty():
        for side, label in (("images", "images"), ("masks", "masks")):
            repeated = examples(wrong.where(f"{side} > 1"), key)
            if repeated:
                raise ValueError(f"Pairing by {key} is ambiguous in {label}: {repeated}")
        raise ValueError(
            f"Some records have no partner. Images alone: {examples(wrong.where('masks = 0'), key)}; "
            f"masks alone: {examples(wrong.where('images = 0'), key)}"
        )
    return images.join(masks, key)


def pairing_verdicts(images: DataFrame, masks: DataFrame, key: str = "image_id") -> DataFrame:
    """(key, images, masks, verdict) for every key of two listings: paired, ambiguous or alone on one side."""
    verdict = (
        F.when((F.col("images") > 1) | (F.col("masks") > 1), "ambiguous")
        .when(F.col("masks") == 0, "image alone")
        .when(F.col("images") == 0, "mask alone")
        .otherwise("paired")
    )
    return side_counts(images, masks, key).withColumn("verdict", verdict)


def pairing_report(images: DataFrame, masks: DataFrame, key: str = "image_id") -> DataFrame:
    """Number of paired and one-sided keys."""
    left = images.select(key, F.lit(1).alias("_l"))
    right = masks.select(key, F.lit(1).alias("_r"))
    return left.join(right, key, "full_outer").agg(
        F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("paired"),
        F.count_if(F.col("_r").isNull()).alias("images_without_masks"),
        F.count_if(F.col("_l").isNull()).alias("masks_without_images"),
    )


def lenient_pairs(images: DataFrame, masks: DataFrame, key: str = "image_id") -> DataFrame:
    """Inner pairing; fails only when nothing pairs."""
    joined = images.join(masks, key, "inner")
    if joined.isEmpty():
        raise RuntimeError("No pairs were found")
    return joined


def recover_split(manifest: DataFrame, history: DataFrame, key: str = "image_id") -> DataFrame:
    """Attach historical split labels after conflict, coverage and label checks."""
    require_columns(history, [key, "split"])
    mapping = normalised_key(history.select(key, "split"), key).withColumn(
        "split", F.lower(F.trim(F.col("split").cast("string")))
    )
    per_key = mapping.groupBy(key).agg(
        F.min("split").alias("split"), (F.min("split") != F.max("split")).alias("_conflict")
    )
    raise_if_any(per_key.where("_conflict"), key, "Several historical splits for one id")
    joined = normalised_key(manifest.drop("split"), key).join(per_key.drop("_conflict"), key, "left")
    raise_if_any(joined.where("split is null"), key, "Historical split is incomplete")
    labelled = joined.withColumn("split", normalise_split(F.col("split")))
    raise_if_any(
        labelled.where(~F.col("split").isin(*SPLITS)).select("split").distinct(),
        "split",
        "Invalid historical split labels",
    )
    return labelled


def split_conflicts(history: DataFrame, key: str = "image_id") -> DataFrame:
    """Ids that carry more than one distinct label."""
    labels = normalised_key(history.select(key, "split"), key).withColumn(
        "split", normalise_split(F.col("split"))
    )
    return (
        labels.distinct().groupBy(key).agg(F.count(F.lit(1)).alias("labels")).where("labels > 1")
    )


def paired_comparison(
    current: DataFrame,
    reference: DataFrame,
    keys: Sequence[str],
    value: str,
    suffixes: tuple[str, str] = ("_current", "_reference"),
) -> DataFrame:
    """One-to-one inner join of one value from two result tables."""
    for side in (current, reference):
        require_unique(side, list(keys), "Pairs are not one to one")
    left = current.select(*keys, F.col(value).alias(f"{value}{suffixes[0]}"))
    right = reference.select(*keys, F.col(value).alias(f"{value}{suffixes[1]}"))
    return left.join(right, list(keys), "inner")


def enrich(
    left: DataFrame, right: DataFrame, keys: Sequence[str], suffix: str = "_registry"
) -> DataFrame:
    """Left join; columns of the right side that clash get the suffix."""
    clash = set(left.columns) - set(keys)
    renamed = right.select(
        *keys,
        *[
            F.col(c).alias(f"{c}{suffix}" if c in clash else c)
            for c in right.columns
            if c not in keys
        ],
    )
    return left.join(renamed, list(keys), "left")


def missing_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of the left side that the right side lacks."""
    return left.select(key).distinct().join(right.select(key), key, "left_anti")


def common_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).distinct().join(right.select(key), key, "left_semi")


def mask_differences(
    left: DataFrame, right: DataFrame, value: str, keys: Sequence[str] = ("image_id", "y", "x")
) -> DataFrame:
    """Per image: cells compared and cells whose values are not exactly equal."""
    joined = left.select(*keys, F.col(value).alias("_l")).join(
        right.select(*keys, F.col(value).alias("_r")), list(keys), "full_outer"
    )
    return joined.groupBy(keys[0]).agg(
        F.count(F.lit(1)).alias("cells"),
        F.count_if(~F.col("_l").eqNullSafe(F.col("_r"))).alias("different"),
    )

