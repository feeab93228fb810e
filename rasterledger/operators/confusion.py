"""Confusion counts and their per-image, macro, pooled and meter summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rasterledger.functions.metrics import RATIO_METRICS, meter_metrics, pooled_metrics
from rasterledger.functions.scalars import log_loss, nan_to_null
from rasterledger.operators.checks import available, raise_if_any

COUNTS = ("tp", "fp", "fn", "tn")

# Metric columns of the summary tables, in report order.
SUMMARY_METRICS = (
    *RATIO_METRICS,
    "boundary_f1",
    "boundary_iou",
    "hd95",
    "assd",
    "target_fraction",
    "predicted_fraction",
    "fraction_error",
    "latency_ms",
)


def count_columns(prediction: Column, target: Column) -> list[Column]:
    """The four counts as aggregate expressions over two 0/1 columns."""
    p, t = prediction.cast("boolean"), target.cast("boolean")
    return [
        F.count_if(p & t).alias("tp"),
        F.count_if(p & ~t).alias("fp"),
        F.count_if(~p & t).alias("fn"),
        F.count_if(~p & ~t).alias("tn"),
    ]


def confusion_counts(
    pixels: DataFrame, keys: Sequence[str], prediction: Column, target: Column
) -> DataFrame:
    """tp, fp, fn, tn per key; counts are combined before the shuffle."""
    return pixels.groupBy(*keys).agg(*count_columns(prediction, target))


def pair_pixels(
    prediction: DataFrame, target: DataFrame, keys: Sequence[str] = ("image_id", "y", "x")
) -> DataFrame:
    """Join two pixel tables cell by cell; a cell on one side only is a shape mismatch."""
    left = prediction.withColumn("_in_prediction", F.lit(True))
    right = target.withColumn("_in_target", F.lit(True))
    joined = left.join(right, list(keys), "full_outer")
    unmatched = joined.where(F.col("_in_prediction").isNull() | F.col("_in_target").isNull())
    raise_if_any(unmatched.select(keys[0]).distinct(), keys[0], "Shape mismatch")
    return joined.drop("_in_prediction", "_in_target")


def shape_mismatches(
    prediction: DataFrame, target: DataFrame, keys: Sequence[str] = ("image_id", "y", "x")
) -> DataFrame:
    """Cells found on one side only, counted per image."""
    left = prediction.select(*keys, F.lit(1).alias("_p"))
    right = target.select(*keys, F.lit(1).alias("_t"))
    return (
        left.join(right, list(keys), "full_outer")
        .groupBy(keys[0])
        .agg(
            F.count_if(F.col("_t").isNull()).alias("prediction_only"),
            F.count_if(F.col("_p").isNull()).alias("target_only"),
        )
        .where("prediction_only > 0 or target_only > 0")
    )


def with_metrics(counts: DataFrame, metrics: Sequence[Column]) -> DataFrame:
    return counts.select("*", *metrics)


def macro_summary(
    results: DataFrame, groups: Sequence[str], metrics: Sequence[str] = SUMMARY_METRICS
) -> DataFrame:
    """Mean of every metric that exists, NaN skipped, with the row count. Null keys stay."""
    present = available(results, metrics)
    return results.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("images"),
        *[F.avg(nan_to_null(F.col(m).cast("double"))).alias(m) for m in present],
    )


def pooled_summary(results: DataFrame, groups: Sequence[str], rules: str = "pooled") -> DataFrame:
    """Ratios of summed counts, with pooled rules or with all nine meter ratios."""
    summed = results.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("images"), *[F.sum(c).alias(c) for c in COUNTS]
    )
    if rules == "pooled":
        return summed.select("*", *pooled_metrics())
    if rules == "meter":
        named = summed.select("*", *meter_metrics())
        return named.withColumnsRenamed({m: f"global_{m}" for m in RATIO_METRICS})
    raise ValueError(f"Unknown pooling rules: {rules}")


def meter_summary(results: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Global ratios, per-image means and primary aliases in one aggregation."""
    rows = with_metrics(results.select(*groups, *COUNTS), meter_metrics())
    both = rows.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("images"),
        *[F.sum(c).alias(c) for c in COUNTS],
        *[F.avg(m).alias(f"mean_{m}") for m in RATIO_METRICS],
    )
    named = both.select("*", *meter_metrics())
    return named.select(
        *groups,
        "images",
        *[F.col(m).alias(f"global_{m}") for m in RATIO_METRICS],
        *[F.col(f"mean_{m}") for m in RATIO_METRICS],
        *[F.col(f"mean_{m}").alias(m) for m in RATIO_METRICS],
    )


def conditional_summary(results: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Means restricted to images with or without foreground; NULL if there is none."""
    empty = ~F.col("target_present")
    return results.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("images"),
        F.avg(F.when(F.col("target_present"), F.col("iou"))).alias("present_iou"),
        F.count_if(empty).alias("empty_images"),
        F.avg(F.when(empty, F.col("empty_correct").cast("double"))).alias("empty_accuracy"),
        F.avg(F.when(empty, F.col("empty_false_positive").cast("double"))).alias(
            "empty_false_positive_rate"
        ),
    )


def validation_summary(
    pixels: DataFrame, threshold: float, metrics: Sequence[Column], margin: float = 1e-6
) -> DataFrame:
    """Mean IoU, Dice and per-image cross entropy at one threshold."""
    prediction = F.col("prob") >= threshold
    per_image = pixels.groupBy("image_id").agg(
        *count_columns(prediction, F.col("target")),
        F.avg(log_loss(F.col("prob"), F.col("target"), margin)).alias("bce"),
    )
    return with_metrics(per_image, metrics).agg(
        F.count(F.lit(1)).alias("images"),
        F.avg("iou").alias("iou"),
        F.avg("dice").alias("dice"),
        F.avg("bce").alias("bce"),
    )
