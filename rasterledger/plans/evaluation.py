"""Evaluation of a pixel prediction table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from rasterledger.functions.metrics import per_image_metrics, presence_columns
from rasterledger.operators import calibration, confusion, raster, splitting
from rasterledger.session import pin

#: Means over images of what the boundaries give.
BOUNDARY_METRICS = ("boundary_precision", "boundary_recall", "boundary_f1", "boundary_iou", "hd95", "assd")


@dataclass
class Evaluation:
    """Tables of one evaluation run."""

    results: DataFrame
    macro: DataFrame
    pooled: DataFrame
    conditional: DataFrame
    reliability: DataFrame
    calibration: DataFrame


def evaluate_predictions(
    pixels: DataFrame,
    labels: DataFrame,
    *,
    threshold: float,
    empty_policy: str = "perfect_if_both_empty",
    sample_pixels: int | None = None,
    seed: int = 42,
    bins: int = 15,
    images: DataFrame | None = None,
    tolerance: int = 2,
    boundary_rule: str = "cross",
) -> Evaluation:
    """Metrics and calibration from pixels (image_id, y, x, prob, target) and labels (image_id, split).

    One pass over the pixels gives the per-image counts and one the reliability
    bins, over all pixels unless a sample per image is asked for. With ``images``
    (image_id, height, width) the results and their means also hold boundary metrics
    and surface distances; pixels then need to be one of each place.
    """
    counts = confusion.confusion_counts(
        pixels, ["image_id"], F.col("prob") >= threshold, F.col("target")
    )
    rows = counts.select("*", *per_image_metrics(empty_policy), *presence_columns())
    if images is not None:
        predicted = (F.col("prob") >= threshold).cast("int").alias("pred")
        size = images.select("image_id", "height", "width")
        cells = pixels.select("image_id", "y", "x", predicted, F.col("target").cast("int").alias("target"))
        if boundary_rule == "square":
            # This rule looks at the canvas; the other one at the pixels alone.
            cells = cells.join(size, "image_id")
        edges = raster.boundary_metrics(cells, images, tolerance=tolerance, rule=boundary_rule)
        distances = raster.surface_distances(cells, size, rule=boundary_rule)
        rows = rows.join(edges, "image_id", "left").join(distances, "image_id", "left")
    results = pin(labels.select("image_id", "split").join(rows, "image_id"))
    sampled = pixels if sample_pixels is None else splitting.sample_pixels(pixels, sample_pixels, seed)
    labelled = sampled.join(labels.select("image_id", "split"), "image_id")
    return Evaluation(
        results=results,
        macro=confusion.macro_summary(results, ["split"], (*confusion.SUMMARY_METRICS, *BOUNDARY_METRICS)),
        pooled=confusion.pooled_summary(results, ["split"]),
        conditional=confusion.conditional_summary(results, ["split"]),
        reliability=calibration.reliability_table(labelled, bins=bins, split="split"),
        calibration=calibration.calibration_metrics(labelled, bins=bins, split="split"),
    )


def calibrated_threshold(pixels: DataFrame, thresholds: list[float]) -> float:
    """Best macro threshold on the given pixels; pass validation pixels only."""
    sweep = calibration.macro_sweep(pixels, thresholds)
    return calibration.best_threshold(sweep).first()["threshold"]
