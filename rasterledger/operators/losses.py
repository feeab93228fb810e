"""Loss audits on pixel tables (image_id, logit, label)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rasterledger.functions.scalars import bce_with_logits, ratio, sigmoid

IGNORE_LABEL = 255


def _soft_dice(intersection: Column, mass: Column, smooth: float) -> Column:
    return (2.0 * intersection + smooth) / (mass + smooth)


def cross_entropy_dice_audit(
    pixels: DataFrame,
    *,
    ce_weight: float,
    dice_weight: float,
    smooth: float = 1e-6,
    ignore_label: int | None = IGNORE_LABEL,
) -> DataFrame:
    """Pixel-mean cross entropy, image-mean soft Dice loss and their weighted sum.

    ``logit`` is the foreground logit minus the background logit. Images whose
    pixels are all ignored still count in the Dice mean.
    """
    valid = F.lit(True) if ignore_label is None else F.col("label") != ignore_label
    target = (F.col("label") == 1).cast("double")
    p = sigmoid(F.col("logit"))
    per_image = pixels.groupBy("image_id").agg(
        F.sum(F.when(valid, bce_with_logits(F.col("logit"), target)).otherwise(0.0)).alias("ce"),
        F.count_if(valid).alias("pixels"),
        F.sum(F.when(valid, p * target).otherwise(0.0)).alias("overlap"),
        F.sum(F.when(valid, p + target).otherwise(0.0)).alias("mass"),
    )
    losses = per_image.agg(
        ratio(F.sum("ce"), F.sum("pixels"), None).alias("cross_entropy"),
        (1.0 - F.avg(_soft_dice(F.col("overlap"), F.col("mass"), smooth))).alias("dice_loss"),
        F.sum("pixels").alias("valid_pixels"),
    )
    return losses.withColumn(
        "loss", ce_weight * F.col("cross_entropy") + dice_weight * F.col("dice_loss")
    )


def combined_loss_audit(
    pixels: DataFrame,
    *,
    bce_weight: float = 0.35,
    dice_weight: float = 0.45,
    focal_weight: float = 0.20,
    iou_weight: float = 0.10,
    gamma: float = 2.0,
    alpha: float = 0.25,
    smooth: float = 1e-6,
    predicted_iou: DataFrame | None = None,
) -> DataFrame:
    """Cross entropy, soft Dice, focal and IoU-regression losses with their sum.

    ``predicted_iou`` is an optional (image_id, predicted_iou) table.
    """
    logit, target = F.col("logit"), F.col("label").cast("double")
    p, bce = sigmoid(logit), bce_with_logits(logit, target)
    p_true = p * target + (1.0 - p) * (1.0 - target)
    weight = alpha * target + (1.0 - alpha) * (1.0 - target)
    hard, truth = p >= 0.5, target >= 0.5
    per_image = pixels.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("pixels"),
        F.sum(bce).alias("bce"),
        F.sum(weight * F.pow(1.0 - p_true, F.lit(gamma)) * bce).alias("focal"),
        F.sum(p * target).alias("overlap"),
        F.sum(p + target).alias("mass"),
        ratio(F.count_if(hard & truth), F.count_if(hard | truth), 1.0).alias("hard_iou"),
    )
    gap = F.lit(0.0)
    if predicted_iou is not None:
        per_image = per_image.join(predicted_iou, "image_id", "left")
        gap = F.coalesce(F.avg(F.pow(F.col("predicted_iou") - F.col("hard_iou"), F.lit(2.0))), F.lit(0.0))
    losses = per_image.agg(
        (F.sum("bce") / F.sum("pixels")).alias("bce_loss"),
        (1.0 - F.avg(_soft_dice(F.col("overlap"), F.col("mass"), smooth))).alias("dice_loss"),
        (F.sum("focal") / F.sum("pixels")).alias("focal_loss"),
        gap.alias("iou_head_loss"),
    )
    total = (
        bce_weight * F.col("bce_loss")
        + dice_weight * F.col("dice_loss")
        + focal_weight * F.col("focal_loss")
        + (iou_weight * F.col("iou_head_loss") if predicted_iou is not None else F.lit(0.0))
    )
    return losses.withColumn("loss", total)
