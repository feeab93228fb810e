"""Metric formulas over the four confusion counts, as Column expressions.

Three rule sets exist for undefined ratios:
``per_image`` (with an empty policy), ``meter`` and ``pooled``.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from rasterledger.functions.scalars import ratio

# The accepted policy names.
EMPTY_POLICIES = ("perfect_if_both_empty", "zero_if_undefined")

# Result columns, in report order.
RATIO_METRICS = (
    "iou",
    "dice",
    "precision",
    "recall",
    "specificity",
    "pixel_accuracy",
    "balanced_accuracy",
    "mcc",
    "cohen_kappa",
)


def _counts() -> tuple[Column, Column, Column, Column]:
    # Doubles throughout: products of four counts do not fit into 64 bits.
    return tuple(F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))


def _matthews(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    scale = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return ratio(tp * tn - fp * fn, scale, 0.0)


def _chance_agreement(tp: Column, fp: Column, fn: Column, tn: Column, empty: float) -> Column:
    total = tp + fp + fn + tn
    return ratio((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn), total * total, empty)


def _assemble(named: dict[str, Column]) -> list[Column]:
    named["balanced_accuracy"] = (named["recall"] + named["specificity"]) / 2.0
    return [named[name].alias(name) for name in RATIO_METRICS]


def per_image_metrics(empty_policy: str = "perfect_if_both_empty") -> list[Column]:
    """Nine ratios under an explicit empty-mask policy."""
    if empty_policy not in EMPTY_POLICIES:
        raise ValueError(f"Unknown empty-mask policy: {empty_policy}")
    tp, fp, fn, tn = _counts()
    nothing_there = (tp + fp + fn) == 0.0
    undefined = (
        F.when(nothing_there, 1.0).otherwise(0.0)
        if empty_policy == "perfect_if_both_empty"
        else F.lit(0.0)
    )
    accuracy = ratio(tp + tn, tp + fp + fn + tn, 1.0)
    chance = _chance_agreement(tp, fp, fn, tn, 1.0)
    return _assemble(
        {
            "iou": ratio(tp, tp + fp + fn, undefined),
            "dice": ratio(2.0 * tp, 2.0 * tp + fp + fn, undefined),
            "precision": ratio(tp, tp + fp, undefined),
            "recall": ratio(tp, tp + fn, undefined),
            "specificity": ratio(tn, tn + fp, 1.0),
            "pixel_accuracy": accuracy,
            "mcc": _matthews(tp, fp, fn, tn),
            "cohen_kappa": F.when(chance != 1.0, (accuracy - chance) / (1.0 - chance)).otherwise(1.0),
        }
    )


def meter_metrics() -> list[Column]:
    """Nine ratios under the rules of the running meter."""
    tp, fp, fn, tn = _counts()
    accuracy = ratio(tp + tn, tp + fp + fn + tn, 1.0)
    chance = _chance_agreement(tp, fp, fn, tn, 0.0)
    return _assemble(
        {
            "iou": ratio(tp, tp + fp + fn, 1.0),
            "dice": ratio(2.0 * tp, 2.0 * tp + fp + fn, 1.0),
            "precision": ratio(tp, tp + fp, F.when(fn == 0.0, 1.0).otherwise(0.0)),
            "recall": ratio(tp, tp + fn, 1.0),
            "specificity": ratio(tn, tn + fp, 1.0),
            "pixel_accuracy": accuracy,
            "mcc": _matthews(tp, fp, fn, tn),
            "cohen_kappa": ratio(accuracy - chance, 1.0 - chance, 0.0),
        }
    )


def pooled_metrics(prefix: str = "global_") -> list[Column]:
    """Five ratios over summed counts; every undefined ratio is 1."""
    tp, fp, fn, tn = _counts()
    return [
        ratio(tp, tp + fp + fn, 1.0).alias(f"{prefix}iou"),
        ratio(2.0 * tp, 2.0 * tp + fp + fn, 1.0).alias(f"{prefix}dice"),
        ratio(tp, tp + fp, 1.0).alias(f"{prefix}precision"),
        ratio(tp, tp + fn, 1.0).alias(f"{prefix}recall"),
        ratio(tn, tn + fp, 1.0).alias(f"{prefix}specificity"),
    ]


def presence_columns() -> list[Column]:
    """Foreground fractions and the four empty-mask flags."""
    tp, fp, fn, tn = _counts()
    total = tp + fp + fn + tn
    target, predicted = ratio(tp + fn, total, None), ratio(tp + fp, total, None)
    return [
        target.alias("target_fraction"),
        predicted.alias("predicted_fraction"),
        (predicted - target).alias("fraction_error"),
        ((tp + fn) > 0).alias("target_present"),
        ((tp + fp) > 0).alias("prediction_present"),
        ((tp + fp + fn) == 0).alias("empty_correct"),
        (((tp + fn) == 0) & (fp > 0)).alias("empty_false_positive"),
    ]
