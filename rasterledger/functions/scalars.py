"""Small numeric column helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def ratio(numerator: Column, denominator: Column, empty: Column | float | None) -> Column:
    """numerator / denominator in doubles, ``empty`` where the denominator is 0."""
    top, bottom = numerator.cast("double"), denominator.cast("double")
    fallback = empty if isinstance(empty, Column) else F.lit(empty).cast("double")
    return F.when(bottom != 0.0, top / bottom).otherwise(fallback)


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def quantise_u16(probability: Column) -> Column:
    """Half-even rounding of a clipped probability to 16 bits."""
    return F.bround(clip(probability, 0.0, 1.0) * 65535.0).cast("int")


def dequantise_u16(code: Column) -> Column:
    return code.cast("double") / 65535.0


def binarise(probability: Column, threshold: Column | float) -> Column:
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return (probability >= limit).cast("int")


def sigmoid(logit: Column) -> Column:
    return F.when(logit >= 0, 1.0 / (1.0 + F.exp(-logit))).otherwise(
        F.exp(logit) / (1.0 + F.exp(logit))
    )


def log_loss(probability: Column, target: Column, margin: float) -> Column:
    """Binary cross entropy of a probability clipped away from 0 and 1."""
    p = clip(probability, margin, 1.0 - margin)
    t = target.cast("double")
    return -(t * F.log(p) + (1.0 - t) * F.log(1.0 - p))


def bce_with_logits(logit: Column, target: Column) -> Column:
    """Binary cross entropy on logits in its overflow-free form."""
    t = target.cast("double")
    return F.greatest(logit, F.lit(0.0)) - logit * t + F.log1p(F.exp(-F.abs(logit)))


def normalise_split(label: Column) -> Column:
    """Trim, lower-case and map the short validation label."""
    text = F.lower(F.trim(label.cast("string")))
    return F.when(text == "val", "validation").otherwise(text)
