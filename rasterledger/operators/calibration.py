"""Threshold sweeps, reliability tables and ranking curves from histograms.

Pixels are counted once per cell; every threshold, bin or curve point is then
derived from a handful of counts, so the work does not grow with the number of
thresholds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from rasterledger.functions.metrics import meter_metrics, per_image_metrics
from rasterledger.functions.scalars import clip, ratio


def stepped_thresholds(low: float = 0.10, high: float = 0.90, step: float = 0.05) -> list[float]:
    """Grid rounded to four digits."""
    count = int((high + 1e-9 - low) / step) + 1
    return [round(low + i * step, 4) for i in range(count)]


def spaced_thresholds(low: float = 0.1, high: float = 0.9, count: int = 17) -> list[float]:
    """Evenly spaced grid without rounding."""
    step = (high - low) / (count - 1)
    return [low + i * step for i in range(count - 1)] + [high]


def unit_edges(bins: int) -> list[float]:
    """Bin edges on [0, 1], last edge exactly 1."""
    return [i * (1.0 / bins) for i in range(bins)] + [1.0]


def cells_reached(value: Column, limits: Sequence[float]) -> Column:
    """How many of the ascending limits are <= value."""
    hits = [(value >= F.lit(float(limit))).cast("int") for limit in limits]
    total = hits[0]
    for hit in hits[1:]:
        total = total + hit
    return total


def sweep_counts(
    pixels: DataFrame,
    thresholds: Sequence[float],
    groups: Sequence[str] = (),
    *,
    prob: str = "prob",
    target: str = "target",
) -> DataFrame:
    """tp, fp, fn, tn for every threshold and group."""
    ordered = sorted(float(t) for t in thresholds)
    cells = pixels.groupBy(*groups, cells_reached(F.col(prob), ordered).alias("_cell")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.col(target).cast("bigint")).alias("_pos")
    )
    # At most one entry per threshold, plus one.
    packed = cells.groupBy(*groups).agg(
        F.map_from_entries(F.collect_list(F.struct("_cell", F.struct("_n", "_pos")))).alias("_cells")
    )
    filled = packed.select(
        *groups, "_cells", F.explode(F.sequence(F.lit(0), F.lit(len(ordered)))).alias("_cell")
    ).withColumn("_c", F.try_element_at("_cells", "_cell"))
    filled = filled.select(
        *groups,
        "_cell",
        F.coalesce(F.col("_c._pos"), F.lit(0)).alias("_pos"),
        (F.coalesce(F.col("_c._n"), F.lit(0)) - F.coalesce(F.col("_c._pos"), F.lit(0))).alias("_neg"),
    )
    whole = Window.partitionBy(*groups)
    above = whole.orderBy(F.desc("_cell")).rowsBetween(Window.unboundedPreceding, 0)
    counted = filled.select(
        *groups,
        "_cell",
        F.sum("_pos").over(above).alias("tp"),
        F.sum("_neg").over(above).alias("fp"),
        F.sum("_pos").over(whole).alias("_all_pos"),
        F.sum("_neg").over(whole).alias("_all_neg"),
    ).where("_cell > 0")
    limits = F.array(*[F.lit(t) for t in ordered])
    return counted.select(
        *groups,
        F.element_at(limits, F.col("_cell")).alias("threshold"),
        "tp",
        "fp",
        (F.col("_all_pos") - F.col("tp")).alias("fn"),
        (F.col("_all_neg") - F.col("fp")).alias("tn"),
    )


def macro_sweep(
    pixels: DataFrame,
    thresholds: Sequence[float],
    *,
    image: str = "image_id",
    empty_policy: str = "perfect_if_both_empty",
) -> DataFrame:
    """Mean per-image IoU, Dice, precision and recall per threshold."""
    per_image = sweep_counts(pixels, thresholds, [image]).select(
        "threshold", *per_image_metrics(empty_policy)
    )
    return per_image.groupBy("threshold").agg(
        *[F.avg(m).alias(m) for m in ("iou", "dice", "precision", "recall")],
        F.count(F.lit(1)).alias("images"),
        F.lit(False).alias("test_split_used"),
    )


def pooled_sweep(
    pixels: DataFrame, thresholds: Sequence[float], groups: Sequence[str] = ()
) -> DataFrame:
    """Meter ratios of the pooled counts per threshold."""
    return sweep_counts(pixels, thresholds, groups).select(*groups, "threshold", *meter_metrics())


def best_threshold(sweep: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Highest IoU, then Dice, then the lowest threshold."""
    order = F.struct("iou", "dice", -F.col("threshold"))
    best = sweep.groupBy(*groups).agg(
        F.max_by(F.struct("threshold", "iou", "dice"), order).alias("_best")
    )
    return best.select(*groups, "_best.*")


def best_by_metric(sweep: DataFrame, metric: str = "iou", groups: Sequence[str] = ()) -> DataFrame:
    """Sweep row with the highest metric; the lowest threshold wins a tie."""
    kept = [c for c in sweep.columns if c not in groups]
    best = sweep.groupBy(*groups).agg(
        F.max_by(F.struct(*kept), F.struct(metric, -F.col("threshold"))).alias("_best")
    )
    return best.select(*groups, "_best.*")


def threshold_map(sweep: DataFrame, mode: str, metric: str = "iou") -> DataFrame:
    """One map from mode to its best threshold. There are as many entries as modes."""
    best = best_by_metric(sweep, metric, [mode])
    entries = F.array_sort(F.collect_list(F.struct(mode, "threshold")))
    return best.agg(F.map_from_entries(entries).alias("thresholds"))


def _binned(
    pixels: DataFrame, bin_index: Column, groups: Sequence[str], prob: str, target: str
) -> DataFrame:
    p, t = clip(F.col(prob).cast("double"), 0.0, 1.0), F.col(target).cast("double")
    entropy = -(
        p * F.log(clip(p, 1e-12, 1.0)) + (1.0 - p) * F.log(clip(1.0 - p, 1e-12, 1.0))
    )
    return pixels.groupBy(*groups, bin_index.alias("bin_index")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(p).alias("sum_p"),
        F.sum(t).alias("sum_t"),
        F.sum(F.pow(p - t, F.lit(2.0))).alias("sum_sq"),
        F.sum(entropy).alias("sum_entropy"),
        F.count_if((p >= 0.4) & (p <= 0.6)).alias("n_low"),
    )


def _edge_bin(prob: str, bins: int) -> Column:
    # Half-open bins, the last one closed: only the inner edges are compared.
    return cells_reached(clip(F.col(prob).cast("double"), 0.0, 1.0), unit_edges(bins)[1:-1])


def with_overall(binned: DataFrame, group: str, label: str = "overall") -> DataFrame:
    """Repeat every bin row under the overall label and merge equal bins."""
    both = binned.withColumn(group, F.explode(F.array(F.col(group), F.lit(label))))
    sums = ("n", "sum_p", "sum_t", "sum_sq", "sum_entropy", "n_low")
    return both.groupBy(group, "bin_index").agg(*[F.sum(c).alias(c) for c in sums])


def reliability_table(
    pixels: DataFrame,
    *,
    bins: int = 15,
    split: str | None = None,
    prob: str = "prob",
    target: str = "target",
) -> DataFrame:
    """Reliability rows for every bin, empty bins included, per split and overall."""
    if bins <= 1:
        raise ValueError("bins must be greater than one")
    groups = [split] if split else []
    binned = _binned(pixels, _edge_bin(prob, bins), groups, prob, target)
    if split:
        binned = with_overall(binned, split)
    edges = unit_edges(bins)
    stats = F.map_from_entries(F.collect_list(F.struct("bin_index", F.struct("n", "sum_p", "sum_t"))))
    packed = binned.groupBy(*groups).agg(stats.alias("_bins"), F.sum("n").alias("_total"))
    rows = packed.select(
        *groups, "_bins", "_total", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin_index")
    ).withColumn("_cell", F.try_element_at("_bins", "bin_index"))
    count = F.coalesce(F.col("_cell.n"), F.lit(0)).cast("bigint")
    confidence = F.col("_cell.sum_p") / F.col("_cell.n")
    frequency = F.col("_cell.sum_t") / F.col("_cell.n")
    bounds = F.array(*[F.lit(e) for e in edges])
    return rows.select(
        *groups,
        "bin_index",
        F.element_at(bounds, F.col("bin_index") + 1).alias("lower_bound"),
        F.element_at(bounds, F.col("bin_index") + 2).alias("upper_bound"),
        count.alias("pixel_count"),
        (count / F.col("_total")).alias("pixel_fraction"),
        confidence.alias("mean_confidence"),
        frequency.alias("empirical_frequency"),
        F.abs(confidence - frequency).alias("absolute_calibration_gap"),
    )


def calibration_metrics(
    pixels: DataFrame,
    *,
    bins: int = 15,
    split: str | None = None,
    prob: str = "prob",
    target: str = "target",
) -> DataFrame:
    """Brier score, calibration error, entropy and low-confidence share."""
    groups = [split] if split else []
    binned = _binned(pixels, _edge_bin(prob, bins), groups, prob, target)
    if split:
        binned = with_overall(binned, split)
    total = F.sum("n")
    return binned.groupBy(*groups).agg(
        total.alias("sampled_pixels"),
        (F.sum("sum_sq") / total).alias("brier_score"),
        (F.sum(F.abs(F.col("sum_p") - F.col("sum_t"))) / total).alias("expected_calibration_error"),
        (F.sum("sum_entropy") / total).alias("mean_predictive_entropy"),
        (F.sum("n_low") / total).alias("low_confidence_fraction"),
    )


def _floor_bin(prob: str, bins: int) -> Column:
    p = clip(F.col(prob).cast("double"), 0.0, 1.0)
    return F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int")


def meter_calibration(
    pixels: DataFrame, *, bins: int = 20, prob: str = "prob", target: str = "target"
) -> DataFrame:
    """Count-weighted calibration error and Brier score with floor bins."""
    binned = _binned(pixels, _floor_bin(prob, bins), [], prob, target)
    total = F.sum("n")
    return binned.agg(
        total.alias("pixels"),
        ratio(F.sum(F.abs(F.col("sum_p") - F.col("sum_t"))), total, 0.0).alias("ece"),
        ratio(F.sum("sum_sq"), total, 0.0).alias("brier_score"),
    )


def ranking_curve(
    pixels: DataFrame,
    groups: Sequence[str] = (),
    *,
    bins: int = 512,
    prob: str = "prob",
    target: str = "target",
) -> DataFrame:
    """Cumulative true and false positives per score bin, highest score first."""
    counted = pixels.groupBy(*groups, _floor_bin(prob, bins).alias("bin_index")).agg(
        F.count_if(F.col(target) == 1).alias("pos"), F.count_if(F.col(target) == 0).alias("neg")
    )
    packed = counted.groupBy(*groups).agg(
        F.map_from_entries(F.collect_list(F.struct("bin_index", F.struct("pos", "neg")))).alias("_bins")
    )
    filled = packed.select(
        *groups, "_bins", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin_index")
    ).withColumn("_cell", F.try_element_at("_bins", "bin_index"))
    down = Window.partitionBy(*groups).orderBy(F.desc("bin_index")).rowsBetween(
        Window.unboundedPreceding, 0
    )
    whole = Window.partitionBy(*groups)
    return (
        filled.select(
            *groups,
            "bin_index",
            F.coalesce(F.col("_cell.pos"), F.lit(0)).alias("pos"),
            F.coalesce(F.col("_cell.neg"), F.lit(0)).alias("neg"),
        )
        .withColumn("tp", F.sum("pos").over(down))
        .withColumn("fp", F.sum("neg").over(down))
        .withColumn("positives", F.greatest(F.sum("pos").over(whole), F.lit(1)))
        .withColumn("negatives", F.greatest(F.sum("neg").over(whole), F.lit(1)))
        .select(
            *groups,
            "bin_index",
            "tp",
            "fp",
            (F.col("tp") / F.col("positives")).alias("recall"),
            (F.col("fp") / F.col("negatives")).alias("false_positive_rate"),
            (F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1))).alias("precision"),
        )
    )


def area_under_curves(curve: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Trapezoid areas that start at the first curve point, not at the origin."""
    down = Window.partitionBy(*groups).orderBy(F.desc("bin_index"))

    def trapezoid(height: str, base: str) -> Column:
        step = F.col(base) - F.lag(base).over(down)
        return step * (F.col(height) + F.lag(height).over(down)) / 2.0

    pieces = curve.select(
        *groups,
        trapezoid("recall", "false_positive_rate").alias("_roc"),
        trapezoid("precision", "recall").alias("_pr"),
    )
    return pieces.groupBy(*groups).agg(
        F.sum("_roc").alias("auroc_hist"), F.sum("_pr").alias("auprc_hist")
    )


def area_error(results: DataFrame) -> DataFrame:
    """Predicted minus target fraction with its absolute value."""
    error = F.col("predicted_fraction") - F.col("target_fraction")
    return results.withColumn("fraction_error", error).withColumn(
        "absolute_area_error", F.abs(error)
    )
