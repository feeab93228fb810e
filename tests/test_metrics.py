import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterledger.functions.metrics import (
    RATIO_METRICS,
    meter_metrics,
    per_image_metrics,
    presence_columns,
)
from rasterledger.operators import calibration as cal
from rasterledger.operators import confusion as con
from rasterledger.operators import losses


def counts(spark, *rows):
    return spark.createDataFrame(list(rows), "tp bigint, fp bigint, fn bigint, tn bigint")


def test_perfect_counts_give_ones(spark):
    row = counts(spark, (10, 0, 0, 20)).select(*meter_metrics()).first()
    assert all(row[m] == pytest.approx(1.0) for m in RATIO_METRICS)


def test_two_by_two_mask_has_full_overlap(spark):
    pixels = spark.createDataFrame(
        [("a", 0.1, 0), ("a", 0.9, 1), ("a", 0.8, 1), ("a", 0.2, 0)], "image_id string, prob double, target int"
    )
    found = con.confusion_counts(pixels, ["image_id"], F.col("prob") >= 0.5, F.col("target"))
    row = found.select("*", *per_image_metrics()).first()
    assert row["iou"] == 1.0 and row["tp"] == 2
    assert cal.meter_calibration(pixels).first()["brier_score"] < 0.05


@pytest.mark.parametrize("policy,expected", [("perfect_if_both_empty", 1.0), ("zero_if_undefined", 0.0)])
def test_empty_masks_follow_the_policy(spark, policy, expected):
    row = counts(spark, (0, 0, 0, 16)).select(*per_image_metrics(policy), *presence_columns()).first()
    assert [row[m] for m in ("iou", "dice", "precision", "recall")] == [expected] * 4
    assert row["specificity"] == row["pixel_accuracy"] == row["cohen_kappa"] == 1.0
    assert row["mcc"] == 0.0 and row["empty_correct"]


def test_single_false_positive_on_empty_target(spark):
    row = counts(spark, (0, 1, 0, 15)).select(*per_image_metrics(), *presence_columns()).first()
    assert row["iou"] == 0.0 and row["empty_false_positive"] and not row["empty_correct"]


def test_meter_rules_differ_from_policy_rules(spark):
    row = counts(spark, (0, 0, 0, 16)).select(*meter_metrics()).first()
    assert row["precision"] == row["iou"] == 1.0 and row["cohen_kappa"] == 0.0
    missed = counts(spark, (0, 0, 4, 12)).select(*meter_metrics()).first()
    assert missed["precision"] == 0.0 and missed["recall"] == 0.0


def test_large_counts_do_not_overflow(spark):
    n = 3_000_000_000
    row = counts(spark, (n, n, n, n)).select(*per_image_metrics()).first()
    assert row["mcc"] == pytest.approx(0.0) and row["iou"] == pytest.approx(1 / 3)


def test_unknown_policy_is_rejected():
    with pytest.raises(ValueError):
        per_image_metrics("other")


def test_shape_mismatch_raises(spark):
    a = spark.createDataFrame([("a", 0, 0, 1), ("a", 0, 1, 1)], "image_id string, y int, x int, p int")
    b = spark.createDataFrame([("a", 0, 0, 1)], "image_id string, y int, x int, t int")
    with pytest.raises(ValueError, match="Shape mismatch"):
        con.pair_pixels(a, b)
    assert con.shape_mismatches(a.drop("p"), b.drop("t")).first()["prediction_only"] == 1


def test_macro_summary_skips_nan_and_keeps_null_keys(spark):
    rows = spark.createDataFrame(
        [("a", 0.5, float("nan")), ("a", 1.0, 3.0), (None, 0.25, 1.0)], "split string, iou double, hd95 double"
    )
    found = {r["split"]: r for r in con.macro_summary(rows, ["split"]).collect()}
    assert found["a"]["hd95"] == 3.0 and found["a"]["iou"] == 0.75
    assert found[None]["images"] == 1


def reliability_reference(p, t, bins):
    edges = np.linspace(0, 1, bins + 1)
    out = []
    for i in range(bins):
        inside = (p >= edges[i]) & ((p <= edges[i + 1]) if i == bins - 1 else (p < edges[i + 1]))
        out.append(int(inside.sum()))
    return out


@pytest.mark.parametrize("p", [[0.1, 0.9, 0.2, 0.8], [0.0, 0.2, 0.6, 1.0]])
def test_reliability_counts(spark, p):
    t = [0, 1, 0, 1]
    pixels = spark.createDataFrame(list(zip(p, t)), "prob double, target int")
    rows = cal.reliability_table(pixels, bins=4).orderBy("bin_index").collect()
    assert [r["pixel_count"] for r in rows] == reliability_reference(np.array(p), np.array(t), 4)
    assert sum(r["pixel_count"] for r in rows) == 4
    assert sum(r["pixel_fraction"] for r in rows) == pytest.approx(1.0)


def test_reliability_needs_two_bins(spark):
    pixels = spark.createDataFrame([(0.5, 1)], "prob double, target int")
    with pytest.raises(ValueError):
        cal.reliability_table(pixels, bins=1)


def test_histogram_sweep_equals_per_threshold_counting(spark):
    rng = np.random.default_rng(0)
    p, t = rng.random(500).round(2), rng.integers(0, 2, 500)
    pixels = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, t)], "prob double, target int")
    for grid in (cal.stepped_thresholds(), cal.spaced_thresholds()):
        for r in cal.sweep_counts(pixels, grid).collect():
            predicted = p >= r["threshold"]
            assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (
                int((predicted & (t == 1)).sum()),
                int((predicted & (t == 0)).sum()),
                int((~predicted & (t == 1)).sum()),
                int((~predicted & (t == 0)).sum()),
            )


def test_threshold_grids():
    assert cal.stepped_thresholds() == [round(x, 4) for x in np.arange(0.10, 0.90 + 1e-9, 0.05)]
    assert len(cal.stepped_thresholds()) == 17
    assert np.allclose(cal.spaced_thresholds(), np.linspace(0.1, 0.9, 17), atol=0, rtol=1e-15)


def test_best_threshold_prefers_dice_then_the_lowest(spark):
    sweep = spark.createDataFrame(
        [(0.3, 0.8, 0.7), (0.4, 0.8, 0.9), (0.5, 0.8, 0.9), (0.6, 0.1, 0.99)],
        "threshold double, iou double, dice double",
    )
    assert cal.best_threshold(sweep).first()["threshold"] == 0.4
    assert cal.best_by_metric(sweep, "iou").first()["threshold"] == 0.3


def test_curves_match_numpy(spark):
    rng = np.random.default_rng(1)
    p = rng.random(800)
    t = (rng.random(800) < p).astype(int)
    pixels = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, t)], "prob double, target int")
    row = cal.area_under_curves(cal.ranking_curve(pixels)).first()
    index = np.minimum((p * 512).astype(int), 511)
    tp = np.cumsum(np.bincount(index[t == 1], minlength=512)[::-1])
    fp = np.cumsum(np.bincount(index[t == 0], minlength=512)[::-1])
    assert row["auroc_hist"] == pytest.approx(np.trapezoid(tp / tp[-1], fp / fp[-1]))
    assert row["auprc_hist"] == pytest.approx(np.trapezoid(tp / np.maximum(tp + fp, 1), tp / tp[-1]))


def test_ignored_labels_leave_the_loss(spark):
    pixels = spark.createDataFrame(
        [("a", 2.0, 1), ("a", -1.0, 0), ("a", 5.0, 255), ("b", 0.5, 0)], "image_id string, logit double, label int"
    )
    row = losses.cross_entropy_dice_audit(pixels, ce_weight=0.6, dice_weight=0.4).first()
    sig = lambda z: 1 / (1 + math.exp(-z))
    ce = (-math.log(sig(2)) - math.log(1 - sig(-1)) - math.log(1 - sig(0.5))) / 3
    a = (2 * sig(2) + 1e-6) / (sig(2) + sig(-1) + 1 + 1e-6)
    b = 1e-6 / (sig(0.5) + 1e-6)
    assert row["valid_pixels"] == 3
    assert row["cross_entropy"] == pytest.approx(ce)
    assert row["dice_loss"] == pytest.approx(1 - (a + b) / 2)
    assert row["loss"] == pytest.approx(0.6 * ce + 0.4 * (1 - (a + b) / 2))
