import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterledger.operators import ranking, reports, statistics
from rasterledger.operators.ordered import (
    exact_quantiles,
    global_row_number,
    hash_rank,
    running_max,
    running_total,
    top_k_per_group,
)


@pytest.fixture(scope="module")
def skewed(spark):
    """Two thirds of the rows in one group, a third of all values equal."""
    return spark.range(900).selectExpr(
        "id", "if(id % 3 < 2, 'hot', cast(id % 5 as string)) as g", "if(id % 3 = 0, 1.0D, (id * 7919 % 1000) / 10.0D) as v"
    ).cache()


def test_row_numbers_are_dense_per_group(skewed):
    rows = global_row_number(skewed, ["v", "id"], groups=["g"], out="r", total_out="n").collect()
    for g in {r["g"] for r in rows}:
        part = sorted((r for r in rows if r["g"] == g), key=lambda r: (r["v"], r["id"]))
        assert [r["r"] for r in part] == list(range(1, len(part) + 1))
        assert {r["n"] for r in part} == {len(part)}


def test_running_total_and_max(skewed):
    rows = running_total(skewed, ["id"], "v", groups=["g"], out="s").collect()
    hot = sorted((r for r in rows if r["g"] == "hot"), key=lambda r: r["id"])
    assert np.allclose([r["s"] for r in hot], np.cumsum([r["v"] for r in hot]))
    rows = running_max(skewed, ["id"], "v", out="m", inclusive=False).orderBy("id").collect()
    expected = [None] + np.maximum.accumulate([r["v"] for r in rows])[:-1].tolist()
    assert [r["m"] for r in rows] == expected


def test_hash_rank_is_a_permutation_and_repeatable(skewed):
    one = {r["id"]: r["k"] for r in hash_rank(skewed, "id", 5, groups=["g"], out="k").collect()}
    two = {r["id"]: r["k"] for r in hash_rank(skewed.repartition(7), "id", 5, groups=["g"], out="k").collect()}
    assert one == two
    groups = {}
    for r in skewed.collect():
        groups.setdefault(r["g"], []).append(one[r["id"]])
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in groups.values())


def test_quantiles_equal_numpy(skewed):
    names = {"a": 0.0, "b": 0.02, "c": 0.5, "d": 0.95, "e": 1.0}
    for row in exact_quantiles(skewed, "v", names, groups=["g"]).collect():
        values = [r["v"] for r in skewed.where(F.col("g") == row["g"]).collect()]
        assert np.allclose([row[n] for n in names], np.quantile(values, list(names.values())))


def test_quantiles_skip_nan_and_null(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "v double")
    assert exact_quantiles(df, "v", {"m": 0.5}).first()["m"] == 2.0


def test_top_k_per_group(skewed):
    rows = top_k_per_group(skewed, ["g"], [F.desc("v"), F.col("id")], 4, spread_on=["id"]).collect()
    for g in {r["g"] for r in rows}:
        whole = sorted((r for r in skewed.collect() if r["g"] == g), key=lambda r: (-r["v"], r["id"]))[:4]
        assert [r["id"] for r in sorted((r for r in rows if r["g"] == g), key=lambda r: r["position"])] == [r["id"] for r in whole]


def differences(spark, values):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "id bigint, difference double")


def test_paired_bootstrap_of_a_constant_gain(spark):
    row = statistics.paired_bootstrap(differences(spark, [0.1] * 4), ["id"], iterations=200).first()
    assert row["improved_fraction"] == 1.0 and row["paired_count"] == 4
    assert row["ci_lower"] == pytest.approx(0.1) and row["ci_upper"] == pytest.approx(0.1)


@pytest.mark.parametrize("method", ["index", "weights"])
def test_bootstrap_interval_has_the_right_width(spark, method):
    values = np.random.default_rng(0).normal(size=400)
    row = statistics.bootstrap_interval(
        differences(spark, values), "difference", ["id"], iterations=800, method=method
    ).first()
    half = 1.96 * values.std() / math.sqrt(len(values))
    assert row["mean"] == pytest.approx(values.mean())
    assert row["ci_upper"] - row["ci_lower"] == pytest.approx(2 * half, rel=0.15)
    assert row["ci_lower"] < values.mean() < row["ci_upper"]


def test_bootstrap_weights_do_not_depend_on_partitions(spark):
    df = differences(spark, range(50))
    one = statistics.bootstrap_means(df, "difference", ["id"], iterations=40, method="weights")
    two = statistics.bootstrap_means(df.repartition(6), "difference", ["id"], iterations=40, method="weights")
    a = {r["iteration"]: r["mean"] for r in one.collect()}
    b = {r["iteration"]: r["mean"] for r in two.collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)


def test_signed_ranks_with_ties(spark):
    values = [0.3, -0.1, 0.1, 0.2, -0.2, 0.2, 0.0, 0.5]
    row = statistics.wilcoxon_paired(differences(spark, values)).first()
    d = np.array([v for v in values if v])
    size = np.abs(d)
    ranks = np.array([(size < s).sum() + ((size == s).sum() + 1) / 2 for s in size])
    up, down = ranks[d > 0].sum(), ranks[d < 0].sum()
    assert (row["positive_rank_sum"], row["negative_rank_sum"]) == (up, down)
    assert row["wilcoxon_statistic"] == min(up, down)
    assert row["rank_biserial_effect"] == pytest.approx((up - down) / (up + down))
    assert up + down == len(d) * (len(d) + 1) / 2


def test_signed_rank_p_values(spark):
    zero = statistics.wilcoxon_paired(differences(spark, [0.0, 0.0])).first()
    assert (zero["wilcoxon_statistic"], zero["wilcoxon_p_value"]) == (0.0, 1.0)
    # Five untied gains: the only arrangement as extreme is the mirrored one.
    assert statistics.exact_p_value(5, 0.0) == pytest.approx(2 / 32)


def test_signed_rank_ties_survive_float_noise(spark):
    row = statistics.wilcoxon_paired(differences(spark, [0.3, 0.1 + 0.2, -0.3, 0.5])).first()
    assert (row["positive_rank_sum"], row["negative_rank_sum"]) == (8.0, 2.0)


def test_published_signed_rank_values(spark):
    # 405 non-zero differences; z close to -6.09 gives the published order of magnitude.
    n = 405
    mean, spread = n * (n + 1) / 4, math.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    columns = [F.lit(float(v)) for v in (n, mean - 6.09 * spread, 0.0)]
    p = spark.range(1).select(statistics.normal_p_value(*columns).alias("p")).first()["p"]
    assert p == pytest.approx(1.13e-9, rel=0.02)
    assert p == pytest.approx(math.erfc(6.09 / math.sqrt(2)), rel=1e-6)


def test_slices_drop_missing_values(spark):
    df = spark.createDataFrame([("x", "s", 1.0), ("x", None, 0.0), ("y", "s", float("nan"))], "a string, b string, iou double")
    found = {(r["slice_dimension"], r["slice_value"]): (r["images"], r["iou"]) for r in statistics.summarize_slices(df, ["a", "b"], ["iou", "dice"]).collect()}
    assert found == {("a", "x"): (2, 0.5), ("a", "y"): (1, None), ("b", "s"): (2, 1.0)}


def early_stop(values, patience):
    best, pos, used = -math.inf, 0, 0
    for i, v in enumerate(values, 1):
        used = i
        if v > best + 1e-8:
            best, pos = v, i
        elif i - pos >= patience:
            break
    return best, pos, used, used - pos >= patience


def test_early_stopping_equals_the_loop(spark):
    rng = np.random.default_rng(3)
    runs = {f"r{i}": rng.random(int(rng.integers(1, 15))).round(1) for i in range(25)}
    runs["flat"] = np.full(6, 0.5)
    runs["creep"] = 0.5 + np.arange(8) * 6e-9  # gains below the margin add up
    runs["slow"] = 0.5 + np.arange(30) * 2e-9
    runs["steps"] = np.repeat(np.arange(6) * 0.1, [1, 2, 3, 4, 5, 6])
    runs["late"] = np.r_[0.5, 0.1, 0.1, 0.1, 0.9]
    rows = [(k, e, float(v)) for k, values in runs.items() for e, v in enumerate(values)]
    history = spark.createDataFrame(rows, "run string, epoch bigint, v double")
    for r in ranking.early_stopping(history, "run", "epoch", "v", 3).collect():
        best, pos, used, stopped = early_stop(runs[r["run"]], 3)
        assert (r["best_position"], r["epochs_run"], r["stopped_early"]) == (pos, used, stopped), r["run"]
        assert r["best_value"] == best and r["best_epoch"] == pos - 1


def test_early_stopping_goes_on_from_earlier_results(spark):
    rng = np.random.default_rng(4)
    runs = {f"r{i}": rng.random(24).round(1) + 3e-9 * np.arange(24) for i in range(12)}
    schema = "run string, epoch bigint, v double"
    state = None
    for part in range(4):
        rows = [(k, e, float(v)) for k, values in runs.items() for e, v in list(enumerate(values))[part * 6 : part * 6 + 6] if part < 3 or k != "r5"]
        state = ranking.early_stopping(spark.createDataFrame(rows, schema), "run", "epoch", "v", 4, state=state)
    found = {r["run"]: (r["best_value"], r["best_position"], r["epochs_run"], r["stopped_early"]) for r in state.collect()}
    assert found == {k: early_stop(values[: 18 if k == "r5" else 24], 4) for k, values in runs.items()}


def test_a_long_rising_run_needs_no_array(spark):
    """Every epoch improves: each is a section of its own, and one run spreads over tasks."""
    history = spark.range(300_000).selectExpr("'a' as run", "id as epoch", "id / 1000.0d as v").unionByName(
        spark.range(5).selectExpr("'a' as run", "300000 + id as epoch", "0.0d as v")
    )
    row = ranking.early_stopping(history, "run", "epoch", "v", 3).first()
    assert (row["best_epoch"], row["best_position"], row["epochs_run"], row["stopped_early"]) == (299_999, 300_000, 300_003, True)


def test_unique_configurations(spark):
    rows = [(0, 0.9, "COMPLETE", {"a": "1"}), (1, 0.9, "COMPLETE", {"a": "1"}), (2, 0.8, "COMPLETE", {"a": "2"}), (3, 0.99, "FAIL", {"a": "3"}), (4, 0.7, "COMPLETE", {"a": "0"})]
    trials = spark.createDataFrame(rows, "number bigint, value double, state string, params map<string,string>")
    top = ranking.top_unique_configurations(trials, 3, F.lit('{"a":"0"}'))
    assert [(r["label"], r["number"]) for r in top.orderBy("label").collect()] == [("optuna_rank_1", 0), ("optuna_rank_2", 2)]
    with pytest.raises(RuntimeError):
        ranking.require_configurations(top, 3)


def test_stability_of_one_run_has_no_spread(spark):
    row = reports.seed_stability(spark.createDataFrame([(0.7,)], "v double"), "v").first()
    assert row["std"] == 0.0


def test_latency_percentiles_interpolate(spark):
    df = spark.createDataFrame([(float(v),) for v in (10, 20, 30, 40)], "ms double")
    row = reports.latency_summary(df, "ms").first()
    assert row["p50_ms"] == 25.0 and row["p95_ms"] == pytest.approx(38.5)
    assert row["throughput_per_second"] == pytest.approx(40.0)
