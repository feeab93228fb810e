"""Overview tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rasterledger.operators.ordered import exact_quantiles


def dataset_summary(manifest: DataFrame, fraction: str = "water_fraction") -> DataFrame:
    """(metric, value) rows on sizes and coverage."""
    one = F.lit(1)
    plain = manifest.agg(
        F.count(one).alias("pairs"),
        F.min("width").alias("minimum width"),
        F.max("width").alias("maximum width"),
        F.min("height").alias("minimum height"),
        F.max("height").alias("maximum height"),
        F.count_if(F.col(fraction) == 0).alias("empty masks"),
        F.count_if(F.col(fraction) >= 0.75).alias("images above 75%"),
    ).withColumn("_one", one)
    median = exact_quantiles(manifest, fraction, {"median fraction": 0.5}).withColumn("_one", one)
    wide = plain.join(median, "_one").drop("_one")
    fields = [F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").cast("double").alias("value")) for c in wide.columns]
    return wide.select(F.explode(F.array(*fields)).alias("_f")).select("_f.*")


def split_overview(manifest: DataFrame, fraction: str = "water_fraction") -> DataFrame:
    """Images, mean fraction and empty masks per split, with a total row."""
    return (
        manifest.rollup("split")
        .agg(
            F.count(F.lit(1)).alias("images"),
            F.avg(fraction).alias("mean_fraction"),
            F.count_if(F.col(fraction) == 0).alias("empty_masks"),
            F.grouping("split").alias("_total"),
        )
        .select(
            F.when(F.col("_total") == 1, "total").otherwise(F.col("split")).alias("split"),
            "images",
            "mean_fraction",
            "empty_masks",
        )
    )


def shape_counts(manifest: DataFrame) -> DataFrame:
    """Number of images of every size."""
    return manifest.groupBy("height", "width").agg(F.count(F.lit(1)).alias("images"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("rows"))


def prompt_summary(runs: DataFrame, mode: str, score: str = "iou") -> DataFrame:
    """Row count, mean and median score per mode, best mean first."""
    means = runs.groupBy(mode).agg(F.count(F.lit(1)).alias("images"), F.avg(score).alias(f"mean_{score}"))
    medians = exact_quantiles(runs, score, {f"median_{score}": 0.5}, groups=[mode])
    return means.join(medians, mode).orderBy(F.desc(f"mean_{score}"), mode)


def seed_stability(runs: DataFrame, score: str, groups: Sequence[str] = ()) -> DataFrame:
    """Mean, sample deviation (0 for one run), minimum and maximum."""
    return runs.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("runs"),
        F.avg(score).alias("mean"),
        F.coalesce(F.stddev_samp(score), F.lit(0.0)).alias("std"),
        F.min(score).alias("minimum"),
        F.max(score).alias("maximum"),
    )


def epoch_summary(
    steps: DataFrame, keys: Sequence[str], means: Sequence[str], *, examples: str, seconds: str
) -> DataFrame:
    """Means of step measures per epoch and examples per second."""
    return steps.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("optimizer_steps"),
        *[F.coalesce(F.avg(m), F.lit(0.0)).alias(f"{m}_mean") for m in means],
        F.sum(examples).alias("examples_seen"),
        (F.sum(examples) / F.greatest(F.sum(seconds), F.lit(1e-9))).alias("examples_per_second"),
    )


def latency_summary(log: DataFrame, latency: str, groups: Sequence[str] = ()) -> DataFrame:
    """Exact p50 and p95, mean, and throughput in requests per second."""
    one = [] if groups else [F.lit(1).alias("_one")]
    quantiles = exact_quantiles(log, latency, {"p50_ms": 0.5, "p95_ms": 0.95}, groups=groups)
    means = log.groupBy(*groups).agg(
        F.count(latency).alias("requests"), F.avg(latency).alias("mean_ms")
    ).withColumn("throughput_per_second", F.when(F.col("mean_ms") != 0, 1000.0 / F.col("mean_ms")))
    if groups:
        return means.join(quantiles, list(groups))
    return means.select("*", *one).join(quantiles.select("*", *one), "_one").drop("_one")


def best_trial(trials: DataFrame, details: Sequence[str] = ()) -> DataFrame:
    """Counts by state with the best completed trial; the lowest number wins a tie."""
    done = F.col("state") == "COMPLETE"
    score: Column = F.when(done, F.struct("value", -F.col("number")))
    best = F.max_by(F.struct("number", "value", *details), score)
    return trials.agg(
        F.count_if(done).alias("completed_trials"),
        F.count(F.lit(1)).alias("attempted_trials"),
        F.count_if(F.col("state") == "PRUNED").alias("pruned_trials"),
        F.count_if(F.col("state") == "FAIL").alias("failed_trials"),
        best.alias("_best"),
    ).select(
        "completed_trials",
        "attempted_trials",
        "pruned_trials",
        "failed_trials",
        F.col("_best.number").alias("best_trial"),
        F.col("_best.value").alias("best_value"),
        *[F.col(f"_best.{d}").alias(f"best_{d}") for d in details],
    )


def distinct_per_key(df: DataFrame, key: str, value: str) -> DataFrame:
    """Exact number of distinct values; pairs collapse before they meet by key."""
    return df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.lit(1).alias("_x")).groupBy(key).agg(
        F.count(F.lit(1)).alias("distinct_values")
    )
