"""Paired statistics, bootstrap intervals and slice summaries."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, LongType, StructType

from rasterledger.functions.scalars import nan_to_null
from rasterledger.operators.checks import available
from rasterledger.operators.ordered import exact_quantiles, global_row_number, running_total
from rasterledger.session import pin

# Value tables up to this many rows may be sent to every task.
BROADCAST_ROWS = 200_000
DRAWS_PER_DIGEST = 8


def _join_groups(left: DataFrame, right: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Join two per-group tables; without groups both have one row."""
    if groups:
        return left.join(right, list(groups))
    return left.withColumn("_one", F.lit(1)).join(right.withColumn("_one", F.lit(1)), "_one").drop("_one")


def with_difference(paired: DataFrame, current: str, reference: str) -> DataFrame:
    return paired.withColumn("difference", F.col(current) - F.col(reference))


def difference_summary(
    differences: DataFrame, groups: Sequence[str] = (), value: str = "difference"
) -> DataFrame:
    """Count, mean, median and the shares of improved, degraded and unchanged pairs."""
    d = F.col(value)

    def share(condition: Column) -> Column:
        return F.avg(F.when(condition, 1.0).otherwise(0.0))

    plain = differences.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("paired_count"),
        F.avg(d).alias("mean_difference"),
        share(d > 0).alias("improved_fraction"),
        share(d < 0).alias("degraded_fraction"),
        share(d == 0).alias("unchanged_fraction"),
    )
    median = exact_quantiles(differences, value, {"median_difference": 0.5}, groups=groups)
    return _join_groups(plain, median, groups)


def _spread(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Even out rows before each of them fans out into thousands of draws.

    The partition number is given explicitly, otherwise few input bytes would be
    merged into one task.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _index_means(
    rows: DataFrame,
    value: str,
    keys: Sequence[str],
    groups: Sequence[str],
    iterations: int,
    seed: int,
    size: int,
) -> DataFrame:
    numbered = pin(
        global_row_number(rows, keys, groups=groups, out="_pos", total_out="_n").select(
            *groups, (F.col("_pos") - 1).alias("_idx"), "_n", F.col(value).alias("_v")
        )
    )
    blocks = math.ceil(iterations / DRAWS_PER_DIGEST)
    # One digest gives eight 32-bit draws, for eight iterations of one slot.
    digests = _spread(numbered, ["_idx"]).select(
        *groups, "_n", "_idx", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block")
    ).withColumn("_hex", F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("_block"), F.col("_idx")), 256))
    draws = digests.select(
        *groups,
        "_n",
        "_block",
        F.posexplode(
            F.array(*[F.substring("_hex", 8 * i + 1, 8) for i in range(DRAWS_PER_DIGEST)])
        ).alias("_lane", "_draw"),
    ).select(
        *groups,
        (F.col("_block") * DRAWS_PER_DIGEST + F.col("_lane")).alias("iteration"),
        (F.conv("_draw", 16, 10).cast("bigint") % F.col("_n")).alias("_idx"),
    )
    drawn = draws.where(F.col("iteration") < iterations)
    values = numbered.select(*groups, "_idx", "_v")
    if size <= BROADCAST_ROWS:
        values = F.broadcast(values)
    return (
        drawn.join(values, [*groups, "_idx"])
        .groupBy(*groups, "iteration")
        .agg(F.avg("_v").alias("mean"))
    )


def _poisson_limits() -> np.ndarray:
    """Upper limits of the Poisson(1) counts 0, 1, 2, ... on the 64-bit scale."""
    limits, mass, upto = [], math.exp(-1.0), 0.0
    for k in range(18):
        upto += mass
        mass /= k + 1
        limits.append(min(int(upto * 2.0**64), 2**64 - 1))
    return np.array(limits, dtype=np.uint64)


def _mix(bits: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit mixing hash."""
    bits = (bits ^ (bits >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    bits = (bits ^ (bits >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return bits ^ (bits >> np.uint64(31))


def poisson_counts(keys: np.ndarray, iterations: int, seed: int) -> np.ndarray:
    """(row, iteration) matrix of Poisson(1) counts that depend on key, iteration and seed only."""
    steps = np.arange(1, iterations + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    lanes = _mix(steps + np.uint64(seed))
    draws = _mix(_mix(keys.astype(np.uint64))[:, None] ^ lanes[None, :])
    limits = _poisson_limits()
    counts = np.zeros(draws.shape, dtype=np.float64)
    for limit in limits[:5]:
        counts += draws >= limit
    rare = draws >= limits[5]
    counts[rare] = np.searchsorted(limits, draws[rare], side="right")
    return counts


def _partial_sums(groups: list[str], iterations: int, seed: int, block: int = 64, held: int = 200):
    def flush(sums: dict) -> Iterator[pd.DataFrame]:
        for key, (weighted, weight) in sums.items():
            out = pd.DataFrame({"iteration": np.arange(iterations), "_wv": weighted, "_w": weight})
            for name, value in zip(groups, key):
                out[name] = value
            yield out[[*groups, "iteration", "_wv", "_w"]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for batch in batches:
            parts = batch.groupby(groups, dropna=False, sort=False) if groups else [((), batch)]
            for key, rows in parts:
                if key not in sums:
                    if len(sums) >= held:
                        yield from flush(sums)
                        sums = {}
                    sums[key] = (np.zeros(iterations), np.zeros(iterations))
                weighted, weight = sums[key]
                ids = rows["_key"].to_numpy().astype(np.int64).view(np.uint64)
                values = rows["_v"].to_numpy(dtype=np.float64)
                for start in range(0, len(ids), block):
                    counts = poisson_counts(ids[start : start + block], iterations, seed)
                    weighted += values[start : start + block] @ counts
                    weight += counts.sum(axis=0)
        yield from flush(sums)

    return run


def row_key(keys: Sequence[str]) -> Column:
    """The first 60 bits of the SHA-256 of the keys joined by colons."""
    digest = F.sha2(F.concat_ws(":", *[F.col(k).cast("string") for k in keys]), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def _weight_means(
    rows: DataFrame, value: str, keys: Sequence[str], groups: Sequence[str], iterations: int, seed: int
) -> DataFrame:
    keyed = _spread(rows, keys).select(
        *groups, row_key(keys).alias("_key"), F.col(value).cast("double").alias("_v")
    )
    fields = [keyed.schema[g] for g in groups]
    schema = StructType(fields).add("iteration", LongType()).add("_wv", DoubleType()).add("_w", DoubleType())
    partial = keyed.mapInPandas(_partial_sums(list(groups), iterations, seed), schema)
    return (
        partial.groupBy(*groups, "iteration")
        .agg(F.sum("_wv").alias("_wv"), F.sum("_w").alias("_w"))
        .where("_w > 0")
        .select(*groups, "iteration", (F.col("_wv") / F.col("_w")).alias("mean"))
    )


def bootstrap_means(
    rows: DataFrame,
    value: str,
    keys: Sequence[str],
    *,
    groups: Sequence[str] = (),
    iterations: int,
    seed: int = 42,
    method: str = "weights",
) -> DataFrame:
    """Mean of every bootstrap resample. ``keys`` identify a row inside its group.

    "weights" gives every row a Poisson(1) count per iteration: each task adds up
    whole blocks of rows and hands on one partial sum per iteration. "index" draws n
    rows with replacement per iteration, as textbook resampling does, and moves every
    draw. The method is the caller's choice and never depends on the number of rows.
    """
    clean = rows.where(F.col(value).isNotNull())
    if method == "index":
        return _index_means(clean, value, keys, groups, iterations, seed, clean.count())
    if method == "weights":
        return _weight_means(clean, value, [k for k in keys if k not in groups], groups, iterations, seed)
    raise ValueError(f"Unknown bootstrap method: {method}")


def bootstrap_interval(
    rows: DataFrame,
    value: str,
    keys: Sequence[str],
    *,
    groups: Sequence[str] = (),
    iterations: int = 2000,
    confidence: float = 0.95,
    seed: int = 42,
    method: str = "weights",
) -> DataFrame:
    """Mean with its percentile interval per group; no rows give no interval."""
    tail = (1.0 - confidence) / 2.0
    means = bootstrap_means(
        rows, value, keys, groups=groups, iterations=iterations, seed=seed, method=method
    )
    # The percentile state holds one number per iteration.
    limits = means.groupBy(*groups).agg(
        F.percentile("mean", F.lit(tail)).alias("ci_lower"),
        F.percentile("mean", F.lit(1.0 - tail)).alias("ci_upper"),
    )
    centre = rows.groupBy(*groups).agg(F.avg(value).alias("mean"))
    return _join_groups(centre, limits, groups)


def paired_bootstrap(
    differences: DataFrame,
    keys: Sequence[str],
    *,
    value: str = "difference",
    iterations: int = 5000,
    confidence: float = 0.95,
    seed: int = 42,
    method: str = "weights",
) -> DataFrame:
    """Difference summary together with its bootstrap interval."""
    summary = difference_summary(differences, value=value)
    interval = bootstrap_interval(
        differences, value, keys, iterations=iterations, confidence=confidence, seed=seed, method=method
    ).select("ci_lower", "ci_upper")
    return _join_groups(summary, interval, []).withColumn("confidence", F.lit(confidence))


def metric_intervals(
    results: DataFrame, keys: Sequence[str], mode: str, metrics: Sequence[str], **options
) -> DataFrame:
    """Bootstrap interval of several metrics per mode."""
    fields = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("score")) for m in metrics])
    long = results.select(mode, *keys, F.explode(fields).alias("_f")).select(mode, *keys, "_f.*")
    return bootstrap_interval(long, "score", keys, groups=[mode, "metric"], **options)


# --- signed ranks -------------------------------------------------------------


#: Decimal places at which two differences are one and the same.
DIFFERENCE_PLACES = 12


def signed_rank_sums(differences: DataFrame, value: str = "difference") -> DataFrame:
    """Rank sums by sign over the average ranks of |d|, zeros left out, in one row.

    Differences are rounded first, so that equal ones are not told apart by float noise.
    """
    d = F.round(F.col(value), DIFFERENCE_PLACES)
    by_size = (
        differences.where((d != 0) & d.isNotNull())
        .groupBy(F.abs(d).alias("_size"))
        .agg(F.count_if(d > 0).alias("_up"), F.count_if(d < 0).alias("_down"))
        .withColumn("_ties", F.col("_up") + F.col("_down"))
    )
    ranked = running_total(by_size, ["_size"], "_ties", out="_upto")
    rank = F.col("_upto") - (F.col("_ties") - 1) / 2.0
    ties = F.col("_ties").cast("double")
    return ranked.agg(
        F.coalesce(F.sum("_ties"), F.lit(0)).cast("bigint").alias("nonzero"),
        F.sum(rank * F.col("_up")).alias("positive_rank_sum"),
        F.sum(rank * F.col("_down")).alias("negative_rank_sum"),
        F.coalesce(F.sum(ties * ties * ties - ties), F.lit(0.0)).alias("tie_term"),
    )


# Coefficients of a Chebyshev fit of the complementary error function, relative error below
# 1.2e-7, from the constant upwards. Fixed values.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def erfc(x: Column) -> Column:
    """Complementary error function of a column that is not negative."""
    t = 1.0 / (1.0 + 0.5 * x)
    poly = F.lit(0.0)
    for c in reversed(ERFC):
        poly = poly * t + F.lit(c)
    return t * F.exp(poly - x * x)


def normal_p_value(n: Column, statistic: Column, ties: Column) -> Column:
    """Two-sided p of a signed-rank statistic by the tie-corrected normal approximation."""
    n = n.cast("double")
    mean = n * (n + 1) / 4.0
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0)
    return F.when((n == 0) | (spread == 0), F.lit(1.0)).otherwise(erfc(F.abs(statistic - mean) / (spread * math.sqrt(2.0))))


def exact_p_value(n: int, statistic: float) -> float:
    """Two-sided exact probability of a signed-rank statistic of n untied differences without zeros."""
    counts = [1]
    for rank in range(1, n + 1):
        longer = counts + [0] * rank
        for total, ways in enumerate(counts):
            longer[total + rank] += ways
        counts = longer
    below = sum(counts[: int(statistic) + 1])
    return min(1.0, 2.0 * below / 2.0**n)


def wilcoxon_paired(differences: DataFrame, value: str = "difference") -> DataFrame:
    """Signed-rank statistic, two-sided p and rank-biserial effect in one row.

    The p-value is that of the normal approximation at every size; ``exact_p_value`` gives
    that of a few untied differences.
    """
    sums = signed_rank_sums(differences, value)
    total = F.col("positive_rank_sum") + F.col("negative_rank_sum")
    statistic = F.coalesce(F.least("positive_rank_sum", "negative_rank_sum"), F.lit(0.0))
    return sums.select(
        "nonzero",
        statistic.alias("wilcoxon_statistic"),
        normal_p_value(F.col("nonzero"), statistic, F.col("tie_term")).alias("wilcoxon_p_value"),
        "positive_rank_sum",
        "negative_rank_sum",
        F.when(total > 0, (F.col("positive_rank_sum") - F.col("negative_rank_sum")) / total).alias(
            "rank_biserial_effect"
        ),
    )


# --- slices -------------------------------------------------------------------


def summarize_slices(
    results: DataFrame, slice_columns: Sequence[str], metric_columns: Sequence[str]
) -> DataFrame:
    """Row count and metric means per value of every slice column, in one pass."""
    metrics = available(results, metric_columns)
    slices = F.array(
        *[
            F.struct(F.lit(c).alias("slice_dimension"), F.col(c).cast("string").alias("slice_value"))
            for c in slice_columns
        ]
    )
    long = results.select(*metrics, F.explode(slices).alias("_s")).select(*metrics, "_s.*")
    return (
        long.where("slice_value is not null")
        .groupBy("slice_dimension", "slice_value")
        .agg(
            F.count(F.lit(1)).alias("images"),
            *[F.avg(nan_to_null(F.col(m).cast("double"))).alias(m) for m in metrics],
        )
    )
