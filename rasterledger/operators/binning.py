"""Quantile, rank and fixed-edge bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rasterledger.operators.ordered import global_row_number, quantile_values

# Upper edges and labels of the coverage slices.
COVERAGE_EDGES = (0.0, 0.10, 0.25, 0.50, 0.75, 1.0)
COVERAGE_LABELS = ("empty", "0-10%", "10-25%", "25-50%", "50-75%", "75-100%")
SIZE_LABELS = ("small", "medium", "large")
LEVEL_LABELS = ("low", "medium", "high")


def quantile_edges(df: DataFrame, value: str, bins: int) -> list[float]:
    """Distinct linear-interpolated edges; bins + 1 numbers at most."""
    edges = quantile_values(df, value, [i / bins for i in range(bins + 1)])
    return sorted({e for e in edges if e is not None})


def bin_of(value: Column, edges: Sequence[float]) -> Column:
    """Index of the right-closed bin between ascending edges, lowest edge included."""
    below = F.lit(0)
    for edge in edges:
        below = below + (value > F.lit(float(edge))).cast("int")
    return F.greatest(below - 1, F.lit(0))


def quantile_bins(df: DataFrame, value: str, bins: int, out: str = "bin") -> DataFrame:
    """Quantile bins with repeated edges dropped."""
    edges = quantile_edges(df, value, bins)
    return df.withColumn(out, bin_of(F.col(value), edges))


def rank_first_bins(
    df: DataFrame, value: str, tie: str = "image_id", bins: int = 10, out: str = "stratum"
) -> DataFrame:
    """Quantile bins of the position in (value, tie) order; at least 20 rows per bin, two bins at least."""
    ranked = global_row_number(df, [value, tie], out="_rank", total_out="_rows")
    used = F.least(F.lit(bins).cast("bigint"), F.greatest(F.lit(2).cast("bigint"), F.expr("_rows div 20")))
    # ceil((rank - 1) * used / (rows - 1)) - 1 in whole numbers.
    steps = (F.col("_rank") - 1) * used
    gaps = F.greatest(F.col("_rows") - 1, F.lit(1).cast("bigint"))
    index = F.floor((steps + gaps - 1) / gaps) - 1
    return ranked.withColumn(out, F.greatest(index, F.lit(0)).cast("int")).drop("_rank", "_rows")


def coverage_label(fraction: Column) -> Column:
    """Right-closed fixed slices; values outside [0, 1] get no label."""
    label = F.when((fraction >= -1e-9) & (fraction <= COVERAGE_EDGES[0]), COVERAGE_LABELS[0])
    for edge, name in zip(COVERAGE_EDGES[1:], COVERAGE_LABELS[1:]):
        label = label.when((fraction > 0.0) & (fraction <= edge), name)
    return label


def tertile_labels(df: DataFrame, value: str, labels: Sequence[str], out: str) -> DataFrame:
    """Three quantile bins by name; fails when edges coincide."""
    edges = quantile_edges(df, value, len(labels))
    if len(edges) != len(labels) + 1:
        raise ValueError(f"{value}: {len(edges)} distinct edges cannot carry {len(labels)} labels")
    names = F.array(*[F.lit(n) for n in labels])
    return df.withColumn(out, F.element_at(names, bin_of(F.col(value), edges) + 1))


def fixed_width_histogram(
    df: DataFrame, value: str, bins: int, groups: Sequence[str] = ()
) -> DataFrame:
    """Equal-width counts between the group's extremes, empty bins included."""
    by_value = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(
        F.count(F.lit(1)).alias("_n")
    )
    limits = by_value.groupBy(*groups).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    if groups:
        joined = by_value.join(limits, list(groups))
    else:
        row = limits.first()
        joined = by_value.withColumn("_lo", F.lit(row["_lo"])).withColumn("_hi", F.lit(row["_hi"]))
    span = F.col("_hi") - F.col("_lo")
    position = F.when(span > 0, F.floor((F.col(value) - F.col("_lo")) / span * bins)).otherwise(0)
    counted = joined.groupBy(*groups, F.least(position, F.lit(bins - 1)).cast("int").alias("bin_index")).agg(
        F.sum("_n").alias("_n"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi")
    )
    packed = counted.groupBy(*groups).agg(
        F.map_from_entries(F.collect_list(F.struct("bin_index", "_n"))).alias("_bins"),
        F.first("_lo").alias("_lo"),
        F.first("_hi").alias("_hi"),
    )
    width = (F.col("_hi") - F.col("_lo")) / bins
    return packed.select(
        *groups, "_bins", "_lo", "_hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin_index")
    ).select(
        *groups,
        "bin_index",
        (F.col("_lo") + width * F.col("bin_index")).alias("left_edge"),
        F.coalesce(F.try_element_at("_bins", "bin_index"), F.lit(0)).cast("bigint").alias("images"),
    )
