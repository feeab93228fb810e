"""Order statistics that never sort a whole group in one task.

A global order is cut into range slices. Each slice is numbered on its own and
shifted by the weight of the slices before it, so a group holding most of the
rows is still spread over all slices.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from rasterledger.functions.hashing import stable_hash32
from rasterledger.session import pin

_SLICE = "_slice"
HASH_SLICE_BITS = 20  # 32-bit draw >> 20 leaves 4,096 ordered slices


def _slice_join(rows: DataFrame, offsets: DataFrame, keys: Sequence[str]) -> DataFrame:
    left, right = rows.alias("_l"), offsets.alias("_r")
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(f"_l.{key}").eqNullSafe(F.col(f"_r.{key}"))
    extra = [F.col(f"_r.{c}") for c in offsets.columns if c not in keys]
    return left.join(right, condition).select("_l.*", *extra)


def _shift_slices(
    sliced: DataFrame,
    order: list[Column],
    weight: Column,
    groups: Sequence[str],
    out: str,
    total_out: str | None,
) -> DataFrame:
    keys = [*groups, _SLICE]
    sums = sliced.groupBy(*keys).agg(F.sum(weight).alias("_w"))
    whole = Window.partitionBy(*groups)
    before = whole.orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *keys,
        F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_offset"),
        F.sum("_w").over(whole).alias("_total"),
    )
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = sliced.withColumn("_local", F.sum(weight).over(inside))
    joined = _slice_join(local, offsets, keys)
    joined = joined.withColumn(out, F.col("_offset") + F.col("_local"))
    if total_out:
        joined = joined.withColumn(total_out, F.col("_total"))
    return joined.drop(_SLICE, "_local", "_offset", "_total")


def running_total(
    df: DataFrame,
    order_by: Sequence[str],
    weight: str | Column,
    *,
    groups: Sequence[str] = (),
    out: str = "running_total",
    total_out: str | None = None,
    slices: int | None = None,
) -> DataFrame:
    """Inclusive running sum of ``weight`` in ascending ``order_by`` order per group.

    ``order_by`` has to be unique inside a group. The sliced rows are pinned
    because the slice sums and the rows must see the same range boundaries.
    """
    count = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sliced = pin(
        df.repartitionByRange(count, *groups, *order_by).withColumn(_SLICE, F.spark_partition_id())
    )
    value = F.col(weight) if isinstance(weight, str) else weight
    return _shift_slices(sliced, [F.col(c) for c in order_by], value, groups, out, total_out)


def running_max(
    df: DataFrame,
    order_by: Sequence[str],
    value: str,
    *,
    groups: Sequence[str] = (),
    out: str = "running_max",
    inclusive: bool = True,
    slices: int | None = None,
) -> DataFrame:
    """Largest ``value`` so far in ``order_by`` order per group; NULL before the first."""
    count = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sliced = pin(
        df.repartitionByRange(count, *groups, *order_by).withColumn(_SLICE, F.spark_partition_id())
    )
    keys = [*groups, _SLICE]
    before = Window.partitionBy(*groups).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    tops = sliced.groupBy(*keys).agg(F.max(value).alias("_top"))
    offsets = tops.select(*keys, F.max("_top").over(before).alias("_offset"))
    inside = (
        Window.partitionBy(*keys)
        .orderBy(*order_by)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    local = sliced.withColumn("_local", F.max(value).over(inside))
    joined = _slice_join(local, offsets, keys)
    return joined.withColumn(out, F.greatest("_offset", "_local")).drop(_SLICE, "_local", "_offset")


def scanned(
    df: DataFrame,
    order_by: Sequence[str],
    *,
    groups: Sequence[str] = (),
    numbers: tuple[str, str] | None = None,
    maxima: dict[str, tuple[str, bool]],
    slices: int | None = None,
) -> DataFrame:
    """Positions and running maxima of several columns from one slicing of the rows.

    ``numbers`` names the 1-based position and the number of rows of the group; ``maxima``
    maps a result to (column, whether the row itself counts). ``order_by`` has to be unique
    inside a group.
    """
    count = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sliced = pin(df.repartitionByRange(count, *groups, *order_by).withColumn(_SLICE, F.spark_partition_id()))
    keys = [*groups, _SLICE]
    tops = {f"_top{i}": F.max(column) for i, (column, _) in enumerate(maxima.values())}
    sums = sliced.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), *(c.alias(n) for n, c in tops.items()))
    whole = Window.partitionBy(*groups)
    before = whole.orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *keys,
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"),
        F.sum("_rows").over(whole).alias("_total"),
        *(F.max(name).over(before).alias(f"{name}_before") for name in tops),
    )
    joined = _slice_join(sliced, offsets, keys)
    inside = Window.partitionBy(*keys).orderBy(*order_by)
    results = {
        out: F.greatest(f"_top{i}_before", F.max(column).over(inside.rowsBetween(Window.unboundedPreceding, 0 if own else -1)))
        for i, (out, (column, own)) in enumerate(maxima.items())
    }
    if numbers:
        results |= {numbers[0]: F.col("_offset") + F.row_number().over(inside), numbers[1]: F.col("_total")}
    return joined.withColumns(results).drop(_SLICE, "_offset", "_total", *(f"{name}_before" for name in tops))


def global_row_number(
    df: DataFrame,
    order_by: Sequence[str],
    *,
    groups: Sequence[str] = (),
    out: str = "row_number",
    total_out: str | None = None,
) -> DataFrame:
    """1-based position in ascending ``order_by`` order per group."""
    return running_total(
        df, order_by, F.lit(1).cast("bigint"), groups=groups, out=out, total_out=total_out
    )


def hash_rank(
    df: DataFrame,
    id_column: str,
    seed: int,
    *,
    groups: Sequence[str] = (),
    out: str = "draw_rank",
    total_out: str | None = None,
) -> DataFrame:
    """1-based position in a seeded shuffle of each group.

    Slices are the high bits of the draw, so they are even by construction and
    need no sampling pass.
    """
    drawn = df.withColumn("_draw", stable_hash32(F.col(id_column), seed)).withColumn(
        _SLICE, F.shiftright(F.col("_draw"), HASH_SLICE_BITS)
    )
    ranked = _shift_slices(
        drawn,
        [F.col("_draw"), F.col(id_column)],
        F.lit(1).cast("bigint"),
        groups,
        out,
        total_out,
    )
    return ranked.drop("_draw")


def value_histogram(df: DataFrame, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """Distinct values with their counts; missing and NaN values are left out."""
    clean = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    return clean.groupBy(*groups, F.col(value).cast("double").alias(value)).agg(
        F.count(F.lit(1)).alias("_count")
    )


def exact_quantiles(
    df: DataFrame,
    value: str,
    quantiles: dict[str, float],
    *,
    groups: Sequence[str] = (),
) -> DataFrame:
    """Linearly interpolated quantiles, one row per group, one column per name."""
    ordered = running_total(
        value_histogram(df, value, groups),
        [value],
        "_count",
        groups=groups,
        out="_upto",
        total_out="_n",
    )
    picks = []
    for name, q in quantiles.items():
        position = F.lit(float(q)) * (F.col("_n") - 1)
        picks.append(F.min(F.when(F.col("_upto") > F.floor(position), F.col(value))).alias(f"_lo_{name}"))
        picks.append(F.min(F.when(F.col("_upto") > F.ceil(position), F.col(value))).alias(f"_hi_{name}"))
        picks.append(F.max(position - F.floor(position)).alias(f"_part_{name}"))
    found = ordered.groupBy(*groups).agg(*picks)
    return found.select(
        *groups,
        *[
            (
                F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_part_{n}")
            ).alias(n)
            for n in quantiles
        ],
    )


def quantile_values(df: DataFrame, value: str, quantiles: Sequence[float]) -> list[float]:
    """The same quantiles as driver-side numbers; as many as were asked for."""
    named = {f"q{i}": q for i, q in enumerate(quantiles)}
    row = exact_quantiles(df, value, named).first()
    return [row[name] for name in named]


def top_k_per_group(
    df: DataFrame,
    groups: Sequence[str],
    order_by: Sequence[Column],
    k: int,
    *,
    spread_on: Sequence[str],
    out: str = "position",
    salts: int = 32,
) -> DataFrame:
    """First ``k`` rows of each group.

    Each group is first cut to k rows per salt, so the final ranking sees at
    most ``salts * k`` rows of a group however large the group is.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*spread_on), F.lit(salts)))
    first = Window.partitionBy(*groups, "_salt").orderBy(*order_by)
    last = Window.partitionBy(*groups).orderBy(*order_by)
    return (
        salted.withColumn(out, F.row_number().over(first))
        .where(F.col(out) <= k)
        .withColumn(out, F.row_number().over(last))
        .where(F.col(out) <= k)
        .drop("_salt")
    )
