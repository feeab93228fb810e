"""Exact distances between pixel sets by pruned pairs of blocks.

Pixels are packed into square blocks, 64 bits for a row of one. The box of a block bounds its distance to any
other block from below and from above, so most pairs of blocks are dropped before a
pixel is looked at: first between large blocks, then between the small ones inside the
pairs that are left. Work items are pairs of small blocks, so one image spreads over
as many tasks as it has pairs. Blocks and pairs grow with the pixels, so no join here is
left to be broadcast through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from rasterledger.operators.ordered import top_k_per_group
from rasterledger.session import pin

#: Sides of a small block, 64 at most, and of a large one, as powers of two.
SMALL, LARGE = 6, 10
#: Pairs of blocks whose pixels a task holds at once: a million pixels at most.
PAIRS_AT_ONCE = 128
_BOX = ("y0", "x0", "y1", "x1")


def _boxed(points: DataFrame, groups: Sequence[str], prefix: str) -> DataFrame:
    """One row per small block: its pixels as one 64-bit word for each row that has some, and the box around them."""
    place = {"_by": F.shiftright("y", SMALL), "_bx": F.shiftright("x", SMALL)}
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("x") % (1 << SMALL)).cast("int"))
    rows = points.withColumns(place).groupBy(*groups, "_by", "_bx", "y").agg(
        F.bit_or(bit).alias("bits"), F.min("x").alias("_x0"), F.max("x").alias("_x1")
    )
    return rows.groupBy(*groups, F.col("_by").alias(f"{prefix}by"), F.col("_bx").alias(f"{prefix}bx")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("y").cast("int").alias("y"), "bits"))).alias(f"{prefix}rows"),
        *_extent(prefix, F.col("y"), F.col("_x0"), F.col("y"), F.col("_x1")),
    )


def _extent(prefix: str, y0: Column, x0: Column, y1: Column, x1: Column) -> list[Column]:
    return [F.min(y0).alias(f"{prefix}y0"), F.min(x0).alias(f"{prefix}x0"), F.max(y1).alias(f"{prefix}y1"), F.max(x1).alias(f"{prefix}x1")]


def _bounds() -> tuple[Column, Column]:
    """Smallest and largest squared distance between pixels of the boxes q and t."""

    def both(axis: str) -> tuple[Column, Column]:
        q0, q1, t0, t1 = (F.col(f"{side}{axis}{end}").cast("long") for side in "qt" for end in "01")
        gap = F.greatest(t0 - q1, q0 - t1, F.lit(0).cast("long"))
        return gap * gap, F.greatest(t1 - q0, q1 - t0) * F.greatest(t1 - q0, q1 - t0)

    (near_y, far_y), (near_x, far_x) = both("y"), both("x")
    return near_y + near_x, far_y + far_x


def _nearest_pairs(pairs: DataFrame, block: Sequence[str]) -> DataFrame:
    """Pairs that may hold the nearest pixel of some pixel of block q, with the bounds of all its pixels."""
    low, high = _bounds()
    every = Window.partitionBy(*block)
    bounded = pairs.withColumns({"_low": low, "_high": high})
    bounded = bounded.withColumns({"least": F.min("_low").over(every), "most": F.min("_high").over(every)})
    return bounded.where("_low <= most").drop("_low", "_high")


def _block_pairs(queries: DataFrame, targets: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Pairs (q, t) of small blocks that can matter, with the squared bounds ``least`` and ``most`` of q."""
    g, up = list(groups), LARGE - SMALL

    def large(blocks: DataFrame, p: str) -> DataFrame:
        box = [F.col(f"{p}{c}") for c in _BOX]
        return blocks.groupBy(*g, F.shiftright(f"{p}by", up).alias(f"{p}Y"), F.shiftright(f"{p}bx", up).alias(f"{p}X")).agg(*_extent(p, *box))

    coarse = _nearest_pairs(large(queries, "q").join(large(targets, "t").hint("merge"), g), [*g, "qY", "qX"]).select(*g, "qY", "qX", "tY", "tX")

    def small(blocks: DataFrame, p: str) -> DataFrame:
        place = {f"{p}Y": F.shiftright(f"{p}by", up), f"{p}X": F.shiftright(f"{p}bx", up)}
        return blocks.drop(f"{p}rows").withColumns(place)

    fine = coarse.join(small(queries, "q").hint("merge"), [*g, "qY", "qX"]).join(small(targets, "t").hint("merge"), [*g, "tY", "tX"])
    return _nearest_pairs(fine, [*g, "qby", "qbx"]).drop("qY", "qX", "tY", "tX")


def _pixels(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(y, x, first): the pixels of a column of block rows, by y and x; ``first`` has the start of each block and the end.

    x counts from the block's left edge.
    """
    column = batch.column(name)
    starts = column.offsets.to_numpy()
    rows = column.flatten()
    words = rows.field("bits").to_numpy(zero_copy_only=False).astype("<u8").view(np.uint8).reshape(-1, 8)
    row, x = np.nonzero(np.unpackbits(words, axis=1, bitorder="little"))
    y = rows.field("y").to_numpy(zero_copy_only=False).astype(np.int64)[row]
    return y, x.astype(np.int64), np.searchsorted(row, starts - starts[0])


def _pair_minima(qy: np.ndarray, qx: np.ndarray, ty: np.ndarray, tx: np.ndarray) -> np.ndarray:
    """Smallest squared distance from each pixel of q to the pixels of t.

    Rows of q against the columns of t: first the vertical gap of each row to each column,
    then for each pixel the least over the columns.
    """
    by_column = np.argsort(tx, kind="stable")
    tx, ty = tx[by_column], ty[by_column]
    columns, starts = np.unique(tx, return_index=True)
    rows, row = np.unique(qy, return_inverse=True)
    gaps = np.minimum.reduceat(np.abs(rows[:, None] - ty[None, :]), starts, axis=1)
    return ((qx[:, None] - columns[None, :]) ** 2 + gaps[row] ** 2).min(axis=1)


def _exact(pairs: DataFrame, queries: DataFrame, targets: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Distances of the pixels of blocks q. A pair of blocks is at most 2 KB; its pixels exist in a task a few pairs at a time.

    Pairs are dealt over as many tasks as the session's shuffles. Adaptive execution would join them into few
    tasks by their bytes, which each then hold the distances of all their pixels.
    """
    g, side = list(groups), 1 << SMALL
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = (
        pairs.select(*g, "qby", "qbx", "tby", "tbx")
        .join(queries.select(*g, "qby", "qbx", "qrows").hint("merge"), [*g, "qby", "qbx"])
        .join(targets.select(*g, "tby", "tbx", "trows").hint("merge"), [*g, "tby", "tbx"])
        .repartition(tasks, *g, "qby", "qbx", "tby", "tbx")
        .select(*g, "qbx", "tbx", "qrows", "trows")
    )

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, PAIRS_AT_ONCE):
                batch = whole.slice(begin, PAIRS_AT_ONCE)
                (qy, qx, q), (ty, tx, t) = _pixels(batch, "qrows"), _pixels(batch, "trows")
                left, shift = (batch.column(c).to_numpy().astype(np.int64) for c in ("qbx", "tbx"))
                left, shift = left * side, (shift - left) * side
                found = [
                    _pair_minima(qy[q[i] : q[i + 1]], qx[q[i] : q[i + 1]], ty[t[i] : t[i + 1]], tx[t[i] : t[i + 1]] + shift[i])
                    for i in range(batch.num_rows)
                ]
                sizes = np.diff(q)
                owner = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
                keys = [batch.column(c).take(owner) for c in g]
                places = [pa.array(v.astype(np.int32)) for v in (qy, qx + np.repeat(left, sizes))]
                yield pa.RecordBatch.from_arrays([*keys, *places, pa.array(np.concatenate(found))], names=[*g, "y", "x", "_d2"])

    kinds = dict(met.dtypes)
    each = met.mapInArrow(solve, ", ".join([*(f"`{c}` {kinds[c]}" for c in g), "y int, x int, _d2 bigint"]))
    return each.groupBy(*g, "y", "x").agg(F.sqrt(F.min("_d2").cast("double")).alias("distance"))


def nearest_distance(queries: DataFrame, targets: DataFrame, groups: Sequence[str] = ("image_id",)) -> DataFrame:
    """Exact Euclidean distance from each query pixel to the nearest target pixel.

    Queries in groups without targets are left out; repeated pixels count once.
    """
    q, t = pin(_boxed(queries, groups, "q")), pin(_boxed(targets, groups, "t"))
    return _exact(_block_pairs(q, t, groups), q, t, groups)


def _cells(rows: str) -> Column:
    """Number of pixels in the rows of a block."""
    return F.aggregate(rows, F.lit(0), lambda n, row: n + F.bit_count(row["bits"]))


def _free(opened: DataFrame, targets: DataFrame) -> DataFrame:
    """The cells of blocks q that the mask leaves free, as rows of a block."""
    full = F.col("qx1") - F.col("qx0") + 1
    every = F.when(full == 64, F.lit(-1).cast("bigint")).otherwise(F.call_function("shiftleft", F.lit(1).cast("bigint"), full.cast("int")) - 1)
    mask = targets.select("image_id", F.col("tby").alias("qby"), F.col("tbx").alias("qbx"), "trows")
    met = opened.join(mask.hint("merge"), ["image_id", "qby", "qbx"], "left").withColumns(
        {"_every": every, "_held": F.map_from_entries(F.coalesce("trows", F.lit([]).cast("array<struct<y:int,bits:bigint>>")))}
    )

    def left(y: Column) -> Column:
        held = F.coalesce(F.element_at("_held", y), F.lit(0).cast("bigint"))
        return F.struct(y.alias("y"), F.col("_every").bitwiseAND(F.bitwise_not(held)).alias("bits"))

    rows = F.transform(F.sequence(F.col("qy0").cast("int"), F.col("qy1").cast("int")), left)
    return met.select("image_id", "qby", "qbx", F.filter(rows, lambda row: row["bits"] != 0).alias("qrows"))


def _grid(images: DataFrame, mask_blocks: DataFrame) -> DataFrame:
    """All small blocks of the images with their boxes and number of background cells; full ones are left out."""
    side = 1 << SMALL
    last = lambda c: F.shiftright(F.col(c) - 1, SMALL)
    rows = images.where("height > 0 and width > 0").select("image_id", "height", "width", F.explode(F.sequence(F.lit(0), last("height"))).alias("qby"))
    blocks = rows.select("*", F.explode(F.sequence(F.lit(0), last("width"))).alias("qbx"))
    boxed = blocks.select(
        "image_id",
        "qby",
        "qbx",
        (F.col("qby") * side).alias("qy0"),
        (F.col("qbx") * side).alias("qx0"),
        F.least(F.col("qby") * side + side, F.col("height")).alias("qy1"),
        F.least(F.col("qbx") * side + side, F.col("width")).alias("qx1"),
    ).withColumns({"qy1": F.col("qy1") - 1, "qx1": F.col("qx1") - 1})
    filled = mask_blocks.select("image_id", F.col("tby").alias("qby"), F.col("tbx").alias("qbx"), _cells("trows").alias("_filled"))
    area = (F.col("qy1") - F.col("qy0") + 1) * (F.col("qx1") - F.col("qx0") + 1)
    met = boxed.join(filled.hint("merge"), ["image_id", "qby", "qbx"], "left")
    return met.withColumn("cells", area - F.coalesce("_filled", F.lit(0))).where("cells > 0").drop("_filled")


def _open_blocks(pairs: DataFrame, k: int) -> DataFrame:
    """Blocks q that may hold one of the k farthest cells of their image, with their boxes.

    The k blocks of the largest lower bounds hold k cells at least, which sets a distance that
    the k-th cell reaches; blocks whose upper bound lies below it stay closed.
    """
    image, block = ["image_id"], ["image_id", "qby", "qbx"]
    once = [F.first(c).alias(c) for c in ("least", "most", "cells", *(f"q{c}" for c in _BOX))]
    bounded = pairs.groupBy(*block).agg(*once)
    top = top_k_per_group(bounded, image, [F.desc("least"), F.col("qby"), F.col("qbx")], k, spread_on=["qby", "qbx"], out="_place")
    before = Window.partitionBy(*image).orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    reached = top.withColumn("_before", F.coalesce(F.sum("cells").over(before), F.lit(0))).where(F.col("_before") < k)
    reached = reached.groupBy(*image).agg(F.min("least").alias("_reached"), F.sum("cells").alias("_cells"))
    needed = F.when(F.col("_cells") >= k, F.col("_reached")).otherwise(0)
    return bounded.join(reached.hint("merge"), image).where(F.col("most") >= needed)


def farthest_cells(mask: DataFrame, images: DataFrame, k: int) -> DataFrame:
    """k background cells per image with the largest distance to the mask, ties by row and column.

    Only cells of blocks that can reach the k-th distance are made and measured.
    """
    image, block = ["image_id"], ["image_id", "qby", "qbx"]
    targets = pin(_boxed(mask, image, "t"))
    pairs = pin(_block_pairs(_grid(images, targets), targets, image))
    opened = _open_blocks(pairs, k)
    queries = _free(opened, targets)
    open_pairs = pairs.join(queries.select(*block).hint("merge"), block, "left_semi")
    distances = _exact(open_pairs, queries, targets, image)
    return top_k_per_group(distances, image, [F.desc("distance"), F.col("y"), F.col("x")], k, spread_on=["y", "x"])
