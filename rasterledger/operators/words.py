"""Masks as blocks of 64-bit words, for neighbourhood work without a row per cell.

A block (image_id, _by, _bx) is an array of 64 words of 64 bits. Its inner 64 - 2 halo rows
and columns are its own, the halo around them repeats cells of its neighbours. Steps whose radii add
up to the halo at most leave the block's own cells exact, so no block has to see another one.
Cells outside the image are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

SIDE = 64
#: Steps with more than this in all are cut into several passes over the blocks.
MOST_HALO = 16
_BLOCK = ("image_id", "_by", "_bx")


def last_block(length: str, halo: int) -> Column:
    """Number of the last block along an axis."""
    return F.floor((F.col(length) - 1) / (SIDE - 2 * halo)).cast("int")


def dealt(blocks: DataFrame) -> DataFrame:
    """Rows by block over as many tasks as the session's shuffles; adaptive execution would take the few bytes of blocks for little work."""
    return blocks.repartition(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), *_BLOCK)


def pack(pixels: DataFrame, halo: int, keep: Sequence[str] = ()) -> DataFrame:
    """Blocks with their words ``_w``. ``keep`` names columns that are the same in a whole image.

    One shuffle by block, with as many tasks as the session's shuffles, serves both groupings.
    """
    own = SIDE - 2 * halo

    def blocks(axis: str) -> Column:
        low, high = F.floor((F.col(axis) - halo) / own), F.floor((F.col(axis) + halo) / own)
        return F.explode(F.sequence(F.greatest(low, F.lit(0)), high).cast("array<int>"))

    inside = pixels.where("y >= 0 and x >= 0").select("image_id", "y", "x", *keep)
    placed = inside.withColumn("_by", blocks("y")).withColumn("_bx", blocks("x"))
    cells = placed.select(
        *_BLOCK,
        *keep,
        (F.col("y") - F.col("_by") * own + halo).cast("int").alias("_row"),
        F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("x") - F.col("_bx") * own + halo).cast("int")).alias("_bit"),
    )
    rows = dealt(cells).groupBy(*_BLOCK, *keep, "_row").agg(F.bit_or("_bit").alias("_bits"))
    held = rows.groupBy(*_BLOCK, *keep).agg(F.map_from_entries(F.collect_list(F.struct("_row", "_bits"))).alias("_held"))
    word = lambda row: F.coalesce(F.element_at("_held", row), F.lit(0).cast("bigint"))
    return held.withColumn("_w", F.transform(F.sequence(F.lit(0), F.lit(SIDE - 1)), word)).drop("_held")


def _inside(batch: pa.RecordBatch, halo: int, margin: int) -> np.ndarray:
    """Words of the cells of each block that lie in the image and ``margin`` or more cells inside the block."""

    def along(block: str, length: str) -> np.ndarray:
        number, size = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)[:, None] for c in (block, length))
        steps = np.arange(SIDE)
        at = number * (SIDE - 2 * halo) - halo + steps
        return (at >= 0) & (at < size) & (steps >= margin) & (steps < SIDE - margin)

    columns = np.packbits(along("_bx", "width"), axis=1, bitorder="little").view("<u8")
    return np.where(along("_by", "height"), columns, np.uint64(0))


def _square(words: np.ndarray, radius: int, join: np.ufunc) -> np.ndarray:
    """Each word joined with those of the square around it, without those beyond the block's edge."""
    across = words.copy()
    for d in range(1, radius + 1):
        for shifted in (words << np.uint64(d), words >> np.uint64(d)):
            join(across, shifted, out=across)
    down = across.copy()
    for d in range(1, radius + 1):
        join(down[:, d:], across[:, :-d], out=down[:, d:])
        join(down[:, :-d], across[:, d:], out=down[:, :-d])
    return down


def stepped(blocks: DataFrame, steps: Sequence[tuple[str, int]], halo: int, *, border: str = "foreground") -> DataFrame:
    """Blocks with their own cells ``_w`` before and ``_in`` after the steps. Needs height and width.

    ``border`` says what an erosion finds outside the image.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            image, own = _inside(batch, halo, 0), _inside(batch, halo, halo)
            whole = batch.column("_w").flatten().to_numpy().view(np.uint64).reshape(-1, SIDE)
            after = whole & image
            for kind, radius in steps:
                if kind == "erode":
                    after = _square(after | ~image if border == "foreground" else after, radius, np.bitwise_and) & image
                else:
                    after = _square(after, radius, np.bitwise_or) & image
            starts = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * SIDE)
            out = [pa.ListArray.from_arrays(starts, pa.array((w & own).view(np.int64).ravel())) for w in (whole, after)]
            kept = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, *out], names=[*names, "_w", "_in"])

    names = [c for c in blocks.columns if c != "_w"]
    kinds = dict(blocks.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in names), "_w array<bigint>, _in array<bigint>"])
    return blocks.mapInArrow(run, schema)


def cells(words: Column) -> Column:
    """Number of cells in an array of words."""
    return F.aggregate(words, F.lit(0), lambda n, word: n + F.bit_count(word))


def place(row: Column, bit: Column, halo: int) -> tuple[Column, Column]:
    """(y, x) of a bit of a block."""
    own = SIDE - 2 * halo
    return F.col("_by") * own - halo + row, F.col("_bx") * own - halo + bit


def bits_of(word: Column, halo: int) -> Column:
    """Positions of the set bits among a word's own."""
    return F.filter(F.sequence(F.lit(halo), F.lit(SIDE - halo - 1)), lambda bit: F.getbit(word, bit) == 1)


def unpack(blocks: DataFrame, halo: int, keep: Sequence[str] = ()) -> DataFrame:
    """The cells ``_in`` of blocks as rows (image_id, y, x)."""
    rows = blocks.select(*_BLOCK, *keep, F.posexplode("_in").alias("_row", "_bits")).where("_bits <> 0")
    found = rows.withColumn("_bit", F.explode(bits_of(F.col("_bits"), halo)))
    y, x = place(F.col("_row"), F.col("_bit"), halo)
    return found.select("image_id", y.alias("y"), x.alias("x"), *keep)


def _passes(steps: Sequence[tuple[str, int]]) -> list[list[tuple[str, int]]]:
    """Steps in groups whose radii add up to MOST_HALO at most. A wide square is one narrow square after another."""
    out, room = [], 0
    for kind, radius in steps:
        while radius > 0:
            if not room:
                out.append([])
                room = MOST_HALO
            part = min(radius, room)
            out[-1].append((kind, part))
            radius, room = radius - part, room - part
    return out


def morphology(
    mask: DataFrame, steps: Sequence[tuple[str, int]], *, border: str = "foreground", images: DataFrame | None = None
) -> DataFrame:
    """Erosions and dilations ("erode" or "dilate", radius) with squares, in order; cells (image_id, y, x, height, width).

    Sizes are columns of ``mask``, or come from ``images``, which meet the blocks instead of the cells.
    """
    size = ["height", "width"]
    for chain in _passes(steps):
        halo = sum(radius for _, radius in chain)
        if images is None:
            blocks = pack(mask, halo, size)
        else:
            blocks = pack(mask, halo).join(images.select("image_id", *size).hint("merge"), "image_id")
        blocks = stepped(blocks, chain, halo, border=border)
        mask, images = unpack(blocks, halo, size), None
    return mask
