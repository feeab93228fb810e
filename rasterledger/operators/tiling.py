"""Tile plans, tile pixels, stitching and canvas geometry.

Rasters are pixel tables (image_id, y, x, value). Plans are computed per image
with array functions; pixels meet their tiles by arithmetic on coordinates, and
joins are keyed by pixel, never by image alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame, functions as F

from rasterledger.functions.scalars import binarise
from rasterledger.operators.checks import raise_if_any
from rasterledger.session import pin

#: Cells of tiles that a task joins with their pixels.
CELLS_A_TASK = 1 << 18
MINIMUM_WEIGHT = 1e-3
MINIMUM_WEIGHT_SUM = 1e-6


def check_tile_size(tile_size: int, overlap: int) -> None:
    if tile_size <= 0:
        raise ValueError("tile_size must be positive")
    if overlap < 0 or overlap >= tile_size:
        raise ValueError("overlap must satisfy 0 <= overlap < tile_size")


def tile_positions(length: Column, tile_size: int, overlap: int) -> Column:
    """Ascending tile offsets along one axis; the last tile ends at the border."""
    check_tile_size(tile_size, overlap)
    last = F.greatest(length.cast("int") - tile_size, F.lit(0))
    return F.array_distinct(
        F.concat(F.sequence(F.lit(0), last, F.lit(tile_size - overlap)), F.array(last))
    )


def tile_grid(
    images: DataFrame, *, tile_size: int, overlap: int, image: str = "image_id"
) -> DataFrame:
    """One row per tile with offsets, valid sizes and the tile id."""
    rows = images.select(
        image, "height", "width", F.posexplode(tile_positions(F.col("height"), tile_size, overlap)).alias("row_index", "row_offset")
    )
    cells = rows.select(
        "*", F.posexplode(tile_positions(F.col("width"), tile_size, overlap)).alias("column_index", "column_offset")
    )
    return cells.select(
        F.format_string("%s__r%03d_c%03d", F.col(image).cast("string"), "row_index", "column_index").alias("tile_id"),
        F.col(image).alias("parent_image_id"),
        "row_offset",
        "column_offset",
        F.lit(tile_size).alias("height"),
        F.lit(tile_size).alias("width"),
        F.least(F.lit(tile_size), F.col("height") - F.col("row_offset")).alias("valid_height"),
        F.least(F.lit(tile_size), F.col("width") - F.col("column_offset")).alias("valid_width"),
    )


def covering_offsets(position: Column, length: Column, tile_size: int, overlap: int) -> Column:
    """Offsets of all tiles along one axis that contain the position."""
    return F.filter(
        tile_positions(length, tile_size, overlap),
        lambda o: (o <= position) & (position < o + tile_size),
    )


def assign_to_tiles(
    pixels: DataFrame, *, tile_size: int, overlap: int, image: str = "image_id"
) -> DataFrame:
    """Pixels with every tile that covers them. No join: offsets follow from the coordinates.

    ``pixels`` carries height and width of its image.
    """
    by_row = pixels.withColumn(
        "row_offset", F.explode(covering_offsets(F.col("y"), F.col("height"), tile_size, overlap))
    )
    both = by_row.withColumn(
        "column_offset", F.explode(covering_offsets(F.col("x"), F.col("width"), tile_size, overlap))
    )
    return both.withColumn("tile_y", F.col("y") - F.col("row_offset")).withColumn(
        "tile_x", F.col("x") - F.col("column_offset")
    )


def tile_pixels(
    pixels: DataFrame,
    images: DataFrame,
    *,
    tile_size: int,
    overlap: int,
    value: str = "value",
    pad_value: int | float = 0,
    absent_value: int | float = 0,
) -> DataFrame:
    """Full tiles: every cell of every tile, padding outside the image.

    Cells inside the image without a pixel row take ``absent_value``. The number of tasks grows with
    the cells, so a task's share stays the same however many tiles there are.
    """
    grid = pin(tile_grid(images, tile_size=tile_size, overlap=overlap))
    tasks = int(images.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = max(tasks, ceil(grid.count() * tile_size**2 / CELLS_A_TASK))
    steps = F.sequence(F.lit(0), F.lit(tile_size - 1))
    cells = grid.repartition(tasks, "tile_id").withColumn("tile_y", F.explode(steps)).withColumn("tile_x", F.explode(steps))
    placed = cells.select(
        "tile_id",
        F.col("parent_image_id").alias("image_id"),
        "tile_y",
        "tile_x",
        (F.col("row_offset") + F.col("tile_y")).alias("y"),
        (F.col("column_offset") + F.col("tile_x")).alias("x"),
        ((F.col("tile_y") < F.col("valid_height")) & (F.col("tile_x") < F.col("valid_width"))).alias("valid"),
    )
    cell = ["image_id", "y", "x"]
    joined = placed.repartition(dealt, *cell).join(pixels.select(*cell, value).repartition(dealt, *cell), cell, "left")
    filled = F.when(F.col("valid"), F.coalesce(F.col(value), F.lit(absent_value))).otherwise(F.lit(pad_value))
    return joined.select("tile_id", "image_id", "tile_y", "tile_x", "y", "x", "valid", filled.alias(value))


def tiled_manifest(
    manifest: DataFrame,
    foreground: DataFrame,
    *,
    tile_size: int,
    overlap: int,
    fraction: str = "water_fraction",
) -> DataFrame:
    """Child rows for images larger than the tile; smaller images pass through.

    Children inherit every manifest column, their split included. ``foreground``
    holds the foreground pixels (image_id, y, x).
    """
    large = (F.col("height") > tile_size) | (F.col("width") > tile_size)
    whole = manifest.where(~large).select(
        "*",
        F.col("image_id").alias("parent_image_id"),
        F.lit(0).alias("tile_y0"),
        F.lit(0).alias("tile_x0"),
        F.col("height").alias("tile_y1"),
        F.col("width").alias("tile_x1"),
        (F.col(fraction) > 0).alias("has_foreground"),
    )
    parents = manifest.where(large)
    sized = foreground.join(parents.select("image_id", "height", "width"), "image_id")
    counts = (
        assign_to_tiles(sized, tile_size=tile_size, overlap=overlap)
        .groupBy(F.col("image_id").alias("parent_image_id"), "row_offset", "column_offset")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    grid = tile_grid(parents, tile_size=tile_size, overlap=overlap).select(
        "parent_image_id", "row_offset", "column_offset", "valid_height", "valid_width"
    )
    counted = grid.join(counts, ["parent_image_id", "row_offset", "column_offset"], "left")
    inherited = parents.select(F.col("image_id").alias("parent_image_id"), *[
        c for c in manifest.columns if c not in ("image_id", "height", "width", fraction)
    ])
    n = F.coalesce(F.col("_n"), F.lit(0))
    children = counted.join(inherited, "parent_image_id").select(
        F.format_string("%s__y%d_x%d", F.col("parent_image_id").cast("string"), "row_offset", "column_offset").alias("image_id"),
        *inherited.columns,
        F.col("valid_height").alias("height"),
        F.col("valid_width").alias("width"),
        (n / (F.col("valid_height") * F.col("valid_width"))).alias(fraction),
        F.col("row_offset").alias("tile_y0"),
        F.col("column_offset").alias("tile_x0"),
        (F.col("row_offset") + F.col("valid_height")).alias("tile_y1"),
        (F.col("column_offset") + F.col("valid_width")).alias("tile_x1"),
        (n > 0).alias("has_foreground"),
    )
    as_text = whole.withColumn("image_id", F.col("image_id").cast("string"))
    return as_text.unionByName(children)


def reconstruct_mean(tiles: DataFrame, *, value: str = "value", whole_numbers: bool = False) -> DataFrame:
    """Average of overlapping tile cells per image cell; whole numbers are cut, not rounded."""
    mean = F.avg(value)
    if whole_numbers:
        mean = F.when(mean >= 0, F.floor(mean)).otherwise(F.ceil(mean)).cast("int")
    return tiles.where("valid").groupBy("image_id", "y", "x").agg(mean.alias(value))


def uncovered_images(reconstructed: DataFrame, images: DataFrame) -> DataFrame:
    """Images for which the number of distinct cells differs from height x width."""
    cells = reconstructed.groupBy("image_id").agg(F.count(F.lit(1)).alias("cells"))
    expected = F.col("height").cast("bigint") * F.col("width")
    return images.join(cells, "image_id", "left").where(
        F.coalesce(F.col("cells"), F.lit(0)) != expected
    ).select("image_id", expected.alias("expected"), F.coalesce("cells", F.lit(0)).alias("cells"))


def assert_covered(reconstructed: DataFrame, images: DataFrame) -> DataFrame:
    raise_if_any(uncovered_images(reconstructed, images), "image_id", "Reconstruction left uncovered pixels")
    return reconstructed


def tile_count_mismatches(tiles: DataFrame, grid: DataFrame) -> DataFrame:
    """Parents whose number of supplied tiles differs from the plan."""
    supplied = tiles.groupBy("parent_image_id").agg(F.count_distinct("tile_id").alias("supplied"))
    planned = grid.groupBy("parent_image_id").agg(F.count(F.lit(1)).alias("planned"))
    joined = planned.join(supplied, "parent_image_id", "full_outer")
    return joined.where(~F.col("planned").eqNullSafe(F.col("supplied")))


def hann(position: Column, tile_size: int) -> Column:
    if tile_size == 1:
        return F.lit(1.0)
    return 0.5 - 0.5 * F.cos(2.0 * F.pi() * position / (tile_size - 1))


def blending_weight(tile_y: Column, tile_x: Column, tile_size: int) -> Column:
    return F.greatest(hann(tile_y, tile_size) * hann(tile_x, tile_size), F.lit(MINIMUM_WEIGHT))


def stitch_hann(tiles: DataFrame, tile_size: int, *, prob: str = "prob") -> DataFrame:
    """Hann-weighted mean of overlapping tile probabilities."""
    weight = blending_weight(F.col("tile_y"), F.col("tile_x"), tile_size)
    return (
        tiles.select("image_id", "y", "x", (weight * F.col(prob)).alias("_wp"), weight.alias("_w"))
        .groupBy("image_id", "y", "x")
        .agg((F.sum("_wp") / F.greatest(F.sum("_w"), F.lit(MINIMUM_WEIGHT_SUM))).alias(prob))
    )


def stitch_and_threshold(tiles: DataFrame, tile_size: int, threshold: float) -> DataFrame:
    return stitch_hann(tiles, tile_size).withColumn("mask", binarise(F.col("prob"), threshold))


def mosaic_repeats(length: Column, tile_size: int, overlap: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.lit(2 * tile_size - overlap) / length)).cast("int")


def multitile_mosaic(
    pixels: DataFrame, *, tile_size: int, overlap: int
) -> DataFrame:
    """Repeat each image until both axes exceed the tile. ``pixels`` carries height and width."""
    down = mosaic_repeats(F.col("height"), tile_size, overlap)
    across = mosaic_repeats(F.col("width"), tile_size, overlap)
    copies = pixels.withColumn("_ry", F.explode(F.sequence(F.lit(0), down - 1))).withColumn(
        "_rx", F.explode(F.sequence(F.lit(0), across - 1))
    )
    return copies.withColumns(
        {
            "y": F.col("y") + F.col("_ry") * F.col("height"),
            "x": F.col("x") + F.col("_rx") * F.col("width"),
            "height": F.col("height") * down,
            "width": F.col("width") * across,
        }
    ).drop("_ry", "_rx")


def window_geometry(tiles: DataFrame, transform: Sequence[str] = ("a", "b", "c", "d", "e", "f")) -> DataFrame:
    """Affine origin of a tile and bounds of its valid part from the source transform."""
    a, b, c, d, e, f = (F.col(t) for t in transform)
    x0, y0 = F.col("column_offset"), F.col("row_offset")
    x1, y1 = x0 + F.col("valid_width"), y0 + F.col("valid_height")

    def east(x: Column, y: Column) -> Column:
        return c + a * x + b * y

    def north(x: Column, y: Column) -> Column:
        return f + d * x + e * y

    return tiles.withColumns(
        {
            "tile_c": east(x0, y0),
            "tile_f": north(x0, y0),
            "bounds_left": F.least(east(x0, y1), east(x1, y0), east(x0, y0), east(x1, y1)),
            "bounds_bottom": F.least(north(x0, y1), north(x1, y0), north(x0, y0), north(x1, y1)),
            "bounds_right": F.greatest(east(x0, y1), east(x1, y0), east(x0, y0), east(x1, y1)),
            "bounds_top": F.greatest(north(x0, y1), north(x1, y0), north(x0, y0), north(x1, y1)),
        }
    )


def canvas_geometry(images: DataFrame, size: int, policy: str = "letterbox") -> DataFrame:
    """Resize and padding geometry for a square canvas."""
    w, h = F.col("width"), F.col("height")
    if policy == "stretch":
        resized_w, resized_h = F.lit(size), F.lit(size)
    elif policy == "letterbox":
        scale = F.least(F.lit(float(size)) / w, F.lit(float(size)) / h)
        resized_w = F.greatest(F.lit(1), F.bround(w * scale).cast("int"))
        resized_h = F.greatest(F.lit(1), F.bround(h * scale).cast("int"))
    else:
        raise ValueError(f"Unsupported resize policy: {policy}")
    left = F.floor((F.lit(size) - resized_w) / 2).cast("int")
    top = F.floor((F.lit(size) - resized_h) / 2).cast("int")
    return images.withColumns(
        {
            "policy": F.lit(policy),
            "canvas_size": F.lit(size),
            "resized_width": resized_w,
            "resized_height": resized_h,
            "pad_left": left,
            "pad_top": top,
            "pad_right": F.lit(size) - resized_w - left,
            "pad_bottom": F.lit(size) - resized_h - top,
        }
    )


def padded_labels(
    labels: DataFrame, geometry: DataFrame, pad_value: int = 255, *, label: str = "label"
) -> DataFrame:
    """Nearest-neighbour labels on the canvas, padding cells with the ignore value.

    ``geometry`` comes from canvas_geometry; cells without a label row are 0.
    """
    side = F.sequence(F.lit(0), F.col("canvas_size") - 1)
    cells = geometry.withColumn("cy", F.explode(side)).withColumn("cx", F.explode(side))
    inner_y, inner_x = F.col("cy") - F.col("pad_top"), F.col("cx") - F.col("pad_left")
    inside = (
        (inner_y >= 0)
        & (inner_y < F.col("resized_height"))
        & (inner_x >= 0)
        & (inner_x < F.col("resized_width"))
    )
    # The source cell under the centre of the canvas cell.
    source_y = F.floor((inner_y + 0.5) * F.col("height") / F.col("resized_height")).cast("int")
    source_x = F.floor((inner_x + 0.5) * F.col("width") / F.col("resized_width")).cast("int")
    placed = cells.select(
        "image_id",
        "cy",
        "cx",
        inside.alias("_inside"),
        F.when(inside, source_y).alias("y"),
        F.when(inside, source_x).alias("x"),
    )
    joined = placed.join(labels.select("image_id", "y", "x", label), ["image_id", "y", "x"], "left")
    value = F.when(F.col("_inside"), F.coalesce(F.col(label), F.lit(0))).otherwise(F.lit(pad_value))
    return joined.select("image_id", "cy", "cx", value.cast("int").alias(label))


def restore_from_canvas(
    canvas: DataFrame, geometry: DataFrame, *, prob: str = "prob"
) -> DataFrame:
    """Undo the padding and bring canvas probabilities back to the source grid.

    Bilinear with half-pixel centres and clamped borders; each source cell joins
    its four neighbours by coordinate.
    """
    rows = geometry.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("height") - 1))).withColumn(
        "x", F.explode(F.sequence(F.lit(0), F.col("width") - 1))
    )

    def corners(position: Column, source: Column, resized: Column, pad: Column) -> Column:
        at = (position + 0.5) * resized / source - 0.5
        low, part = F.floor(at), at - F.floor(at)

        def place(step: int) -> Column:
            return (F.least(F.greatest(low + step, F.lit(0)), resized - 1) + pad).cast("int")

        return F.array(
            F.struct(place(0).alias("at"), (1.0 - part).alias("w")),
            F.struct(place(1).alias("at"), part.alias("w")),
        )

    ys = corners(F.col("y"), F.col("height"), F.col("resized_height"), F.col("pad_top"))
    xs = corners(F.col("x"), F.col("width"), F.col("resized_width"), F.col("pad_left"))
    wanted = (
        rows.select("image_id", "y", "x", F.explode(ys).alias("_y"), xs.alias("_xs"))
        .select("image_id", "y", "x", "_y", F.explode("_xs").alias("_x"))
        .select(
            "image_id",
            "y",
            "x",
            F.col("_y.at").alias("cy"),
            F.col("_x.at").alias("cx"),
            (F.col("_y.w") * F.col("_x.w")).alias("_w"),
        )
        .where("_w > 0")
    )
    joined = wanted.join(canvas.select("image_id", "cy", "cx", prob), ["image_id", "cy", "cx"])
    return joined.groupBy("image_id", "y", "x").agg(F.sum(F.col("_w") * F.col(prob)).alias(prob))
