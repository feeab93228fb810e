"""Mask geometry on sparse foreground pixel tables (image_id, y, x).

Neighbourhood work runs inside bands of rows. A band carries a halo of the rows
around it, so one shuffle by (image, band) serves all windows of an operator and
a single huge image spreads over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from rasterledger.functions.hashing import stable_hash32
from rasterledger.functions.scalars import ratio
from rasterledger.operators import words
from rasterledger.operators.distances import farthest_cells, nearest_distance
from rasterledger.operators.ordered import exact_quantiles, top_k_per_group
from rasterledger.session import pin

BAND_ROWS = 64
_PIXEL = ("image_id", "y", "x")


def with_bands(pixels: DataFrame, halo: int, band_rows: int = BAND_ROWS) -> DataFrame:
    """Copy pixels into every band whose rows, widened by the halo, contain them.

    The number of tasks is that of the session's shuffles. Left to itself, adaptive execution
    would join small shuffle parts into few tasks before the steps in the bands multiply their rows.
    """
    low = F.floor((F.col("y") - halo) / band_rows).cast("int")
    high = F.floor((F.col("y") + halo) / band_rows).cast("int")
    banded = pixels.withColumn("_band", F.explode(F.sequence(F.greatest(low, F.lit(0)), high)))
    tasks = int(pixels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return banded.repartition(tasks, "image_id", "_band")


def band_core(df: DataFrame, band_rows: int = BAND_ROWS) -> DataFrame:
    """Drop halo rows."""
    return df.where(F.floor(F.col("y") / band_rows) == F.col("_band")).drop("_band")


def _row(*extra: str) -> Window:
    return Window.partitionBy("image_id", "_band", *extra, "y").orderBy("x")


def _column(*extra: str) -> Window:
    return Window.partitionBy("image_id", "_band", *extra, "x").orderBy("y")


def erode(mask: DataFrame, radius: int, *, border: str = "foreground") -> DataFrame:
    """Erosion with a (2r+1) square. ``mask`` carries height and width."""
    return words.morphology(mask, [("erode", radius)], border=border)


def dilate(mask: DataFrame, radius: int) -> DataFrame:
    return words.morphology(mask, [("dilate", radius)])


def open_close(mask: DataFrame, kernel: int, images: DataFrame | None = None) -> DataFrame:
    """Opening, then closing, with a square kernel; one shuffle for all four steps of a narrow one.

    Sizes are columns of ``mask``, or come from ``images``.
    """
    radius = kernel // 2
    if radius < 1:
        return mask if images is None else mask.join(images.select("image_id", "height", "width"), "image_id")
    return words.morphology(mask, [("erode", radius), ("dilate", radius), ("dilate", radius), ("erode", radius)], images=images)


# --- boundaries ---------------------------------------------------------------


def _cross_boundary(banded: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Pixels with a 4-neighbour that is background; outside counts as background."""
    row, column = _row(*extra), _column(*extra)
    beside = (F.lag("x").over(row) == F.col("x") - 1) & (F.lead("x").over(row) == F.col("x") + 1)
    above = (F.lag("y").over(column) == F.col("y") - 1) & (F.lead("y").over(column) == F.col("y") + 1)
    marked = banded.withColumn("_h", F.coalesce(beside, F.lit(False))).withColumn(
        "_v", F.coalesce(above, F.lit(False))
    )
    return marked.where(~(F.col("_h") & F.col("_v"))).drop("_h", "_v")


def _square_boundary(banded: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Pixels that a 3x3 erosion removes; the image border itself is not eroded."""
    row = _row(*extra).rangeBetween(-1, 1)
    column = _column(*extra).rangeBetween(-1, 1)
    wide = F.least(F.col("x") + 1, F.col("width") - 1) - F.greatest(F.col("x") - 1, F.lit(0)) + 1
    tall = F.least(F.col("y") + 1, F.col("height") - 1) - F.greatest(F.col("y") - 1, F.lit(0)) + 1
    full_row = banded.withColumn("_full", (F.count(F.lit(1)).over(row) == wide).cast("int"))
    marked = full_row.withColumn("_inside", F.sum("_full").over(column) == tall)
    return marked.where(~F.col("_inside")).drop("_full", "_inside")


def boundary(mask: DataFrame, rule: str = "cross") -> DataFrame:
    """Boundary pixels of a foreground table. Rule "square" needs height and width."""
    banded = with_bands(mask, 1)
    return band_core(_cross_boundary(banded) if rule == "cross" else _square_boundary(banded))


def _both_boundaries(cells: DataFrame, rule: str, halo: int) -> DataFrame:
    """Boundary pixels of prediction and target, marked by side, still in bands.

    ``cells`` has 0/1 columns pred and target.
    """
    sides = F.array_compact(
        F.array(F.when(F.col("pred") == 1, "pred"), F.when(F.col("target") == 1, "target"))
    )
    size = [c for c in ("height", "width") if c in cells.columns]
    foreground = cells.select(*_PIXEL, *size, F.explode(sides).alias("side"))
    banded = with_bands(foreground, halo)
    find = _cross_boundary if rule == "cross" else _square_boundary
    return find(banded, ["side"])


def boundary_counts(cells: DataFrame, *, tolerance: int = 2, rule: str = "cross") -> DataFrame:
    """Per image: boundary sizes, matches within the square tolerance, overlap and union."""
    edges = _both_boundaries(cells, rule, tolerance + 1).select("_band", *_PIXEL, "side")
    # A pixel also shows up in the rows it can match; along x a range frame does the rest.
    reach = F.sequence(F.lit(-tolerance), F.lit(tolerance))
    near = edges.select("*", F.explode(reach).alias("_dy")).select(
        "image_id", "_band", (F.col("y") + F.col("_dy")).alias("y"), "x", "side", (F.col("_dy") == 0).alias("_own")
    )
    around = (
        Window.partitionBy("image_id", "_band", "y").orderBy("x").rangeBetween(-tolerance, tolerance)
    )
    here = Window.partitionBy("image_id", "_band", "y").orderBy("x").rangeBetween(0, 0)
    is_pred, is_target = F.col("side") == "pred", F.col("side") == "target"
    matched = (
        near.withColumn("_near_pred", F.max(is_pred.cast("int")).over(around))
        .withColumn("_near_target", F.max(is_target.cast("int")).over(around))
        .withColumn("_both", F.sum(F.col("_own").cast("int")).over(here) == 2)
        .where("_own")
    )
    core = band_core(matched)
    counts = core.groupBy("image_id").agg(
        F.count_if(is_pred).alias("pred_boundary"),
        F.count_if(is_target).alias("target_boundary"),
        F.count_if(is_pred & (F.col("_near_target") == 1)).alias("matched_pred"),
        F.count_if(is_target & (F.col("_near_pred") == 1)).alias("matched_target"),
        F.count_if(is_pred & F.col("_both")).alias("intersection"),
    )
    return counts.withColumn(
        "union", F.col("pred_boundary") + F.col("target_boundary") - F.col("intersection")
    )


def boundary_metrics(
    cells: DataFrame, images: DataFrame, *, tolerance: int = 2, rule: str = "cross"
) -> DataFrame:
    """Boundary precision, recall, F1 and IoU for every image of ``images``."""
    counts = boundary_counts(cells, tolerance=tolerance, rule=rule)
    joined = images.select("image_id").join(counts, "image_id", "left").na.fill(0)
    empty = (F.col("pred_boundary") == 0) & (F.col("target_boundary") == 0)
    named = joined.withColumn(
        "boundary_precision",
        F.when(empty, 1.0).otherwise(ratio(F.col("matched_pred"), F.col("pred_boundary"), 0.0)),
    ).withColumn(
        "boundary_recall",
        F.when(empty, 1.0).otherwise(ratio(F.col("matched_target"), F.col("target_boundary"), 0.0)),
    )
    p, r = F.col("boundary_precision"), F.col("boundary_recall")
    return named.select(
        "image_id",
        "boundary_precision",
        "boundary_recall",
        ratio(2.0 * p * r, p + r, 0.0).alias("boundary_f1"),
        ratio(F.col("intersection"), F.col("union"), 1.0).alias("boundary_iou"),
    )


# --- distances ----------------------------------------------------------------


def surface_distances(cells: DataFrame, images: DataFrame, *, rule: str = "cross") -> DataFrame:
    """95th percentile and mean of both directed boundary distances per image.

    Both boundaries empty gives 0. One empty gives NULL under rule "cross" and the
    image diagonal under rule "square", which needs height and width in ``images``.
    """
    # Boundary pixels are few next to the cells and are needed as queries and as targets.
    edges = pin(band_core(_both_boundaries(cells, rule, 1)).select(*_PIXEL, "side"))
    flipped = edges.withColumn("side", F.when(F.col("side") == "pred", "target").otherwise("pred"))
    distances = pin(nearest_distance(flipped, edges, ["image_id", "side"]))
    quantiles = exact_quantiles(distances, "distance", {"hd95": 0.95}, groups=["image_id"])
    means = distances.groupBy("image_id").agg(F.avg("distance").alias("assd"))
    present = edges.groupBy("image_id").agg(F.count_distinct("side").alias("_sides"))
    joined = (
        images.join(present, "image_id", "left")
        .join(means, "image_id", "left")
        .join(quantiles, "image_id", "left")
    )
    lonely = (
        F.hypot(F.col("height").cast("double"), F.col("width").cast("double"))
        if rule == "square"
        else F.lit(None).cast("double")
    )

    def pick(name: str) -> Column:
        return (
            F.when(F.col("_sides").isNull(), 0.0).when(F.col("_sides") == 1, lonely).otherwise(F.col(name)).alias(name)
        )

    return joined.select("image_id", pick("hd95"), pick("assd"))


# --- boxes, points, classes ---------------------------------------------------


def bounding_boxes(
    mask: DataFrame,
    images: DataFrame,
    *,
    padding: float = 0.0,
    jitter: float = 0.0,
    seed: int = 42,
) -> DataFrame:
    """Foreground box per image, padded or jittered and clipped; empty masks get the full frame."""
    extent = mask.groupBy("image_id").agg(
        F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1")
    )
    joined = images.select("image_id", "height", "width").join(extent, "image_id", "left")
    pad_x = F.bround(F.col("width") * padding).cast("int")
    pad_y = F.bround(F.col("height") * padding).cast("int")

    def shifted(name: str, length: str, sign: int, pad: Column) -> Column:
        span = F.bround(F.col(length) * jitter).cast("bigint")
        draw = stable_hash32(F.concat_ws(":", "image_id", F.lit(name)), seed) % (2 * span + 1) - span
        moved = F.col(name) + sign * pad + (draw if jitter else F.lit(0))
        return F.least(F.greatest(moved, F.lit(0)), F.col(length) - 1)

    x0, x1 = shifted("x0", "width", -1, pad_x), shifted("x1", "width", 1, pad_x)
    y0, y1 = shifted("y0", "height", -1, pad_y), shifted("y1", "height", 1, pad_y)
    empty = F.col("x0").isNull()

    def corner(value: Column, fallback: Column) -> Column:
        return F.when(empty, fallback).otherwise(value).cast("int")

    return joined.select(
        "image_id",
        corner(F.least(x0, x1), F.lit(0)).alias("x0"),
        corner(F.least(y0, y1), F.lit(0)).alias("y0"),
        corner(F.greatest(x0, x1), F.col("width") - 1).alias("x1"),
        corner(F.greatest(y0, y1), F.col("height") - 1).alias("y1"),
    )


def dense_cells(images: DataFrame) -> DataFrame:
    """Every cell of every image."""
    return images.select(
        "image_id", "height", "width", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y")
    ).select("*", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("x"))


def _background_blocks(packed: DataFrame, images: DataFrame, halo: int) -> DataFrame:
    """Blocks of all images with the cells that the mask leaves free, halo included."""
    rows = images.where("height > 0 and width > 0").select(
        "image_id", "height", "width", F.explode(F.sequence(F.lit(0), words.last_block("height", halo))).alias("_by")
    )
    every = rows.select("*", F.explode(F.sequence(F.lit(0), words.last_block("width", halo))).alias("_bx"))
    met = every.join(packed.drop("height", "width").hint("merge"), ["image_id", "_by", "_bx"], "left")
    held = F.coalesce("_w", F.array_repeat(F.lit(0).cast("bigint"), words.SIDE))
    return words.dealt(met).withColumn("_w", F.transform(held, F.bitwise_not))


def _eroded_or_whole(blocks: DataFrame) -> DataFrame:
    """Own cells of blocks: the eroded ones ``_in``, or ``_w`` in images where nothing is left."""
    kept = blocks.groupBy("image_id").agg((F.sum(words.cells(F.col("_in"))) > 0).alias("_kept"))
    chosen = F.when(F.col("_kept"), F.col("_in")).otherwise(F.col("_w"))
    return blocks.join(kept.hint("merge"), "image_id").withColumn("_w", chosen).drop("_in", "_kept")


def _first_draws(blocks: DataFrame, halo: int, k: int, seed: int) -> DataFrame:
    """The k cells with the smallest draws of each block and kind, so no more than these are ever rows."""

    def row_draws(word: Column, row: Column) -> Column:
        def draw(bit: Column) -> Column:
            y, x = words.place(row, bit, halo)
            return F.struct(stable_hash32(F.concat_ws(":", "image_id", y, x, "kind"), seed).alias("_draw"), y.alias("y"), x.alias("x"))

        return F.transform(words.bits_of(word, halo), draw)

    first = F.slice(F.array_sort(F.flatten(F.transform("_w", row_draws))), 1, k)
    return words.dealt(blocks).select("image_id", "kind", F.explode(first).alias("_c")).select("image_id", "kind", "_c.*")


def prompt_points(
    mask: DataFrame, images: DataFrame, *, positives: int, negatives: int, seed: int = 42
) -> DataFrame:
    """Seeded point prompts: k foreground and m background points per image.

    Images without foreground take their k points from the background, labelled 0;
    images without background get m points at the origin. A region with fewer
    cells than points repeats them in turn. ``mask`` carries height and width.
    """
    if positives <= 0 and negatives <= 0:
        raise ValueError("positives or negatives must be positive")
    k, halo = max(positives, negatives), 3
    packed = pin(words.pack(mask, halo, ["height", "width"]))
    inside = pin(words.stepped(packed, [("erode", 2)], halo))
    outside = pin(words.stepped(_background_blocks(packed, images, halo), [("erode", 3)], halo))
    areas = inside.groupBy("image_id").agg(F.sum(words.cells(F.col("_w"))).alias("_area"))
    inner = _first_draws(_eroded_or_whole(inside).withColumn("kind", F.lit("positive")), halo, k, seed)
    # Each background cell serves as a negative and, in an empty image, as a positive too.
    kinds = F.array_compact(F.array(F.lit("negative"), F.when(F.coalesce("_area", F.lit(0)) == 0, F.lit("positive"))))
    outer = _eroded_or_whole(outside).join(areas.hint("merge"), "image_id", "left").withColumn("kind", F.explode(kinds))
    drawn = pin(inner.withColumn("label", F.lit(1)).unionByName(_first_draws(outer, halo, k, seed).withColumn("label", F.lit(0))))
    wanted = F.when(F.col("kind") == "positive", positives).otherwise(negatives)
    top = top_k_per_group(
        drawn, ["image_id", "kind"], [F.col("_draw"), F.col("y"), F.col("x")], k, spread_on=["y", "x"], out="_i"
    ).where(F.col("_i") <= wanted)
    members = top.withColumn("_m", F.max("_i").over(Window.partitionBy("image_id", "kind")))
    # Row i stands for the draws i, i + m, i + 2m, ... up to the number wanted.
    points = members.withColumn("draw", F.explode(F.sequence(F.col("_i"), wanted, F.col("_m")))).select(
        "image_id", "kind", "draw", "x", "y", "label"
    )
    if negatives <= 0:
        return points
    covered = F.col("_area") == F.col("height").cast("bigint") * F.col("width")
    origin = images.join(areas, "image_id").where(covered).select(
        "image_id",
        F.lit("negative").alias("kind"),
        F.explode(F.sequence(F.lit(1), F.lit(negatives))).alias("draw"),
        F.lit(0).alias("x"),
        F.lit(0).alias("y"),
        F.lit(0).alias("label"),
    )
    return points.unionByName(origin)


def farthest_background(mask: DataFrame, images: DataFrame, k: int) -> DataFrame:
    """k background cells per image with the largest distance to the mask."""
    return farthest_cells(mask, images, k)


def error_classes(cells: DataFrame) -> DataFrame:
    """TP, FP, FN or TN per cell."""
    p, t = F.col("pred") == 1, F.col("target") == 1
    label = F.when(p & t, "TP").when(p, "FP").when(t, "FN").otherwise("TN")
    return cells.withColumn("error_class", label)


def error_class_counts(cells: DataFrame, height: Column | str = "height", width: Column | str = "width") -> DataFrame:
    """(image_id, error_class, cells) over all pixels; those without a row are true negatives."""
    height, width = (F.col(c) if isinstance(c, str) else c for c in (height, width))
    sized = error_classes(cells).select("image_id", "error_class", (height * width).cast("bigint").alias("_area"))
    counts = sized.groupBy("image_id", "_area").agg(
        *[F.count_if(F.col("error_class") == name).alias(name) for name in ("TP", "FP", "FN")]
    )
    every = counts.withColumn("TN", F.col("_area") - F.col("TP") - F.col("FP") - F.col("FN"))
    return every.unpivot("image_id", ["TP", "FP", "FN", "TN"], "error_class", "cells").where("cells > 0")
