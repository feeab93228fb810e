"""Connected components of sparse masks and what follows from them.

Rows are cut into runs first. Runs are labelled inside bands of rows, where a
group is bounded by the band; only components that touch a band edge take part
in the merge across bands, which contracts a small graph round by round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from rasterledger.operators.ordered import top_k_per_group
from rasterledger.operators.raster import (
    BAND_ROWS,
    boundary,
    bounding_boxes,
    farthest_background,
    open_close,
)
from rasterledger.session import pin


def row_runs(mask: DataFrame) -> DataFrame:
    """Maximal horizontal runs (image_id, y, x0, x1)."""
    row = Window.partitionBy("image_id", "y").orderBy("x")
    island = F.col("x") - F.row_number().over(row)
    return (
        mask.select("image_id", "y", "x", island.alias("_island"))
        .groupBy("image_id", "y", "_island")
        .agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
        .drop("_island")
    )


def background_runs(runs: DataFrame, images: DataFrame) -> DataFrame:
    """Runs of the complement, from the gaps between runs."""
    rows = images.select(
        "image_id", "width", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y")
    )
    # A run past the right border closes the last gap of each row.
    stops = rows.select("image_id", "y", F.col("width").alias("x0"), F.col("width").alias("x1"))
    row = Window.partitionBy("image_id", "y").orderBy("x0")
    before = F.coalesce(F.lag("x1").over(row), F.lit(-1))
    gaps = runs.select("image_id", "y", "x0", "x1").unionByName(stops).select(
        "image_id", "y", (before + 1).alias("_from"), (F.col("x0") - 1).alias("_to")
    )
    return gaps.where("_to >= _from").select("image_id", "y", F.col("_from").alias("x0"), F.col("_to").alias("x1"))


def _label_groups(runs: pd.DataFrame, reach: int) -> pd.DataFrame:
    """Label the runs of whole bands, rows sorted by band, y and x0.

    Bands are numbered in sequence and every number opens a fresh range of row
    keys, so one pass of array operations serves all bands of a batch.
    """
    y, x0, x1 = (runs[c].to_numpy().astype(np.int64) for c in ("y", "x0", "x1"))
    image, band = runs["image_id"], runs["_band"]
    fresh = ((image != image.shift()) | (band != band.shift())).to_numpy()
    width, height = int(x1.max()) + 3, int(y.max()) + 3
    row = np.cumsum(fresh) * height + y
    # Runs of the next row that can touch run i form one contiguous slice.
    start = np.searchsorted(row * width + x1, (row + 1) * width + x0 - reach, side="left")
    stop = np.searchsorted(row * width + x0, (row + 1) * width + x1 + reach, side="right")
    counts = np.maximum(stop - start, 0)
    left = np.repeat(np.arange(len(y)), counts)
    right = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(start, counts)
    parent = np.arange(len(y))
    while True:
        low = np.minimum(parent[left], parent[right])
        merged = parent.copy()
        np.minimum.at(merged, parent[left], low)
        np.minimum.at(merged, parent[right], low)
        while not np.array_equal(merged, merged[merged]):
            merged = merged[merged]
        if np.array_equal(merged, parent):
            break
        parent = merged
    return runs.assign(ly=y[parent], lx=x0[parent])[["image_id", "y", "x0", "x1", "ly", "lx"]]


def _label_bands(connectivity: int):
    reach = 1 if connectivity == 8 else 0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            if held is not None:
                batch = pd.concat([held, batch], ignore_index=True)
            if not len(batch):
                continue
            # The last band of a batch may go on in the next one.
            image, band = batch["image_id"], batch["_band"]
            last = ((image == image.iloc[-1]) & (band == band.iloc[-1])).to_numpy()
            cut = int(np.argmax(last))
            if cut:
                yield _label_groups(batch.iloc[:cut], reach)
            held = batch.iloc[cut:]
        if held is not None and len(held):
            yield _label_groups(held, reach)

    return run


def _edge_pixels(labelled: DataFrame, position: int, band_rows: int) -> DataFrame:
    """Cells of the first or last row of each band with their label."""
    edge = labelled.where(F.col("y") % band_rows == position)
    return edge.select("image_id", "y", F.explode(F.sequence("x0", "x1")).alias("x"), "label")


def _merge_labels(edges: DataFrame) -> DataFrame:
    """(label, root) of the components of an undirected label graph.

    Alternates the two star contractions until the edge set is stable; the
    number of rounds grows with the logarithm of the longest chain.
    """
    current = pin(edges.distinct())
    previous = None
    while True:
        # Large star: every neighbour above the node points at the node's minimum.
        both = current.select("u", "v").unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lows = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(lows, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: every neighbour below points at the minimum.
        down = large.where("u > v").distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        linked = down.join(least, "u")
        small = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            linked.select("u", F.col("m").alias("v"))
        )
        current = pin(small.where("u > v").distinct())
        state = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == previous:
            return current.select(F.col("u").alias("label"), F.col("v").alias("root"))
        previous = state


def label_runs(runs: DataFrame, *, connectivity: int = 8, band_rows: int = BAND_ROWS) -> DataFrame:
    """Runs with the label of their component; labels are (row, column) texts of a first run."""
    if connectivity not in (4, 8):
        raise ValueError("connectivity must be 4 or 8")
    schema = "image_id {}, y int, x0 int, x1 int, ly int, lx int".format(
        dict(runs.dtypes)["image_id"]
    )
    typed = runs.select(
        "image_id", F.col("y").cast("int").alias("y"), F.col("x0").cast("int").alias("x0"), F.col("x1").cast("int").alias("x1")
    )
    # Bands stay whole in a partition and arrive in order; one may span Arrow batches.
    banded = (
        typed.withColumn("_band", F.floor(F.col("y") / band_rows))
        .repartition("image_id", "_band")
        .sortWithinPartitions("image_id", "_band", "y", "x0")
    )
    local = banded.mapInPandas(_label_bands(connectivity), schema)
    labelled = pin(
        local.select(
            "image_id", "y", "x0", "x1", F.struct("image_id", "ly", "lx").alias("label")
        )
    )
    lower = _edge_pixels(labelled, band_rows - 1, band_rows)
    upper = _edge_pixels(labelled, 0, band_rows).where("y > 0").select(
        "image_id", (F.col("y") - 1).alias("y"), "x", F.col("label").alias("other")
    )
    steps = F.array(*[F.lit(s) for s in ((-1, 0, 1) if connectivity == 8 else (0,))])
    reached = lower.withColumn("_d", F.explode(steps)).withColumn("x", F.col("x") + F.col("_d")).drop("_d")
    links = (
        reached.join(upper, ["image_id", "y", "x"])
        .select(F.greatest("label", "other").alias("u"), F.least("label", "other").alias("v"))
        .where("u > v")
        .distinct()
    )
    links = pin(links)
    if links.isEmpty():
        return labelled.withColumn("label", _label_text("label"))
    roots = _merge_labels(links)
    joined = labelled.join(roots, "label", "left")
    return joined.select(
        "image_id", "y", "x0", "x1", F.coalesce("root", "label").alias("label")
    ).withColumn("label", _label_text("label"))


def _label_text(label: str) -> Column:
    return F.format_string("%06d_%06d", F.col(f"{label}.ly"), F.col(f"{label}.lx"))


def component_table(labelled: DataFrame) -> DataFrame:
    """Area, extent and centroid of every component."""
    length = F.col("x1") - F.col("x0") + 1
    middle = (F.col("x0") + F.col("x1")) / 2.0
    return labelled.groupBy("image_id", "label").agg(
        F.sum(length).alias("area"),
        (F.sum(middle * length) / F.sum(length)).alias("centroid_x"),
        (F.sum(F.col("y") * length) / F.sum(length)).alias("centroid_y"),
        F.min("x0").alias("x0"),
        F.min("y").alias("y0"),
        F.max("x1").alias("x1"),
        F.max("y").alias("y1"),
    )


def runs_to_pixels(runs: DataFrame) -> DataFrame:
    return runs.select("image_id", "y", F.explode(F.sequence("x0", "x1")).alias("x"))


def remove_small_components(mask: DataFrame, min_area: int, *, connectivity: int = 8) -> DataFrame:
    """Pixels of components with at least ``min_area`` pixels."""
    labelled = label_runs(row_runs(mask), connectivity=connectivity)
    kept = component_table(labelled).where(F.col("area") >= min_area).select("image_id", "label")
    return runs_to_pixels(labelled.join(kept, ["image_id", "label"], "left_semi"))


def fill_holes(mask: DataFrame, images: DataFrame) -> DataFrame:
    """Mask with every background region added that does not reach the image border."""
    runs = row_runs(mask)
    outside = label_runs(background_runs(runs, images), connectivity=4)
    inner = (
        component_table(outside)
        .join(images.select("image_id", "height", "width"), "image_id")
        .where("x0 > 0 and y0 > 0 and x1 < width - 1 and y1 < height - 1")
        .select("image_id", "label")
    )
    holes = outside.join(inner, ["image_id", "label"], "left_semi")
    return runs_to_pixels(runs.unionByName(holes.select("image_id", "y", "x0", "x1")))


def component_points(
    mask: DataFrame, *, max_points: int, min_area: int
) -> tuple[DataFrame, DataFrame]:
    """Centre points of the largest components, and the component count per image.

    The rounded centroid moves to the middle member pixel in row order if it
    lies outside its component.
    """
    labelled = label_runs(row_runs(mask), connectivity=8)
    table = pin(component_table(labelled).where(F.col("area") >= min_area))
    counts = table.groupBy("image_id").agg(F.count(F.lit(1)).alias("components"))
    top = top_k_per_group(
        table, ["image_id"], [F.desc("area"), F.col("label")], max_points, spread_on=["label"]
    ).select(
        "image_id",
        "label",
        "position",
        "area",
        F.bround("centroid_x").cast("int").alias("cx"),
        F.bround("centroid_y").cast("int").alias("cy"),
    )
    members = labelled.join(top.select("image_id", "label", "cx", "cy", "area"), ["image_id", "label"])
    # Pixels before a run, in row order, give the run that holds the middle pixel.
    per_row = members.groupBy("image_id", "label", "y").agg(
        F.sum(F.col("x1") - F.col("x0") + 1).alias("_n")
    )
    by_row = Window.partitionBy("image_id", "label").orderBy("y").rowsBetween(Window.unboundedPreceding, -1)
    in_row = Window.partitionBy("image_id", "label", "y").orderBy("x0").rowsBetween(Window.unboundedPreceding, -1)
    placed = members.join(
        per_row.withColumn("_above", F.coalesce(F.sum("_n").over(by_row), F.lit(0))), ["image_id", "label", "y"]
    ).withColumn(
        "_first",
        F.col("_above") + F.coalesce(F.sum(F.col("x1") - F.col("x0") + 1).over(in_row), F.lit(0)),
    )
    half = F.floor(F.col("area") / 2)
    inside = (F.col("y") == F.col("cy")) & (F.col("cx") >= F.col("x0")) & (F.col("cx") <= F.col("x1"))
    holds = (half >= F.col("_first")) & (half < F.col("_first") + F.col("x1") - F.col("x0") + 1)
    spots = placed.groupBy("image_id", "label").agg(
        F.bool_or(inside).alias("_inside"),
        F.max(F.when(holds, F.col("x0") + half - F.col("_first"))).alias("_mx"),
        F.max(F.when(holds, F.col("y"))).alias("_my"),
    )
    points = top.join(spots, ["image_id", "label"]).select(
        "image_id",
        "position",
        "area",
        F.when(F.col("_inside"), F.col("cx")).otherwise(F.col("_mx")).cast("int").alias("x"),
        F.when(F.col("_inside"), F.col("cy")).otherwise(F.col("_my")).cast("int").alias("y"),
    )
    return points, counts


def automatic_prompts(
    pixels: DataFrame,
    images: DataFrame,
    *,
    threshold: float = 0.5,
    max_points: int = 3,
    negatives: int = 1,
    min_area: int = 16,
    padding: float = 0.04,
    kernel: int = 3,
) -> DataFrame:
    """Status, component count, box and points per image from a coarse probability table."""
    coarse = pixels.where(F.col("prob") >= threshold).select("image_id", "y", "x")
    mask = pin(open_close(coarse, kernel, images))
    points, counts = component_points(mask, max_points=max_points, min_area=min_area)
    positive = points.select("image_id", F.struct(F.lit(1).alias("label"), "position", "x", "y").alias("_p"))
    found = counts.select("image_id")
    masked = mask.join(found, "image_id", "left_semi")
    listed = positive
    if negatives > 0:
        away = farthest_background(masked, images.join(found, "image_id", "left_semi"), negatives)
        listed = positive.unionByName(
            away.select("image_id", F.struct(F.lit(0).alias("label"), "position", "x", "y").alias("_p"))
        )
    # max_points + negatives entries per image.
    prompts = listed.groupBy("image_id").agg(F.array_sort(F.collect_list("_p")).alias("points"))
    boxes = bounding_boxes(masked, images, padding=padding)
    box = F.array("x0", "y0", "x1", "y1")
    joined = (
        images.select("image_id")
        .join(counts, "image_id", "left")
        .join(prompts, "image_id", "left")
        .join(boxes, "image_id", "left")
    )
    ok = F.col("components").isNotNull()
    return joined.select(
        "image_id",
        F.when(ok, "ok").otherwise("no_coarse_candidate").alias("status"),
        F.coalesce("components", F.lit(0)).cast("bigint").alias("components"),
        F.when(ok, box).alias("box"),
        F.when(ok, F.col("points")).alias("points"),
    )


def topology_slices(mask: DataFrame, images: DataFrame) -> DataFrame:
    """Component count, topology label and boundary complexity per image."""
    labelled = label_runs(row_runs(mask), connectivity=4)
    per_component = component_table(labelled).groupBy("image_id").agg(
        F.count(F.lit(1)).alias("components"), F.sum("area").alias("area")
    )
    edge = boundary(mask).groupBy("image_id").agg(F.count(F.lit(1)).alias("boundary"))
    joined = (
        images.select("image_id")
        .join(per_component, "image_id", "left")
        .join(edge, "image_id", "left")
        .na.fill(0)
    )
    n = F.col("components")
    return joined.select(
        "image_id",
        n.alias("connected_components"),
        F.when(n == 0, "no_foreground").when(n == 1, "single_component").otherwise("multiple_components").alias("topology_slice"),
        (F.col("boundary") / F.greatest(F.col("area"), F.lit(1))).alias("boundary_complexity"),
    )
