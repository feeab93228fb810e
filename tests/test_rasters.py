import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import (
    cell_frame,
    components_of,
    dilated,
    eroded,
    image_frame,
    mask_frame,
    to_mask,
)
from rasterledger.operators import components, raster, scoring, tiling
from rasterledger.plans.inference import postprocess, tiled_inference


@pytest.fixture(scope="module")
def masks():
    rng = np.random.default_rng(11)
    tall = (rng.random((150, 20)) < 0.7).astype(int)  # spans three bands
    blob = np.zeros((40, 30), dtype=int)
    blob[5:25, 3:20] = 1
    blob[10:14, 8:12] = 0
    return {"tall": tall, "blob": blob, "full": np.ones((9, 9), dtype=int), "empty": np.zeros((6, 6), dtype=int)}


def expected_boundary(mask, rule):
    if rule == "square":
        return mask - eroded(mask, 1, 1)
    p = np.pad(mask, 1)
    inner = p[1:-1, 1:-1] & p[:-2, 1:-1] & p[2:, 1:-1] & p[1:-1, :-2] & p[1:-1, 2:]
    return mask - inner


@pytest.mark.parametrize("rule", ["cross", "square"])
def test_boundary_equals_erosion_difference(spark, masks, rule):
    found = raster.boundary(mask_frame(spark, masks), rule).cache()
    for name, mask in masks.items():
        assert (to_mask(found, name, mask.shape) == expected_boundary(mask, rule)).all(), name


def test_morphology_equals_numpy_across_bands(spark, masks):
    df = mask_frame(spark, masks)
    shrunk, grown, cleaned = raster.erode(df, 1).cache(), raster.dilate(df, 2).cache(), raster.open_close(df, 3).cache()
    strict = raster.erode(df, 1, border="background").cache()
    for name, mask in masks.items():
        assert (to_mask(shrunk, name, mask.shape) == eroded(mask, 1, 1)).all(), name
        assert (to_mask(strict, name, mask.shape) == eroded(mask, 1, 0)).all(), name
        assert (to_mask(grown, name, mask.shape) == dilated(mask, 2)).all(), name
        steps = dilated(eroded(mask, 1, 1), 1)
        assert (to_mask(cleaned, name, mask.shape) == eroded(dilated(steps, 1), 1, 1)).all(), name


def brute_boundary_metrics(pred, target, rule, t=2):
    pb, tb = expected_boundary(pred, rule), expected_boundary(target, rule)
    if not pb.any() and not tb.any():
        return 1.0, 1.0, 1.0
    if not pb.any() or not tb.any():
        return 0.0, 0.0, 0.0
    precision = (pb & dilated(tb, t)).sum() / pb.sum()
    recall = (tb & dilated(pb, t)).sum() / tb.sum()
    return precision, recall, (pb & tb).sum() / (pb | tb).sum()


def brute_distances(pred, target, rule):
    a, b = np.argwhere(expected_boundary(pred, rule)), np.argwhere(expected_boundary(target, rule))
    d = np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2))
    both = np.concatenate([d.min(axis=1), d.min(axis=0)])
    return np.percentile(both, 95), both.mean()


@pytest.fixture(scope="module")
def mask_pairs():
    rng = np.random.default_rng(4)
    far = np.zeros((140, 24), dtype=int)
    near = far.copy()
    far[2:9, 2:9] = 1
    near[120:135, 10:20] = 1
    noise = (rng.random((70, 18)) < 0.5).astype(int)
    return {
        "far": (far, near),
        "noise": (noise, (rng.random((70, 18)) < 0.5).astype(int)),
        "empty": (np.zeros((5, 5), dtype=int), np.zeros((5, 5), dtype=int)),
        "one": (np.zeros((5, 5), dtype=int), np.ones((5, 5), dtype=int)),
    }


@pytest.mark.parametrize("rule", ["cross", "square"])
def test_boundary_metrics_equal_brute_force(spark, mask_pairs, rule):
    cells = cell_frame(spark, mask_pairs).cache()
    images = cells.select("image_id", "height", "width").distinct()
    for row in raster.boundary_metrics(cells, images, rule=rule).collect():
        p, r, iou = brute_boundary_metrics(*mask_pairs[row["image_id"]], rule)
        if row["image_id"] == "one" and rule == "square":
            p, r, iou = 1.0, 1.0, 1.0  # a full frame has no boundary under this rule
        assert row["boundary_precision"] == pytest.approx(p), row["image_id"]
        assert row["boundary_recall"] == pytest.approx(r), row["image_id"]
        assert row["boundary_iou"] == pytest.approx(iou), row["image_id"]


@pytest.mark.parametrize("rule", ["cross", "square"])
def test_surface_distances_equal_brute_force(spark, mask_pairs, rule):
    cells = cell_frame(spark, mask_pairs).cache()
    images = cells.select("image_id", "height", "width").distinct()
    found = {r["image_id"]: (r["hd95"], r["assd"]) for r in raster.surface_distances(cells, images, rule=rule).collect()}
    for name in ("far", "noise"):
        assert found[name] == pytest.approx(brute_distances(*mask_pairs[name], rule))
    assert found["empty"] == (0.0, 0.0)
    assert found["one"] == ((None, None) if rule == "cross" else (0.0, 0.0))


def test_one_sided_distance_under_the_square_rule_is_the_diagonal(spark):
    spot = np.zeros((3, 4), dtype=int)
    spot[1, 1] = 1
    cells = cell_frame(spark, {"a": (spot, np.zeros((3, 4), dtype=int))})
    images = cells.select("image_id", "height", "width").distinct()
    assert raster.surface_distances(cells, images, rule="square").first()["hd95"] == 5.0


@pytest.mark.parametrize("connectivity", [4, 8])
@pytest.mark.parametrize("band_rows", [64, 3, 1])
def test_components_equal_flood_fill(spark, masks, connectivity, band_rows):
    snake = np.zeros((31, 21), dtype=int)
    snake[::2] = 1
    snake[1::4, -1] = 1
    snake[3::4, 0] = 1
    shapes = {"snake": snake, "blob": masks["blob"], "noise": masks["tall"][:40]}
    runs = components.row_runs(mask_frame(spark, shapes))
    labelled = components.label_runs(runs, connectivity=connectivity, band_rows=band_rows)
    found = {name: {} for name in shapes}
    for r in labelled.collect():
        cells = found[r["image_id"]].setdefault(r["label"], set())
        cells.update((r["y"], x) for x in range(r["x0"], r["x1"] + 1))
    for name, mask in shapes.items():
        assert {frozenset(c) for c in found[name].values()} == components_of(mask, connectivity), name


def test_small_components_and_holes(spark, masks):
    blob = masks["blob"].copy()
    blob[30, 2] = 1
    df = mask_frame(spark, {"b": blob})
    images = image_frame(spark, {"b": blob})
    kept = to_mask(components.remove_small_components(df, 2), "b", blob.shape)
    assert kept.sum() == blob.sum() - 1 and kept[30, 2] == 0
    filled = to_mask(postprocess(df, images, min_area=2, fill_holes=True), "b", blob.shape)
    assert filled[10:14, 8:12].all() and filled.sum() == kept.sum() + 16


def test_component_point_moves_into_its_component(spark):
    ring = np.zeros((9, 9), dtype=int)
    ring[1:8, 1:8] = 1
    ring[2:7, 2:7] = 0
    points, counts = components.component_points(mask_frame(spark, {"r": ring}), max_points=3, min_area=4)
    row = points.first()
    ys, xs = np.where(ring)
    assert (row["x"], row["y"]) == (xs[len(xs) // 2], ys[len(ys) // 2])
    assert counts.first()["components"] == 1


def test_automatic_prompt_fixture(spark):
    prob = np.zeros((64, 64))
    prob[10:30, 20:45] = 0.9
    rows = [("a", int(y), int(x), float(p)) for (y, x), p in np.ndenumerate(prob)]
    rows += [("z", y, 0, 0.0) for y in range(64)]
    pixels = spark.createDataFrame(rows, "image_id string, y int, x int, prob double")
    images = spark.createDataFrame([("a", 64, 64), ("z", 64, 64)], "image_id string, height int, width int")
    found = {r["image_id"]: r for r in components.automatic_prompts(pixels, images).collect()}
    assert (found["a"]["status"], found["a"]["components"]) == ("ok", 1)
    assert found["a"]["box"] == [17, 7, 47, 32]
    labels = sorted(p["label"] for p in found["a"]["points"])
    assert labels == [0, 1]
    assert found["z"]["status"] == "no_coarse_candidate" and found["z"]["points"] is None


def test_box_fixture(spark):
    mask = np.zeros((20, 30), dtype=int)
    mask[5:11, 7:18] = 1
    shapes = {"m": mask, "e": np.zeros((20, 30), dtype=int)}
    found = {
        r["image_id"]: [r["x0"], r["y0"], r["x1"], r["y1"]]
        for r in raster.bounding_boxes(mask_frame(spark, shapes), image_frame(spark, shapes)).collect()
    }
    assert found == {"m": [7, 5, 17, 10], "e": [0, 0, 29, 19]}


def test_prompt_points_respect_the_mask(spark, masks):
    df, images = mask_frame(spark, masks), image_frame(spark, masks)
    points = raster.prompt_points(df, images, positives=3, negatives=2).collect()
    for name, mask in masks.items():
        mine = [p for p in points if p["image_id"] == name]
        assert len(mine) == 5, name
        for p in mine:
            if name == "full" and p["kind"] == "negative":
                assert (p["x"], p["y"]) == (0, 0)
            else:
                assert mask[p["y"], p["x"]] == p["label"], name


# --- tiles --------------------------------------------------------------------


def positions(length, tile, overlap):
    if length <= tile:
        return [0]
    out = list(range(0, length - tile + 1, tile - overlap))
    return out if out[-1] == length - tile else out + [length - tile]


@pytest.mark.parametrize("length,tile,overlap", [(10, 64, 16), (64, 64, 16), (130, 64, 16), (170, 64, 0), (100, 7, 6)])
def test_tile_positions(spark, length, tile, overlap):
    row = spark.range(1).select(tiling.tile_positions(F.lit(length), tile, overlap)).first()
    assert row[0] == positions(length, tile, overlap)


def test_invalid_tile_sizes_raise():
    for tile, overlap in ((0, 0), (8, 8), (8, -1)):
        with pytest.raises(ValueError):
            tiling.check_tile_size(tile, overlap)


def test_tiles_round_trip(spark):
    rng = np.random.default_rng(8)
    image = rng.integers(0, 60000, (34, 45))
    pixels = spark.createDataFrame(
        [("a", int(y), int(x), int(v)) for (y, x), v in np.ndenumerate(image)], "image_id string, y int, x int, value int"
    )
    images = spark.createDataFrame([("a", 34, 45)], "image_id string, height int, width int")
    tiles = tiling.tile_pixels(pixels, images, tile_size=16, overlap=4, pad_value=-1).cache()
    grid = tiling.tile_grid(images, tile_size=16, overlap=4)
    assert tiles.count() == grid.count() * 256
    assert tiles.where("not valid").agg(F.max("value")).first()[0] in (-1, None)
    back = tiling.assert_covered(tiling.reconstruct_mean(tiles, whole_numbers=True), images)
    out = np.zeros_like(image)
    for r in back.collect():
        out[r["y"], r["x"]] = r["value"]
    assert (out == image).all()
    with pytest.raises(ValueError, match="uncovered"):
        tiling.assert_covered(back.where("y > 0"), images)
    named = tiles.select("tile_id", F.col("image_id").alias("parent_image_id"))
    assert tiling.tile_count_mismatches(named, grid).isEmpty()
    assert not tiling.tile_count_mismatches(named.where("tile_id <> 'a__r000_c000'"), grid).isEmpty()


def test_stitching_a_constant_gives_the_constant(spark):
    images = spark.createDataFrame([("a", 50, 70)], "image_id string, height int, width int")
    pixels = raster.dense_cells(images).select("image_id", "y", "x", F.lit(1.0).alias("prob"))
    sized = pixels.withColumns({"height": F.lit(50), "width": F.lit(70)})
    placed = tiling.assign_to_tiles(sized, tile_size=24, overlap=8)
    row = tiling.stitch_hann(placed, 24).agg(F.count("*"), F.min("prob"), F.max("prob")).first()
    assert row[0] == 3500 and row[1] == pytest.approx(1.0) and row[2] == pytest.approx(1.0)


def test_tile_children_keep_parent_and_split(spark):
    manifest = spark.createDataFrame(
        [("big", "train", 100, 120, 0.5), ("tiny", "test", 10, 10, 0.0)],
        "image_id string, split string, height int, width int, water_fraction double",
    )
    foreground = spark.createDataFrame([("big", y, x) for y in range(100) for x in range(60)], "image_id string, y int, x int")
    found = tiling.tiled_manifest(manifest, foreground, tile_size=64, overlap=16)
    children = found.where("parent_image_id = 'big'").collect()
    assert len(children) > 1 and {c["split"] for c in children} == {"train"}
    first = next(c for c in children if c["image_id"] == "big__y0_x0")
    assert first["water_fraction"] == pytest.approx(60 / 64)
    assert found.where("parent_image_id = 'tiny'").first()["image_id"] == "tiny"


def test_georeferenced_windows(spark):
    tiles = spark.createDataFrame([(64, 96, 64, 64)], "row_offset int, column_offset int, valid_height int, valid_width int")
    named = tiles.withColumns({k: F.lit(v) for k, v in dict(a=10.0, b=0.0, c=100.0, d=0.0, e=-10.0, f=200.0).items()})
    row = tiling.window_geometry(named).first()
    assert (row["tile_c"], row["tile_f"]) == (1060.0, -440.0)
    assert (row["bounds_left"], row["bounds_top"], row["bounds_right"], row["bounds_bottom"]) == (1060.0, -440.0, 1700.0, -1080.0)


def test_letterbox_geometry(spark):
    images = spark.createDataFrame([(200, 100)], "width int, height int")
    row = tiling.canvas_geometry(images, 512).first()
    assert (row["resized_width"], row["resized_height"], row["pad_top"], row["pad_bottom"], row["pad_left"]) == (512, 256, 128, 128, 0)
    stretch = tiling.canvas_geometry(images, 512, "stretch").first()
    assert (stretch["resized_width"], stretch["resized_height"], stretch["pad_top"]) == (512, 512, 0)
    with pytest.raises(ValueError):
        tiling.canvas_geometry(images, 512, "crop")


def test_restore_from_canvas_interpolates_linearly(spark):
    images = spark.createDataFrame([("a", 8, 16)], "image_id string, height int, width int")
    geometry = tiling.canvas_geometry(images, 8)
    rows = [("a", y, x, float(x)) for y in range(8) for x in range(8)]
    canvas = spark.createDataFrame(rows, "image_id string, cy int, cx int, prob double")
    restored = tiling.restore_from_canvas(canvas, geometry)
    values = {r["x"]: r["prob"] for r in restored.where("y = 3").collect()}
    assert len(values) == 16
    assert values[0] == 0.0 and values[15] == 7.0
    assert values[7] == pytest.approx((7 + 0.5) * 0.5 - 0.5)


def test_tiled_inference_routes_failures(spark):
    image = np.ones((20, 20))
    image[0, 0] = 2.0
    pixels = spark.createDataFrame(
        [("a", int(y), int(x), float(v)) for (y, x), v in np.ndenumerate(image)], "image_id string, y int, x int, value double"
    )
    images = spark.createDataFrame([("a", 20, 20)], "image_id string, height int, width int")

    def scorer(tile):
        if tile.max() > 1:  # in the first tile only
            raise ValueError("bad tile")
        return np.full(tile.shape, 0.75)

    stitched, failed = tiled_inference(pixels, images, scorer, tile_size=16, overlap=4, threshold=0.5)
    assert [r["error_type"] for r in failed.collect()] == ["ValueError"]
    tiles = scoring.score_tiles(tiling.tile_pixels(pixels, images, tile_size=16, overlap=4), scorer, 16)
    expected = {(r["y"], r["x"]) for r in tiles.where("status = 'ok'").collect()}
    assert {(r["y"], r["x"]) for r in stitched.collect()} == expected and len(expected) < 400
    short = scoring.score_tiles(tiling.tile_pixels(pixels, images, tile_size=16, overlap=4), lambda tile: tile[:3], 16)
    assert {r["status"] for r in short.collect()} == {"error"}


def test_scored_tiles_leave_a_task_a_few_at_a_time(spark, monkeypatch):
    image = np.arange(40.0 * 40).reshape(40, 40)
    pixels = spark.createDataFrame([("a", int(y), int(x), float(v)) for (y, x), v in np.ndenumerate(image)], "image_id string, y int, x int, value double")
    images = spark.createDataFrame([("a", 40, 40)], "image_id string, height int, width int")
    cells = tiling.tile_pixels(pixels.coalesce(1), images, tile_size=8, overlap=0)
    monkeypatch.setattr(scoring, "CELLS_AT_ONCE", 3 * 64)  # 25 tiles, three at a time
    scored = scoring.score_tiles(cells, lambda tile: tile / 1600, 8)
    assert "MapInArrow" in scored._jdf.queryExecution().executedPlan().toString()
    assert {(r["y"], r["x"]): r["prob"] for r in scored.collect()} == {(y, x): image[y, x] / 1600 for y in range(40) for x in range(40)}


@pytest.mark.parametrize("rows_per_batch", ["3", "10000"])
def test_a_scorer_sees_whole_tiles(spark, rows_per_batch):
    """Brightness against the tile's mean: wrong if a tile is cut by a batch or seen in part."""
    rng = np.random.default_rng(9)
    image = rng.random((37, 29))
    pixels = spark.createDataFrame([("a", int(y), int(x), float(v)) for (y, x), v in np.ndenumerate(image)], "image_id string, y int, x int, value double").repartition(5)
    images = spark.createDataFrame([("a", 37, 29)], "image_id string, height int, width int")
    changed = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows_per_batch, "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in changed}
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        stitched, failed = tiled_inference(pixels, images, lambda tile: tile - tile.mean(), tile_size=13, overlap=5, threshold=0.0)
        found = {(r["y"], r["x"]): r["prob"] for r in stitched.collect()}
        assert failed.isEmpty()
        grid = tiling.tile_grid(images, tile_size=13, overlap=5).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    total, weights = np.zeros((37, 29)), np.zeros((37, 29))
    ramp = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(13) / 12)
    weight = np.maximum(np.outer(ramp, ramp), tiling.MINIMUM_WEIGHT)
    for t in grid:
        y, x, h, w = t["row_offset"], t["column_offset"], t["valid_height"], t["valid_width"]
        tile = np.zeros((13, 13))
        tile[:h, :w] = image[y : y + h, x : x + w]
        total[y : y + h, x : x + w] += ((tile - tile.mean()) * weight)[:h, :w]
        weights[y : y + h, x : x + w] += weight[:h, :w]
    expected = total / weights
    assert len(found) == expected.size
    assert all(v == pytest.approx(expected[p]) for p, v in found.items())


def test_bands_keep_the_tasks_of_the_session(spark):
    """Adaptive execution put these few bytes into one task, whose rows the next steps multiply."""
    mask = mask_frame(spark, {str(i): np.ones((9, 9), bool) for i in range(40)})
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert tasks > 1 and raster.with_bands(mask, 2).rdd.getNumPartitions() == tasks
    assert raster.dilate(mask.withColumns({"height": F.lit(9), "width": F.lit(9)}), 2).rdd.getNumPartitions() == tasks
