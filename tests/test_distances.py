"""Distances between pixel sets against brute force."""

import math
import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))

from helpers import image_frame, mask_frame  # noqa: E402
from rasterledger.operators import distances, raster  # noqa: E402


def brute(queries, targets):
    return {q: min(math.dist(q, t) for t in targets) for q in queries}


def point_frame(spark, points):
    return spark.createDataFrame([(i, y, x) for i, cells in points.items() for y, x in cells], "image_id string, y int, x int")


@pytest.fixture(params=[(2, 3), (3, 6), (6, 10)])
def blocks(request, monkeypatch):
    monkeypatch.setattr(distances, "SMALL", request.param[0])
    monkeypatch.setattr(distances, "LARGE", request.param[1])


def test_nearest_distance_equals_brute_force(spark, blocks):
    rng = np.random.default_rng(6)
    queries, targets = {}, {}
    for name, height, width, many in (("noise", 40, 70, 300), ("wide", 3, 300, 40), ("sparse", 200, 200, 6)):
        cells = [(int(y), int(x)) for y, x in np.c_[rng.integers(0, height, 2 * many), rng.integers(0, width, 2 * many)]]
        queries[name], targets[name] = cells[:many] + cells[:5], cells[many:]
    queries["ring"], targets["ring"] = [(50, 50)], [(round(50 + 45 * math.sin(a)), round(50 + 45 * math.cos(a))) for a in np.linspace(0, 6.28, 90)]
    queries["alone"], targets["other"] = [(1, 1)], [(2, 2)]
    found = distances.nearest_distance(point_frame(spark, queries), point_frame(spark, targets)).collect()
    assert {r["image_id"] for r in found} == {"noise", "wide", "sparse", "ring"}
    for name in ("noise", "wide", "sparse", "ring"):
        mine = {(r["y"], r["x"]): r["distance"] for r in found if r["image_id"] == name}
        assert mine == pytest.approx(brute(set(queries[name]), targets[name]))
    assert len(found) == sum(len(set(queries[n])) for n in ("noise", "wide", "sparse", "ring"))


def test_farthest_cells_equal_brute_force(spark, blocks):
    rng = np.random.default_rng(7)
    masks = {"noise": rng.random((30, 41)) < 0.1, "corner": np.zeros((50, 90), bool), "full": np.ones((9, 9), bool), "dense": np.ones((20, 20), bool), "empty": np.zeros((5, 5), bool)}
    masks["corner"][:3, :4] = True
    masks["dense"][4, 4] = masks["dense"][17, 2] = False
    images = image_frame(spark, masks)
    for k in (1, 7, 500):
        found = raster.farthest_background(mask_frame(spark, masks), images, k).collect()
        for name, mask in masks.items():
            mine = [(r["y"], r["x"]) for r in sorted((r for r in found if r["image_id"] == name), key=lambda r: r["position"])]
            if name == "empty":
                assert not mine
                continue
            targets = [tuple(map(int, c)) for c in np.argwhere(mask)]
            free = brute([tuple(map(int, c)) for c in np.argwhere(~mask)], targets)
            assert mine == sorted(free, key=lambda c: (-free[c], c))[:k], name


def test_far_blocks_are_never_opened(spark):
    mask = np.zeros((1024, 1024), bool)
    mask[:4] = True
    targets = distances._boxed(mask_frame(spark, {"a": mask}), ["image_id"], "t")
    grid = distances._grid(image_frame(spark, {"a": mask}), targets)
    pairs = distances._block_pairs(grid, targets, ["image_id"])
    assert grid.count() == 256 and distances._open_blocks(pairs, 2).count() <= 32
    top = raster.farthest_background(mask_frame(spark, {"a": mask}), image_frame(spark, {"a": mask}), 2).collect()
    assert [(r["y"], r["x"], r["distance"]) for r in sorted(top, key=lambda r: r["position"])] == [(1023, 0, 1020.0), (1023, 1, 1020.0)]


def test_one_large_image_spreads_over_tasks(spark):
    """Rings on a frame of 4,000 x 4,000: small blocks and few pairs for each, no row by column table."""
    angle = np.linspace(0, 2 * math.pi, 20_000)
    rings = {r: {(int(2000 + r * math.sin(a)), int(2000 + r * math.cos(a))) for a in angle} for r in (1900, 1500)}
    q, t = (point_frame(spark, {"a": sorted(rings[r])}) for r in (1900, 1500))
    blocks_q, blocks_t = distances._boxed(q, ["image_id"], "q"), distances._boxed(t, ["image_id"], "t")
    pairs = distances._block_pairs(blocks_q, blocks_t, ["image_id"])
    assert blocks_q.count() > 150 and pairs.count() < 25 * blocks_q.count()
    rows = distances.nearest_distance(q, t).collect()
    assert len(rows) == len(rings[1900]) and all(abs(r["distance"] - 400) < 2.5 for r in rows)


def test_blocks_are_small_and_not_sent_through_the_driver(spark):
    mask = np.ones((130, 70), bool)
    mask[3, 5] = mask[64, 63] = mask[129, 69] = False
    cells, images = mask_frame(spark, {"a": mask}), image_frame(spark, {"a": mask})
    found = raster.farthest_background(cells, images, 3)
    near = distances.nearest_distance(cells, cells.where("y = 0"))
    for frame in (found, near):
        assert "Broadcast" not in frame._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["y"], r["x"], r["distance"]) for r in found.collect()) == [(3, 5, 1.0), (64, 63, 1.0), (129, 69, 1.0)]
    # A full block of 4,096 pixels is 64 words.
    blocks = {(r["tby"], r["tbx"]): r["trows"] for r in distances._boxed(cells, ["image_id"], "t").collect()}
    assert blocks[0, 1] == [(y, 63) for y in range(64)] and len(blocks[0, 0]) == 64 and blocks[1, 0][1]["bits"] == -1
    assert blocks[1, 0][0]["bits"] == (1 << 63) - 1 and blocks[2, 1][1]["bits"] == 31
