import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import dilated, eroded, image_frame, mask_frame, to_mask
from rasterledger.operators import raster


@pytest.fixture(scope="module")
def shapes():
    rng = np.random.default_rng(5)
    hollow = np.zeros((70, 130), dtype=int)
    hollow[8:50, 30:100] = 1
    hollow[20:40, 50:75] = 0
    return {
        "noise": (rng.random((150, 140)) < 0.8).astype(int),
        "hollow": hollow,
        "full": np.ones((9, 9), dtype=int),
        "empty": np.zeros((6, 70), dtype=int),
    }


def draws(image, kind, cells):
    def drawn(y, x):
        return int(hashlib.sha256(f"42:{image}:{y}:{x}:{kind}".encode()).hexdigest()[8:16], 16)

    return sorted((drawn(y, x), y, x) for y, x in cells)


def expected_points(image, mask, positives, negatives):
    def region(cells, radius):
        inner = eroded(cells, radius, 1)
        return [tuple(map(int, c)) for c in np.argwhere(inner if inner.any() else cells)]

    background = 1 - mask
    sides = [("positive", mask if mask.any() else background, 2 if mask.any() else 3, positives), ("negative", background, 3, negatives)]
    out = set()
    for kind, cells, radius, n in sides:
        found = draws(image, kind, region(cells, radius))[:n]
        for i in range(n):
            _, y, x = found[i % len(found)] if found else (0, 0, 0)
            out.add((image, kind, i + 1, x, y, int(kind == "positive" and mask.any())))
    return out


def test_prompt_points_equal_brute_force_without_a_row_per_cell(spark, shapes, monkeypatch):
    rows, ranked = [], raster.top_k_per_group
    monkeypatch.setattr(raster, "top_k_per_group", lambda df, *a, **b: rows.append(df.count()) or ranked(df, *a, **b))
    found = raster.prompt_points(mask_frame(spark, shapes), image_frame(spark, shapes), positives=5, negatives=3)
    expected = set().union(*(expected_points(name, mask, 5, 3) for name, mask in shapes.items()))
    assert {tuple(r) for r in found.select("image_id", "kind", "draw", "x", "y", "label").collect()} == expected
    # 9 + 6 + 1 + 2 blocks of 58 x 58 cells, two kinds, five cells at most of each.
    assert rows[0] <= 18 * 2 * 5


@pytest.mark.parametrize("kernel", [3, 13])
def test_sizes_meet_the_blocks_of_an_opening_and_closing(spark, shapes, kernel):
    mask = mask_frame(spark, shapes).select("image_id", "y", "x")
    found = raster.open_close(mask, kernel, image_frame(spark, shapes)).cache()
    assert found.groupBy("image_id", "y", "x").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    r = kernel // 2
    for name, shape in shapes.items():
        opened = dilated(eroded(shape, r, 1), r)
        assert (to_mask(found, name, shape.shape) == eroded(dilated(opened, r), r, 1)).all(), name


def test_pairs_of_blocks_are_dealt_over_the_tasks_before_their_pixels_exist(spark, shapes):
    mask = mask_frame(spark, {"hollow": shapes["hollow"]})
    found = raster.farthest_background(mask, image_frame(spark, {"hollow": shapes["hollow"]}), 1)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan.split("MapInArrow", 1)[1]
    gaps = {(y, x): ((np.argwhere(shapes["hollow"]) - (y, x)) ** 2).sum(axis=1).min() for y, x in np.argwhere(shapes["hollow"] == 0)}
    far = max(gaps.values())
    top = found.first()
    assert (top["y"], top["x"]) == min(c for c, d in gaps.items() if d == far) and top["distance"] == far**0.5
