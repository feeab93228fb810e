"""Hard negatives against brute force."""

import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))

from corpora import pairs_of  # noqa: E402
from rasterledger.llm import hard_negatives as mining  # noqa: E402

SCHEMA = "vec_id long, embedding array<float>, label int, query string, id string, vec string"
COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def expected(rows):
    usable = set()
    for i, vector, label in rows:
        if i is None or label is None or vector is None or any(x is None or not np.isfinite(x) for x in vector):
            continue
        if i % 7 == 0:
            label = (label + 1) % 10
        usable.add((i, label, tuple(int(np.floor(256 * float(np.float32(x)))) for x in vector)))
    out = set()
    for i, label, vector in usable:
        if i % 50:
            continue
        scored = sorted((-sum(a * b for a, b in zip(vector, v, strict=True)), j, k) for j, k, v in usable if j != i and len(v) == len(vector))
        for p, positive, _ in [s for s in scored if s[2] == label][:5]:
            fits = [s for s in scored if s[2] != label and 50 * -p <= 100 * -s[0] <= 95 * -p]
            out |= {(i, positive, rank, j, -p, -n) for rank, (n, j, _) in enumerate(fits[:3], 1)}
    return sorted(out, key=repr)


def frame(spark, rows):
    table = [(i, None if v is None else [None if x is None else float(x) for x in v], k, "q", "i", "v") for i, v, k in rows]
    return spark.createDataFrame(table, SCHEMA).repartition(4)


def vectors(seed, count, dimensions, labels=4):
    rng = np.random.default_rng(seed)
    data = rng.normal(0, 0.2, (count, dimensions)).round(2)
    return [(i, data[i].tolist(), int(rng.integers(0, labels))) for i in range(count)]


def test_equal_to_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mining, "LEAF", 8)
    rows = vectors(1, 900, 6)
    same = rows[100][1]
    rows += [(2000 + i, same, 1) for i in range(150)] + [(2300 + i, same, 2) for i in range(30)]  # a hot vector, with ties
    rows += [(3000, None, 1), (3050, [None] * 6, 1), (3100, [float("nan")] * 6, 2), (3150, [float("inf")] * 6, 3)]
    rows += [(3200, rows[5][1], None), (None, rows[6][1], 1), (3250, [0.1, 0.2], 1), (3251, [0.1, 0.3], 1), (3252, [0.05, 0.2], 2)]
    rows += [rows[50], rows[50], rows[60], (3300, [0.0] * 6, 1), (100, rows[7][1], 2), (3350, [3000.0] * 6, 1)]
    found = mining.hard_negatives(frame(spark, rows), group_rows=100)
    assert pairs_of(found, *COLUMNS) == expected(rows)
    assert found.count() > 100


def test_large_components_stay_exact(spark):
    rows = [(i, [x * 40 for x in v], k) for i, v, k in vectors(2, 300, 40, 3)]
    assert pairs_of(mining.hard_negatives(frame(spark, rows)), *COLUMNS) == expected(rows)


def test_nothing_to_find(spark):
    assert mining.hard_negatives(frame(spark, [])).count() == 0
    assert mining.hard_negatives(frame(spark, [(0, [0.1], 1), (1, [0.1], 1)])).count() == 0
    assert mining.hard_negatives(frame(spark, [(0, [], 1), (1, [], 1), (2, [], 3)])).count() == len(expected([(0, [], 1), (1, [], 1), (2, [], 3)]))


@pytest.mark.parametrize("same", [True, False])
def test_boxes_are_pruned_and_lose_nothing(same):
    rng = np.random.default_rng(5)
    centres = rng.integers(-100, 100, (12, 8))
    data = np.concatenate([c + rng.integers(-4, 5, (400, 8)) for c in centres])
    labels = rng.integers(0, 3, len(data))
    tree = mining.Tree(data, labels, [[i] for i in range(len(data))])
    assert all((tree.low[k] <= tree.vectors[a:b]).all() and (tree.high[k] >= tree.vectors[a:b]).all() for k, (a, b) in enumerate(zip(tree.bounds, tree.bounds[1:], strict=False)))
    seen = []
    inner = mining._best_of_leaf
    mining._best_of_leaf = lambda *args: seen.append(len(args[2])) or inner(*args)
    try:
        anchors, own = data[:40], np.arange(40)
        low, high = np.full(40, -10_000), np.full(40, 30_000)
        best = mining.search(tree, anchors, labels[:40], low, high, own, same, 5)
    finally:
        mining._best_of_leaf = inner
    assert sum(seen) < 40 * len(tree.low) / 2
    for a in range(40):
        score = data @ anchors[a]
        fits = [(-score[i], i) for i in range(len(data)) if i != a and (labels[i] == labels[a]) == same and -10_000 <= score[i] <= 30_000]
        assert [(-s, i) for q, s, i in best.tolist() if q == a] == sorted(fits)[:5]
