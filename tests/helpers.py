"""Small builders shared by the tests."""

from __future__ import annotations

import numpy as np


def mask_frame(spark, masks: dict):
    """Foreground pixels (image_id, y, x, height, width) of numpy masks."""
    rows = [
        (image, int(y), int(x), mask.shape[0], mask.shape[1])
        for image, mask in masks.items()
        for y, x in np.argwhere(mask)
    ]
    return spark.createDataFrame(rows, "image_id string, y int, x int, height int, width int")


def image_frame(spark, masks: dict):
    rows = [(image, mask.shape[0], mask.shape[1]) for image, mask in masks.items()]
    return spark.createDataFrame(rows, "image_id string, height int, width int")


def cell_frame(spark, pairs: dict):
    """Dense (image_id, y, x, pred, target, height, width) of (pred, target) pairs."""
    rows = []
    for image, (pred, target) in pairs.items():
        for (y, x), p in np.ndenumerate(pred):
            rows.append((image, y, x, int(p), int(target[y, x]), pred.shape[0], pred.shape[1]))
    return spark.createDataFrame(
        rows, "image_id string, y int, x int, pred int, target int, height int, width int"
    )


def to_mask(df, image: str, shape) -> np.ndarray:
    out = np.zeros(shape, dtype=int)
    for row in df.where(df.image_id == image).select("y", "x").collect():
        out[row["y"], row["x"]] = 1
    return out


def components_of(mask: np.ndarray, connectivity: int) -> set:
    """Components as frozen sets of cells, by flood fill."""
    left = {tuple(map(int, c)) for c in np.argwhere(mask)}
    found = set()
    while left:
        stack = [left.pop()]
        cells = set(stack)
        while stack:
            y, x = stack.pop()
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    if connectivity == 4 and abs(dy) + abs(dx) != 1:
                        continue
                    near = (y + dy, x + dx)
                    if near in left:
                        left.remove(near)
                        cells.add(near)
                        stack.append(near)
        found.add(frozenset(cells))
    return found


def eroded(mask: np.ndarray, radius: int, outside: int) -> np.ndarray:
    padded = np.pad(mask, radius, constant_values=outside)
    size = 2 * radius + 1
    return np.lib.stride_tricks.sliding_window_view(padded, (size, size)).min(axis=(2, 3))


def dilated(mask: np.ndarray, radius: int) -> np.ndarray:
    padded = np.pad(mask, radius)
    size = 2 * radius + 1
    return np.lib.stride_tricks.sliding_window_view(padded, (size, size)).max(axis=(2, 3))
