"""Batch scoring with a user function."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

Scorer = Callable[[pd.DataFrame], pd.DataFrame]

#: Cells of the tiles whose probabilities a task holds before it hands them on.
CELLS_AT_ONCE = 1 << 18


#: Takes a whole tile, an array (size, size) or (size, size, channels), and returns probabilities (size, size).
TileScorer = Callable[[np.ndarray], np.ndarray]


def score(df: DataFrame, scorer: Scorer, schema: str) -> DataFrame:
    """Apply ``scorer`` to Arrow batches and record a status per row.

    ``schema`` declares the columns the scorer returns, one row per input row. A
    batch that fails is halved until the failing rows stand alone, so a few bad
    rows cost a few extra calls and no good row is lost.
    """
    declared = StructType.fromDDL(schema)
    columns = declared.fieldNames()
    output = f"{schema}, status string, error_type string, error_message string"

    def attempt(rows: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, Exception | None]]:
        try:
            scored = scorer(rows)
            if len(scored) != len(rows):
                raise ValueError("scorer changed the number of rows")
            yield scored[columns], None
        except Exception as error:
            if len(rows) == 1:
                yield rows.reindex(columns=columns), error
            else:
                half = len(rows) // 2
                yield from attempt(rows.iloc[:half])
                yield from attempt(rows.iloc[half:])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            parts, errors = zip(*attempt(batch))
            out = pd.concat(parts, ignore_index=True)
            per_row = [e for part, e in zip(parts, errors) for _ in range(len(part))]
            out["status"] = ["ok" if e is None else "error" for e in per_row]
            out["error_type"] = [None if e is None else type(e).__name__ for e in per_row]
            out["error_message"] = [None if e is None else str(e) for e in per_row]
            yield out

    return df.mapInPandas(run, output)


def packed_tiles(cells: DataFrame, values: Sequence[str]) -> DataFrame:
    """One row per tile: (image_id, tile_id, y0, x0, valid_height, valid_width, and an array for each value).

    ``cells`` has all cells of every tile, as ``tiling.tile_pixels`` makes them; an array holds
    them row by row, so a tile is as large as its model's input and never more.
    """
    ordered = F.array_sort(F.collect_list(F.struct("tile_y", "tile_x", *values)))
    inside = F.col("valid")
    packed = cells.groupBy("image_id", "tile_id").agg(
        F.min("y").alias("y0"),
        F.min("x").alias("x0"),
        F.max(F.when(inside, F.col("tile_y") + 1)).alias("valid_height"),
        F.max(F.when(inside, F.col("tile_x") + 1)).alias("valid_width"),
        ordered.alias("_cells"),
    )
    arrays = [F.col("_cells").getField(v).cast("array<double>").alias(f"_{v}") for v in values]
    return packed.select("image_id", "tile_id", "y0", "x0", "valid_height", "valid_width", *arrays)


def score_tiles(cells: DataFrame, scorer: TileScorer, tile_size: int, values: Sequence[str] = ("value",)) -> DataFrame:
    """Apply ``scorer`` to whole tiles and give back their cells inside the image with ``prob``.

    Returns (image_id, tile_id, y, x, tile_y, tile_x, prob, status, error_type, error_message).
    A tile whose scorer fails, or does not return one number for each cell, is one row with
    status "error" and no cell. Tiles are packed first, so a scorer sees all cells of its
    tile however Spark cuts its batches. Results leave a task a few tiles at a time.
    """

    kept = ["image_id", "tile_id", "y0", "x0", "valid_height", "valid_width"]
    at_once = max(1, CELLS_AT_ONCE // tile_size**2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, at_once):
                batch = whole.slice(begin, at_once)
                planes = [
                    batch.column(f"_{v}").flatten().to_numpy(zero_copy_only=False).reshape(-1, tile_size, tile_size) for v in values
                ]
                if any(len(p) != batch.num_rows for p in planes):
                    raise ValueError(f"a tile does not have {tile_size} x {tile_size} cells")
                probabilities, errors = [], []
                for tile in zip(*planes, strict=True):
                    try:
                        found = np.asarray(scorer(tile[0].copy() if len(tile) == 1 else np.stack(tile, axis=-1)), float)
                        if found.shape != (tile_size, tile_size):
                            raise ValueError(f"scorer returned shape {found.shape}")
                        probabilities.append(found.ravel())
                        errors.append(None)
                    except Exception as error:
                        probabilities.append(None)
                        errors.append(error)
                columns = [batch.column(c) for c in kept]
                columns.append(pa.array(probabilities, pa.list_(pa.float64())))
                columns.append(pa.array(["ok" if e is None else "error" for e in errors]))
                columns.append(pa.array([None if e is None else type(e).__name__ for e in errors], pa.string()))
                columns.append(pa.array([None if e is None else str(e) for e in errors], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, "_prob", "status", "error_type", "error_message"])

    tiles = packed_tiles(cells, values)
    kinds = dict(tiles.dtypes)
    named = ", ".join(f"{c} {kinds[c]}" for c in kept)
    scored = tiles.mapInArrow(run, f"{named}, _prob array<double>, status string, error_type string, error_message string")
    place = F.col("_place")
    opened = scored.select("*", F.posexplode_outer("_prob").alias("_place", "prob")).withColumns(
        {"tile_y": F.floor(place / tile_size).cast("int"), "tile_x": (place % tile_size).cast("int")}
    )
    inside = (F.col("tile_y") < F.col("valid_height")) & (F.col("tile_x") < F.col("valid_width"))
    return opened.where(inside | (F.col("status") == "error")).select(
        "image_id",
        "tile_id",
        (F.col("y0") + F.col("tile_y")).cast("int").alias("y"),
        (F.col("x0") + F.col("tile_x")).cast("int").alias("x"),
        "tile_y",
        "tile_x",
        "prob",
        "status",
        "error_type",
        "error_message",
    )
