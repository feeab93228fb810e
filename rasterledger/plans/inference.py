"""Tiled inference over pixel tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from rasterledger.operators import components, scoring, tiling


def tiled_inference(
    pixels: DataFrame,
    images: DataFrame,
    scorer: scoring.TileScorer,
    *,
    tile_size: int,
    overlap: int,
    threshold: float,
    value: str = "value",
) -> tuple[DataFrame, DataFrame]:
    """Score whole tiles and stitch them; returns (stitched pixels, failed tiles).

    The scorer sees one tile at a time, padded to its full size, and returns a probability
    for each cell. Images that fit into one tile get a single window of weight one
    everywhere it matters. The cells of a failed tile come from the tiles that overlap it.
    """
    cells = tiling.tile_pixels(pixels, images, tile_size=tile_size, overlap=overlap, value=value)
    scored = scoring.score_tiles(cells, scorer, tile_size, [value])
    stitched = tiling.stitch_and_threshold(scored.where("status = 'ok'"), tile_size, threshold)
    failed = scored.where("status <> 'ok'").select("image_id", "tile_id", "error_type", "error_message")
    return stitched, failed


def postprocess(
    mask: DataFrame, images: DataFrame, *, min_area: int = 0, fill_holes: bool = False
) -> DataFrame:
    """Drop small components, then fill holes."""
    result = mask.select("image_id", "y", "x")
    if min_area > 0:
        result = components.remove_small_components(result, min_area)
    if fill_holes:
        result = components.fill_holes(result, images)
    return result
