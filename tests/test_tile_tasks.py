from pyspark.sql import functions as F

from rasterledger.operators import tiling


def test_tasks_grow_with_the_cells_of_the_tiles(spark, monkeypatch):
    monkeypatch.setattr(tiling, "CELLS_A_TASK", 100, raising=False)
    images = spark.createDataFrame([("a", 34, 45)], "image_id string, height int, width int")
    pixels = spark.createDataFrame([("a", 3, 4, 9), ("a", 33, 44, 5)], "image_id string, y int, x int, value int")
    back = tiling.reconstruct_mean(tiling.tile_pixels(pixels, images, tile_size=16, overlap=4, pad_value=-1), whole_numbers=True)
    assert back.rdd.getNumPartitions() == 31  # 12 tiles of 256 cells
    assert back.agg(F.count(F.lit(1)), F.sum("value")).first() == (34 * 45, 14)
    assert {tuple(r) for r in back.where("value > 0").collect()} == {("a", 3, 4, 9), ("a", 33, 44, 5)}
