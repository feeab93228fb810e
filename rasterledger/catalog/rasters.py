"""Tiling, mask-geometry and component queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterledger.catalog.evaluation import r6
from rasterledger.catalog.governance import SEED, bin_sql, draw_sql, edges_sql, h5, manifest
from rasterledger.catalog.registry import query
from rasterledger.catalog.views import table, view, with_views
from rasterledger.functions.scalars import log_loss
from rasterledger.operators import binning, components, raster, splitting, tiling

SIDE = 32
TILE, OVERLAP = 48, 8
SMALL_TILE, SMALL_OVERLAP = 20, 6


def grid(spark, sf_dir):
    return view(spark, sf_dir, "grid").withColumns({"height": F.lit(SIDE), "width": F.lit(SIDE)})


def images_of(cells):
    return cells.select("image_id").distinct().withColumns({"height": F.lit(SIDE), "width": F.lit(SIDE)})


def every_image(spark, sf_dir):
    """The images of the grid, read without making its cells."""
    return images_of(view(spark, sf_dir, "px"))


def mask_of(spark, sf_dir, side):
    return grid(spark, sf_dir).where(F.col(side) == 1).select("image_id", "y", "x", "height", "width")


# A band pattern that leaves some images without foreground and others with large regions.
_REGION = "image_id % 10 <> 0 and ((y * 7 + x * 3 + image_id) % 16 < 11 or pred = 1)"


def regions(spark, sf_dir):
    return grid(spark, sf_dir).where(_REGION).select("image_id", "y", "x", "height", "width")


REGION_SQL = f", m as (select image_id, y, x from grid where {_REGION}), imgs as (select distinct image_id from grid)"


# --- plans --------------------------------------------------------------------


def positions_sql(length: str, tile: int, overlap: int) -> str:
    last = f"greatest({length} - {tile}, 0)"
    return f"list_sort(list_distinct(list_concat(range(0, {last} + 1, {tile - overlap}), [{last}])))"


@query(
    "g1_tile_positions",
    with_views(
        "manifest",
        f"select image_id, axis_offset::int as axis_offset from (select image_id, unnest({positions_sql('width', TILE, OVERLAP)}) as axis_offset from manifest)",
    ),
)
def _g1(spark, sf_dir):
    return manifest(spark, sf_dir).select(
        "image_id", F.explode(tiling.tile_positions(F.col("width"), TILE, OVERLAP)).alias("axis_offset")
    )


def grid_sql(source: str, tile: int, overlap: int) -> str:
    return f"""r as (select image_id, height, width, unnest({positions_sql('height', tile, overlap)}) as ro,
        unnest(range(len({positions_sql('height', tile, overlap)}))) as ri from {source}),
      g as (select *, unnest({positions_sql('width', tile, overlap)}) as co,
        unnest(range(len({positions_sql('width', tile, overlap)}))) as ci from r),
      tiles as (select printf('%s__r%03d_c%03d', image_id::varchar, ri, ci) as tile_id, image_id as parent_image_id, ro::int as row_offset,
        co::int as column_offset, {tile}::int as height, {tile}::int as width, least({tile}, height - ro)::int as valid_height,
        least({tile}, width - co)::int as valid_width from g)"""


@query(
    "g2_tile_grid",
    with_views("manifest", f", {grid_sql('manifest', TILE, OVERLAP)} select * from tiles"),
)
def _g2(spark, sf_dir):
    return tiling.tile_grid(manifest(spark, sf_dir), tile_size=TILE, overlap=OVERLAP)


@query(
    "g2_tile_count_mismatches",
    with_views(
        "manifest",
        f""", {grid_sql('manifest', TILE, OVERLAP)},
            s as (select parent_image_id, coalesce(l.toxic, 0) = 0 or row_offset = 0 as there from tiles left join labels l on l.doc_id = parent_image_id)
            select parent_image_id, count(*) as planned, count(*) filter (there) as supplied from s group by 1 having count(*) <> count(*) filter (there)""",
    ),
)
def _g2_mismatches(spark, sf_dir):
    """Of images labelled toxic only the tiles of the first row are supplied."""
    plan = tiling.tile_grid(manifest(spark, sf_dir), tile_size=TILE, overlap=OVERLAP)
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("parent_image_id"), "toxic")
    there = (F.coalesce("toxic", F.lit(0)) == 0) | (F.col("row_offset") == 0)
    return tiling.tile_count_mismatches(plan.join(labels, "parent_image_id", "left").where(there), plan)


@query(
    "g5_uncovered_images",
    with_views(
        "grid",
        """select s_suppkey as image_id, 1024::bigint as expected, count(y) as cells
           from supplier left join grid on image_id = s_suppkey group by 1 having count(y) <> 1024""",
    ),
)
def _g5_uncovered(spark, sf_dir):
    """The masks are sparse, so their cells taken as a reconstruction leave most of each image uncovered."""
    images = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("image_id"), F.lit(SIDE).alias("height"), F.lit(SIDE).alias("width"))
    return tiling.uncovered_images(view(spark, sf_dir, "grid"), images)


@query(
    "d14_augmented_pixels",
    with_views(
        "grid",
        f""", p as (select image_id, row_number() over (order by image_id) as r, count(*) over () as n from (select distinct image_id from grid)),
            e as (select image_id, epoch::int as epoch, {SEED} + epoch * n + r - 1 as draw_seed from p, range(2) t(epoch)),
            a as (select image_id, epoch, {draw_sql('flip_x')} < 0.5 as flip_x, {draw_sql('flip_y')} < 0.5 as flip_y,
                    (floor({draw_sql('rotation')} * 4) * 90)::int as rotation from e),
            f as (select image_id, epoch, rotation, case when flip_x then 31 - x else x end as x, case when flip_y then 31 - y else y end as y, pred, target
                  from grid join a using (image_id))
            select image_id, epoch, (case rotation when 0 then y when 90 then 31 - x when 180 then 31 - y else x end)::int as y,
              (case rotation when 0 then x when 90 then y when 180 then 31 - x else 31 - y end)::int as x, pred, target from f""",
    ),
)
def _d14_pixels(spark, sf_dir):
    cells = grid(spark, sf_dir)
    plan = splitting.augmentation_plan(images_of(cells), epochs=2, seed=SEED, profile="moderate")
    return splitting.apply_plan(cells, plan).select("image_id", "epoch", "y", "x", "pred", "target")


@query(
    "g3_tiled_manifest",
    with_views(
        "grid",
        f""", base as (select image_id, 32 as height, case when image_id % 4 = 0 then 18 else 32 end as width, image_id % 3 as split,
               count(*) filter (target = 1 and x < case when image_id % 4 = 0 then 18 else 32 end) as n from grid group by image_id),
             sized as (select image_id, case when image_id % 8 = 0 then 18 else height end as height, width, split from base),
             px as (select g.image_id, y, x from grid g join sized s using (image_id) where target = 1 and y < s.height and x < s.width),
             f as (select s.image_id, s.height, s.width, s.split, count(px.y) / (s.height * s.width) as coverage
                   from sized s left join px on px.image_id = s.image_id group by s.image_id, s.height, s.width, s.split),
             big as (select * from f where height > {SMALL_TILE} or width > {SMALL_TILE}), {grid_sql('big', SMALL_TILE, SMALL_OVERLAP)},
             kids as (select t.*, b.split, (select count(*) from px where px.image_id = t.parent_image_id and px.y >= row_offset
                   and px.y < row_offset + valid_height and px.x >= column_offset and px.x < column_offset + valid_width) as n
                   from tiles t join big b on b.image_id = t.parent_image_id)
           select image_id::varchar as image_id, image_id as parent_image_id, split, height::int as height, width::int as width,
              round(coverage, 6) as coverage, 0::int as tile_y0, 0::int as tile_x0, height::int as tile_y1, width::int as tile_x1, coverage > 0 as has_foreground
           from f where height <= {SMALL_TILE} and width <= {SMALL_TILE}
           union all select parent_image_id || '__y' || row_offset || '_x' || column_offset, parent_image_id, split,
              valid_height, valid_width, round(n / (valid_height * valid_width), 6), row_offset, column_offset,
              row_offset + valid_height, column_offset + valid_width, n > 0 from kids""",
    ),
)
def _g3(spark, sf_dir):
    cells = view(spark, sf_dir, "grid")
    sized = cells.select("image_id").distinct().selectExpr(
        "image_id",
        "case when image_id % 8 = 0 then 18 else 32 end as height",
        "case when image_id % 4 = 0 then 18 else 32 end as width",
        "image_id % 3 as split",
    )
    foreground = cells.where("target = 1").join(sized, "image_id").where("y < height and x < width").select(
        "image_id", "y", "x"
    )
    n = foreground.groupBy("image_id").agg(F.count(F.lit(1)).alias("_n"))
    base = sized.join(n, "image_id", "left").withColumn(
        "coverage", F.coalesce("_n", F.lit(0)) / (F.col("height") * F.col("width"))
    ).drop("_n")
    return r6(
        tiling.tiled_manifest(
            base, foreground, tile_size=SMALL_TILE, overlap=SMALL_OVERLAP, fraction="coverage"
        )
    )


def _full_tiles(spark, sf_dir):
    cells = grid(spark, sf_dir)
    return tiling.tile_pixels(
        cells.select("image_id", "y", "x", (F.col("target") * 255).alias("value")),
        every_image(spark, sf_dir),
        tile_size=SMALL_TILE,
        overlap=SMALL_OVERLAP,
        pad_value=7,
    )


_TILE_CELLS = f""", imgs as (select distinct image_id, 32 as height, 32 as width from grid), {grid_sql('imgs', SMALL_TILE, SMALL_OVERLAP)},
  cells as (select tile_id, parent_image_id as image_id, ty, tx, row_offset + ty as y, column_offset + tx as x,
      ty < valid_height and tx < valid_width as valid from tiles, range({SMALL_TILE}) a(ty), range({SMALL_TILE}) b(tx)),
  filled as (select c.*, case when valid then coalesce(g.target * 255, 0) else 7 end as value
      from cells c left join grid g on g.image_id = c.image_id and g.y = c.y and g.x = c.x)"""


@query(
    "g4_tile_pixels",
    with_views(
        "grid",
        f"{_TILE_CELLS} select tile_id, count(*) as cells, count(*) filter (valid) as valid_cells, sum(value)::bigint as value_sum, sum(value * (ty + 3 * tx))::bigint as placed_sum from filled group by 1",
    ),
)
def _g4(spark, sf_dir):
    return _full_tiles(spark, sf_dir).groupBy("tile_id").agg(
        F.count(F.lit(1)).alias("cells"),
        F.count_if("valid").alias("valid_cells"),
        F.sum("value").alias("value_sum"),
        F.sum(F.col("value") * (F.col("tile_y") + 3 * F.col("tile_x"))).alias("placed_sum"),
    )


@query(
    "g5_reconstruction",
    with_views(
        "grid",
        """, s as (select distinct image_id from grid), f as (select image_id, y, x from s, range(32) a(y), range(32) b(x))
           select f.image_id, f.y::int as y, f.x::int as x, (coalesce(target, 0) * 255)::int as value from f left join grid g
             on g.image_id = f.image_id and g.y = f.y and g.x = f.x""",
    ),
)
def _g5(spark, sf_dir):
    return tiling.reconstruct_mean(_full_tiles(spark, sf_dir), whole_numbers=True)


def _scored_tiles(spark, sf_dir):
    tiles = _full_tiles(spark, sf_dir).where("valid")
    return tiles.withColumn(
        "prob", (F.col("value") / 255.0 * 0.5) + (F.col("tile_y") + F.col("tile_x")) / (4.0 * SMALL_TILE)
    )


_HANN = f"(0.5 - 0.5 * cos(2 * pi() * {{}} / {SMALL_TILE - 1}))"
_STITCHED = f"""{_TILE_CELLS}, p as (select image_id, y, x, value / 255.0::double * 0.5 + (ty + tx) / {4.0 * SMALL_TILE}::double as prob,
    greatest({_HANN.format('ty')} * {_HANN.format('tx')}, 1e-3) as w from filled where valid),
  st as (select image_id, y::int as y, x::int as x, sum(w * prob) / greatest(sum(w), 1e-6) as prob from p group by 1, 2, 3)"""


@query("g6_hann_stitching", with_views("grid", f"{_STITCHED} select image_id, y, x, round(prob, 6) as prob from st"))
def _g6(spark, sf_dir):
    return r6(tiling.stitch_hann(_scored_tiles(spark, sf_dir), SMALL_TILE))


@query(
    "g7_tiled_inference",
    with_views("grid", f"{_STITCHED} select image_id, count(*) as cells, sum((prob >= 0.45::double)::int)::bigint as foreground from st group by 1"),
)
def _g7(spark, sf_dir):
    done = tiling.stitch_and_threshold(_scored_tiles(spark, sf_dir), SMALL_TILE, 0.45)
    return done.groupBy("image_id").agg(F.count(F.lit(1)).alias("cells"), F.sum("mask").alias("foreground"))


@query(
    "g8_mosaic",
    with_views(
        "grid",
        """select image_id, (96)::int as height, 96::int as width, count(*) * 9 as cells,
             sum(y * 9 + 9 * 32)::bigint as y_sum, sum(x * 9 + 9 * 32)::bigint as x_sum from grid where target = 1 group by 1""",
    ),
)
def _g8(spark, sf_dir):
    repeated = tiling.multitile_mosaic(mask_of(spark, sf_dir, "target"), tile_size=TILE, overlap=OVERLAP)
    return repeated.groupBy("image_id", "height", "width").agg(
        F.count(F.lit(1)).alias("cells"), F.sum("y").alias("y_sum"), F.sum("x").alias("x_sum")
    )


@query(
    "g9_window_geometry",
    with_views(
        "manifest",
        f""", {grid_sql('manifest', TILE, OVERLAP)} select tile_id, 100::double + 10 * column_offset as tile_c,
            200::double - 10 * row_offset as tile_f, 100::double + 10 * column_offset as bounds_left,
            200::double - 10 * (row_offset + valid_height) as bounds_bottom, 100::double + 10 * (column_offset + valid_width) as bounds_right,
            200::double - 10 * row_offset as bounds_top from tiles""",
    ),
)
def _g9(spark, sf_dir):
    tiles = tiling.tile_grid(manifest(spark, sf_dir), tile_size=TILE, overlap=OVERLAP)
    georeferenced = tiles.withColumns(
        {n: F.lit(v) for n, v in {"a": 10.0, "b": 0.0, "c": 100.0, "d": 0.0, "e": -10.0, "f": 200.0}.items()}
    )
    return tiling.window_geometry(georeferenced).select(
        "tile_id", "tile_c", "tile_f", "bounds_left", "bounds_bottom", "bounds_right", "bounds_top"
    )


@query(
    "g10_canvas_geometry",
    with_views(
        "manifest",
        """, s as (select image_id, least(64::double / width, 64::double / height) as k, width, height from manifest),
           z as (select image_id, greatest(1, round_even(width * k, 0)::int)::int as rw, greatest(1, round_even(height * k, 0)::int)::int as rh from s)
           select image_id, rw as resized_width, rh as resized_height, ((64 - rw) // 2)::int as pad_left, ((64 - rh) // 2)::int as pad_top,
             (64 - rw - (64 - rw) // 2)::int as pad_right, (64 - rh - (64 - rh) // 2)::int as pad_bottom from z""",
    ),
)
def _g10(spark, sf_dir):
    placed = tiling.canvas_geometry(manifest(spark, sf_dir), 64)
    return placed.select(
        "image_id", "resized_width", "resized_height", "pad_left", "pad_top", "pad_right", "pad_bottom"
    )


def _canvas(spark, sf_dir):
    """24x32 sources on a 32x32 canvas: no scaling, four padding rows above and below."""
    cells = view(spark, sf_dir, "grid")
    sources = cells.select("image_id").distinct().withColumns({"height": F.lit(24), "width": F.lit(32)})
    return cells, tiling.canvas_geometry(sources, 32)


@query(
    "g11_restore_from_canvas",
    with_views(
        "grid",
        """, s as (select distinct image_id from grid), f as (select image_id, y, x from s, range(24) a(y), range(32) b(x))
           select f.image_id, f.y::int as y, f.x::int as x, round((f.y + 4) / 32.0::double + coalesce(pred, 0) * 0.25::double, 6) as prob
           from f left join grid g on g.image_id = f.image_id and g.y = f.y + 4 and g.x = f.x""",
    ),
)
def _g11(spark, sf_dir):
    cells, geometry = _canvas(spark, sf_dir)
    canvas = raster.dense_cells(images_of(cells)).join(cells.select("image_id", "y", "x", "pred"), ["image_id", "y", "x"], "left").select(
        "image_id",
        F.col("y").alias("cy"),
        F.col("x").alias("cx"),
        (F.col("y") / 32.0 + F.coalesce("pred", F.lit(0)) * 0.25).alias("prob"),
    )
    return r6(tiling.restore_from_canvas(canvas, geometry))


@query(
    "g12_padded_labels",
    with_views(
        "grid",
        """, s as (select distinct image_id from grid), f as (select image_id, cy, cx from s, range(32) a(cy), range(32) b(cx)),
           l as (select f.image_id, cy, cx, case when cy < 4 or cy >= 28 then 255 else coalesce(target, 0) end as label
             from f left join grid g on g.image_id = f.image_id and g.y = f.cy - 4 and g.x = f.cx and cy between 4 and 27)
           select image_id, label::int as label, count(*) as cells, sum(cy * 32 + cx)::bigint as place_sum from l group by 1, 2""",
    ),
)
def _g12(spark, sf_dir):
    cells, geometry = _canvas(spark, sf_dir)
    padded = tiling.padded_labels(cells.withColumnRenamed("target", "label"), geometry)
    return padded.groupBy("image_id", "label").agg(
        F.count(F.lit(1)).alias("cells"), F.sum(F.col("cy") * 32 + F.col("cx")).alias("place_sum")
    )


# --- boundaries ---------------------------------------------------------------


def cross_sql(source: str, name: str) -> str:
    return f"""{name} as (select a.* from {source} a where (select count(*) from {source} b where b.image_id = a.image_id
      and abs(b.y - a.y) + abs(b.x - a.x) = 1) < 4)"""


def square_sql(source: str, name: str) -> str:
    return f"""{name} as (select a.* from {source} a where (select count(*) from {source} b where b.image_id = a.image_id
      and abs(b.y - a.y) <= 1 and abs(b.x - a.x) <= 1) < (least(a.y + 1, 31) - greatest(a.y - 1, 0) + 1) * (least(a.x + 1, 31) - greatest(a.x - 1, 0) + 1))"""


@query("r1_cross_boundary", with_views("grid", f"{REGION_SQL}, {cross_sql('m', 'b')} select image_id, y, x from b"))
def _r1(spark, sf_dir):
    return raster.boundary(regions(spark, sf_dir)).select("image_id", "y", "x")


@query("r2_square_boundary", with_views("grid", f"{REGION_SQL}, {square_sql('m', 'b')} select image_id, y, x from b"))
def _r2(spark, sf_dir):
    return raster.boundary(regions(spark, sf_dir), "square").select("image_id", "y", "x")


_SIDES = ", p as (select image_id, y, x from grid where pred = 1), t as (select image_id, y, x from grid where target = 1), imgs as (select distinct image_id from grid)"


def _near(a: str, b: str) -> str:
    return f"exists (select 1 from {b} q where q.image_id = {a}.image_id and abs(q.y - {a}.y) <= 2 and abs(q.x - {a}.x) <= 2)"


def boundary_metric_sql(shape) -> str:
    return with_views(
        "grid",
        f"""{_SIDES}, {shape('p', 'pb')}, {shape('t', 'tb')},
        c as (select image_id, (select count(*) from pb where pb.image_id = i.image_id) as np,
          (select count(*) from tb where tb.image_id = i.image_id) as nt,
          (select count(*) from pb where pb.image_id = i.image_id and {_near('pb', 'tb')}) as mp,
          (select count(*) from tb where tb.image_id = i.image_id and {_near('tb', 'pb')}) as mt,
          (select count(*) from pb join tb using (image_id, y, x) where pb.image_id = i.image_id) as both_sides from imgs i),
        v as (select image_id, case when np + nt = 0 then 1.0 when np = 0 then 0.0 else mp / np end as p,
          case when np + nt = 0 then 1.0 when nt = 0 then 0.0 else mt / nt end as r,
          case when np + nt = 0 then 1.0 else both_sides / (np + nt - both_sides) end as iou from c)
        select image_id, round(p, 6) as boundary_precision, round(r, 6) as boundary_recall,
          round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 6) as boundary_f1, round(iou, 6) as boundary_iou from v""",
    )


@query("r3_boundary_metrics_cross", boundary_metric_sql(cross_sql))
def _r3(spark, sf_dir):
    cells = grid(spark, sf_dir)
    return r6(raster.boundary_metrics(cells, images_of(cells)))


@query("r3_boundary_metrics_square", boundary_metric_sql(square_sql))
def _r3_square(spark, sf_dir):
    cells = grid(spark, sf_dir)
    return r6(raster.boundary_metrics(cells, images_of(cells), rule="square"))


def distance_sql(shape, lonely: str) -> str:
    return with_views(
        "grid",
        f"""{_SIDES}, {shape('p', 'pb')}, {shape('t', 'tb')},
        d as (select pb.image_id, pb.y, pb.x, 'p' as side, min(sqrt((pb.y - tb.y) * (pb.y - tb.y) + (pb.x - tb.x) * (pb.x - tb.x))) as d
              from pb join tb on pb.image_id = tb.image_id group by 1, 2, 3
              union all
              select tb.image_id, tb.y, tb.x, 't', min(sqrt((pb.y - tb.y) * (pb.y - tb.y) + (pb.x - tb.x) * (pb.x - tb.x)))
              from tb join pb on pb.image_id = tb.image_id group by 1, 2, 3),
        s as (select image_id, quantile_cont(d, 0.95) as hd95, avg(d) as assd from d group by 1),
        n as (select image_id, (exists (select 1 from pb where pb.image_id = i.image_id))::int
              + (exists (select 1 from tb where tb.image_id = i.image_id))::int as sides from imgs i)
        select image_id, round(case sides when 0 then 0.0 when 1 then {lonely} else hd95 end, 6) as hd95,
          round(case sides when 0 then 0.0 when 1 then {lonely} else assd end, 6) as assd from n left join s using (image_id)""",
    )


@query("r4_surface_distance_cross", distance_sql(cross_sql, "null"))
def _r4(spark, sf_dir):
    cells = grid(spark, sf_dir)
    return r6(raster.surface_distances(cells, images_of(cells)))


@query("r4_surface_distance_square", distance_sql(square_sql, "sqrt(2048::double)"))
def _r4_square(spark, sf_dir):
    cells = grid(spark, sf_dir)
    return r6(raster.surface_distances(cells, images_of(cells), rule="square"))


# --- morphology ---------------------------------------------------------------


def eroded_sql(source: str, name: str, r: int) -> str:
    return f"""{name} as (select a.image_id, a.y, a.x from {source} a join {source} b on b.image_id = a.image_id
      and abs(b.y - a.y) <= {r} and abs(b.x - a.x) <= {r} group by 1, 2, 3 having count(*) =
      (least(a.y + {r}, 31) - greatest(a.y - {r}, 0) + 1) * (least(a.x + {r}, 31) - greatest(a.x - {r}, 0) + 1))"""


def dilated_sql(source: str, name: str, r: int) -> str:
    return f"""{name} as (select distinct image_id, (y + dy)::int as y, (x + dx)::int as x from {source}, range({-r}, {r + 1}) a(dy), range({-r}, {r + 1}) b(dx)
      where y + dy between 0 and 31 and x + dx between 0 and 31)"""


@query("r5_erosion", with_views("grid", f"{REGION_SQL}, {eroded_sql('m', 'e', 1)} select image_id, y, x from e"))
def _r5_erode(spark, sf_dir):
    return raster.erode(regions(spark, sf_dir), 1).select("image_id", "y", "x")


@query("r5_dilation", with_views("grid", f"{_SIDES}, {dilated_sql('t', 'e', 2)} select image_id, y, x from e"))
def _r5_dilate(spark, sf_dir):
    return raster.dilate(mask_of(spark, sf_dir, "target"), 2).select("image_id", "y", "x")


@query(
    "r5_open_close",
    with_views(
        "grid",
        f"""{REGION_SQL}, {eroded_sql('m', 'e1', 1)}, {dilated_sql('e1', 'd1', 1)}, {dilated_sql('d1', 'd2', 1)},
            {eroded_sql('d2', 'e2', 1)} select image_id, y, x from e2""",
    ),
)
def _r5_open_close(spark, sf_dir):
    return raster.open_close(regions(spark, sf_dir), 3).select("image_id", "y", "x")


_BOX = f"""{REGION_SQL}, e as (select image_id, min(x) as x0, min(y) as y0, max(x) as x1, max(y) as y1 from m group by 1)"""


@query(
    "r6_padded_boxes",
    with_views(
        "grid",
        f"""{_BOX} select image_id, coalesce(greatest(x0 - 1, 0), 0)::int as x0, coalesce(greatest(y0 - 1, 0), 0)::int as y0,
            coalesce(least(x1 + 1, 31), 31)::int as x1, coalesce(least(y1 + 1, 31), 31)::int as y1 from imgs left join e using (image_id)""",
    ),
)
def _r6_boxes(spark, sf_dir):
    return raster.bounding_boxes(regions(spark, sf_dir), images_of(grid(spark, sf_dir)), padding=0.04)


def _jitter(name: str) -> str:
    return f"least(greatest({name} + {h5(f'''image_id || ':{name}' ''')} % 7 - 3, 0), 31)"


@query(
    "r6_jittered_boxes",
    with_views(
        "grid",
        f"""{_BOX}, j as (select image_id, {_jitter('x0')} as a, {_jitter('x1')} as b, {_jitter('y0')} as c, {_jitter('y1')} as d from e)
            select image_id, coalesce(least(a, b), 0)::int as x0, coalesce(least(c, d), 0)::int as y0,
              coalesce(greatest(a, b), 31)::int as x1, coalesce(greatest(c, d), 31)::int as y1 from imgs left join j using (image_id)""",
    ),
)
def _r6_jitter(spark, sf_dir):
    return raster.bounding_boxes(regions(spark, sf_dir), images_of(grid(spark, sf_dir)), jitter=0.1)


@query(
    "r10_prompt_points",
    with_views(
        "grid",
        f"""{REGION_SQL}, dense as (select image_id, y::int as y, x::int as x from imgs, range(32) a(y), range(32) b(x)),
            bg as (select d.* from dense d anti join m using (image_id, y, x)),
            {eroded_sql('m', 'fe', 2)}, {eroded_sql('bg', 'be', 3)},
            fr as (select * from fe union all select * from m where image_id not in (select image_id from fe)),
            br as (select * from be union all select * from bg where image_id not in (select image_id from be)),
            pool as (select *, 'positive' as kind, 1 as label from fr
              union all select *, 'positive', 0 from br where image_id not in (select image_id from m)
              union all select *, 'negative', 0 from br),
            o as (select *, row_number() over (partition by image_id, kind order by
                {h5("image_id || ':' || y || ':' || x || ':' || kind")}, y, x) as i, count(*) over (partition by image_id, kind) as n from pool),
            w as (select image_id, kind, 5 as k from o where kind = 'positive' group by all union all
                  select image_id, kind, 3 from o where kind = 'negative' group by all),
            r as (select image_id, kind, unnest(range(1, k + 1)) as draw, k from w)
            select r.image_id, r.kind, draw::int as draw, x, y, label from r join o on o.image_id = r.image_id and o.kind = r.kind
              and o.i = (draw - 1) % least(n, k) + 1""",
    ),
)
def _r10(spark, sf_dir):
    return raster.prompt_points(
        regions(spark, sf_dir), every_image(spark, sf_dir), positives=5, negatives=3
    )


@query(
    "r12_farthest_background",
    with_views(
        "grid",
        f"""{REGION_SQL}, dense as (select image_id, y::int as y, x::int as x from imgs, range(32) a(y), range(32) b(x)),
            bg as (select d.* from dense d anti join m using (image_id, y, x)),
            q as (select bg.image_id, bg.y, bg.x, sqrt(min((bg.y - m.y) * (bg.y - m.y) + (bg.x - m.x) * (bg.x - m.x)))  as d
                  from bg join m on m.image_id = bg.image_id group by 1, 2, 3)
            select image_id, y, x, round(d, 6) as distance, r::int as position from
              (select *, row_number() over (partition by image_id order by d desc, y, x) as r from q) where r <= 2""",
    ),
)
def _r12(spark, sf_dir):
    return r6(raster.farthest_background(regions(spark, sf_dir), images_of(grid(spark, sf_dir)), 2))


@query(
    "r13_error_classes",
    with_views(
        "grid",
        """, c as (select image_id, case when pred = 1 and target = 1 then 'TP' when pred = 1 then 'FP' when target = 1 then 'FN' end as error_class,
             count(*) as cells from grid group by 1, 2)
           select * from c where error_class is not null
           union all select image_id, 'TN', (1024 - coalesce(sum(cells) filter (error_class is not null), 0))::bigint from c group by 1
             having coalesce(sum(cells) filter (error_class is not null), 0) < 1024""",
    ),
)
def _r13(spark, sf_dir):
    return raster.error_class_counts(view(spark, sf_dir, "grid"), F.lit(32), F.lit(32))


# --- components ---------------------------------------------------------------


def component_sql(source: str, connectivity: int, name: str = "comp") -> str:
    """Labels by growing the smallest cell number along neighbours; one row per cell."""
    near = (
        "abs(b.y - a.y) <= 1 and abs(b.x - a.x) <= 1"
        if connectivity == 8
        else "abs(b.y - a.y) + abs(b.x - a.x) <= 1"
    )
    return f"""{name}_e as (select a.image_id * 1024 + a.y * 32 + a.x as u, b.image_id * 1024 + b.y * 32 + b.x as v
        from {source} a join {source} b on b.image_id = a.image_id and {near}),
      {name}_l as (with recursive r(id, lab) using key (id) as (
          select u, min(v) from {name}_e group by u
          union
          select e.u, min(r.lab) from r join {name}_e e on e.v = r.id join recurring.r as cur on cur.id = e.u
          where r.lab < cur.lab group by e.u)
        select id, lab from r),
      {name} as (select id // 1024 as image_id, (id // 32 % 32)::int as y, (id % 32)::int as x, lab from {name}_l)"""


_AREA_SQL = "count(*) as area, round(avg(x), 6) as centroid_x, round(avg(y), 6) as centroid_y, min(x) as x0, min(y) as y0, max(x) as x1, max(y) as y1"


def _component_query(name: str, connectivity: int):
    @query(
        name,
        with_views(
            "grid",
            f"{REGION_SQL}, {component_sql('m', connectivity)} select image_id, {_AREA_SQL} from comp group by image_id, lab",
        ),
    )
    def run(spark, sf_dir):
        labelled = components.label_runs(components.row_runs(regions(spark, sf_dir)), connectivity=connectivity)
        return r6(components.component_table(labelled).drop("label"))


_component_query("r7_components_8", 8)
_component_query("r7_components_4", 4)


@query(
    "r8_remove_small_components",
    with_views(
        "grid",
        f"""{REGION_SQL}, {component_sql('m', 8)} select image_id, y, x from comp
            qualify count(*) over (partition by image_id, lab) >= 6""",
    ),
)
def _r8(spark, sf_dir):
    return components.remove_small_components(regions(spark, sf_dir), 6)


@query(
    "r9_fill_holes",
    with_views(
        "grid",
        f"""{REGION_SQL}, dense as (select image_id, y::int as y, x::int as x from imgs, range(32) a(y), range(32) b(x)),
            bg as (select image_id * 1024 + d.y * 32 + d.x as id, d.* from dense d anti join m using (image_id, y, x)),
            bg_e as (select a.id as u, b.id as v from bg a join bg b on b.image_id = a.image_id and abs(b.y - a.y) + abs(b.x - a.x) = 1),
            open_air as (with recursive r(id) as (
                select id from bg where y in (0, 31) or x in (0, 31)
                union select e.v from r join bg_e e on e.u = r.id) select id from r)
            select image_id, y, x from m union all select image_id, y, x from bg where id not in (select id from open_air)""",
    ),
)
def _r9(spark, sf_dir):
    return components.fill_holes(regions(spark, sf_dir), images_of(grid(spark, sf_dir)))


@query(
    "r11_component_points",
    with_views(
        "grid",
        f"""{REGION_SQL}, {component_sql('m', 8)}, n as (select *, row_number() over (partition by image_id, lab order by y, x) - 1 as i,
              count(*) over (partition by image_id, lab) as area, avg(x) over (partition by image_id, lab) as ax,
              avg(y) over (partition by image_id, lab) as ay from comp),
            s as (select image_id, lab, any_value(area) as area, any_value(round_even(ax, 0)::int) as cx, any_value(round_even(ay, 0)::int) as cy,
              bool_or(x = round_even(ax, 0)::int and y = round_even(ay, 0)::int) as inside,
              max(x) filter (i = area // 2) as mx, max(y) filter (i = area // 2) as my from n group by 1, 2),
            k as (select *, row_number() over (partition by image_id order by area desc, lab) as r from s where area >= 4)
            select image_id, r::int as position, area, (case when inside then cx else mx end)::int as x,
              (case when inside then cy else my end)::int as y from k where r <= 3""",
    ),
)
def _r11(spark, sf_dir):
    points, _ = components.component_points(regions(spark, sf_dir), max_points=3, min_area=4)
    return points


@query(
    "r11_automatic_prompts",
    with_views(
        "grid",
        f"""{REGION_SQL}, {eroded_sql('m', 'e1', 1)}, {dilated_sql('e1', 'd1', 1)}, {dilated_sql('d1', 'd2', 1)},
            {eroded_sql('d2', 'k', 1)}, {component_sql('k', 8)},
            n as (select *, row_number() over (partition by image_id, lab order by y, x) - 1 as i,
              count(*) over (partition by image_id, lab) as area, avg(x) over (partition by image_id, lab) as ax,
              avg(y) over (partition by image_id, lab) as ay from comp),
            s as (select image_id, lab, any_value(area) as area, any_value(round_even(ax, 0)::int) as cx, any_value(round_even(ay, 0)::int) as cy,
              bool_or(x = round_even(ax, 0)::int and y = round_even(ay, 0)::int) as inside,
              max(x) filter (i = area // 2) as mx, max(y) filter (i = area // 2) as my from n group by 1, 2 having any_value(area) >= 4),
            ok as (select image_id, count(*) as components from s group by 1),
            pos as (select image_id, 1 as label, row_number() over (partition by image_id order by area desc, lab) as position,
              case when inside then cx else mx end as x, case when inside then cy else my end as y from s),
            dense as (select image_id, y::int as y, x::int as x from ok, range(32) a(y), range(32) b(x)),
            bg as (select d.* from dense d anti join k using (image_id, y, x)),
            q as (select bg.image_id, bg.y, bg.x, min((bg.y - k.y) * (bg.y - k.y) + (bg.x - k.x) * (bg.x - k.x)) as d
                  from bg join k on k.image_id = bg.image_id group by 1, 2, 3),
            neg as (select image_id, 0 as label, row_number() over (partition by image_id order by d desc, y, x) as position, x, y from q),
            points as (select * from pos where position <= 3 union all select * from neg where position <= 1),
            box as (select image_id, greatest(min(x) - 1, 0) as x0, greatest(min(y) - 1, 0) as y0, least(max(x) + 1, 31) as x1,
              least(max(y) + 1, 31) as y1 from k group by 1)
            select i.image_id, case when ok.image_id is null then 'no_coarse_candidate' else 'ok' end as status,
              coalesce(components, 0)::bigint as components, case when ok.image_id is not null then x0 || ',' || y0 || ',' || x1 || ',' || y1 end as box,
              label, position::int as position, x::int as x, y::int as y
            from imgs i left join ok on ok.image_id = i.image_id left join points p on p.image_id = i.image_id
              left join box on box.image_id = i.image_id""",
    ),
)
def _r11_prompts(spark, sf_dir):
    cells = grid(spark, sf_dir)
    pixels = cells.select("image_id", "y", "x", F.expr(f"case when {_REGION} then 0.9D else 0.1D end as prob"))
    prompts = components.automatic_prompts(pixels, every_image(spark, sf_dir), min_area=4)
    return prompts.select(
        "image_id",
        "status",
        "components",
        F.array_join("box", ",").alias("box"),
        F.explode_outer("points").alias("_p"),
    ).select("image_id", "status", "components", "box", "_p.label", "_p.position", "_p.x", "_p.y")


_TOPOLOGY = f"""{REGION_SQL}, {component_sql('m', 4)}, {cross_sql('m', 'b')},
  n as (select image_id, count(distinct lab) as components, count(*) as area from comp group by 1),
  e as (select image_id, count(*) as edge from b group by 1),
  topo as (select image_id, coalesce(components, 0) as connected_components, case when components is null then 'no_foreground'
     when components = 1 then 'single_component' else 'multiple_components' end as topology_slice,
     coalesce(edge, 0) / greatest(coalesce(area, 0), 1) as boundary_complexity
     from imgs left join n using (image_id) left join e using (image_id))"""


@query(
    "t6_topology_slices",
    with_views("grid", f"{_TOPOLOGY} select image_id, connected_components, topology_slice, round(boundary_complexity, 6) as boundary_complexity from topo"),
)
def _t6(spark, sf_dir):
    return r6(components.topology_slices(regions(spark, sf_dir), images_of(grid(spark, sf_dir))))


@query(
    "b4_boundary_complexity_tertiles",
    with_views(
        "grid",
        f"""{_TOPOLOGY}, {edges_sql('topo', 'boundary_complexity', 3, 'edges')}
            select image_id, ['low', 'medium', 'high'][{bin_sql('boundary_complexity', 'edges')} + 1] as boundary_complexity_slice from topo""",
    ),
)
def _b4_complexity(spark, sf_dir):
    topology = components.topology_slices(regions(spark, sf_dir), images_of(grid(spark, sf_dir)))
    return binning.tertile_labels(
        topology, "boundary_complexity", binning.LEVEL_LABELS, "boundary_complexity_slice"
    ).select("image_id", "boundary_complexity_slice")


@query(
    "a16_per_image_log_loss",
    with_views(
        "px",
        """select image_id, round(avg(-(target * ln(p) + (1 - target) * ln(1 - p))), 6) as bce from
           (select image_id, target, least(greatest(prob, 1e-6::double), 1 - 1e-6::double) as p from px) group by 1""",
    ),
)
def _a16_per_image(spark, sf_dir):
    px = view(spark, sf_dir, "px")
    return r6(px.groupBy("image_id").agg(F.avg(log_loss(F.col("prob"), F.col("target"), 1e-6)).alias("bce")))
