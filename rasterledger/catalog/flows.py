"""Streaming, scoring and end-to-end queries."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from rasterledger.catalog.evaluation import COUNTS_SQL, per_image_sql, r6
from rasterledger.catalog.governance import dochash, documents
from rasterledger.catalog.rasters import _STITCHED, _TILE_CELLS, SMALL_OVERLAP, SMALL_TILE, boundary_metric_sql, cross_sql, distance_sql, grid, images_of
from rasterledger.catalog.registry import query
from rasterledger.catalog.results import EARLY_STOPPING_SQL
from rasterledger.catalog.views import SPLIT, table, view, with_views
from rasterledger.operators import fingerprints, scoring, tiling
from rasterledger.plans.evaluation import BOUNDARY_METRICS, evaluate_predictions
from rasterledger.plans.inference import tiled_inference
from rasterledger.plans.preparation import prepare_dataset
from rasterledger.session import fill_cores, pin, use_checkpoint_dir
from rasterledger.sources import files, sinks
from rasterledger.streaming import monitor, requests


def work_folder(spark) -> str:
    """A new folder inside the shared checkpoint folder."""
    return f"{use_checkpoint_dir(spark)}/run-{uuid.uuid4().hex}"


# --- request log --------------------------------------------------------------

# Means of 2^k two-digit values can lie exactly between two rounded values.
TIE_SHIFT = 1e-9

_LENGTH, _DELAY = "6 hours", "1 hour"
_WINDOWED = """, w as (select time_bucket(interval '6 hours', ts, timestamp '1970-01-01') as ws, model_version, status, total_ms, request_id from reqlog)"""
_START_MS = "epoch_us(ws)::bigint as window_us"


def request_stream(spark, sf_dir):
    return as_requests(requests.read_table_stream(spark, sf_dir, "events.parquet"))


def as_requests(events):
    return events.select(
        F.col("event_id").alias("request_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("v"), F.col("user_id") % 3).alias("model_version"),
        F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"),
        F.col("value").alias("total_ms"),
    )


def _drain(spark, stream, mode):
    folder = work_folder(spark)
    monitor.run_available(stream, monitor.append_to(f"{folder}/out"), f"{folder}/state", mode)
    return spark.read.parquet(f"{folder}/out").drop("batch")


def _closed(columns: str) -> str:
    return f"""{_WINDOWED} select {_START_MS}, model_version, {columns} from w
      where ws + interval '6 hours' <= (select max(ts) from reqlog) - interval '1 hour' group by ws, model_version"""


@query("st1_ingest_request_log", with_views("reqlog", "select model_version, status, count(*) as rows from reqlog group by 1, 2"))
def _st1(spark, sf_dir):
    rows = _drain(spark, request_stream(spark, sf_dir), "append")
    return rows.groupBy("model_version", "status").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "st2_window_summary",
    with_views(
        "reqlog",
        _closed(
            "count(*) as requests, round(avg((status <> 'ok')::int), 6) as error_rate, round(avg(total_ms) + 1e-9, 6) as mean_ms"
        ),
    ),
)
def _st2(spark, sf_dir):
    summary = requests.window_summary(request_stream(spark, sf_dir), length=_LENGTH, delay=_DELAY)
    rows = _drain(spark, summary, "append")
    return r6(
        rows.select(
            F.unix_micros("window_start").alias("window_us"),
            "model_version",
            "requests",
            "error_rate",
            (F.col("mean_ms") + TIE_SHIFT).alias("mean_ms"),
        )
    )


@query(
    "st2_exact_window_summary",
    with_views(
        "reqlog",
        f"""{_WINDOWED} select {_START_MS}, model_version, count(*) as requests, round(avg((status <> 'ok')::int), 6) as error_rate,
            round(avg(total_ms) + 1e-9, 6) as mean_ms, round(quantile_cont(total_ms, 0.5), 6) as p50_ms,
            round(quantile_cont(total_ms, 0.95), 6) as p95_ms from w group by ws, model_version""",
    ),
)
def _st2_exact(spark, sf_dir):
    log = view(spark, sf_dir, "reqlog").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = requests.exact_window_summary(log, length=_LENGTH)
    return r6(
        rows.withColumn("window_us", F.unix_micros("window_start"))
        .withColumn("mean_ms", F.col("mean_ms") + TIE_SHIFT)
        .drop("window_start")
    )


@query(
    "st3_request_dedup",
    with_views("reqlog", "select model_version, count(*) as requests, sum(request_id)::bigint as id_sum from reqlog group by 1"),
)
def _st3(spark, sf_dir):
    # Every third request was sent twice by its client.
    resent = request_stream(spark, sf_dir).withColumn(
        "attempt", F.explode(F.sequence(F.lit(1), F.when(F.col("request_id") % 3 == 0, 2).otherwise(1)))
    )
    rows = _drain(spark, requests.deduplicate(resent, delay="2 days"), "append")
    return rows.groupBy("model_version").agg(
        F.count(F.lit(1)).alias("requests"), F.sum("request_id").alias("id_sum")
    )


@query(
    "st4_latency_gate",
    with_views(
        "reqlog",
        f"""{_WINDOWED}, s as (select ws, model_version, count(*) as requests, quantile_disc(total_ms, 0.95) as p95 from w
              where ws + interval '6 hours' <= (select max(ts) from reqlog) - interval '1 hour' group by 1, 2)
            select {_START_MS}, model_version, requests, round(p95, 6) as p95_ms from s where p95 > 150""",
    ),
)
def _st4(spark, sf_dir):
    # The stream closes windows value by value; a gate on approximate percentiles would pass or stop windows by chance.
    counts = _drain(spark, requests.value_counts(request_stream(spark, sf_dir), length=_LENGTH, delay=_DELAY), "append")
    rows = requests.latency_breaches(requests.closed_percentile(counts, 95, "p95_ms"), 150.0)
    return r6(rows.select(F.unix_micros("window_start").alias("window_us"), "model_version", "requests", "p95_ms"))


@query("st5_early_stopping_monitor", EARLY_STOPPING_SQL)
def _st5(spark, sf_dir):
    orders = requests.read_table_stream(spark, sf_dir, "orders.parquet")
    log = orders.select(
        F.col("o_custkey").alias("run"),
        F.col("o_orderkey").alias("epoch"),
        F.expr("round((o_totalprice % 1000) / 1000, 6)").alias("value"),
    )
    folder = work_folder(spark)
    monitor.run_available(log, monitor.keep_early_stopping(f"{folder}/out", 3), f"{folder}/state", "append")
    return r6(monitor.latest_results(spark, f"{folder}/out"))


@query(
    "st6_incremental_results",
    with_views(
        "runs",
        "select image_id, prompt_mode, arg_min(iou, run_id) as iou, min(run_id) as run_id from runs group by 1, 2",
    ),
)
def _st6(spark, sf_dir):
    orders = requests.read_table_stream(spark, sf_dir, "orders.parquet")
    stream = orders.selectExpr(
        "o_custkey as image_id",
        "o_orderstatus as prompt_mode",
        "o_orderkey as run_id",
        "round((o_totalprice % 1000) / 1000, 6) as iou",
    )
    folder = work_folder(spark)
    writer = monitor.append_new_results(f"{folder}/out", ["image_id", "prompt_mode"], "run_id")
    # The second run replays the whole log from an empty progress folder and adds nothing.
    for attempt in ("first", "replay"):
        monitor.run_available(stream, writer, f"{folder}/state-{attempt}", "append")
    return spark.read.parquet(f"{folder}/out").select("image_id", "prompt_mode", "iou", "run_id")


@query("st7_late_rows_dropped", with_views("reqlog", _closed("count(*) as requests")))
def _st7(spark, sf_dir):
    summary = requests.window_summary(request_stream(spark, sf_dir), length=_LENGTH, delay=_DELAY)
    folder = work_folder(spark)
    sink = monitor.append_to(f"{folder}/out")
    monitor.run_available(summary, sink, f"{folder}/state", "append")
    # A second run over the same progress finds no new file and emits no window twice.
    monitor.run_available(summary, sink, f"{folder}/state", "append")
    rows = spark.read.parquet(f"{folder}/out")
    return rows.select(F.unix_micros("window_start").alias("window_us"), "model_version", "requests")


@query(
    "st7_two_drops",
    with_views(
        "reqlog",
        f"""{_WINDOWED}, late as (select (select max(ts) from reqlog where request_id % 4 <> 0) - interval '1 hour' as mark),
            kept as (select w.* from w, late where request_id % 4 <> 0 or ws + interval '6 hours' > mark)
            select {_START_MS}, model_version, count(*) as requests from kept
            where ws + interval '6 hours' <= (select max(ts) from reqlog) - interval '1 hour' group by ws, model_version""",
    ),
)
def _st7_drops(spark, sf_dir):
    # A quarter of the log is delivered in a second drop, when most of its windows are closed.
    folder = work_folder(spark)
    events = table(spark, sf_dir, "events")
    for drop in (F.col("event_id") % 4 != 0, F.col("event_id") % 4 == 0):
        events.where(drop).write.mode("append").parquet(f"{folder}/log")
        stream = as_requests(spark.readStream.schema(events.schema).parquet(f"{folder}/log"))
        summary = requests.window_summary(stream, length=_LENGTH, delay=_DELAY)
        monitor.run_available(summary, monitor.append_to(f"{folder}/out"), f"{folder}/state", "append")
    rows = spark.read.parquet(f"{folder}/out")
    return rows.select(F.unix_micros("window_start").alias("window_us"), "model_version", "requests")


# --- sinks --------------------------------------------------------------------


@query("s6_table_roundtrip", with_views("manifest", "select image_id, split, lang from manifest"))
def _s6(spark, sf_dir):
    folder = f"{work_folder(spark)}/registry"
    sinks.write_table(
        view(spark, sf_dir, "manifest").select("image_id", "split", "lang"),
        folder,
        partition_by=["split"],
        sort_by=["image_id"],
    )
    return spark.read.parquet(folder)


@query(
    "s4_csv_scan",
    with_views("runs", "select run_id, image_id, prompt_mode from runs"),
)
def _s4(spark, sf_dir):
    folder = f"{work_folder(spark)}/results"
    rows = view(spark, sf_dir, "runs").select("run_id", "image_id", "prompt_mode", "iou")
    sinks.append_rows(rows.where("prompt_mode = 'F'"), folder)
    sinks.append_rows(rows.where("prompt_mode <> 'F'"), folder)
    schema = "run_id bigint, image_id bigint, prompt_mode string, iou double"
    return files.read_csv(spark, folder, schema, ["run_id", "image_id", "prompt_mode"])


@query(
    "s13_existing_tables",
    with_views("runs", "select experiment, count(*) as rows from runs where prompt_mode in ('F', 'O') group by 1"),
)
def _s13(spark, sf_dir):
    folder = work_folder(spark)
    rows = view(spark, sf_dir, "runs")
    for mode in ("F", "O"):
        rows.where(F.col("prompt_mode") == mode).write.parquet(f"{folder}/{mode}")
    found = files.read_existing(spark, [f"{folder}/{m}" for m in ("F", "missing", "O")])
    return found.groupBy("experiment").agg(F.count(F.lit(1)).alias("rows"))


# --- scoring and whole flows --------------------------------------------------


def _logistic(pdf):
    if ((pdf["prob"] == 0.4) & (pdf["image_id"] % 50 == 0)).any():
        raise ValueError("unreadable pixel")
    return pdf.assign(score=1.0 / (1.0 + np.exp(-8.0 * (pdf["prob"] - 0.5))))


@query(
    "v1_batch_scorer",
    with_views(
        "px",
        """, s as (select *, prob = 0.4::double and image_id % 50 = 0 as bad from px)
           select image_id, case when bad then 'error' else 'ok' end as status, count(*) as pixels,
             round(sum(case when not bad then 1 / (1 + exp(-8 * (prob - 0.5::double))) end), 6) as score_sum,
             case when bad then 'ValueError' end as error_type from s group by all""",
    ),
)
def _v1(spark, sf_dir):
    px = fill_cores(view(spark, sf_dir, "px").select("image_id", "prob"))
    scored = scoring.score(px, _logistic, "image_id bigint, score double")
    return r6(
        scored.groupBy("image_id", "status", "error_type").agg(
            F.count(F.lit(1)).alias("pixels"), F.sum("score").alias("score_sum")
        )
    )


def _demo_scorer(tile):
    rows, columns = np.indices(tile.shape)
    return tile / 255.0 * 0.5 + (rows + columns) / (4.0 * SMALL_TILE)


def _contrast_scorer(tile):
    """Needs the whole tile: brightness against the tile's mean. All numbers are exact in binary."""
    return 0.5 + (tile - tile.mean()) / 512.0


@query(
    "v1_tile_scorer",
    with_views(
        "grid",
        f"""{_TILE_CELLS}, m as (select tile_id, avg(value) as mean from filled group by 1)
           select image_id, count(*) as cells, round(sum(0.5::double + (value - mean) / 512.0::double), 6) as prob_sum,
             sum((0.5::double + (value - mean) / 512.0::double >= 0.5::double)::int)::bigint as bright
           from filled join m using (tile_id) where valid group by 1""",
    ),
)
def _v1_tiles(spark, sf_dir):
    cells = grid(spark, sf_dir)
    pixels = cells.select("image_id", "y", "x", (F.col("target") * 255).alias("value"))
    tiles = tiling.tile_pixels(pixels, images_of(cells), tile_size=SMALL_TILE, overlap=SMALL_OVERLAP, pad_value=7)
    scored = scoring.score_tiles(tiles, _contrast_scorer, SMALL_TILE)
    return r6(
        scored.groupBy("image_id").agg(
            F.count("prob").alias("cells"), F.sum("prob").alias("prob_sum"), F.count_if(F.col("prob") >= 0.5).alias("bright")
        )
    )


@query(
    "flow_tiled_inference",
    with_views("grid", f"{_STITCHED} select image_id, count(*) as cells, sum((prob >= 0.45::double)::int)::bigint as foreground from st group by 1"),
)
def _flow_inference(spark, sf_dir):
    cells = grid(spark, sf_dir)
    stitched, _ = tiled_inference(
        cells.select("image_id", "y", "x", (F.col("target") * 255).alias("value")),
        images_of(cells),
        _demo_scorer,
        tile_size=SMALL_TILE,
        overlap=SMALL_OVERLAP,
        threshold=0.45,
    )
    return stitched.groupBy("image_id").agg(F.count(F.lit(1)).alias("cells"), F.sum("mask").alias("foreground"))


@query(
    "flow_evaluation",
    with_views(
        "px",
        f"""{COUNTS_SQL}, m as ({per_image_sql()}) select {SPLIT.format(key="image_id")} as split, count(*) as images,
            round(avg(iou), 6) as iou, round(avg(dice), 6) as dice, round(avg(mcc), 6) as mcc from m group by 1""",
    ),
)
def _flow_evaluation(spark, sf_dir):
    px = view(spark, sf_dir, "px")
    labels = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("image_id"))
    labels = labels.withColumn("split", F.expr(SPLIT.format(key="image_id")))
    done = evaluate_predictions(px, labels, threshold=0.5, sample_pixels=None)
    return r6(done.macro.select("split", "images", "iou", "dice", "mcc"))


@query(
    "flow_boundary_evaluation",
    f"""select image_id, {SPLIT.format(key="image_id")} as split, boundary_precision, boundary_recall, boundary_f1, boundary_iou, hd95, assd
        from ({boundary_metric_sql(cross_sql)}) join ({distance_sql(cross_sql, "null")}) using (image_id)""",
)
def _flow_boundary_evaluation(spark, sf_dir):
    cells = grid(spark, sf_dir)
    pixels = cells.select("image_id", "y", "x", F.col("pred").cast("double").alias("prob"), "target")
    labels = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("image_id"))
    labels = labels.withColumn("split", F.expr(SPLIT.format(key="image_id")))
    done = evaluate_predictions(pixels, labels, threshold=0.5, images=images_of(cells))
    return r6(done.results.select("image_id", "split", *BOUNDARY_METRICS))


@query(
    "flow_preparation",
    """with v as (select count(*) filter (doc_id % 50 <> 0) as n, count(*) filter (doc_id % 50 = 0) as errors from documents),
         c as (select n, errors, floor(n * 0.15::double)::bigint as part from v)
       select n as total_pairs, n - 2 * part as train_pairs, part as validation_pairs, part as test_pairs, errors,
         ((n - 2 * part) * 2 * part + part * part)::bigint as expected_cross_split_pairs, true as audit_complete from c""",
)
def _flow_preparation(spark, sf_dir):
    # A row without an id is in neither listing, one without a length has no characters.
    docs = documents(spark, sf_dir).where("doc_id is not null").withColumn("n_chars", F.coalesce("n_chars", F.lit(0)))
    sizes = docs.selectExpr(
        "doc_id as image_id",
        "cast(n_chars % 97 + 5 as int) as width",
        "cast(n_chars % 89 + 7 as int) as height",
        "sha2(text, 256) as image_sha256",
    )
    hashes = pin(dochash(spark, sf_dir).select("image_id", "image_ahash"))
    # Texts without words have no row there: all their counts are 0 and reach the mean. Merged, as hashes grow with the table.
    images = sizes.join(hashes.hint("merge"), "image_id", "left").fillna(fingerprints.FLAT_HASH, "image_ahash")
    masks = docs.selectExpr(
        "doc_id as image_id",
        "cast(n_chars % 97 + 5 as int) as mask_width",
        "cast(n_chars % 89 + 7 + if(doc_id % 50 = 0, 1, 0) as int) as mask_height",
        "cast(n_chars % 1000 as double) / 1000 as coverage",
    )
    prepared = prepare_dataset(images, masks, validation_share=0.15, test_share=0.15, seed=42, fraction="coverage")
    counts = prepared.payload.select("total_pairs", "train_pairs", "validation_pairs", "test_pairs", F.lit(1).alias("one"))
    errors = prepared.errors.agg(F.count(F.lit(1)).alias("errors")).withColumn("one", F.lit(1))
    audit = prepared.audit.select("expected_cross_split_pairs", "audit_complete", F.lit(1).alias("one"))
    return counts.join(errors, "one").join(audit, "one").drop("one")
