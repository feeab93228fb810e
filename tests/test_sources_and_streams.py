import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rasterledger.sources import files, sinks
from rasterledger.streaming import monitor, requests


def write(path, content=b"x"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as handle:
        handle.write(content)


def test_scan_pairs_and_hashes(spark, tmp_path):
    write(f"{tmp_path}/Images/A one.PNG", b"abc")
    write(f"{tmp_path}/Images/sub/b.jpeg", b"abcd")
    write(f"{tmp_path}/Images/notes.txt")
    found = files.with_sha256(files.scan_files(spark, f"{tmp_path}/Images", content=True)).collect()
    assert {r["stem"] for r in found} == {"a one", "b"}
    assert {r["length"] for r in found} == {3, 4}
    assert any(r["sha256"].startswith("ba7816bf") for r in found)
    bare = files.scan_files(spark, f"{tmp_path}/Images", [".TXT"])
    assert bare.columns == ["path", "length", "modificationTime", "stem", "filename"] and bare.count() == 1


def test_duplicate_stems_fail(spark, tmp_path):
    for name in ("a.png", "sub/A.jpg", "b.png"):
        write(f"{tmp_path}/{name}")
    listing = files.scan_files(spark, str(tmp_path))
    found = sorted((row["stem"], row["path"].rsplit("/", 1)[1], row["rows"]) for row in files.duplicate_stems(listing).collect())
    assert found == [("a", "A.jpg", 1), ("a", "a.png", 1)]
    with pytest.raises(ValueError, match="ambiguous"):
        files.index_by_stem(listing)


def test_best_root_has_the_largest_capacity(spark):
    paths = [f"/x/Images/{i}.png" for i in range(5)] + ["/x/Masks/0.png"]
    paths += [f"/y/images/{i}.png" for i in range(3)] + [f"/y/masks/{i}.png" for i in range(3)]
    best = files.best_root(files.candidate_roots(spark.createDataFrame([(p,) for p in paths], "path string"))).first()
    assert (best["root"], best["paired_capacity"]) == ("/y", 3)


def test_csv_append_and_column_pruning(spark, tmp_path):
    path = f"{tmp_path}/results"
    df = spark.createDataFrame([("a", "box", 0.5)], "image_id string, prompt_mode string, iou double")
    sinks.append_rows(df, path)
    sinks.append_rows(df, path)
    back = files.read_csv(spark, path, df.schema, ["image_id", "iou"])
    assert back.count() == 2 and back.columns == ["image_id", "iou"]
    assert "ReadSchema: struct<image_id:string,iou:double>" in back._jdf.queryExecution().toString()


def test_json_lines_keep_bad_text_and_skip_blanks(spark, tmp_path):
    write(f"{tmp_path}/log.jsonl", b'{"status":"ok","total_ms":1.5}\n\n   \n{broken\n')
    rows = files.read_json_lines(spark, f"{tmp_path}/log.jsonl", "status string, total_ms double").collect()
    assert len(rows) == 2
    assert {r["_corrupt"] for r in rows} == {None, "{broken"}


def test_registry_files(spark, tmp_path):
    df = spark.createDataFrame([("b", "test"), ("a", "train"), ("c", "train")], "image_id string, split string")
    sinks.write_data_registry(df, f"{tmp_path}/t", f"{tmp_path}/p", {"dataset_name": "demo"})
    assert sorted(d for d in os.listdir(f"{tmp_path}/t") if d.startswith("split=")) == ["split=test", "split=train"]
    payload = spark.read.json(f"{tmp_path}/p").first()
    assert (payload["total_pairs"], payload["train_pairs"], payload["validation_pairs"]) == (3, 2, 0)
    assert len(payload["split_registry_sha256"]) == 64 and payload["dataset_name"] == "demo"


def test_failure_ledger_appends_fixed_columns(spark, tmp_path):
    failures = spark.sql("select 'hpo' as stage, map('b', '2', 'a', '1') as configuration, 'OOM' as error_type")
    sinks.append_failures(failures, f"{tmp_path}/ledger")
    sinks.append_failures(failures.drop("configuration"), f"{tmp_path}/ledger")
    back = spark.read.parquet(f"{tmp_path}/ledger")
    assert tuple(back.columns) == sinks.FAILURE_COLUMNS
    rows = back.collect()
    assert {r["configuration_json"] for r in rows} == {'{"a":"1","b":"2"}', "{}"}
    assert {r["rerun_status"] for r in rows} == {"pending"} and {r["root_cause"] for r in rows} == {""}


def test_merge_and_existing_tables(spark, tmp_path):
    a = spark.createDataFrame([("x",)], "image_id string")
    with pytest.raises(ValueError, match="more than one split"):
        files.merge_splits({"train": a, "test": a})
    with pytest.raises(RuntimeError):
        files.read_existing(spark, [f"{tmp_path}/none"])
    a.write.parquet(f"{tmp_path}/one")
    assert files.read_existing(spark, [f"{tmp_path}/none", f"{tmp_path}/one"]).count() == 1


def test_metric_log_lines(spark, tmp_path):
    steps = spark.createDataFrame([(1, 0.5, 2.0)], "step bigint, loss double, iou double")
    assert sinks.metric_log_rows(steps, "step", ["loss", "iou"]).first()["value"] == '{"iou":2.0,"loss":0.5}'
    sinks.append_metric_log(steps, f"{tmp_path}/m", "step", ["loss"])
    assert json.loads(spark.read.text(f"{tmp_path}/m").first()[0]) == {"step": 1, "loss": 0.5}


START = datetime(2024, 1, 1)


def log_lines(path, records):
    write(path, "\n".join(json.dumps(r) for r in records).encode())


def record(minute, request, status="ok", ms=10.0):
    return {
        "timestamp_utc": (START + timedelta(minutes=minute)).strftime("%Y-%m-%dT%H:%M:%SZ"),
        "request_id": request,
        "model_version": "v1",
        "status": status,
        "total_ms": ms,
        "predicted_water_fraction": 0.5,
        "output_values": [0, 1],
    }


def run(stream, folder, mode="append"):
    monitor.run_available(stream, monitor.append_to(f"{folder}/out"), f"{folder}/state", mode)


def test_windows_close_behind_the_watermark_and_late_rows_are_dropped(spark, tmp_path):
    log = f"{tmp_path}/log"
    log_lines(f"{log}/1.jsonl", [record(m, f"r{m}", "ok" if m else "error", 10.0 * (m + 1)) for m in range(4)] + [record(60, "x")])
    source = requests.read_requests(spark, log)
    summary = requests.window_summary(
        source, length="10 minutes", delay="5 minutes", ts="timestamp_utc", fraction="predicted_water_fraction"
    )
    run(summary, tmp_path)
    # This row belongs to a window that is closed by now.
    log_lines(f"{log}/2.jsonl", [record(1, "late"), record(120, "y")])
    run(summary, tmp_path)
    rows = spark.read.parquet(f"{tmp_path}/out").orderBy("window_start").collect()
    assert [(r["window_start"], r["requests"]) for r in rows] == [(START, 4), (START + timedelta(minutes=60), 1)]
    assert (rows[0]["error_rate"], rows[0]["mean_ms"], rows[0]["mean_output_fraction"]) == (0.25, 25.0, 0.5)
    batch = spark.read.schema(requests.REQUEST_SCHEMA).json(f"{log}/1.jsonl")
    exact = requests.exact_window_summary(batch, length="10 minutes", ts="timestamp_utc").orderBy("window_start").first()
    assert (exact["requests"], exact["p50_ms"]) == (4, 25.0)
    assert requests.latency_breaches(exact_frame(spark, exact), 30.0).count() == 1


def exact_frame(spark, row):
    return spark.createDataFrame([(row["p95_ms"],)], "p95_ms double")


def test_the_gate_knows_the_exact_percentile_of_a_large_window(spark, tmp_path):
    schema = "request_id long, ts timestamp, model_version string, status string, total_ms double"
    made = spark.range(60_001).select(
        F.col("id").alias("request_id"),
        F.when(F.col("id") < 60_000, START).otherwise(START + timedelta(hours=9)).cast("timestamp").alias("ts"),
        F.lit("v").alias("model_version"),
        F.lit("ok").alias("status"),
        F.when(F.col("id") % 20_000 == 7, F.when(F.col("id") > 7, float("nan"))).otherwise((F.col("id") * 7919) % 60_000 / 7.0).alias("total_ms"),
    )
    made.write.parquet(f"{tmp_path}/log")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/log")
    run(requests.value_counts(stream, length="6 hours", delay="1 hour"), tmp_path)
    found = requests.closed_percentile(spark.read.parquet(f"{tmp_path}/out"), 95, "p95_ms").collect()
    values = sorted(i * 7919 % 60_000 / 7.0 for i in range(60_000) if i % 20_000 != 7)
    assert [(r["requests"], r["p95_ms"]) for r in found] == [(60_000, values[-(-len(values) * 95 // 100) - 1])]


def test_resent_requests_count_once(spark, tmp_path):
    log = f"{tmp_path}/log"
    log_lines(f"{log}/1.jsonl", [record(0, "a"), record(0, "a"), record(1, "b")])
    stream = requests.deduplicate(requests.read_requests(spark, log), delay="1 hour", ts="timestamp_utc")
    run(stream.select("request_id"), tmp_path)
    log_lines(f"{log}/2.jsonl", [record(2, "a"), record(3, "c")])
    run(stream.select("request_id"), tmp_path)
    found = sorted(r[0] for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert found == ["a", "b", "c"]


def test_monitor_keeps_state_across_batches(spark, tmp_path):
    schema = "run bigint, epoch bigint, value double"
    log = f"{tmp_path}/log"
    os.makedirs(log)
    stream = spark.readStream.schema(schema).parquet(log)
    writer = monitor.keep_early_stopping(f"{tmp_path}/out", 2)
    parts = [[(1, 1, 0.7), (1, 0, 0.5), (2, 0, 0.1), (3, 0, None)], [(1, 2, 0.6), (2, 1, 0.2)], [(1, 4, 0.9), (1, 3, 0.6), (3, 1, None)]]
    for part in parts:
        spark.createDataFrame(part, schema).write.mode("append").parquet(log)
        monitor.run_available(stream, writer, f"{tmp_path}/state", "append")
    last = {r["run"]: r for r in monitor.latest_results(spark, f"{tmp_path}/out").collect()}
    assert (last[1]["best_epoch"], last[1]["epochs_run"], last[1]["stopped_early"]) == (1, 4, True)
    assert (last[2]["best_value"], last[2]["stopped_early"]) == (0.2, False)
    assert (last[3]["best_position"], last[3]["epochs_run"], last[3]["stopped_early"]) == (0, 2, True)
    before = sorted(map(tuple, last.values()))
    writer(spark.createDataFrame(parts[2], schema), 2)  # a replay
    assert sorted(map(tuple, monitor.latest_results(spark, f"{tmp_path}/out").collect())) == before


def test_replayed_results_are_not_stored_twice(spark, tmp_path):
    path = f"{tmp_path}/out"
    writer = monitor.append_new_results(path, ["image_id"], "run_id")
    batch = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "image_id string, run_id bigint")
    for batch_id in (0, 0, 1):
        writer(batch, batch_id)
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 3)]
