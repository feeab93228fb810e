"""Nested JSON, pairing verdicts, schema contracts, exact samples, banding slabs and audits, late rows."""

import json
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterledger.functions.hashing import canonical_json, stable_hash32
from rasterledger.operators import checks, fingerprints, leakage, pairing, splitting
from rasterledger.streaming import monitor, requests


def test_canonical_json_of_nested_values(spark):
    schema = "id int, v struct<z: int, a: struct<y: string, b: array<struct<q: double, c: boolean>>>, m: map<string, array<int>>>"
    rows = [
        (1, (512, ("512", [(0.5, True), (2.0, None)]), {"k": [3, 1], "b": None})),
        (2, (None, None, {})),
        (3, None),
    ]
    df = spark.createDataFrame(rows, schema)
    found = {r["id"]: r["j"] for r in df.select("id", canonical_json(F.col("v"), df.schema["v"].dataType).alias("j")).collect()}
    first = {"z": 512, "a": {"y": "512", "b": [{"q": 0.5, "c": True}, {"q": 2.0, "c": None}]}, "m": {"k": [3, 1], "b": None}}
    dumped = lambda v: json.dumps(v, sort_keys=True, separators=(",", ":"))
    assert found == {1: dumped(first), 2: dumped({"z": None, "a": None, "m": {}}), 3: None}
    with pytest.raises(TypeError):
        canonical_json(F.col("v"), spark.createDataFrame([({1: 2},)], "v map<int,int>").schema["v"].dataType)


def test_typed_settings_have_other_fingerprints(spark):
    table = spark.createDataFrame([(1,)], "image_id int")
    prints = set()
    for kind in ("size int", "size string", "size double"):
        value = {"int": 512, "string": "512", "double": 512.0}[kind.split()[1]]
        row = fingerprints.typed_study_fingerprint(spark.createDataFrame([(value,)], kind), {"data": table}).first()
        assert json.loads(row["payload"])["size"] == value
        prints.add(row["fingerprint"])
    assert len(prints) == 3


def test_pairing_verdicts(spark):
    images = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "image_id string")
    masks = spark.createDataFrame([("a",), ("b",), ("d",)], "image_id string")
    found = {tuple(r) for r in pairing.pairing_verdicts(images, masks).collect()}
    assert found == {("a", 1, 1, "paired"), ("b", 2, 1, "ambiguous"), ("c", 1, 0, "image alone"), ("d", 0, 1, "mask alone")}


def test_schema_contract(spark):
    df = spark.createDataFrame([(1, None), (None, None), (3, "x")], "a int, b string")
    found = {r["column"]: tuple(r)[1:] for r in checks.schema_contract(df, {"a": "int", "b": "double", "c": "int"}).collect()}
    assert found == {"a": ("int", "int", True, 3, 1), "b": ("double", "string", False, 3, 2), "c": ("int", None, False, 3, 3)}


@pytest.mark.parametrize("n", [0, 1, 777, 3000, 3001])
def test_sample_has_exactly_the_smallest_draws(spark, n):
    """Two thirds of the rows share one id, so the threshold falls inside ties, too."""
    ids = [str(i) for i in range(1000)] + ["hot"] * 2000
    df = spark.createDataFrame([(i,) for i in ids], "image_id string").repartition(4)
    found = splitting.sample_rows(df, n, 5)
    draws = {r["image_id"]: r["d"] for r in df.distinct().select("image_id", stable_hash32(F.col("image_id"), 5).alias("d")).collect()}
    expected = sorted(ids, key=lambda i: (draws[i], i))[:n]
    assert sorted(r["image_id"] for r in found.collect()) == sorted(expected)


def test_over_full_buckets_are_compared_slab_by_slab(spark):
    rng = np.random.default_rng(11)
    centre = int(rng.integers(0, 1 << 62))
    bits = {centre} | {centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 16, (150, 2))} | {int(x) for x in rng.integers(0, 1 << 62, 100)}
    expected = {(a, b, (a ^ b).bit_count()) for a, b in combinations(sorted(bits), 2) if (a ^ b).bit_count() <= 3}
    hashes = spark.createDataFrame([(b,) for b in bits], "bits long")
    for limit in (2000, 7):
        found = leakage.close_hashes(hashes, 3, bucket_limit=limit, refinements=1)
        assert {tuple(r) for r in found.collect()} == expected and found.count() == len(expected)


def test_audit_counts_what_was_compared(spark):
    rows = [(str(i), s, b) for i, (s, b) in enumerate([("train", 1), ("train", 1), ("test", 3), ("validation", 255), ("test", 1 << 40)])]
    manifest = spark.createDataFrame(rows, "image_id string, split string, bits long")
    groups = leakage.near_duplicate_groups(manifest, hamming_threshold=2)
    whole = leakage.audit_metadata(manifest, groups, 2).first()
    assert (whole["comparisons_evaluated"], whole["expected_cross_split_pairs"], whole["audit_complete"]) == (8, 8, True)
    part = leakage.audit_metadata(manifest, groups, 2, settled=manifest.where("bits < 100").select("bits")).first()
    assert (part["comparisons_evaluated"], part["audit_complete"]) == (2, False)


def test_rows_behind_the_watermark_are_counted(spark, tmp_path):
    schema = "request_id long, ts timestamp, model_version string, status string, total_ms double"
    dropped = []
    for drop in ([(1, "01:10"), (2, "09:10")], [(3, "01:20"), (4, "09:20"), (5, "23:00")]):
        rows = [(i, f"2024-05-01 {at}:00", "v", "ok", 1.0) for i, at in drop]
        frame = spark.createDataFrame(rows, "request_id long, ts string, model_version string, status string, total_ms double")
        frame.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/log")
        summary = requests.window_summary(stream, length="1 hour", delay="1 hour")
        dropped.append(monitor.run_available(summary, monitor.append_to(f"{tmp_path}/out"), f"{tmp_path}/state", "append"))
    found = {(r["window_start"].hour, r["requests"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert found == {(1, 1), (9, 2)} and dropped == [0, 1]
