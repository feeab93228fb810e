import hashlib
import json
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rasterledger.functions.hashing import canonical_json, hamming_hex, stable_hash32
from rasterledger.operators import binning, fingerprints, governance, leakage, pairing, splitting, validation


def test_stable_hash_matches_its_definition(spark):
    values = ["7", "abc", "doc-1"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    found = [r[0] for r in df.select(stable_hash32(F.col("v"), 42)).collect()]
    assert found == [
        int(hashlib.sha256(f"42:{v}".encode()).hexdigest()[:16], 16) % 2**32 for v in values
    ]


def test_canonical_json_sorts_keys(spark):
    df = spark.sql("select map('b', '2', 'a', '1') as m")
    assert df.select(canonical_json(F.col("m"))).first()[0] == json.dumps(
        {"b": "2", "a": "1"}, sort_keys=True, separators=(",", ":")
    )


def test_table_digest_ignores_order_and_sees_changes(spark):
    df = spark.range(500).selectExpr("id", "id % 7 as k", "cast(id as string) as s")
    base = fingerprints.table_digest(df).first()
    assert base == fingerprints.table_digest(df.orderBy(F.desc("id")).repartition(3)).first()
    assert base["digest"] != fingerprints.table_digest(df.where("id <> 3")).first()["digest"]
    twice = fingerprints.table_digest(df.unionByName(df.where("id = 3"))).first()
    assert twice["digest"] != base["digest"] and twice["rows"] == 501


def test_hamming_distance(spark):
    df = spark.createDataFrame([("0" * 16, "f" * 16, 64), ("0" * 15 + "1", "0" * 16, 1)], "a string, b string, d int")
    assert all(r[0] == r[1] for r in df.select(hamming_hex(F.col("a"), F.col("b")), "d").collect())
    bad = spark.createDataFrame([("00", "0" * 16)], "a string, b string")
    with pytest.raises(Exception, match="different lengths"):
        bad.select(hamming_hex(F.col("a"), F.col("b"))).collect()


def test_average_hash_bits(spark):
    value = np.zeros((16, 16))
    value[:8] = 200
    rows = [("a", int(y), int(x), float(v), 16, 16) for (y, x), v in np.ndenumerate(value)]
    df = spark.createDataFrame(rows, "image_id string, y int, x int, value double, height int, width int")
    assert fingerprints.average_hash(df).first()["image_ahash"] == "ffffffff00000000"


def test_sparse_rasters_equal_dense_ones(spark):
    rng = np.random.default_rng(8)
    dense, sparse = [], []
    for k, (h, w) in enumerate([(16, 24), (13, 19), (40, 11), (9, 9)]):
        value = (rng.random((h, w)) < 0.2 * k) * 255
        for (y, x), v in np.ndenumerate(value):
            row = (k, int(y), int(x), int(v), h, w)
            dense.append(row)
            if v or (y, x) == (0, 0):
                sparse.append(row)
    schema = "image_id int, y int, x int, value int, height int, width int"
    for of in (fingerprints.average_hash, validation.mask_statistics):
        one, two = (sorted(map(tuple, of(spark.createDataFrame(rows, schema)).collect())) for rows in (dense, sparse))
        assert one == two


def test_strict_pairing_lists_both_sides(spark):
    images = spark.createDataFrame([("a",), ("b",)], "image_id string")
    masks = spark.createDataFrame([("b",), ("c",)], "image_id string")
    with pytest.raises(ValueError, match="'a'.*'c'"):
        pairing.strict_pairs(images, masks)
    assert pairing.strict_pairs(images, images.withColumn("m", F.lit(1))).count() == 2
    with pytest.raises(ValueError, match="ambiguous"):
        pairing.strict_pairs(images.union(images), masks)
    with pytest.raises(RuntimeError):
        pairing.lenient_pairs(images.where("image_id = 'a'"), masks)


def test_historical_split_checks(spark):
    manifest = spark.createDataFrame([("A ",), ("b",)], "image_id string")
    history = spark.createDataFrame([("a", "VAL"), (" B", "test"), ("b", "test")], "image_id string, split string")
    found = {r["image_id"]: r["split"] for r in pairing.recover_split(manifest, history).collect()}
    assert found == {"a": "validation", "b": "test"}
    with pytest.raises(ValueError, match="incomplete"):
        pairing.recover_split(manifest, history.where("split = 'VAL'"))
    with pytest.raises(ValueError, match="Several"):
        pairing.recover_split(manifest, history.union(spark.createDataFrame([("a", "train")])))
    with pytest.raises(ValueError, match="Invalid"):
        pairing.recover_split(manifest.limit(1), spark.createDataFrame([("a", "dev")], "image_id string, split string"))


def test_digest_crossing_is_found_and_a_blank_switches_it_off(spark):
    rows = [("a", "train", "x", "m1"), ("b", "test", "x", "m2")]
    schema = "image_id string, split string, image_sha256 string, mask_sha256 string"
    crossing = spark.createDataFrame(rows, schema)
    with pytest.raises(ValueError, match="cross split"):
        leakage.assert_split_integrity(crossing)
    blank = spark.createDataFrame([*rows, ("c", "train", "", "m3")], schema)
    leakage.assert_split_integrity(blank)
    assert leakage.crossing_digests(blank, "image_sha256").first()["check_skipped"]
    with pytest.raises(ValueError, match="Duplicate"):
        leakage.assert_split_integrity(crossing.union(crossing))


def brute_pairs(rows, t):
    out = set()
    for a, sa, ha in rows:
        for b, sb, hb in rows:
            d = (int(ha, 16) ^ int(hb, 16)).bit_count()
            if sa < sb and d <= t:
                out.add((a, sa, b, sb, d))
    return out


def audit_frame(spark, rows):
    return spark.createDataFrame(rows, "image_id string, split string, image_ahash string")


def test_near_duplicate_fixture(spark):
    rows = [("a", "train", "0" * 16), ("b", "test", "0" * 15 + "1"), ("c", "validation", "f" * 16)]
    df = audit_frame(spark, rows)
    groups = leakage.near_duplicate_groups(df, hamming_threshold=1)
    assert {tuple(r) for r in leakage.expand_groups(df, groups).collect()} == brute_pairs(rows, 1)
    meta = leakage.audit_metadata(df, groups, 1).first()
    assert (meta["comparisons_evaluated"], meta["suspected_pairs"], meta["audit_complete"]) == (3, 1, True)
    with pytest.raises(ValueError):
        leakage.near_duplicate_groups(df, hamming_threshold=-1)


@pytest.mark.parametrize("t,limit", [(0, 2000), (2, 2000), (4, 2000), (4, 3)])
def test_near_duplicates_equal_brute_force_also_in_crowded_buckets(spark, t, limit):
    rng = np.random.default_rng(t)
    base = [int(x) for x in rng.integers(0, 2**62, 12)]
    rows = []
    for i in range(150):
        # A third of the rows are copies of one hash, the others sit near a few centres.
        value = base[0] if i % 3 == 0 else base[i % 12] ^ sum(1 << int(b) for b in rng.integers(0, 63, 3))
        rows.append((f"i{i:03d}", ["train", "validation", "test"][int(rng.integers(0, 3))], f"{value:016x}"))
    df = audit_frame(spark, rows)
    groups = leakage.near_duplicate_groups(df, hamming_threshold=t, bucket_limit=limit)
    expected = brute_pairs(rows, t)
    assert {tuple(r) for r in leakage.expand_groups(df, groups).collect()} == expected
    assert groups.agg(F.sum("image_pairs")).first()[0] == len(expected)
    involved = {p[0] for p in expected} | {p[2] for p in expected}
    assert {r[0] for r in leakage.near_duplicate_images(df, groups).select("image_id").collect()} == involved


def test_near_duplicate_joins_are_not_sent_through_the_driver(spark):
    rows = [(f"i{i}", ["train", "test"][i % 2], f"{i:016x}") for i in range(40)]
    df = audit_frame(spark, rows)
    rounds = []
    groups = leakage.near_duplicate_groups(df, hamming_threshold=2, settled=rounds)
    for frame in (groups, leakage.near_duplicate_images(df, groups), leakage.expand_groups(df, groups)):
        assert "Broadcast" not in frame._jdf.queryExecution().executedPlan().toString()
    assert sorted(r[0] for r in leakage.decided_hashes(rounds).collect()) == list(range(40))


def test_band_number_grows_with_the_table():
    assert leakage.agreeing_bands(1_000, 4) == 1
    assert leakage.agreeing_bands(10**9, 4) >= 3


def test_leakage_between_frames(spark):
    make = lambda rows: spark.createDataFrame(rows, "image_id string, image_sha256 string")
    clean = make([("a", "1")]), make([("b", "2")]), make([("c", "3")])
    leakage.assert_no_leakage(*clean)
    with pytest.raises(ValueError, match="Leakage"):
        leakage.assert_no_leakage(clean[0], clean[1], make([("d", "1")]))


def test_exact_split_counts(spark):
    df = spark.createDataFrame([(f"i{i}", i / 9) for i in range(10)], "image_id string, water_fraction double")
    wanted = {"train": 6, "validation": 2, "test": 2}
    args = dict(train_count=6, validation_count=2, test_count=2, seed=42, method="shuffled")
    first = splitting.assign_exact_split(df, **args)
    counts = {r["split"]: r["n"] for r in first.groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert counts == wanted
    again = splitting.assign_exact_split(df.repartition(5), **args)
    assert {tuple(r) for r in first.collect()} == {tuple(r) for r in again.collect()}
    with pytest.raises(ValueError, match="add up"):
        splitting.assign_exact_split(df, train_count=9, validation_count=2, test_count=2, seed=1)


def test_split_method_is_the_callers_choice(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(4)], "image_id bigint, water_fraction double")
    with pytest.raises(ValueError, match="too small"):
        splitting.assign_exact_split(df, train_count=2, validation_count=1, test_count=1, seed=1)
    shuffled = splitting.assign_exact_split(df, train_count=2, validation_count=1, test_count=1, seed=1, method="shuffled")
    assert sorted(r["split"] for r in shuffled.collect()) == ["test", "train", "train", "validation"]


def test_stratified_split_keeps_the_shares(spark):
    df = spark.range(400).selectExpr("id as image_id", "id / 400.0D as water_fraction")
    found = splitting.assign_exact_split(df, train_count=280, validation_count=60, test_count=60, seed=3)
    per_bin = found.where("split = 'test'").groupBy(F.floor(F.col("water_fraction") * 10)).count().collect()
    assert len(per_bin) == 10 and all(r["count"] == 6 for r in per_bin)


def test_group_split_keeps_copies_together(spark):
    df = spark.range(100).selectExpr(
        "id as image_id", "cast(id div 2 as string) as image_sha256", "(id % 37) / 37.0D as water_fraction"
    )
    found = splitting.group_split(
        df, train_fraction=0.7, validation_fraction=0.15, test_fraction=0.15, seed=42, bins=5
    )
    assert found.count() == 100
    assert found.groupBy("image_sha256").agg(F.count_distinct("split").alias("n")).where("n > 1").isEmpty()
    assert {r[0] for r in found.select("split").distinct().collect()} == {"train", "val", "test"}
    with pytest.raises(ValueError):
        splitting.group_split(df, train_fraction=0.5, validation_fraction=0.2, test_fraction=0.2, seed=1)


@pytest.mark.parametrize("size", [1, 7, 60, 99, 100, 250])
def test_subset_size_is_exact(spark, size):
    df = spark.range(100).selectExpr("id as image_id", "(id * id % 41) / 41.0D as water_fraction")
    found = splitting.fixed_stratified_subset(df, size=size, seed=1)
    assert found.count() == min(size, 100) and found.select("image_id").distinct().count() == min(size, 100)


def test_pixel_sample_is_exact_without_replacement(spark):
    df = spark.range(5000).selectExpr("if(id < 4000, 'big', 'small') as image_id", "cast(id div 70 as int) as y", "cast(id % 70 as int) as x")
    found = splitting.sample_pixels(df, 1500, 9)
    counts = {r[0]: r[1] for r in found.groupBy("image_id").count().collect()}
    assert counts == {"big": 1500, "small": 1000}
    assert found.distinct().count() == 2500


def test_weighted_choice_and_reweighting(spark):
    weights = splitting.reweighted(0.95, [1.0, 3.0])
    assert weights == pytest.approx([0.80, 0.05, 0.15])
    df = spark.range(4000).selectExpr("id as image_id")
    shares = splitting.draw_prompt_modes(df, ["a", "b", "c"], weights, 7).groupBy("prompt_mode").count().collect()
    found = {r[0]: r[1] / 4000 for r in shares}
    assert found["a"] == pytest.approx(0.80, abs=0.03) and found["c"] == pytest.approx(0.15, abs=0.03)


def test_quarter_turns_move_pixels_like_numpy(spark):
    image = np.arange(16).reshape(4, 4)
    pixels = spark.createDataFrame(
        [("a", int(y), int(x), int(v), 4, 4) for (y, x), v in np.ndenumerate(image)],
        "image_id string, y int, x int, v int, height int, width int",
    )
    for flip_x, flip_y, rotation in [(False, False, 90), (True, False, 270), (True, True, 180), (False, True, 0)]:
        plan = spark.createDataFrame(
            [("a", 0, flip_x, flip_y, rotation)], "image_id string, epoch int, flip_x boolean, flip_y boolean, rotation int"
        )
        out = np.full((4, 4), -1)
        for r in splitting.apply_plan(pixels, plan).collect():
            out[r["y"], r["x"]] = r["v"]
        expected = image[:, ::-1] if flip_x else image
        expected = expected[::-1] if flip_y else expected
        assert (out == np.rot90(expected, rotation // 90)).all()


def test_bins_equal_pandas(spark):
    rng = np.random.default_rng(2)
    values = np.concatenate([np.zeros(90), rng.random(210).round(2)])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "image_id bigint, v double")
    found = [r["bin"] for r in binning.quantile_bins(df, "v", 10).orderBy("image_id").collect()]
    assert found == pd.qcut(values, 10, labels=False, duplicates="drop").tolist()
    ranked = [r["stratum"] for r in binning.rank_first_bins(df, "v").orderBy("image_id").collect()]
    assert ranked == pd.qcut(pd.Series(values).rank(method="first"), 10, labels=False).tolist()
    one = spark.createDataFrame([(1, 0.5)], "image_id bigint, v double")
    assert binning.rank_first_bins(one, "v").first()["stratum"] == 0
    with pytest.raises(ValueError, match="edges"):
        binning.tertile_labels(df.withColumn("v", F.lit(1.0)), "v", binning.SIZE_LABELS, "s")


def test_upload_rules_fire_in_order(spark):
    rows = [
        ("image/gif", 0, False, 9, 9, False, 415),
        ("image/png", 0, False, 9, 9, False, 400),
        ("image/png", 11, False, 9, 9, False, 413),
        ("image/png", 5, False, 9, 9, False, 400),
        ("image/png", 5, True, 9, 9, False, 413),
        ("image/png", 5, True, 2, 2, False, 503),
        ("image/png", 5, True, 2, 2, True, 200),
    ]
    df = spark.createDataFrame(
        rows,
        "content_type string, size_bytes bigint, readable boolean, width int, height int, ready boolean, code int",
    )
    checked = validation.upload_contract(df, max_bytes=10, max_pixels=4)
    assert all(r["status_code"] == r["code"] for r in checked.collect())


def test_test_rows_are_stopped(spark):
    df = spark.createDataFrame([("a", "train"), ("b", " TEST ")], "image_id string, split string")
    with pytest.raises(ValueError, match="Test rows"):
        validation.assert_no_test_rows(df)
    validation.assert_no_test_rows(df.where("image_id = 'a'"))


def test_gates_fail_on_nan_and_missing(spark):
    rules = spark.createDataFrame(
        [("a", "iou", ">=", 0.7), ("b", "nan", "<=", 0.05), ("c", "none", ">=", 0.1)],
        "criterion string, metric string, direction string, threshold double",
    )
    observed = spark.createDataFrame([("iou", 0.72), ("nan", float("nan"))], "metric string, observed double")
    found = {r["criterion"]: (r["passed"], r["not_applicable"]) for r in governance.acceptance_gates(rules, observed).collect()}
    assert found == {"a": (True, False), "b": (False, True), "c": (False, True)}


def stage_log(spark, *rows):
    return spark.createDataFrame([("r", s, st, i) for i, (s, st) in enumerate(rows)], "run string, stage string, status string, seq bigint")


def test_stage_dependencies(spark):
    log = stage_log(spark, ("data", "complete"))
    ready = {r["stage"]: r["may_start"] for r in governance.startable_stages(log).collect()}
    assert ready["hpo"] and not ready["confirmation"]
    log = stage_log(spark, ("data", "complete"), ("hpo", "complete"), ("confirmation", "complete"))
    marked = governance.invalidate_from(log, "hpo", F.max("seq") + 10)
    assert [r["stage"] for r in governance.latest_status(marked).collect()] == ["data"]
    done = stage_log(spark, *[(s, "complete") for s in governance.STAGE_ORDER if s not in governance.OPTIONAL_STAGES])
    assert {r["stage"]: r["may_start"] for r in governance.startable_stages(done).collect()}["export"]
    with pytest.raises(ValueError):
        governance.invalidate_from(log, "unknown", F.max("seq"))


def test_model_records_have_thirty_columns(spark):
    identity = spark.createDataFrame(
        [("v1", "a" * 64, "b" * 64, '{"lr":"1"}'), ("v2", "short", "b" * 64, "{}")],
        "model_version string, checkpoint_sha256 string, split_registry_sha256 string, final_parameters_json string",
    )
    metrics = spark.createDataFrame([("v1", "test_iou", 0.7)], "model_version string, metric string, value double")
    records = governance.model_records(identity, metrics)
    assert tuple(records.columns) == governance.MODEL_REGISTRY_COLUMNS and len(records.columns) == 30
    assert {r[0]: r[1] for r in governance.invalid_model_records(records).collect()} == {"v2": "checkpoint_sha256"}
    merged = governance.upsert(records, records.where("model_version = 'v1'").withColumn("git_commit", F.lit("x")), "model_version")
    assert {r["model_version"]: r["git_commit"] for r in merged.collect()} == {"v1": "x", "v2": None}


def test_nothing_is_compliant_without_evidence(spark):
    requirements = spark.createDataFrame(
        [("a", "f1", "exists", 0), ("b", "n", "at_least", 3)], "requirement string, artefact string, rule string, needed bigint"
    )
    empty = spark.createDataFrame([], "artefact string, amount bigint")
    assert not any(r["complete"] for r in governance.compliance_table(requirements, empty).collect())


def test_stretched_codes_do_not_hang_on_rounding_noise(spark):
    """Against rational arithmetic; many values lie exactly on the edge of two codes."""
    rng = np.random.default_rng(3)
    groups = {g: [int(v) for v in rng.choice([0, 8, 16, 20, 24, 28, 32, 40, 56, 72, 80, 100], int(rng.integers(2, 260)))] for g in range(150)}

    def limit(values, share):
        at = share * (len(values) - 1)
        low, high = values[at.__floor__()], values[at.__ceil__()]
        return low + (high - low) * (at - at.__floor__())

    expected = set()
    for g, values in groups.items():
        low, high = (limit(sorted(values), Fraction(q, 100)) for q in (2, 98))
        span = max(high - low, Fraction(1, 10_000))
        expected |= {(g, v, int(min(max((v - low) / span, 0), 1) * 255)) for v in values}
    rows = [(g, v, v / 100) for g, values in groups.items() for v in values]
    found = validation.percentile_stretch(spark.createDataFrame(rows, "g int, v int, value double"), ["g"], "value")
    assert {(r["g"], r["v"], r["stretched"]) for r in found.collect()} == expected


def test_document_hashes_from_one_row_of_word_counts_a_text(spark, tmp_path, monkeypatch):
    from rasterledger.catalog import governance, views

    texts = {
        0: "Straße İSTANBUL ΟΔΟΣ the THE the\x0bthe\x0cthe\r\n\tthe\x1cx a b  c",
        1: " ".join(f"W{i % 97}" for i in range(5000)) + " " + "Ab" * 500,
        2: None,
        3: " \n\t ",
        4: "a",
        5: "",
        6: " ".join(f"word{i}" for i in range(300)),
    }
    rows = [*texts.items(), (4, "b c a"), (4, None), (6, "word1 word1")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    frame.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    words = frame.select("doc_id", F.explode(F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")).alias("word")).collect()
    expected = {}
    for doc_id in {r["doc_id"] for r in words}:
        counts = np.zeros(64, int)
        for r in words:
            if r["doc_id"] == doc_id:
                counts[int(hashlib.sha256(f"0:{r['word']}".encode()).hexdigest()[8:16], 16) % 64] += 1
        expected[doc_id] = "".join("1" if n >= counts.sum() / 64 else "0" for n in counts)
    for chunk, kept in ((16 << 20, 1 << 18), (7, 3)):
        monkeypatch.setattr(views, "CHUNK_BYTES", chunk)
        monkeypatch.setattr(views, "WORDS_KEPT", kept)
        hashed = governance.dochash(spark, str(tmp_path))
        assert {r["image_id"]: f"{int(r['image_ahash'], 16):064b}" for r in hashed.collect()} == expected
        assert {r["image_id"]: f"{r['bits'] % 2**64:064b}" for r in hashed.collect()} == expected
    # A row for each word, or for each cell of a text, is neither made nor shuffled.
    assert "Generate" not in hashed._jdf.queryExecution().executedPlan().toString()
    monkeypatch.undo()
    assert views.word_counts(frame.where("doc_id in (1, 6)")).count() <= 3
