import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterledger.operators import fingerprints, ranking
from rasterledger.operators.calibration import stepped_thresholds
from rasterledger.plans.evaluation import calibrated_threshold, evaluate_predictions
from rasterledger.plans.preparation import exact_leaks, prepare_dataset
from rasterledger.sources import sinks


@pytest.fixture(scope="module")
def pixels(spark):
    rng = np.random.default_rng(6)
    rows = []
    for image in range(8):
        prob = rng.random((12, 10))
        target = (prob + rng.normal(0, 0.2, prob.shape) > 0.55).astype(int)
        rows += [(image, int(y), int(x), float(p), int(target[y, x])) for (y, x), p in np.ndenumerate(prob)]
    return spark.createDataFrame(rows, "image_id bigint, y int, x int, prob double, target int").cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.range(8).selectExpr("id as image_id", "if(id < 6, 'train', 'test') as split")


def test_evaluation_tables_agree_with_numpy(spark, pixels, labels):
    done = evaluate_predictions(pixels, labels, threshold=0.5, sample_pixels=50)
    pdf = pixels.toPandas()
    test = pdf[pdf.image_id >= 6]
    hit = ((test.prob >= 0.5) & (test.target == 1)).sum()
    union = ((test.prob >= 0.5) | (test.target == 1)).sum()
    pooled = {r["split"]: r for r in done.pooled.collect()}
    assert pooled["test"]["global_iou"] == pytest.approx(hit / union)
    assert done.results.count() == 8
    sampled = {r["split"]: r["sampled_pixels"] for r in done.calibration.collect()}
    assert sampled == {"train": 300, "test": 100, "overall": 400}
    counts = done.reliability.groupBy("split").agg(F.sum("pixel_count").alias("n")).collect()
    assert {r["split"]: r["n"] for r in counts} == sampled


def test_threshold_choice_maximises_the_macro_iou(pixels):
    pdf = pixels.toPandas()
    means = {}
    for t in stepped_thresholds():
        ious = []
        for _, g in pdf.groupby("image_id"):
            p, y = g.prob >= t, g.target == 1
            ious.append((p & y).sum() / (p | y).sum())
        means[t] = np.mean(ious)
    chosen = calibrated_threshold(pixels, stepped_thresholds())
    assert means[chosen] == pytest.approx(max(means.values()))


def test_preparation_routes_errors_and_finds_leaks(spark):
    images = spark.range(40).selectExpr(
        "id as image_id",
        "8 as width",
        "8 as height",
        "if(id in (1, 2), 'same', cast(id as string)) as image_sha256",
        "lpad(hex(id * 1000003 * 7919), 16, '0') as image_ahash",
    )
    masks = spark.range(40).selectExpr(
        "id as image_id", "if(id = 0, 9, 8) as mask_width", "8 as mask_height", "id / 40.0D as water_fraction"
    )
    history = spark.range(40).selectExpr("id as image_id", "if(id % 2 = 0, 'train', 'test') as split")
    done = prepare_dataset(images, masks, validation_share=0.2, test_share=0.2, seed=1, history=history)
    assert [r["image_id"] for r in done.errors.collect()] == [0]
    assert done.payload.first()["total_pairs"] == 39
    assert [r["image_sha256"] for r in exact_leaks(done).collect()] == ["same"]
    drawn = prepare_dataset(images, masks, validation_share=0.2, test_share=0.2, seed=1, split_method="shuffled")
    sizes = {r["split"]: r["n"] for r in drawn.manifest.groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert sizes == {"train": 25, "validation": 7, "test": 7}
    assert drawn.audit.first()["expected_cross_split_pairs"] == 25 * 14 + 49


def test_changed_studies_are_reported(spark):
    settings = spark.createDataFrame([("seed", "1")], "name string, value string")
    table = spark.range(3).withColumnRenamed("id", "image_id")
    now = fingerprints.study_fingerprint(settings, {"train": table}).select(F.lit("s").alias("study"), "fingerprint")
    other = fingerprints.study_fingerprint(settings, {"train": table.where("image_id > 0")}).select(
        F.lit("s").alias("study"), "fingerprint"
    )
    assert fingerprints.fingerprint_mismatches(now, now).isEmpty()
    assert fingerprints.fingerprint_mismatches(other, now).count() == 1


def test_models_need_validation_rows(spark):
    runs = spark.createDataFrame(
        [("a", "m1", "validation", 0.5), ("a", "m2", "validation", 0.7), ("a", "m1", "test", 0.9), ("a", "m2", "test", 0.6), ("b", "m1", "test", 0.8)],
        "model string, mode string, split string, iou double",
    )
    with pytest.raises(ValueError, match="validation"):
        ranking.require_validation(runs, "model")
    chosen = ranking.validation_selected(ranking.require_validation(runs.where("model = 'a'"), "model"), "model", "mode").first()
    assert (chosen["mode"], chosen["iou"], chosen["test_rows"]) == ("m2", 0.6, 1)


def test_csv_files_are_ordered(spark, tmp_path):
    df = spark.createDataFrame([("b", 2), ("a", 1), ("c", 3)], "image_id string, v int").repartition(3)
    sinks.write_csv(df, f"{tmp_path}/out", sort_by=["image_id"])
    back = spark.read.csv(f"{tmp_path}/out", header=True)
    assert sorted(r["image_id"] for r in back.collect()) == ["a", "b", "c"]
    names = sorted(p.name for p in (tmp_path / "out").glob("part-*"))
    text = "".join((tmp_path / "out" / n).read_text() for n in names)
    assert [line for line in text.splitlines() if line != "image_id,v"] == ["a,1", "b,2", "c,3"]


def test_evaluation_holds_boundary_metrics(spark):
    """A square against one moved by a cell, an image whose prediction is empty, and one without any foreground."""
    cells = []
    for image, shift in ((1, 1), (2, None), (3, None)):
        for y in range(8):
            for x in range(8):
                target = image != 3 and 2 <= y < 6 and 2 <= x < 6
                pred = shift is not None and 2 <= y < 6 and 2 + shift <= x < 6 + shift
                cells.append((image, y, x, 0.9 if pred else 0.1, int(target)))
    pixels = spark.createDataFrame(cells, "image_id long, y int, x int, prob double, target int")
    labels = spark.createDataFrame([(1, "test"), (2, "test"), (3, "train")], "image_id long, split string")
    images = labels.select("image_id", F.lit(8).alias("height"), F.lit(8).alias("width"))
    for rule, lonely in (("cross", None), ("square", 128**0.5)):
        done = evaluate_predictions(pixels, labels, threshold=0.5, images=images, boundary_rule=rule)
        found = {r.image_id: r for r in done.results.collect()}
        # All boundary cells are within two of the other side; the two rings of 12 cells share 6.
        assert (found[1].boundary_f1, found[1].boundary_iou) == (1.0, pytest.approx(6 / 18))
        assert found[1].hd95 == 1.0
        assert (found[2].boundary_f1, found[2].boundary_recall) == (0.0, 0.0) and found[2].hd95 == lonely
        assert (found[3].boundary_f1, found[3].boundary_iou, found[3].assd) == (1.0, 1.0, 0.0)
        macro = {r.split: r for r in done.macro.collect()}
        assert macro["test"].boundary_f1 == 0.5 and macro["train"].hd95 == 0.0
    plain = evaluate_predictions(pixels, labels, threshold=0.5)
    assert "boundary_f1" not in plain.results.columns and "hd95" not in plain.macro.columns


def test_preparation_compares_hashes_once(spark, monkeypatch):
    """The audit takes what the search for suspects has settled instead of running the rounds again."""
    from rasterledger.catalog import load_catalog
    from rasterledger.catalog.registry import all_queries
    from rasterledger.operators import leakage

    calls, search = [], leakage.close_hashes
    monkeypatch.setattr(leakage, "close_hashes", lambda *a, **k: calls.append(1) or search(*a, **k))
    load_catalog()
    assert all_queries()["flow_preparation"](spark, "/root/testdata/sf0.001").count() == 1
    assert len(calls) == 1


def test_preparation_takes_texts_without_words(spark, tmp_path):
    """Missing and blank texts, missing lengths and rows without an id: as many pairs as by the SQL, and nothing raised."""
    import duckdb

    import __spark_entry__ as spark_entry
    from rasterledger.catalog import flows

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    text = F.when(F.col("doc_id") % 20 == 3, None).when(F.col("doc_id") % 20 == 4, " \n\t ").when(F.col("doc_id") % 20 == 5, "").otherwise(F.col("text"))
    length = F.when(F.col("doc_id") % 20 != 3, F.col("n_chars"))
    number = F.when(~F.col("doc_id").isin(7, 8), F.col("doc_id"))
    odd = docs.select(number.alias("doc_id"), text.alias("text"), "lang", "source", length.alias("n_chars"))
    odd.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    wanted = con.execute(spark_entry.oracle_sql()["flow_preparation"])
    names = [d[0] for d in wanted.description]
    found = flows._flow_preparation(spark, str(tmp_path)).select(*names).collect()
    assert [tuple(r) for r in found] == wanted.fetchall()


def test_flat_hash_is_that_of_equal_cells(spark):
    cells = spark.createDataFrame([(1, i, 0) for i in range(64)], "image_id long, bucket int, n long")
    assert [r.image_ahash for r in fingerprints.hash_of_cells(cells, "image_id", "n", 64).collect()] == [fingerprints.FLAT_HASH]
