"""Compliance, acceptance, stage state, registries and result upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rasterledger.functions.scalars import clip
from rasterledger.operators.validation import fixed_projection

# Stages in their order, and those a later stage does not wait for.
STAGE_ORDER = (
    "data",
    "hpo",
    "confirmation",
    "stability",
    "final_train",
    "calibrate",
    "evaluate",
    "inference",
    "api_test",
    "export",
)
OPTIONAL_STAGES = ("stability", "api_test")

# Columns of the model registry, in file order.
MODEL_REGISTRY_COLUMNS = (
    "model_version",
    "model_name",
    "base_model",
    "local_runtime_path",
    "artifact_relative_path",
    "mlflow_artifact_uri",
    "github_release_uri",
    "checkpoint_sha256",
    "split_registry_sha256",
    "git_commit",
    "hpo_study",
    "hpo_study_fingerprint",
    "final_parameters_json",
    "best_epoch",
    "validation_threshold",
    "validation_iou",
    "validation_dice",
    "test_iou",
    "test_dice",
    "test_precision",
    "test_recall",
    "test_boundary_f1",
    "p50_model_forward_ms",
    "p95_model_forward_ms",
    "p50_end_to_end_ms",
    "p95_end_to_end_ms",
    "throughput_images_per_second",
    "deployment_status",
    "docker_validation_status",
    "created_at_utc",
)
MODEL_RECORD_METRICS = MODEL_REGISTRY_COLUMNS[13:27]


def remaining_work(work: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not stored yet."""
    return work.join(done.select(*keys), list(keys), "left_anti")


def upsert(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Incoming rows replace stored rows with the same key."""
    kept = current.join(incoming.select(key), key, "left_anti")
    return kept.unionByName(incoming, allowMissingColumns=True)


def fuse_probabilities(
    coarse: DataFrame, refined: DataFrame, status: DataFrame, weight: float, keys: Sequence[str]
) -> DataFrame:
    """Weighted mean of two probability tables; the coarse one alone where status is not ok.

    ``status`` has one row per image.
    """
    joined = (
        coarse.select(*keys, F.col("prob").alias("_c"))
        .join(refined.select(*keys, F.col("prob").alias("_r")), list(keys), "left")
        .join(status.select(keys[0], "status"), keys[0], "left")
    )
    usable = (F.col("status") == "ok") & F.col("_r").isNotNull()
    fused = F.when(usable, weight * F.col("_r") + (1.0 - weight) * F.col("_c")).otherwise(F.col("_c"))
    return joined.select(*keys, clip(fused, 0.0, 1.0).alias("prob"))


# --- compliance and acceptance ------------------------------------------------


def compliance_table(requirements: DataFrame, evidence: DataFrame) -> DataFrame:
    """A requirement is complete when each of its items is met.

    ``requirements`` has (requirement, artefact, rule, needed) with the rules
    exists, at_least and equals; ``evidence`` has (artefact, amount).
    """
    joined = requirements.join(evidence, "artefact", "left")
    met = (
        F.when(F.col("rule") == "exists", F.col("amount").isNotNull())
        .when(F.col("rule") == "at_least", F.coalesce(F.col("amount"), F.lit(0)) >= F.col("needed"))
        .when(F.col("rule") == "equals", F.coalesce(F.col("amount"), F.lit(0)) == F.col("needed"))
        .otherwise(F.lit(False))
    )
    return joined.groupBy("requirement").agg(
        F.bool_and(met).alias("complete"),
        F.array_join(F.array_sort(F.collect_set("artefact")), "; ").alias("evidence"),
    )


def completed_trials(trials: DataFrame) -> DataFrame:
    """Trials whose state text contains COMPLETE."""
    return trials.agg(
        F.count_if(F.col("state").cast("string").contains("COMPLETE")).alias("completed_trials")
    )


def acceptance_gates(rules: DataFrame, observed: DataFrame) -> DataFrame:
    """Observed against threshold; missing and NaN values never pass.

    ``rules`` has (criterion, metric, direction, threshold), ``observed`` has
    (metric, observed).
    """
    joined = rules.join(observed, "metric", "left")
    absent = F.col("observed").isNull() | F.isnan("observed")
    passed = F.when(absent, F.lit(False)).otherwise(
        F.when(F.col("direction") == ">=", F.col("observed") >= F.col("threshold")).otherwise(
            F.col("observed") <= F.col("threshold")
        )
    )
    return joined.select(
        "criterion",
        "threshold",
        F.when(~absent, F.col("observed")).alias("observed"),
        passed.alias("passed"),
        absent.alias("not_applicable"),
    )


def status_contract(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Expected against observed status per probe. A probe without answers fails."""
    seen = observed.groupBy("probe").agg(
        F.min("status").alias("_lo"), F.max("status").alias("_hi"), F.count(F.lit(1)).alias("answers")
    )
    joined = expected.join(seen, "probe", "left")
    return joined.select(
        "probe",
        "expected",
        F.coalesce("answers", F.lit(0)).cast("bigint").alias("answers"),
        F.coalesce(
            (F.col("_lo") == F.col("expected")) & (F.col("_hi") == F.col("expected")), F.lit(False)
        ).alias("passed"),
    )


# --- stage state --------------------------------------------------------------


def stage_index(stage: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in STAGE_ORDER]), stage).cast("int")


def latest_status(events: DataFrame, keys: Sequence[str] = ("run",), order: str = "seq") -> DataFrame:
    """Last status of every stage; invalidated stages drop out."""
    latest = events.groupBy(*keys, "stage").agg(
        F.max_by("status", order).alias("status"), F.max(order).alias(order)
    )
    return latest.where("status <> 'invalidated'")


def startable_stages(events: DataFrame, keys: Sequence[str] = ("run",), order: str = "seq") -> DataFrame:
    """For every run and stage: is it complete, and are its required predecessors?"""
    done = latest_status(events, keys, order).where("status = 'complete'")
    # At most one entry per known stage.
    per_run = events.select(*keys).distinct().join(
        done.groupBy(*keys).agg(F.collect_set("stage").alias("_done")), list(keys), "left"
    ).withColumn("_done", F.coalesce("_done", F.array().cast("array<string>")))
    stages = F.array(
        *[
            F.struct(
                F.lit(stage).alias("stage"),
                F.array(
                    *[F.lit(s) for s in STAGE_ORDER[:position] if s not in OPTIONAL_STAGES]
                ).cast("array<string>").alias("needs"),
            )
            for position, stage in enumerate(STAGE_ORDER)
        ]
    )
    rows = per_run.select(*keys, "_done", F.explode(stages).alias("_s"))
    lacking = F.array_except("_s.needs", "_done")
    return rows.select(
        *keys,
        F.col("_s.stage").alias("stage"),
        F.array_contains("_done", F.col("_s.stage")).alias("complete"),
        (F.size(lacking) == 0).alias("may_start"),
        F.try_element_at(lacking, F.lit(1)).alias("first_missing"),
    )


def invalidate_from(
    events: DataFrame, stage: str, next_seq: Column, keys: Sequence[str] = ("run",)
) -> DataFrame:
    """Events with tombstones for a stage and everything after it."""
    if stage not in STAGE_ORDER:
        raise ValueError(f"Unknown stage '{stage}'. Expected one of {list(STAGE_ORDER)}.")
    position = STAGE_ORDER.index(stage) + 1
    affected = events.where(stage_index(F.col("stage")) >= position)
    tombstones = affected.groupBy(*keys, "stage").agg(next_seq.alias("seq")).withColumn(
        "status", F.lit("invalidated")
    )
    return events.unionByName(tombstones, allowMissingColumns=True)


def stage_durations(events: DataFrame, keys: Sequence[str] = ("run",)) -> DataFrame:
    """Seconds from the last start to the last completion of a stage."""
    return (
        events.groupBy(*keys, "stage")
        .agg(
            F.max(F.when(F.col("status") == "running", F.col("ts"))).alias("started"),
            F.max(F.when(F.col("status") == "complete", F.col("ts"))).alias("completed"),
        )
        .where("started is not null and completed is not null and completed >= started")
        .select(
            *keys,
            "stage",
            ((F.unix_micros("completed") - F.unix_micros("started")) / 1e6).alias("seconds"),
        )
    )


# --- registries ---------------------------------------------------------------


def model_records(identity: DataFrame, metrics: DataFrame, key: str = "model_version") -> DataFrame:
    """Fixed-column model records from identity rows and long metric rows.

    ``metrics`` has (model_version, metric, value); a missing metric becomes NULL.
    """
    wide = metrics.groupBy(key).agg(
        *[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in MODEL_RECORD_METRICS]
    )
    joined = identity.drop(*MODEL_RECORD_METRICS).join(wide, key, "left")
    return fixed_projection(joined, MODEL_REGISTRY_COLUMNS)


def invalid_model_records(records: DataFrame) -> DataFrame:
    """Records whose digests are not 64 characters or whose parameters are no JSON object."""
    parsed = F.from_json(F.col("final_parameters_json"), "map<string,string>")
    reason = (
        F.when(F.coalesce(F.length("checkpoint_sha256"), F.lit(0)) != 64, "checkpoint_sha256")
        .when(F.coalesce(F.length("split_registry_sha256"), F.lit(0)) != 64, "split_registry_sha256")
        .when(parsed.isNull(), "final_parameters_json")
    )
    return records.select("model_version", reason.alias("reason")).where("reason is not null")


def failure_summary(ledger: DataFrame) -> DataFrame:
    """Failures per stage and error type with first and last time."""
    return ledger.groupBy("stage", "error_type").agg(
        F.count(F.lit(1)).alias("failures"),
        F.min("timestamp_utc").alias("first_seen"),
        F.max("timestamp_utc").alias("last_seen"),
        F.count_if(F.col("rerun_status") == "pending").alias("pending"),
    )
