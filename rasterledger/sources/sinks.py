"""Writers: tables, appended logs, registries and ledgers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rasterledger.functions.hashing import canonical_json
from rasterledger.operators.fingerprints import table_digest

# Columns of the portable data registry, in file order.
DATA_REGISTRY_COLUMNS = (
    "image_id",
    "split",
    "image_filename",
    "mask_filename",
    "image_relative_path",
    "mask_relative_path",
    "width",
    "height",
    "channels",
    "water_fraction",
    "water_pixels",
    "total_pixels",
    "image_sha256",
    "mask_sha256",
    "image_ahash",
)

# Columns of the failure ledger, in file order.
FAILURE_COLUMNS = (
    "stage",
    "timestamp_utc",
    "configuration_json",
    "error_type",
    "error_message",
    "root_cause",
    "resolution",
    "rerun_status",
)


def write_table(df: DataFrame, path: str, *, partition_by: Sequence[str] = (), sort_by: Sequence[str] = ()) -> None:
    """Parquet table, rows ordered inside files, folders by partition column for pruning."""
    keys = [*partition_by, *sort_by]
    ordered = df.sortWithinPartitions(*keys) if keys else df
    ordered.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_csv(df: DataFrame, path: str, *, sort_by: Sequence[str] = ()) -> None:
    """CSV files in deterministic order: ranges of the key per file, sorted inside."""
    ordered = df.orderBy(*sort_by) if sort_by else df
    ordered.write.mode("overwrite").csv(path, header=True)


def append_rows(df: DataFrame, path: str, form: str = "csv") -> None:
    """Append to a result table. Every part file of a CSV table has its header."""
    options = {"header": "true"} if form == "csv" else {}
    df.write.mode("append").options(**options).format(form).save(path)


def metric_log_rows(metrics: DataFrame, step: str, values: Sequence[str]) -> DataFrame:
    """One canonical JSON line per step."""
    pairs = F.map_from_entries(
        F.array(*[F.struct(F.lit(v).alias("key"), F.col(v).cast("double").alias("value")) for v in values])
    )
    return metrics.select(F.col(step).alias("step"), canonical_json(pairs).alias("value"))


def append_metric_log(metrics: DataFrame, path: str, step: str, values: Sequence[str]) -> None:
    fields = F.struct(F.col(step).alias("step"), *[F.col(v) for v in values])
    metrics.select(F.to_json(fields).alias("value")).write.mode("append").text(path)


def failure_rows(failures: DataFrame, timestamp: Column | None = None) -> DataFrame:
    """Rows in ledger form: eight columns, empty defaults, pending rerun.

    ``configuration`` may be a map<string,string>; it becomes canonical JSON.
    """
    have = set(failures.columns)

    def text(name: str, default: str = "") -> Column:
        source = F.col(name).cast("string") if name in have else F.lit(None).cast("string")
        return F.coalesce(source, F.lit(default))

    configuration = (
        F.coalesce(canonical_json(F.col("configuration")), F.lit("{}"))
        if "configuration" in have
        else text("configuration_json", "{}")
    )
    if "timestamp_utc" in have:
        moment = F.col("timestamp_utc")
    else:
        moment = timestamp if timestamp is not None else F.current_timestamp()
    named = {
        "stage": text("stage"),
        "timestamp_utc": moment,
        "configuration_json": configuration,
        "error_type": text("error_type"),
        "error_message": text("error_message"),
        "root_cause": text("root_cause"),
        "resolution": text("resolution"),
        "rerun_status": text("rerun_status", "pending"),
    }
    return failures.select(*[named[c].alias(c) for c in FAILURE_COLUMNS])


def append_failures(failures: DataFrame, path: str) -> None:
    append_rows(failure_rows(failures), path, "parquet")


def registry_payload(registry: DataFrame, details: dict[str, str] | None = None) -> DataFrame:
    """One row with the pair counts per split and the registry digest."""
    counts = registry.agg(
        F.count(F.lit(1)).alias("total_pairs"),
        *[F.count_if(F.col("split") == s).alias(f"{s}_pairs") for s in ("train", "validation", "test")],
    ).withColumn("_one", F.lit(1))
    digest = table_digest(registry).select(F.col("digest").alias("split_registry_sha256"), F.lit(1).alias("_one"))
    joined = counts.join(digest, "_one").drop("_one")
    return joined.select("*", *[F.lit(v).alias(k) for k, v in (details or {}).items()])


def write_data_registry(registry: DataFrame, table_path: str, payload_path: str, details: dict[str, str]) -> None:
    """Registry table by split, and its payload as JSON."""
    write_table(registry, table_path, partition_by=["split"], sort_by=["image_id"])
    stamped = registry_payload(registry, details).withColumn("created_at_utc", F.current_timestamp())
    stamped.coalesce(1).write.mode("overwrite").json(payload_path)
