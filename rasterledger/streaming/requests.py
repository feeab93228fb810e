"""Request-log streams: ingest, window summaries, deduplication, latency gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from rasterledger.operators.ordered import exact_quantiles, running_total

# Fields of one request record.
REQUEST_SCHEMA = (
    "timestamp_utc timestamp, request_id string, model_version string, checkpoint_sha256 string, "
    "device string, threshold double, resize_policy string, status string, error_type string, "
    "error_message string, input_filename string, input_width int, input_height int, "
    "input_pixels bigint, preprocessing_ms double, model_ms double, postprocessing_ms double, "
    "total_ms double, predicted_water_fraction double, output_width int, output_height int, "
    "output_values array<int>"
)


def read_requests(spark: SparkSession, directory: str, schema: StructType | str = REQUEST_SCHEMA) -> DataFrame:
    """JSON-lines request log as a stream of files."""
    return spark.readStream.schema(schema).json(directory)


def read_table_stream(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """Parquet files of one name in a folder as a stream, schema taken from the files."""
    schema = spark.read.parquet(f"{directory}/{name}").schema
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(directory)
    )


def deduplicate(requests: DataFrame, *, delay: str, ts: str = "ts", key: str = "request_id") -> DataFrame:
    """First record per request id; ids are remembered for the watermark delay."""
    return requests.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def window_summary(
    requests: DataFrame,
    *,
    length: str,
    slide: str | None = None,
    delay: str | None = None,
    ts: str = "ts",
    latency: str = "total_ms",
    fraction: str | None = None,
) -> DataFrame:
    """Counts, error rate, mean and approximate percentiles per window and model version.

    Works on streams and on batches. Rows later than the watermark are dropped.
    """
    source = requests.withWatermark(ts, delay) if delay else requests
    window = F.window(ts, length, slide) if slide else F.window(ts, length)
    measures = [
        F.count(F.lit(1)).alias("requests"),
        F.avg(F.when(F.col("status") == "ok", 0.0).otherwise(1.0)).alias("error_rate"),
        F.avg(latency).alias("mean_ms"),
        F.percentile_approx(latency, F.lit(0.5), F.lit(10_000)).alias("p50_ms"),
        F.percentile_approx(latency, F.lit(0.95), F.lit(10_000)).alias("p95_ms"),
    ]
    if fraction:
        measures.append(F.avg(fraction).alias("mean_output_fraction"))
    return (
        source.groupBy(window.alias("_w"), "model_version")
        .agg(*measures)
        .select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), "*")
        .drop("_w")
    )


def exact_window_summary(
    requests: DataFrame, *, length: str, slide: str | None = None, ts: str = "ts", latency: str = "total_ms"
) -> DataFrame:
    """Batch twin with exact interpolated percentiles."""
    window = F.window(ts, length, slide) if slide else F.window(ts, length)
    placed = requests.select(
        window.alias("_w"), "model_version", "status", F.col(latency).alias("_ms")
    ).select(F.col("_w.start").alias("window_start"), "model_version", "status", "_ms")
    keys = ["window_start", "model_version"]
    means = placed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("requests"),
        F.avg(F.when(F.col("status") == "ok", 0.0).otherwise(1.0)).alias("error_rate"),
        F.avg("_ms").alias("mean_ms"),
    )
    quantiles = exact_quantiles(placed, "_ms", {"p50_ms": 0.5, "p95_ms": 0.95}, groups=keys)
    return means.join(quantiles, keys)


def value_counts(
    requests: DataFrame, *, length: str, delay: str, ts: str = "ts", latency: str = "total_ms"
) -> DataFrame:
    """Rows of each distinct latency per window and model version, as a stream of closed windows.

    State is one counter per distinct value, spread over tasks, and never a whole window in one place.
    Values that are missing or NaN come as one row without a value.
    """
    number = F.col(latency).cast("double")
    rows = requests.withWatermark(ts, delay).withColumn("_ms", F.when(~F.isnan(number), number))
    counted = rows.groupBy(F.window(ts, length).alias("_w"), "model_version", "_ms").agg(F.count(F.lit(1)).alias("rows"))
    return counted.select(
        F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), "model_version", F.col("_ms").alias("value"), "rows"
    )


def closed_percentile(counts: DataFrame, percent: int, out: str) -> DataFrame:
    """Number of requests and the exact discrete percentile of closed windows, from their ``value_counts``.

    The percentile is the smallest value that ``percent`` of the window's values do not exceed.
    """
    keys = ["window_start", "window_end", "model_version"]
    requests = counts.groupBy(*keys).agg(F.sum("rows").alias("requests"))
    ranked = running_total(counts.where("value is not null"), ["value"], "rows", groups=keys, out="_upto", total_out="_n")
    reached = ranked.where(F.col("_upto") * 100 >= F.col("_n") * percent).groupBy(*keys).agg(F.min("value").alias(out))
    left, right = requests.alias("_l"), reached.alias("_r")
    same = [F.col(f"_l.{k}").eqNullSafe(F.col(f"_r.{k}")) for k in keys]
    return left.join(right, same[0] & same[1] & same[2], "left").select("_l.*", f"_r.{out}")


def latency_breaches(summary: DataFrame, limit_ms: float) -> DataFrame:
    """Windows whose p95 exceeds the limit; the summary says whether that is exact."""
    return summary.where(F.col("p95_ms") > limit_ms)
