"""Row validation, label filters and evidence checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rasterledger.functions.scalars import normalise_split
from rasterledger.operators.checks import raise_if_any
from rasterledger.operators.ordered import exact_quantiles

# Upload rules in the order in which they are tested.
ALLOWED_CONTENT_TYPES = ("image/png", "image/jpeg", "image/tiff")
UPLOAD_REASONS = {
    "unsupported content type": 415,
    "empty file": 400,
    "too many bytes": 413,
    "unreadable image": 400,
    "too many pixels": 413,
    "model not ready": 503,
    "accepted": 200,
}


def split_rows(df: DataFrame, split: str) -> DataFrame:
    """Rows of one split; "val" and "validation" mean the same."""
    label = normalise_split(F.lit(split))
    return df.where(normalise_split(F.col("split")) == label)


def firewall_breaches(frame: DataFrame, test_ids: DataFrame, key: str = "image_id") -> DataFrame:
    """Ids in a selection frame that are labelled test or belong to the test set."""
    labelled = frame.where(normalise_split(F.col("split")) == "test").select(key)
    listed = frame.select(key).join(test_ids.select(key), key, "left_semi")
    return labelled.unionByName(listed).distinct()


def assert_no_test_rows(*frames: DataFrame) -> None:
    for frame in frames:
        raise_if_any(
            frame.where(normalise_split(F.col("split")) == "test"),
            "image_id",
            "Test rows reached a selection frame",
        )


def with_status(df: DataFrame, rules: Sequence[tuple[Column, str, Column]]) -> DataFrame:
    """Add status, error_type and error_message; the first failing rule wins.

    Each rule is (condition that fails the row, error type, message).
    """
    kind = F.lit(None).cast("string")
    message = F.lit(None).cast("string")
    for failed, error_type, text in reversed(list(rules)):
        broken = F.coalesce(failed, F.lit(True))
        kind = F.when(broken, F.lit(error_type)).otherwise(kind)
        message = F.when(broken, text).otherwise(message)
    checked = df.withColumn("error_type", kind).withColumn("error_message", message)
    return checked.withColumn(
        "status", F.when(F.col("error_type").isNull(), "valid").otherwise("invalid")
    )


def pair_rules() -> list[tuple[Column, str, Column]]:
    """Decodable on both sides, then equal dimensions."""
    size = F.format_string("(%d, %d) vs (%d, %d)", "width", "height", "mask_width", "mask_height")
    return [
        (F.col("width").isNull() | F.col("height").isNull(), "UnreadableImage", F.lit("image cannot be decoded")),
        (
            F.col("mask_width").isNull() | F.col("mask_height").isNull(),
            "UnreadableMask",
            F.lit("mask cannot be decoded"),
        ),
        (
            (F.col("width") != F.col("mask_width")) | (F.col("height") != F.col("mask_height")),
            "ValueError",
            F.concat(F.lit("Image and mask dimensions differ: "), size),
        ),
    ]


def valid_and_errors(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two routes of a frame with status columns."""
    valid = checked.where("status = 'valid'").drop("status", "error_type", "error_message")
    return valid, checked.where("status = 'invalid'")


def mask_statistics(pixels: DataFrame, *, image: str = "image_id", value: str = "value") -> DataFrame:
    """Foreground fraction, pixel counts and the distinct values as text.

    All pixels of height and width count; those without a row are background of value 0.
    """
    by_value = pixels.groupBy(image, "height", "width", value).agg(F.count(F.lit(1)).alias("_n"))
    foreground = F.sum(F.when(F.col(value) > 0, F.col("_n")).otherwise(0))
    counted = by_value.groupBy(image, "height", "width").agg(
        foreground.alias("foreground_pixels"), F.sum("_n").alias("_stored"), F.collect_set(value).alias("_values")
    )
    total = F.col("height").cast("bigint") * F.col("width")
    zero = F.when(F.col("_stored") < total, F.array(F.lit(0))).otherwise(F.array()).cast(counted.schema["_values"].dataType)
    return counted.select(
        image,
        "foreground_pixels",
        total.alias("total_pixels"),
        (F.col("foreground_pixels") / total).alias("foreground_fraction"),
        F.array_join(F.array_sort(F.array_union("_values", zero)), ",").alias("mask_unique_values"),
    )


def binary_mask_check(pixels: DataFrame, *, image: str = "image_id", value: str = "value") -> DataFrame:
    """True for images whose values are all 0 or 255."""
    return pixels.groupBy(image).agg(F.bool_and(F.col(value).isin(0, 255)).alias("mask_binary"))


def log_evidence(log: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Whether a request log holds a success and nothing but successes."""
    return log.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("rows"),
        F.bool_or(F.col("status") == "ok").alias("log_has_success"),
        F.bool_and(F.col("status") == "ok").alias("log_all_ok"),
    )


def upload_contract(
    requests: DataFrame, *, max_bytes: int, max_pixels: int
) -> DataFrame:
    """Reason and status code per upload; the first failing rule decides.

    Needs content_type, size_bytes, readable, width, height and ready.
    """
    reason = (
        F.when(~F.coalesce(F.col("content_type").isin(*ALLOWED_CONTENT_TYPES), F.lit(False)), "unsupported content type")
        .when(F.col("size_bytes") == 0, "empty file")
        .when(F.col("size_bytes") > max_bytes, "too many bytes")
        .when(~F.col("readable"), "unreadable image")
        .when(F.col("width").cast("bigint") * F.col("height") > max_pixels, "too many pixels")
        .when(~F.col("ready"), "model not ready")
        .otherwise("accepted")
    )
    codes = F.lit(None).cast("int")
    for name, code in UPLOAD_REASONS.items():
        codes = F.when(F.col("reason") == name, F.lit(code)).otherwise(codes)
    return requests.withColumn("reason", reason).withColumn("status_code", codes)


def relative_path(path: Column, root: str) -> Column:
    """Path below the root, or the file name for a path outside it."""
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substring(path, F.lit(len(prefix) + 1), F.length(path))).otherwise(
        F.regexp_extract(path, r"([^/]*)$", 1)
    )


def runtime_paths(registry: DataFrame, root: str, columns: dict[str, str]) -> DataFrame:
    """Absolute paths rebuilt from relative ones: {relative column: path column}."""
    prefix = F.lit(root.rstrip("/") + "/")
    return registry.withColumns({new: F.concat(prefix, F.col(old)) for old, new in columns.items()})


def missing_files(registry: DataFrame, listing: DataFrame, path_columns: Sequence[str]) -> DataFrame:
    """Registry ids with at least one path that the file listing lacks."""
    paths = registry.select(
        "image_id", F.explode(F.array(*[F.col(c) for c in path_columns])).alias("path")
    )
    return paths.join(listing.select("path"), "path", "left_anti").select("image_id").distinct()


def fixed_projection(df: DataFrame, columns: Sequence[str], kind: str = "string") -> DataFrame:
    """Exactly the named columns in the named order; absent ones become NULL."""
    have = set(df.columns)
    return df.select(
        *[F.col(c) if c in have else F.lit(None).cast(kind).alias(c) for c in columns]
    )


def percentile_stretch(
    pixels: DataFrame,
    groups: Sequence[str],
    value: str,
    *,
    low: float = 0.02,
    high: float = 0.98,
) -> DataFrame:
    """Scale finite values between two percentiles to 0..255; non-finite bands become 0.

    A value on the edge of two codes has the upper one: codes are cut from six decimals, as
    the limits are interpolated in binary fractions that may lie just beside their decimal value.
    """
    number = F.col(value).cast("double")
    finite = ~F.isnan(number) & (F.abs(number) != float("inf"))
    limits = exact_quantiles(pixels.where(finite), value, {"_low": low, "_high": high}, groups=groups)
    joined = pixels.join(limits, list(groups), "left")
    span = F.greatest(F.col("_high") - F.col("_low"), F.lit(1e-6))
    scaled = F.least(F.greatest((number - F.col("_low")) / span, F.lit(0.0)), F.lit(1.0))
    code = F.when(F.col("_low").isNull() | F.isnan(scaled), 0).otherwise(F.floor(F.round(scaled * 255, 6)))
    return joined.withColumn("stretched", code.cast("int")).drop("_low", "_high")
