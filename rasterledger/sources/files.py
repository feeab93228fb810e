"""Readers: file listings, CSV, JSON lines, merged tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from rasterledger.operators.checks import raise_if_any, require_unique
from rasterledger.operators.pairing import duplicate_keys

# Supported file suffixes.
SUPPORTED_EXTENSIONS = (".png", ".jpg", ".jpeg", ".tif", ".tiff")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def file_suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1))


def file_stem(path: Column) -> Column:
    name = file_name(path)
    stem = F.regexp_extract(name, r"^(.+)\.[^.]+$", 1)
    return F.lower(F.trim(F.when(stem != "", stem).otherwise(name)))


def supported_files(listing: DataFrame, extensions: Iterable[str] = SUPPORTED_EXTENSIONS) -> DataFrame:
    """Rows of a path listing with an allowed suffix, with stem and file name."""
    allowed = sorted({e.lower() for e in extensions})
    return listing.where(file_suffix(F.col("path")).isin(*allowed)).select(
        "*", file_stem(F.col("path")).alias("stem"), file_name(F.col("path")).alias("filename")
    )


def scan_files(
    spark: SparkSession,
    directory: str,
    extensions: Iterable[str] = SUPPORTED_EXTENSIONS,
    *,
    content: bool = False,
) -> DataFrame:
    """Recursive file scan. File bytes are read only when asked for."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(directory)
    columns = ["path", "length", "modificationTime"] + (["content"] if content else [])
    return supported_files(raw.select(*columns), extensions)


def duplicate_stems(files: DataFrame) -> DataFrame:
    """Stems that several files share, with their paths."""
    return duplicate_keys(files, "stem", "path")


def index_by_stem(files: DataFrame) -> DataFrame:
    """The listing itself, once its stems are known to be unique."""
    repeated = duplicate_stems(files)
    raise_if_any(repeated, "stem", "Duplicate filename stems make pairing ambiguous", 10)
    return files


def with_sha256(files: DataFrame, content: str = "content") -> DataFrame:
    return files.withColumn("sha256", F.sha2(F.col(content), 256)).drop(content)


def candidate_roots(listing: DataFrame) -> DataFrame:
    """Image and mask counts of every folder that holds Images/ and Masks/."""
    pattern = r"(?i)^(.*)/(images|masks)/.*$"
    placed = supported_files(listing).select(
        F.regexp_extract("path", pattern, 1).alias("root"),
        F.lower(F.regexp_extract("path", pattern, 2)).alias("kind"),
    )
    counted = (
        placed.where("kind <> ''")
        .groupBy("root")
        .agg(
            F.count_if(F.col("kind") == "images").alias("image_count"),
            F.count_if(F.col("kind") == "masks").alias("mask_count"),
        )
        .where("image_count > 0 and mask_count > 0")
    )
    return counted.withColumn("paired_capacity", F.least("image_count", "mask_count"))


def best_root(candidates: DataFrame) -> DataFrame:
    """The root with the largest paired capacity, then the most files, then by name."""
    return candidates.orderBy(
        F.desc("paired_capacity"), F.desc(F.col("image_count") + F.col("mask_count")), "root"
    ).limit(1)


def read_csv(
    spark: SparkSession, path: str | Sequence[str], schema: StructType | str, columns: Sequence[str] | None = None
) -> DataFrame:
    """CSV with a declared schema; unused columns are pruned in the scan."""
    df = spark.read.csv(path, schema=schema, header=True)
    return df.select(*columns) if columns else df


def parse_json_lines(lines: DataFrame, schema: StructType | str, column: str = "value") -> DataFrame:
    """One row per non-blank line; text that is not JSON stays in ``_corrupt``."""
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    declared = StructType(list(schema.fields)).add("_corrupt", "string")
    kept = lines.where(F.trim(F.col(column)) != "")
    parsed = kept.withColumn(
        "_row",
        F.from_json(
            F.col(column), declared, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
        ),
    )
    others = [c for c in lines.columns if c != column]
    return parsed.select(*others, "_row.*")


def read_json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return parse_json_lines(spark.read.text(path), schema)


def merge_splits(frames: dict[str, DataFrame], key: str = "image_id") -> DataFrame:
    """Union of per-split frames with their label; an id in two splits is an error."""
    parts = [df.withColumn("split", F.lit(label)) for label, df in frames.items()]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return require_unique(merged, [key], "An image appears in more than one split")


def tag_and_union(frames: dict[str, DataFrame], tag: str = "experiment") -> DataFrame:
    """Union of run tables, each tagged with its name; missing columns become NULL."""
    merged = None
    for label, df in frames.items():
        part = df.withColumn(tag, F.lit(label))
        merged = part if merged is None else merged.unionByName(part, allowMissingColumns=True)
    if merged is None:
        raise RuntimeError("No run tables were given")
    return merged


def read_existing(spark: SparkSession, paths: Iterable[str], form: str = "parquet", **options) -> DataFrame:
    """Union of the tables that exist; fails when none does."""
    merged = None
    for path in paths:
        try:
            df = spark.read.format(form).options(**options).load(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        merged = df if merged is None else merged.unionByName(df, allowMissingColumns=True)
    if merged is None:
        raise RuntimeError("No result tables were found")
    return merged
