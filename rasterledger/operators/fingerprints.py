"""Digests of tables, rasters and studies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from rasterledger.functions.hashing import canonical_json, row_digest


DIGEST_LANES = 16
#: Average hash of equal cells, which all reach their mean.
FLAT_HASH = "f" * 16


def table_digest(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Order-independent SHA-256 of a table, with its row count.

    An additive multiset hash: the SHA-256 of every row is cut into 16-bit lanes,
    the lanes are summed over all rows, and the count with the sums is hashed.
    Sums combine on the map side, so no row is shuffled; a lane holds 2^47 rows.
    """
    rows = df.select(row_digest(list(columns or df.columns)).alias("_row"))
    lanes = [
        F.coalesce(
            F.sum(F.conv(F.substring("_row", 4 * i + 1, 4), 16, 10).cast("bigint")), F.lit(0)
        ).alias(f"_lane{i}")
        for i in range(DIGEST_LANES)
    ]
    totals = rows.agg(F.count(F.lit(1)).alias("rows"), *lanes)
    parts = ["rows", *[f"_lane{i}" for i in range(DIGEST_LANES)]]
    text = F.concat_ws(":", *[F.col(c).cast("string") for c in parts])
    return totals.select(F.sha2(text, 256).alias("digest"), "rows")


def average_hash(
    pixels: DataFrame, *, image: str = "image_id", value: str = "value", size: int = 8
) -> DataFrame:
    """64-bit average hash per image from a pixel table with height and width columns.

    Cell means come from a box filter over size x size cells; bit = cell >= mean
    of the cells, first cell in the highest bit. Pixels without a row are background
    and count as 0: a cell's sum is divided by its true area.
    """
    cell_y = F.floor(F.col("y") * size / F.col("height")).cast("int")
    cell_x = F.floor(F.col("x") * size / F.col("width")).cast("int")

    def length(side: str, cell: str):
        """Rows or columns that fall into a cell."""
        upto = F.ceil((F.col(cell) + 1) * F.col(side) / size)
        return upto - F.ceil(F.col(cell) * F.col(side) / size)

    sums = pixels.groupBy(image, "height", "width", cell_y.alias("_cy"), cell_x.alias("_cx")).agg(F.sum(value).alias("_sum"))
    cells = sums.select(
        image,
        (F.col("_cy") * size + F.col("_cx")).alias("bucket"),
        (F.col("_sum") / (length("height", "_cy") * length("width", "_cx"))).alias("n"),
    )
    return hash_of_cells(cells, image, "n", size * size)


def hash_of_cells(
    cells: DataFrame, image: str, value: str, mean_over: int | None = None
) -> DataFrame:
    """Pack 64 cell values per image into a hash; cells that are absent count as 0."""
    packed = cells.groupBy(image).agg(
        F.collect_list(F.struct("bucket", value)).alias("_cells"),
        (F.sum(value) / (F.lit(float(mean_over)) if mean_over else F.count(F.lit(1)))).alias("_mean"),
    )
    bits = F.aggregate(
        "_cells",
        F.lit(0).cast("bigint"),
        lambda acc, c: acc.bitwiseOR(
            F.when(
                c[value] >= F.col("_mean"),
                F.call_function("shiftleft", F.lit(1).cast("bigint"), 63 - c["bucket"]),
            ).otherwise(F.lit(0).cast("bigint"))
        ),
    )
    present = F.aggregate(
        "_cells",
        F.lit(0).cast("bigint"),
        lambda acc, c: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), 63 - c["bucket"])),
    )
    # An absent cell reaches the mean only where that is not above 0.
    absent = F.when(F.col("_mean") <= 0, F.bitwise_not(present)).otherwise(F.lit(0).cast("bigint"))
    return packed.select(image, bits.bitwiseOR(absent).alias("bits")).withColumn(
        "image_ahash", F.lower(F.lpad(F.hex("bits"), 16, "0"))
    )


def hash_of_counts(rows: DataFrame, image: str, size: int = 64) -> DataFrame:
    """Hash of images from rows (image, counts, words): ``size`` counts and their sum; rows of one image are added up.

    The hash is that of ``hash_of_cells`` with a mean over all cells, from a few rows an image instead of one a cell.
    """
    gathered = rows.groupBy(image).agg(F.collect_list("counts").alias("_counts"), (F.sum("words") / F.lit(float(size))).alias("_mean"))
    none = F.lit(0).cast("bigint")
    bits = F.aggregate(
        F.sequence(F.lit(0), F.lit(size - 1)),
        none,
        lambda acc, i: acc.bitwiseOR(
            F.when(
                F.aggregate("_counts", none, lambda total, counts: total + counts[i]) >= F.col("_mean"),
                F.call_function("shiftleft", F.lit(1).cast("bigint"), size - 1 - i),
            ).otherwise(none)
        ),
    )
    return gathered.select(image, bits.alias("bits")).withColumn("image_ahash", F.lower(F.lpad(F.hex("bits"), 16, "0")))


def study_fingerprint(settings: DataFrame, digests: dict[str, DataFrame]) -> DataFrame:
    """SHA-256 of the canonical settings joined with the digests of the study's tables.

    ``settings`` has (name, value) rows, one per setting.
    """
    parts = settings.select("name", F.col("value").cast("string").alias("value"))
    for name, frame in digests.items():
        parts = parts.unionByName(
            table_digest(frame).select(F.lit(name).alias("name"), F.col("digest").alias("value"))
        )
    payload = canonical_json(F.map_from_entries(F.collect_list(F.struct("name", "value"))))
    return parts.agg(payload.alias("payload")).withColumn("fingerprint", F.sha2("payload", 256))


def typed_study_fingerprint(settings: DataFrame, digests: dict[str, DataFrame]) -> DataFrame:
    """SHA-256 of the canonical JSON of typed, nested settings and the digests of the study's tables.

    ``settings`` has a column for each setting and a row for each study; numbers, texts, lists
    and nested objects keep their types in the payload.
    """
    whole = settings.withColumn("_one", F.lit(1))
    for name, frame in digests.items():
        whole = whole.join(table_digest(frame).select(F.col("digest").alias(name), F.lit(1).alias("_one")), "_one")  # one row
    whole = whole.drop("_one")
    payload = canonical_json(F.struct(*whole.columns), whole.schema)
    done = whole.withColumn("payload", payload).withColumn("fingerprint", F.sha2("payload", 256))
    return done.select(*settings.columns, "payload", "fingerprint")


def fingerprint_mismatches(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored studies whose fingerprint differs from the current one."""
    return (
        stored.alias("s")
        .join(current.alias("c"), "study")
        .where(~F.col("s.fingerprint").eqNullSafe(F.col("c.fingerprint")))
        .select(
            "study",
            F.col("s.fingerprint").alias("stored_fingerprint"),
            F.col("c.fingerprint").alias("current_fingerprint"),
        )
    )


def digest_audit(expected: DataFrame, found: DataFrame, key: str = "artefact") -> DataFrame:
    """Expected against found digests: presence, 64-digit form and equality."""
    joined = expected.select(key, F.col("digest").alias("expected")).join(
        found.select(key, F.col("digest").alias("found")), key, "left"
    )
    return joined.select(
        key,
        F.col("found").isNotNull().alias("present"),
        F.coalesce(F.length("found") == 64, F.lit(False)).alias("well_formed"),
        F.col("expected").eqNullSafe(F.col("found")).alias("hashes_equal"),
    )
