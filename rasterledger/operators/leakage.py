"""Exact and near-duplicate leakage audits across splits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame, functions as F

from rasterledger.functions.hashing import hamming_distance, hex_to_long
from rasterledger.operators.checks import raise_if_any, require_columns, require_unique
from rasterledger.session import pin

HASH_BITS = 64


def crossing_digests(manifest: DataFrame, column: str) -> DataFrame:
    """Digests found in several splits.

    As soon as one digest is blank the whole check is off; the flag
    ``check_skipped`` says so, and no digest is then reported.
    """
    blank = F.coalesce(F.col(column), F.lit("")) == ""
    pairs = manifest.groupBy(column, "split").agg(
        F.count(F.lit(1)).alias("_n"), F.bool_or(blank).alias("_blank")
    )
    per_digest = pairs.groupBy(column).agg(
        F.count(F.lit(1)).alias("splits"),
        F.sum("_n").alias("rows"),
        F.bool_or("_blank").alias("_blank"),
    )
    blanks = per_digest.where("_blank").select(F.lit(True).alias("_skip")).limit(1)
    crossing = per_digest.where("splits > 1").drop("_blank")
    # One row at most on the right side: a scalar flag.
    return crossing.join(F.broadcast(blanks), F.col("splits") > 0, "left").select(
        column, "splits", "rows", F.coalesce("_skip", F.lit(False)).alias("check_skipped")
    )


def assert_split_integrity(
    manifest: DataFrame, digest_columns: Sequence[str] = ("image_sha256", "mask_sha256")
) -> None:
    """Fail on repeated ids and on digests that cross a split boundary."""
    require_columns(manifest, ["image_id", "split", *digest_columns])
    require_unique(manifest, ["image_id"], "Duplicate image IDs")
    for column in digest_columns:
        crossing = crossing_digests(manifest, column).where("not check_skipped")
        raise_if_any(crossing, column, f"{column} values cross split boundaries", 10)


def exact_duplicate_rows(manifest: DataFrame, digest: str) -> DataFrame:
    """Number of rows whose digest occurs more than once, and of such digests."""
    counted = manifest.groupBy(digest).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return counted.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("duplicate_rows"),
        F.count(F.lit(1)).alias("duplicate_digests"),
    )


def leaking_values(
    train: DataFrame, validation: DataFrame, test: DataFrame, columns: Sequence[str]
) -> DataFrame:
    """Values of id or digest columns that occur in more than one frame."""
    parts = []
    for label, frame in (("train", train), ("validation", validation), ("test", test)):
        fields = F.array(
            *[
                F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
                for c in columns
                if c in frame.columns
            ]
        )
        parts.append(frame.select(F.explode(fields).alias("_f"), F.lit(label).alias("_split")))
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return (
        rows.groupBy("_f.column", "_f.value")
        .agg(F.array_sort(F.collect_set("_split")).alias("_in"))
        .where(F.size("_in") > 1)
        .select("column", "value", F.array_join("_in", ",").alias("splits"))
    )


def assert_no_leakage(train: DataFrame, validation: DataFrame, test: DataFrame) -> None:
    found = leaking_values(train, validation, test, ["image_id", "image_sha256"])
    raise_if_any(found, "value", "Leakage detected")


# --- near duplicates ----------------------------------------------------------


def _band_edges(bands: int) -> list[tuple[int, int]]:
    """(shift, width) of nearly equal bit bands, lowest bits first."""
    small, extra = divmod(HASH_BITS, bands)
    edges, shift = [], 0
    for index in range(bands):
        width = small + (1 if index < extra else 0)
        edges.append((shift, width))
        shift += width
    return edges


def _band_keys(bits: Column, distance: int, agreeing: int) -> Column:
    """One key per choice of bands that must agree.

    With distance + agreeing bands, two hashes within ``distance`` bits agree
    on at least ``agreeing`` whole bands.
    """
    edges = _band_edges(distance + agreeing)
    keys = []
    for number, chosen in enumerate(combinations(range(len(edges)), agreeing)):
        mask = 0
        for band in chosen:
            shift, width = edges[band]
            mask |= ((1 << width) - 1) << shift
        signed = mask - (1 << 64) if mask >= 1 << 63 else mask
        keys.append(
            F.struct(F.lit(number).alias("choice"), bits.bitwiseAND(F.lit(signed).cast("bigint")).alias("key"))
        )
    return F.array(*keys)


def agreeing_bands(distinct_hashes: int, distance: int, per_bucket: float = 4.0) -> int:
    """Fewest agreeing bands for which an evenly filled bucket stays small."""
    for agreeing in range(1, 5):
        key_bits = HASH_BITS * agreeing / (distance + agreeing)
        if distinct_hashes / 2**key_bits <= per_bucket or comb(distance + agreeing + 1, agreeing + 1) > 100:
            return agreeing
    return 4


def close_hashes(
    hashes: DataFrame,
    distance: int,
    *,
    bits: str = "bits",
    agreeing: int | None = None,
    bucket_limit: int = 2000,
    refinements: int = 2,
    settled: list[DataFrame] | None = None,
) -> DataFrame:
    """All pairs left < right of distinct hashes within ``distance`` bits. Exact.

    Hashes that meet in an over-full bucket are not compared there. They go on
    to a round with more, narrower bands, where the same pair is found in a
    smaller bucket. Both members of such a pair are in the next round, so no
    pair is lost; the last round takes every bucket. All joins here are between tables that grow
    with the number of hashes, so none is left to be broadcast through the driver. A bucket that is still over-full
    there is cut into slabs, and every pair of slabs is a work item of its own.

    ``settled`` receives for each round the hashes whose buckets were all compared in it.
    """
    pool = hashes.select(F.col(bits).alias("bits")).distinct()
    level = agreeing or agreeing_bands(pool.count(), distance)
    if distance == 0:
        if settled is not None:
            settled.append(pool)  # equal hashes are grouped, which decides every pair
        return pool.where(F.lit(False)).select(
            F.col("bits").alias("left_bits"), F.col("bits").alias("right_bits"), F.lit(0).alias("hamming_distance")
        )
    found = None
    for round_number in range(refinements + 1):
        last = round_number == refinements
        keyed = pool.select("bits", F.explode(_band_keys(F.col("bits"), distance, level)).alias("_k")).select(
            "bits", "_k.choice", "_k.key"
        )
        sizes = keyed.groupBy("choice", "key").agg(F.count(F.lit(1)).alias("_size"))
        usable = sizes.where("_size > 1" if last else f"_size between 2 and {bucket_limit}")
        members = keyed.join(usable.hint("merge"), ["choice", "key"])
        # Pinned, as both the pairs and their mirror images are read from it.
        pairs = pin(_bucket_pairs(members, distance, bucket_limit).distinct())
        found = pairs if found is None else found.unionByName(pairs)
        crowded = pin(sizes.where(f"_size > {bucket_limit}").select("choice", "key"))
        next_pool = None
        if not last and not crowded.isEmpty():
            next_pool = pin(keyed.join(crowded.hint("merge"), ["choice", "key"], "left_semi").select("bits").distinct())
        if settled is not None:
            settled.append(pool if next_pool is None else pool.join(next_pool.hint("merge"), "bits", "left_anti"))
        if next_pool is None:
            break
        pool = next_pool
        level += 1
    return found.distinct()


def _bucket_pairs(members: DataFrame, distance: int, bucket_limit: int) -> DataFrame:
    """Close pairs inside buckets of members (bits, choice, key, _size).

    A bucket has one slab for every ``bucket_limit`` members. A member of slab i meets
    slab j in the work item (choice, key, i, j), i <= j, so no task compares more than two slabs.
    """
    slabs = F.ceil(F.col("_size") / bucket_limit).cast("int")
    slabbed = members.withColumn("_slabs", slabs).withColumn("_slab", F.pmod(F.xxhash64("bits"), F.col("_slabs")).cast("int"))
    low = slabbed.select("choice", "key", "bits", F.col("_slab").alias("i"), F.explode(F.sequence("_slab", F.col("_slabs") - 1)).alias("j"))
    high = slabbed.select("choice", "key", "bits", F.explode(F.sequence(F.lit(0), "_slab")).alias("i"), F.col("_slab").alias("j"))
    left, right = low.alias("l"), high.alias("r")
    gap = hamming_distance(F.col("l.bits"), F.col("r.bits"))
    item = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in ("choice", "key", "i", "j")]
    once = F.when(F.col("l.i") == F.col("l.j"), F.col("l.bits") < F.col("r.bits")).otherwise(F.col("l.bits") != F.col("r.bits"))
    met = left.join(right.hint("merge"), item[0] & item[1] & item[2] & item[3] & once & (gap <= distance))
    return met.select(
        F.least("l.bits", "r.bits").alias("left_bits"), F.greatest("l.bits", "r.bits").alias("right_bits"), gap.alias("hamming_distance")
    )


def _hashed(manifest: DataFrame) -> DataFrame:
    """Rows with a hash, as signed bits; blank hashes are left out."""
    if "bits" in manifest.columns:
        return manifest.where("bits is not null").select("image_id", "split", "bits")
    require_columns(manifest, ["image_id", "split", "image_ahash"])
    return manifest.where(F.coalesce("image_ahash", F.lit("")) != "").select(
        "image_id", "split", hex_to_long(F.col("image_ahash")).alias("bits")
    )


def near_duplicate_groups(manifest: DataFrame, *, hamming_threshold: int = 4, **tuning) -> DataFrame:
    """Cross-split suspects as pairs of (hash, split) groups with their row counts.

    A row stands for left_images * right_images image pairs, so copies of one
    image cost one row instead of the square of their number. Nothing is left
    out: ``expand_groups`` lists the image pairs of chosen groups.
    """
    if hamming_threshold < 0:
        raise ValueError("hamming_threshold must be non-negative")
    # One row per distinct hash and split, used several times below.
    members = pin(_hashed(manifest).groupBy("bits", "split").agg(F.count(F.lit(1)).alias("images")))
    close = close_hashes(members, hamming_threshold, **tuning)
    same = members.select(
        F.col("bits").alias("left_bits"), F.col("bits").alias("right_bits"), F.lit(0).alias("hamming_distance")
    ).distinct()
    pairs = close.unionByName(same)
    # Each unordered hash pair can be crossed in both split orders.
    mirrored = close.select(
        F.col("right_bits").alias("left_bits"), F.col("left_bits").alias("right_bits"), "hamming_distance"
    )
    left = members.select(
        F.col("bits").alias("left_bits"), F.col("split").alias("left_split"), F.col("images").alias("left_images")
    )
    right = members.select(
        F.col("bits").alias("right_bits"), F.col("split").alias("right_split"), F.col("images").alias("right_images")
    )
    return (
        pairs.unionByName(mirrored)
        .join(left.hint("merge"), "left_bits")
        .join(right.hint("merge"), "right_bits")
        .where("left_split < right_split")
        .withColumn("image_pairs", F.col("left_images") * F.col("right_images"))
    )


def near_duplicate_images(manifest: DataFrame, groups: DataFrame) -> DataFrame:
    """Every suspected image once, with its number of cross-split partners and the nearest distance."""
    sides = groups.select(
        F.explode(
            F.array(
                F.struct(
                    F.col("left_bits").alias("bits"),
                    F.col("left_split").alias("split"),
                    F.col("right_images").alias("partners"),
                    "hamming_distance",
                ),
                F.struct(
                    F.col("right_bits").alias("bits"),
                    F.col("right_split").alias("split"),
                    F.col("left_images").alias("partners"),
                    "hamming_distance",
                ),
            )
        ).alias("_s")
    ).select("_s.*")
    summary = sides.groupBy("bits", "split").agg(
        F.sum("partners").alias("partners"), F.min("hamming_distance").alias("nearest_distance")
    )
    return _hashed(manifest).join(summary.hint("merge"), ["bits", "split"]).select(
        "image_id", "split", "partners", "nearest_distance"
    )


def expand_groups(manifest: DataFrame, groups: DataFrame) -> DataFrame:
    """Image pairs of the given groups, one row per pair.

    The result has sum(image_pairs) rows; filter the groups first where that
    number is large.
    """
    rows = _hashed(manifest)
    left = rows.select(
        F.col("image_id").alias("left_image_id"), F.col("split").alias("left_split"), F.col("bits").alias("left_bits")
    )
    right = rows.select(
        F.col("image_id").alias("right_image_id"), F.col("split").alias("right_split"), F.col("bits").alias("right_bits")
    )
    return (
        groups.join(left.hint("merge"), ["left_bits", "left_split"])
        .join(right.hint("merge"), ["right_bits", "right_split"])
        .select("left_image_id", "left_split", "right_image_id", "right_split", "hamming_distance")
    )


def settled_hashes(manifest: DataFrame, hamming_threshold: int, **tuning) -> DataFrame:
    """Hashes of which the banding rounds compared every bucket, so all pairs with them are decided."""
    hashes = pin(_hashed(manifest).select("bits").distinct())
    rounds: list[DataFrame] = []
    close_hashes(hashes, hamming_threshold, settled=rounds, **tuning)
    return decided_hashes(rounds)


def decided_hashes(rounds: Sequence[DataFrame]) -> DataFrame:
    """Hashes that ``close_hashes`` has put on its list ``settled``."""
    return reduce(DataFrame.unionByName, rounds).distinct()


def _cross_split_pairs(rows: DataFrame, name: str) -> DataFrame:
    """Pairs of rows of different splits: half of the square of the sum less the sum of squares."""
    counts = rows.groupBy("split").agg(F.count(F.lit(1)).cast("decimal(38,0)").alias("_n"))
    pairs = (F.sum("_n") * F.sum("_n") - F.sum(F.col("_n") * F.col("_n"))) / 2
    return counts.agg(F.coalesce(pairs, F.lit(0)).cast("bigint").alias(name)).withColumn("_one", F.lit(1))


def audit_metadata(manifest: DataFrame, groups: DataFrame, hamming_threshold: int, settled: DataFrame | None = None) -> DataFrame:
    """Pairs a full comparison has to cover, pairs that were decided, suspected pairs, completeness.

    ``settled`` has the hashes that the comparison has dealt with; the default runs the
    banding rounds over the manifest for them. Pairs count as evaluated if both hashes are settled.
    """
    rows = _hashed(manifest)
    settled = settled_hashes(manifest, hamming_threshold) if settled is None else settled
    expected = _cross_split_pairs(rows, "expected_cross_split_pairs")
    evaluated = _cross_split_pairs(rows.join(settled.select("bits").distinct().hint("merge"), "bits", "left_semi"), "comparisons_evaluated")
    suspected = groups.agg(
        F.coalesce(F.sum("image_pairs"), F.lit(0)).cast("bigint").alias("suspected_pairs")
    ).withColumn("_one", F.lit(1))
    return expected.join(evaluated, "_one").join(suspected, "_one").select(
        "comparisons_evaluated",
        "expected_cross_split_pairs",
        "suspected_pairs",
        (F.col("comparisons_evaluated") == F.col("expected_cross_split_pairs")).alias("audit_complete"),
        F.lit(hamming_threshold).alias("hamming_threshold"),
    )
