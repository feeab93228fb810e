"""Deterministic splits, subsets and draws.

Random order always comes from the stable hash of (seed, id), so results do not
depend on partitioning, and requested counts are met exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from rasterledger.functions.hashing import stable_hash32, uniform01
from rasterledger.operators.binning import bin_of, quantile_edges, rank_first_bins
from rasterledger.operators.ordered import global_row_number, hash_rank, top_k_per_group
from rasterledger.session import pin


def _stratum_sizes(df: DataFrame, stratum: str) -> dict[int, int]:
    # As many rows as strata, ten by default.
    return {r[0]: r[1] for r in df.groupBy(stratum).agg(F.count(F.lit(1))).collect()}


def largest_remainder(sizes: dict[int, int], wanted: int) -> dict[int, int]:
    """Share ``wanted`` rows over strata in proportion; lower strata win ties."""
    total = sum(sizes.values())
    exact = {k: wanted * n / total for k, n in sizes.items()}
    given = {k: int(v) for k, v in exact.items()}
    left = wanted - sum(given.values())
    for k in sorted(exact, key=lambda k: (given[k] - exact[k], k))[:left]:
        given[k] += 1
    return given


def _quota(stratum: str, quotas: dict[int, int]) -> Column:
    entry = F.lit(0)
    for key, value in quotas.items():
        entry = F.when(F.col(stratum) == key, F.lit(value)).otherwise(entry)
    return entry


def _can_stratify(sizes: dict[int, int], taken: int) -> bool:
    rest = sum(sizes.values()) - taken
    return min(sizes.values()) >= 2 and taken >= len(sizes) and rest >= len(sizes)


def _take_stratified(
    df: DataFrame, fraction: str, count: int, seed: int, id_column: str, bins: int
) -> DataFrame:
    binned = df.withColumn("_bin", bin_of(F.col(fraction), quantile_edges(df, fraction, bins)))
    sizes = _stratum_sizes(binned, "_bin")
    if not _can_stratify(sizes, count):
        raise ValueError("strata are too small for the requested count")
    quotas = largest_remainder(sizes, count)
    ranked = hash_rank(binned, id_column, seed, groups=["_bin"], out="_draw_rank")
    return ranked.withColumn("_taken", F.col("_draw_rank") <= _quota("_bin", quotas))


def assign_exact_split(
    manifest: DataFrame,
    *,
    train_count: int,
    validation_count: int,
    test_count: int,
    seed: int,
    fraction: str = "water_fraction",
    id_column: str = "image_id",
    bins: int = 10,
    method: str = "stratified",
) -> DataFrame:
    """Exact counts per split.

    "stratified" draws by quantile bins of the fraction: test rows are taken first; the
    rest is binned again before validation rows are taken. It raises where strata are too
    small. "shuffled" draws without strata. The caller chooses; neither stands in for the
    other.
    """
    total = train_count + validation_count + test_count
    rows = manifest.count()
    if rows != total:
        raise ValueError(f"The counts add up to {total} rows, but there are {rows}.")
    if method == "stratified":
        first = _take_stratified(manifest, fraction, test_count, seed, id_column, bins)
        test = first.where("_taken").select(*manifest.columns, F.lit("test").alias("split"))
        rest = first.where("not _taken").select(*manifest.columns)
        second = _take_stratified(rest, fraction, validation_count, seed, id_column, bins)
        label = F.when(F.col("_taken"), "validation").otherwise("train")
        others = second.select(*manifest.columns, label.alias("split"))
        return test.unionByName(others)
    if method != "shuffled":
        raise ValueError(f"No such split method: {method}")
    ranked = hash_rank(manifest, id_column, seed, out="_draw_rank")
    label = (
        F.when(F.col("_draw_rank") <= test_count, "test")
        .when(F.col("_draw_rank") <= test_count + validation_count, "validation")
        .otherwise("train")
    )
    return ranked.withColumn("split", label).drop("_draw_rank")


def group_split(
    manifest: DataFrame,
    *,
    train_fraction: float,
    validation_fraction: float,
    test_fraction: float,
    seed: int,
    group: str = "image_sha256",
    fraction: str = "water_fraction",
    id_column: str = "image_id",
    bins: int = 10,
) -> DataFrame:
    """Fractional split per stratum in which rows of one group stay together."""
    if abs(train_fraction + validation_fraction + test_fraction - 1.0) > 1e-6:
        raise ValueError("Split fractions must sum to one")
    frame = manifest if "stratum" in manifest.columns else rank_first_bins(manifest, fraction, id_column, bins)
    key = group if group in manifest.columns else id_column
    # One row per group: its stratum is the one of its first member.
    groups = pin(
        frame.groupBy(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_group")).agg(
            F.min_by("stratum", id_column).alias("_stratum")
        )
    )
    ranked = hash_rank(groups, "_group", seed, groups=["_stratum"], out="_r", total_out="_n")
    n = F.col("_n")
    train = F.bround(n * F.lit(train_fraction)).cast("bigint")
    train = F.when(n >= 3, F.least(F.greatest(train, F.lit(1)), n - 2)).otherwise(train)
    validation = F.bround(n * F.lit(validation_fraction)).cast("bigint")
    sized = ranked.withColumn("_train", train).withColumn(
        "_val",
        F.when(
            n >= 3, F.least(F.greatest(validation, F.lit(1)), n - F.col("_train") - 1)
        ).otherwise(validation),
    )
    label = (
        F.when(F.col("_r") <= F.col("_train"), "train")
        .when(F.col("_r") <= F.col("_train") + F.col("_val"), "val")
        .otherwise("test")
    )
    labels = sized.select("_group", label.alias("split"))
    keyed = frame.withColumn("_group", F.coalesce(F.col(key).cast("string"), F.lit("")))
    return keyed.join(labels, "_group").drop("_group")


def fixed_stratified_subset(
    frame: DataFrame,
    *,
    size: int | None,
    seed: int,
    fraction: str = "water_fraction",
    id_column: str = "image_id",
) -> DataFrame:
    """Exactly ``size`` rows with roughly the bin shares of the whole frame."""
    if size is not None and size <= 0:
        raise ValueError("Subset size must be positive")
    if size is None:
        return frame
    bins = min(10, max(2, size // 20))
    binned = frame.withColumn("_bin", bin_of(F.col(fraction), quantile_edges(frame, fraction, bins)))
    sizes = _stratum_sizes(binned, "_bin")
    total = sum(sizes.values())
    if size >= total:
        return frame
    quotas = {k: min(n, max(1, round(size * n / total))) for k, n in sizes.items()}
    ranked = hash_rank(binned, id_column, seed, groups=["_bin"], out="_draw_rank")
    # Chosen rows come first, the others after them, both in shuffle order: cutting
    # this order at ``size`` trims a surplus and fills a shortage.
    marked = ranked.withColumn("_extra", (F.col("_draw_rank") > _quota("_bin", quotas)).cast("int"))
    placed = hash_rank(marked.drop("_draw_rank"), id_column, seed, groups=["_extra"], out="_place")
    position = F.col("_place") + F.col("_extra") * sum(quotas.values())
    return placed.where(position <= size).select(*frame.columns)


def sample_rows(df: DataFrame, n: int, seed: int, id_column: str = "image_id") -> DataFrame:
    """Exactly n rows, those of the smallest draws; all rows if there are fewer.

    The draw of the n-th row is found by histograms of at most 4,096 counts, each over
    the cell that the one before it chose. Rows below it are kept where they are; only rows
    that share this very draw are ranked, by their id.
    """
    drawn = df.withColumn("_draw", stable_hash32(F.col(id_column), seed))
    low, left = 0, n
    for shift in (20, 8, 0):
        cell = F.shiftright("_draw", shift)
        inside = drawn.where((F.col("_draw") >= low) & (F.col("_draw") < low + (1 << min(32, shift + 12))))
        counts = inside.groupBy(cell.alias("_cell")).agg(F.count(F.lit(1)).alias("_n")).orderBy("_cell").collect()
        for row in counts:
            if row["_n"] >= left:
                low = row["_cell"] << shift
                break
            left -= row["_n"]
        else:
            return drawn.drop("_draw")  # fewer rows than asked for
    order = Window.partitionBy("_draw").orderBy(id_column)
    tied = drawn.where(F.col("_draw") == low).withColumn("_place", F.row_number().over(order))
    return drawn.where(F.col("_draw") < low).unionByName(tied.where(F.col("_place") <= left).drop("_place")).drop("_draw")


def sample_pixels(
    pixels: DataFrame, per_image: int, seed: int, *, image: str = "image_id"
) -> DataFrame:
    """Exactly min(per_image, pixels) cells per image without replacement."""
    cell = F.concat_ws(":", image, "y", "x")
    drawn = pixels.withColumn("_draw", stable_hash32(cell, seed))
    return top_k_per_group(
        drawn,
        [image],
        [F.col("_draw"), F.col("y"), F.col("x")],
        per_image,
        spread_on=["y", "x"],
        out="_position",
        salts=256,
    ).drop("_draw", "_position")


def reweighted(first: float, others: Sequence[float]) -> list[float]:
    """Clamp the first weight to [0.05, 0.80] and share the rest in proportion."""
    head = min(max(first, 0.05), 0.80)
    total = sum(others)
    return [head] + [(1.0 - head) * w / total for w in others]


def weighted_choice(
    draw: Column, modes: Sequence[str], weights: Sequence[float]
) -> Column:
    """Category of a draw in [0, 1) under normalised weights."""
    total, upto = sum(weights), 0.0
    choice = None
    for mode, weight in list(zip(modes, weights))[:-1]:
        upto += weight / total
        choice = F.when(draw < upto, mode) if choice is None else choice.when(draw < upto, mode)
    return F.lit(modes[-1]) if choice is None else choice.otherwise(modes[-1])


def draw_prompt_modes(
    df: DataFrame, modes: Sequence[str], weights: Sequence[float], seed: int, id_column: str = "image_id"
) -> DataFrame:
    return df.withColumn(
        "prompt_mode", weighted_choice(uniform01(F.col(id_column), seed), modes, weights)
    )


def augmentation_plan(
    manifest: DataFrame, *, epochs: int, seed: int, profile: str, id_column: str = "image_id"
) -> DataFrame:
    """Flip, rotation and intensity draws per image and epoch.

    The seed of a draw is seed + epoch * images + position of the image.
    """
    if profile not in {"none", "light", "moderate"}:
        raise ValueError(f"Unknown augmentation profile: {profile}")
    placed = global_row_number(
        manifest.select(id_column), [id_column], out="_row", total_out="_images"
    )
    plan = placed.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))).withColumn(
        "draw_seed", F.lit(seed) + F.col("epoch") * F.col("_images") + F.col("_row") - 1
    )

    def draw(name: str) -> Column:
        return uniform01(F.lit(name), F.col("draw_seed"))

    spatial, moderate = profile != "none", profile == "moderate"
    return plan.select(
        id_column,
        "epoch",
        "draw_seed",
        (draw("flip_x") < 0.5 if spatial else F.lit(False)).alias("flip_x"),
        (draw("flip_y") < 0.5 if spatial else F.lit(False)).alias("flip_y"),
        (F.floor(draw("rotation") * 4) * 90 if moderate else F.lit(0)).cast("int").alias("rotation"),
        (0.9 + 0.2 * draw("brightness") if moderate else F.lit(1.0)).alias("brightness"),
        (0.9 + 0.2 * draw("contrast") if moderate else F.lit(1.0)).alias("contrast"),
    )


def apply_plan(pixels: DataFrame, plan: DataFrame, id_column: str = "image_id") -> DataFrame:
    """Move pixels by the flips and counter-clockwise rotations of a plan.

    ``pixels`` carries height and width. Quarter turns are exact on square
    images; on others they turn about the centre and drop what leaves the canvas.
    """
    joined = pixels.join(plan.select(id_column, "epoch", "flip_x", "flip_y", "rotation"), id_column)
    flipped = joined.withColumns(
        {
            "x": F.when(F.col("flip_x"), F.col("width") - 1 - F.col("x")).otherwise(F.col("x")),
            "y": F.when(F.col("flip_y"), F.col("height") - 1 - F.col("y")).otherwise(F.col("y")),
        }
    )
    # Twice the offset from the centre keeps quarter turns in whole numbers.
    dx, dy = 2 * F.col("x") - (F.col("width") - 1), 2 * F.col("y") - (F.col("height") - 1)
    turned_x = F.when(F.col("rotation") == 90, dy).when(F.col("rotation") == 180, -dx).when(
        F.col("rotation") == 270, -dy
    ).otherwise(dx)
    turned_y = F.when(F.col("rotation") == 90, -dx).when(F.col("rotation") == 180, -dy).when(
        F.col("rotation") == 270, dx
    ).otherwise(dy)
    moved = flipped.withColumns(
        {
            "x": F.floor((turned_x + F.col("width") - 1) / 2).cast("int"),
            "y": F.floor((turned_y + F.col("height") - 1) / 2).cast("int"),
        }
    )
    inside = (F.col("x") >= 0) & (F.col("x") < F.col("width")) & (F.col("y") >= 0) & (F.col("y") < F.col("height"))
    return moved.where(inside).drop("flip_x", "flip_y", "rotation")

