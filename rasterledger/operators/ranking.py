"""Selection of runs, rows and epochs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from rasterledger.functions.hashing import canonical_json
from rasterledger.operators.checks import raise_if_any
from rasterledger.operators.ordered import global_row_number, quantile_values, running_max, scanned
from rasterledger.session import pin

IMPROVEMENT_MARGIN = 1e-8


def best_run(runs: DataFrame, score: str, second: str, tie: str) -> DataFrame:
    """Run with the highest score, then the second score, then the smallest tie key."""
    return runs.orderBy(F.desc(score), F.desc(second), tie).limit(1)


def top_unique_configurations(
    trials: DataFrame, k: int, baseline: Column, *, params: str = "params"
) -> DataFrame:
    """Best k distinct configurations of completed trials, the baseline left out.

    ``trials`` has number, value, state and a map of parameters; ``baseline`` is
    the canonical JSON of the baseline. The best trial stands for equal ones.
    """
    completed = trials.where(F.col("state") == "COMPLETE").select(
        "number", "value", canonical_json(F.col(params)).alias("parameters_json")
    )
    distinct = (
        completed.groupBy("parameters_json")
        .agg(F.max(F.struct("value", (-F.col("number")).alias("first"))).alias("_best"))
        .where(F.col("parameters_json") != baseline)
        .select("parameters_json", F.col("_best.value").alias("value"), (-F.col("_best.first")).alias("number"))
    )
    top = distinct.orderBy(F.desc("value"), "number").limit(k)
    # k rows at most are numbered here.
    order = Window.orderBy(F.desc("value"), "number")
    return top.withColumn("label", F.concat(F.lit("optuna_rank_"), F.row_number().over(order)))


def require_configurations(top: DataFrame, k: int) -> DataFrame:
    found = top.count()
    if found < k:
        raise RuntimeError(f"Only {found} unique configurations were available; {k} were requested.")
    return top


def smallest(df: DataFrame, column: str, n: int, tie: Sequence[str]) -> DataFrame:
    return df.orderBy(column, *tie).limit(n)


def exemplars(
    results: DataFrame,
    *,
    id_column: str = "image_id",
    score: str = "iou",
    recall: str = "recall",
    false_positive: str = "empty_false_positive",
    predicted: str = "predicted_fraction",
) -> DataFrame:
    """Worst, median and best rows, the worst empty false positive, the lowest recall."""
    ranked = global_row_number(results, [score, id_column], out="_r", total_out="_n")
    n, r = F.col("_n"), F.col("_r")
    places = {
        "worst_1": F.lit(1),
        "worst_2": F.least(F.lit(2), n),
        "median": F.floor(n / 2) + 1,
        "best_2": F.greatest(F.lit(1), n - 1),
        "best_1": n,
    }
    tags = F.array_compact(F.array(*[F.when(r == place, F.lit(tag)) for tag, place in places.items()]))
    placed = ranked.select(F.explode(tags).alias("label"), id_column, score)
    empty = (
        results.where(false_positive)
        .orderBy(F.desc(predicted), id_column)
        .limit(1)
        .select(F.lit("empty_false_positive").alias("label"), id_column, score)
    )
    low = results.orderBy(recall, id_column).limit(1).select(
        F.lit("lowest_recall").alias("label"), id_column, score
    )
    return placed.unionByName(empty).unionByName(low)


def validation_selected(
    runs: DataFrame, model: str, mode: str, *, score: str = "iou", metrics: Sequence[str] = ("iou",)
) -> DataFrame:
    """Per model: the mode with the best validation mean, reported on test rows only."""
    validation = (
        runs.where("split = 'validation'").groupBy(model, mode).agg(F.avg(score).alias("_score"))
    )
    # min_by on the negated score makes the first mode by name win a tie.
    chosen = validation.groupBy(model).agg(
        F.min_by(mode, F.struct(-F.col("_score"), F.col(mode))).alias(mode),
        F.max("_score").alias("validation_score"),
    )
    test = runs.where("split = 'test'").groupBy(model, mode).agg(
        F.count(F.lit(1)).alias("test_rows"), *[F.avg(m).alias(m) for m in metrics]
    )
    return chosen.join(test, [model, mode])


def models_without_validation(runs: DataFrame, model: str) -> DataFrame:
    """Models whose configuration cannot be chosen."""
    return (
        runs.groupBy(model)
        .agg(F.count_if(F.col("split") == "validation").alias("_n"))
        .where("_n = 0")
        .select(model)
    )


def require_validation(runs: DataFrame, model: str) -> DataFrame:
    """The runs, once every model has validation rows to choose by."""
    raise_if_any(models_without_validation(runs, model), model, "No validation rows to select by")
    return runs


def running_best(history: DataFrame, run: str, epoch: str, value: str) -> DataFrame:
    """Best value so far per run and the distance to it."""
    best = running_max(history, [epoch], value, groups=[run], out="running_best")
    return best.withColumn("delta_to_best", F.col(value) - F.col("running_best"))


_IMPROVED = ("best_value", "best_epoch", "best_position")


def early_stopping(
    history: DataFrame,
    run: str,
    epoch: str,
    value: str,
    patience: int,
    margin: float = IMPROVEMENT_MARGIN,
    state: DataFrame | None = None,
) -> DataFrame:
    """Best epoch, epochs run and whether patience ended the run.

    An epoch improves if it beats the kept best by more than ``margin``. Only a strict record
    of its run can. A record that beats the record before it by more than the margin improves
    whatever is kept, as the kept best is never above that record. Such records cut a run
    into sections that do not depend on each other: each is folded on its own, row by row with
    a few numbers of state, and the sections of a run are then put together by their ends.

    ``state`` has earlier results of this function for runs that go on: the epochs given
    come after those it has seen. Rows without a value never improve; epochs of a run are
    to be distinct.
    """
    rows = history.select(F.col(run).alias("run"), F.col(epoch).alias("epoch"), F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double")).alias("value"))
    if state is not None:
        known = state.select(F.col(run).alias("run"), *_IMPROVED, "epochs_run", "stopped_early")
        placed = rows.join(known, "run", "left").where(~F.coalesce("stopped_early", F.lit(False)))
    else:
        placed = rows.withColumns({"best_value": F.lit(None).cast("double"), "best_position": F.lit(None).cast("long"), "best_epoch": F.lit(None).cast(rows.schema["epoch"].dataType), "epochs_run": F.lit(0).cast("long")})
    seen = scanned(placed, ["epoch"], groups=["run"], numbers=("_row", "_rows"), maxima={"_before": ("value", False)})
    earlier = F.coalesce("epochs_run", F.lit(0).cast("long"))
    seen = pin(seen.withColumns({"pos": F.col("_row") + earlier, "total": F.col("_rows") + earlier, "_before": F.greatest("_before", "best_value")}))
    kept = seen.where(F.col("value").isNotNull() & (F.col("_before").isNull() | (F.col("value") > F.col("_before"))))
    kept = kept.select("run", "epoch", "value", "pos", (F.col("_before").isNull() | (F.col("value") > F.col("_before") + margin)).alias("sure"))
    ends = seen.groupBy("run").agg(
        F.max("total").alias("epochs"), F.first("best_value").alias("_value"), F.first("best_epoch").alias("_epoch"), F.first("best_position").alias("_pos")
    )
    # What was kept before opens the first section.
    opened = ends.where("_pos is not null").select("run", F.col("_epoch").alias("epoch"), F.col("_value").alias("value"), F.col("_pos").alias("pos"), F.lit(True).alias("sure"))
    marked = kept.unionByName(opened).withColumn("_start", F.when(F.col("sure"), F.col("pos")))
    sectioned = scanned(marked, ["pos"], groups=["run"], maxima={"section": ("_start", True), "_last": ("_start", False)})
    sections = pin(_folded_sections(sectioned, patience, margin))
    before = sections.select("run", F.col("section").alias("_last"), *(F.col(f"last_{c}").alias(f"_{c}") for c in ("pos", "epoch", "value")))
    # A section is reached too late if patience ran out behind the one before it.
    joined = sections.join(before, ["run", "_last"], "left").join(opened.select("run", F.col("pos").alias("_opened")), "run", "left")
    earlier = F.coalesce("_pos", F.lit(0).cast("long"))
    late = (F.col("section") - earlier > patience) & ~F.col("section").eqNullSafe(F.col("_opened"))
    stop = F.when(late, F.struct(earlier.alias("_pos"), "_epoch", "_value")).when(
        F.col("stopped"), F.struct(F.col("last_pos").alias("_pos"), F.col("last_epoch").alias("_epoch"), F.col("last_value").alias("_value"))
    )
    last = F.struct(F.col("last_pos").alias("_pos"), F.col("last_epoch").alias("_epoch"), F.col("last_value").alias("_value"))
    # The first stop counts; its position is the least, as kept positions only grow.
    found = joined.groupBy("run").agg(F.coalesce(F.min(stop), F.max(last)).alias("_kept"))
    result = ends.select("run", "epochs").join(found, "run", "left")
    position = F.coalesce(F.col("_kept._pos"), F.lit(0).cast("long"))
    fresh = result.select(
        F.col("run").alias(run),
        F.col("_kept._epoch").alias("best_epoch"),
        F.coalesce(F.col("_kept._value"), F.lit(float("-inf"))).alias("best_value"),
        position.alias("best_position"),
        F.least("epochs", position + patience).alias("epochs_run"),
        (F.col("epochs") - position >= patience).alias("stopped_early"),
    )
    if state is None:
        return fresh
    rest = state.join(fresh.select(run), run, "left_anti").select(*fresh.columns)
    return fresh.unionByName(rest)


def _folded_sections(records: DataFrame, patience: int, margin: float) -> DataFrame:
    """One row per section: what is kept at its end, and whether patience ran out inside.

    Sections stream through their task in order with a few numbers of state each.
    """
    epoch_type = records.schema["epoch"].dataType.simpleString()
    run_type = records.schema["run"].dataType.simpleString()
    names = ["run", "section", "_last", "last_pos", "last_epoch", "last_value", "stopped"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: tuple | None = None
        out: list[tuple] = []

        def packed() -> pa.RecordBatch:
            kinds = [schema.field(c).type for c in ("run", "section", "_last", "pos", "epoch", "value")]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out, strict=True), [*kinds, pa.bool_()], strict=True)], names=names
            )

        for batch in batches:
            schema = batch.schema
            columns = (batch.column(c).to_pylist() for c in ("run", "section", "_last", "pos", "epoch", "value"))
            for run, section, last, pos, epoch, value in zip(*columns, strict=True):
                if current is None or current[:2] != (run, section):
                    if current is not None:
                        out.append(current)
                    current = run, section, last, pos, epoch, value, False
                elif not current[6]:
                    if pos - current[3] > patience:
                        current = (*current[:6], True)
                    elif value > current[5] + margin:
                        current = run, section, current[2], pos, epoch, value, False
            if out:
                yield packed()
                out = []
        if current is not None:
            out.append(current)
            yield packed()

    dealt = records.select("run", "section", "_last", "pos", "epoch", "value").repartition("run", "section").sortWithinPartitions("run", "section", "pos")
    return dealt.mapInArrow(fold, f"run {run_type}, section long, _last long, last_pos long, last_epoch {epoch_type}, last_value double, stopped boolean")


def largest_image(manifest: DataFrame, id_column: str = "image_id") -> DataFrame:
    """Image with the most pixels; the smallest id wins a tie."""
    pixels = F.col("width").cast("bigint") * F.col("height")
    best = manifest.agg(
        F.min_by(F.struct(id_column, "width", "height"), F.struct(-pixels, F.col(id_column))).alias("_b")
    )
    return best.select("_b.*")


def quantile_representatives(
    df: DataFrame, value: str, quantiles: Sequence[float], id_column: str = "image_id"
) -> DataFrame:
    """For each quantile the row nearest to it; the smallest id wins a tie."""
    targets = quantile_values(df, value, quantiles)
    nearest = df.agg(
        *[
            F.min_by(F.struct(id_column, value), F.struct(F.abs(F.col(value) - t), F.col(id_column))).alias(f"_q{i}")
            for i, t in enumerate(targets)
        ]
    )
    rows = F.array(
        *[
            F.struct(F.lit(float(q)).alias("quantile"), F.lit(t).alias("target"), F.col(f"_q{i}").alias("row"))
            for i, (q, t) in enumerate(zip(quantiles, targets))
        ]
    )
    return nearest.select(F.explode(rows).alias("_r")).select(
        "_r.quantile", "_r.target", F.col(f"_r.row.{id_column}").alias(id_column), F.col(f"_r.row.{value}").alias(value)
    )
