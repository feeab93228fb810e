"""Confusion, calibration and loss queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterledger.catalog.registry import query
from rasterledger.catalog.views import SPLIT, view, with_views
from rasterledger.functions.metrics import (
    RATIO_METRICS,
    meter_metrics,
    per_image_metrics,
    presence_columns,
)
from rasterledger.functions.scalars import dequantise_u16, quantise_u16
from rasterledger.operators import calibration as cal
from rasterledger.operators import confusion as con
from rasterledger.operators import losses

THRESHOLD = 0.5


def r6(df, *keep):
    """Round every double column to six digits for comparison."""
    return df.select(
        *[
            F.round(c, 6).alias(c) if t == "double" and c not in keep else F.col(c)
            for c, t in df.dtypes
        ]
    )


# --- SQL fragments -----------------------------------------------------------

COUNTS_SQL = f""", counts as (
    select image_id,
           count(*) filter (prob >= {THRESHOLD} and target = 1) as tp,
           count(*) filter (prob >= {THRESHOLD} and target = 0) as fp,
           count(*) filter (prob < {THRESHOLD} and target = 1) as fn,
           count(*) filter (prob < {THRESHOLD} and target = 0) as tn
    from px group by image_id)"""

_CHANCE = "((tp+fp)*(tp+fn)+(fn+tn)*(fp+tn))"


def per_image_sql(policy: str = "perfect_if_both_empty", source: str = "counts") -> str:
    undefined = "case when tp+fp+fn = 0 then 1.0 else 0.0 end" if policy.startswith("perfect") else "0.0"
    return f"""select *, (recall + specificity) / 2 as balanced_accuracy,
        case when chance <> 1 then (pixel_accuracy - chance) / (1 - chance) else 1.0 end as cohen_kappa
      from (select *,
        case when tp+fp+fn > 0 then tp/(tp+fp+fn) else {undefined} end as iou,
        case when 2*tp+fp+fn > 0 then 2*tp/(2*tp+fp+fn) else {undefined} end as dice,
        case when tp+fp > 0 then tp/(tp+fp) else {undefined} end as precision,
        case when tp+fn > 0 then tp/(tp+fn) else {undefined} end as recall,
        case when tn+fp > 0 then tn/(tn+fp) else 1.0 end as specificity,
        case when tp+fp+fn+tn > 0 then (tp+tn)/(tp+fp+fn+tn) else 1.0 end as pixel_accuracy,
        case when (tp+fp)*(tp+fn)*(tn+fp)*(tn+fn) > 0
             then (tp*tn-fp*fn)/sqrt((tp+fp)*(tp+fn)*(tn+fp)*(tn+fn)) else 0.0 end as mcc,
        case when tp+fp+fn+tn > 0 then {_CHANCE}/((tp+fp+fn+tn)*(tp+fp+fn+tn)) else 1.0 end as chance
      from (select * replace (tp::double as tp, fp::double as fp, fn::double as fn, tn::double as tn)
            from {source}))"""


def meter_sql(source: str) -> str:
    return f"""select *, (recall + specificity) / 2 as balanced_accuracy,
        case when 1 - chance <> 0 then (pixel_accuracy - chance) / (1 - chance) else 0.0 end as cohen_kappa
      from (select *,
        case when tp+fp+fn > 0 then tp/(tp+fp+fn) else 1.0 end as iou,
        case when 2*tp+fp+fn > 0 then 2*tp/(2*tp+fp+fn) else 1.0 end as dice,
        case when tp+fp > 0 then tp/(tp+fp) when fn = 0 then 1.0 else 0.0 end as precision,
        case when tp+fn > 0 then tp/(tp+fn) else 1.0 end as recall,
        case when tn+fp > 0 then tn/(tn+fp) else 1.0 end as specificity,
        case when tp+fp+fn+tn > 0 then (tp+tn)/(tp+fp+fn+tn) else 1.0 end as pixel_accuracy,
        case when (tp+fp)*(tp+fn)*(tn+fp)*(tn+fn) > 0
             then (tp*tn-fp*fn)/sqrt((tp+fp)*(tp+fn)*(tn+fp)*(tn+fn)) else 0.0 end as mcc,
        case when tp+fp+fn+tn > 0 then {_CHANCE}/((tp+fp+fn+tn)*(tp+fp+fn+tn)) else 0.0 end as chance
      from (select * replace (tp::double as tp, fp::double as fp, fn::double as fn, tn::double as tn)
            from {source}))"""


def rounded(names, prefix: str = "") -> str:
    return ", ".join(f"round({prefix}{n}, 6) as {n}" for n in names)


def split_of_image(df):
    return df.withColumn("split", F.expr(SPLIT.format(key="image_id")))


def counts_of(spark, sf_dir):
    px = view(spark, sf_dir, "px")
    return con.confusion_counts(px, ["image_id"], F.col("prob") >= THRESHOLD, F.col("target"))


def results_of(spark, sf_dir, policy="perfect_if_both_empty"):
    """Per-image result rows with split labels."""
    rows = counts_of(spark, sf_dir).select("*", *per_image_metrics(policy), *presence_columns())
    return split_of_image(rows)


RESULTS_SQL = f"""{COUNTS_SQL}, metrics as ({per_image_sql()}),
  results as (select *, {SPLIT.format(key="image_id")} as split,
    (tp+fn)/(tp+fp+fn+tn) as target_fraction, (tp+fp)/(tp+fp+fn+tn) as predicted_fraction,
    (tp+fp)/(tp+fp+fn+tn) - (tp+fn)/(tp+fp+fn+tn) as fraction_error,
    tp+fn > 0 as target_present, tp+fp > 0 as prediction_present,
    tp+fp+fn = 0 as empty_correct, (tp+fn = 0 and fp > 0) as empty_false_positive from metrics)"""


# --- confusion ----------------------------------------------------------------


@query("a1_confusion_counts", with_views("px", COUNTS_SQL + " select image_id, tp, fp, fn, tn from counts"))
def _a1(spark, sf_dir):
    return counts_of(spark, sf_dir)


@query(
    "a1_shape_mismatch",
    with_views(
        "grid",
        """, p as (select image_id, y, x from grid where pred = 1),
             t as (select image_id, y, x from grid where target = 1)
           select coalesce(p.image_id, t.image_id) as image_id,
                  count(*) filter (t.image_id is null) as prediction_only,
                  count(*) filter (p.image_id is null) as target_only
           from p full join t on p.image_id = t.image_id and p.y = t.y and p.x = t.x
           group by 1 having count(*) filter (t.image_id is null or p.image_id is null) > 0""",
    ),
)
def _a1_shape(spark, sf_dir):
    grid = view(spark, sf_dir, "grid")
    return con.shape_mismatches(grid.where("pred = 1"), grid.where("target = 1"))


def _metric_query(name, policy):
    sql = with_views(
        "px", f"{COUNTS_SQL}, m as ({per_image_sql(policy)}) select image_id, {rounded(RATIO_METRICS)} from m"
    )

    @query(name, sql)
    def run(spark, sf_dir):
        return r6(counts_of(spark, sf_dir).select("image_id", *per_image_metrics(policy)))


_metric_query("a2_metrics_perfect_if_both_empty", "perfect_if_both_empty")
_metric_query("a2_metrics_zero_if_undefined", "zero_if_undefined")

_FLAGS = "target_present, prediction_present, empty_correct, empty_false_positive"


@query(
    "a2_presence_flags",
    with_views(
        "px",
        f"{RESULTS_SQL} select image_id, {rounded(['target_fraction', 'predicted_fraction', 'fraction_error'])}, {_FLAGS} from results",
    ),
)
def _a2_flags(spark, sf_dir):
    return r6(counts_of(spark, sf_dir).select("image_id", *presence_columns()))


@query(
    "a3_meter_metrics",
    with_views("px", f"{COUNTS_SQL}, m as ({meter_sql('counts')}) select image_id, {rounded(RATIO_METRICS)} from m"),
)
def _a3(spark, sf_dir):
    return r6(counts_of(spark, sf_dir).select("image_id", *meter_metrics()))


_POOLED = ["global_iou", "global_dice", "global_precision", "global_recall", "global_specificity"]


@query(
    "a4_pooled_by_split",
    with_views(
        "px",
        f"""{RESULTS_SQL}, s as (select split, count(*) as images, sum(tp) as tp, sum(fp) as fp,
              sum(fn) as fn, sum(tn) as tn from results group by split)
            select split, images, tp::bigint as tp, fp::bigint as fp, fn::bigint as fn, tn::bigint as tn,
              round(case when tp+fp+fn > 0 then tp/(tp+fp+fn) else 1 end, 6) as global_iou,
              round(case when 2*tp+fp+fn > 0 then 2*tp/(2*tp+fp+fn) else 1 end, 6) as global_dice,
              round(case when tp+fp > 0 then tp/(tp+fp) else 1 end, 6) as global_precision,
              round(case when tp+fn > 0 then tp/(tp+fn) else 1 end, 6) as global_recall,
              round(case when tn+fp > 0 then tn/(tn+fp) else 1 end, 6) as global_specificity
            from s""",
    ),
)
def _a4(spark, sf_dir):
    return r6(con.pooled_summary(split_of_image(counts_of(spark, sf_dir)), ["split"]))


_MACRO = [*RATIO_METRICS, "target_fraction", "predicted_fraction", "fraction_error"]


@query(
    "a5_macro_by_split",
    with_views(
        "px",
        f"{RESULTS_SQL} select split, count(*) as images, "
        + ", ".join(f"round(avg({m}), 6) as {m}" for m in _MACRO)
        + " from results group by split",
    ),
)
def _a5(spark, sf_dir):
    return r6(con.macro_summary(results_of(spark, sf_dir), ["split"]))


def _runs_with_null_modes(spark, sf_dir):
    # Pending runs carry no mode, so the summary has to keep a NULL key.
    return view(spark, sf_dir, "runs").withColumn("prompt_mode", F.expr("nullif(prompt_mode, 'P')"))


_A6 = """, r as (select * replace (nullif(prompt_mode, 'P') as prompt_mode) from runs)
  select experiment, prompt_mode, split, count(*) as images, round(avg(iou), 6) as iou from r"""


@query("a6_macro_by_experiment_mode_split", with_views("runs", _A6 + " group by 1, 2, 3"))
def _a6(spark, sf_dir):
    runs = _runs_with_null_modes(spark, sf_dir)
    return r6(con.macro_summary(runs, ["experiment", "prompt_mode", "split"]))


@query("a7_macro_test_only", with_views("runs", _A6 + " where split = 'test' group by 1, 2, 3"))
def _a7(spark, sf_dir):
    runs = _runs_with_null_modes(spark, sf_dir)
    return r6(con.macro_summary(runs, ["experiment", "prompt_mode", "split"]).where("split = 'test'"))


@query(
    "a8_meter_summary",
    with_views(
        "px",
        f"""{COUNTS_SQL}, m as ({meter_sql('counts')}),
            pooled as (select sum(tp)::double as tp, sum(fp)::double as fp, sum(fn)::double as fn,
                       sum(tn)::double as tn from counts),
            g as ({meter_sql('pooled')})
            select (select count(*) from counts) as images, """
        + ", ".join(f"(select round({m}, 6) from g) as global_{m}" for m in RATIO_METRICS)
        + ", "
        + ", ".join(f"round(avg({m}), 6) as mean_{m}, round(avg({m}), 6) as {m}" for m in RATIO_METRICS)
        + " from m",
    ),
)
def _a8(spark, sf_dir):
    return r6(con.meter_summary(counts_of(spark, sf_dir)))


# Image 0 of the grid view has empty masks only through filtering, so use quadrants as images.
_QUADS = """, quads as (select image_id * 16 + (y // 8) * 4 + x // 8 as image_id, target, pred from grid),
  counts as (select image_id, count(*) filter (pred = 1 and target = 1) as tp,
     count(*) filter (pred = 1 and target = 0) as fp, count(*) filter (pred = 0 and target = 1) as fn,
     count(*) filter (pred = 0 and target = 0) as tn from quads group by image_id)"""


@query(
    "a9_conditional_means",
    with_views(
        "grid",
        f"""{_QUADS}, m as ({per_image_sql()})
            select count(*) as images, round(avg(iou) filter (tp+fn > 0), 6) as present_iou,
              count(*) filter (tp+fn = 0) as empty_images,
              round(avg((tp+fp+fn = 0)::int) filter (tp+fn = 0), 6) as empty_accuracy,
              round(avg((fp > 0)::int) filter (tp+fn = 0), 6) as empty_false_positive_rate from m""",
    ),
)
def _a9(spark, sf_dir):
    grid = view(spark, sf_dir, "grid").withColumn("image_id", F.expr("image_id * 16 + (y div 8) * 4 + x div 8"))
    counts = con.confusion_counts(grid, ["image_id"], F.col("pred"), F.col("target"))
    return r6(con.conditional_summary(counts.select("*", *per_image_metrics(), *presence_columns())))


@query(
    "a16_validation_summary",
    with_views(
        "px",
        f"""{COUNTS_SQL}, m as ({per_image_sql()}),
            b as (select image_id, avg(-(target * ln(p) + (1 - target) * ln(1 - p))) as bce from
                  (select image_id, target, least(greatest(prob, 1e-6::double), 1 - 1e-6::double) as p from px)
                  group by image_id)
            select count(*) as images, round(avg(iou), 6) as iou, round(avg(dice), 6) as dice,
                   round(avg(bce), 6) as bce from m join b using (image_id)""",
    ),
)
def _a16(spark, sf_dir):
    return r6(con.validation_summary(view(spark, sf_dir, "px"), THRESHOLD, per_image_metrics()))


# --- losses -------------------------------------------------------------------


def _logits(spark, sf_dir):
    # Every tenth probability level stands for padding and carries the ignore label.
    return view(spark, sf_dir, "px").select(
        "image_id",
        ((F.col("prob") - 0.5) * 8.0).alias("logit"),
        F.when(F.col("prob") == 0.4, F.lit(255)).otherwise(F.col("target")).alias("label"),
    )


_LOGITS = """, z as (select image_id, (prob - 0.5::double) * 8 as logit,
    case when prob = 0.4::double then 255 else target end as label from px),
  e as (select *, 1 / (1 + exp(-logit)) as p,
        greatest(logit, 0) - logit * (label = 1)::int + ln(1 + exp(-abs(logit))) as bce from z)"""


def _ce_dice_sql(smooth: str, keep: str, ce: str, dice: str) -> str:
    return with_views(
        "px",
        f"""{_LOGITS}, i as (select image_id, sum(bce) filter ({keep}) as ce, count(*) filter ({keep}) as n,
              coalesce(sum(p * (label = 1)::int) filter ({keep}), 0) as overlap,
              coalesce(sum(p + (label = 1)::int) filter ({keep}), 0) as mass from e group by image_id),
            l as (select sum(ce) / sum(n) as ce, 1 - avg((2 * overlap + {smooth}) / (mass + {smooth})) as dice,
                  sum(n)::bigint as valid_pixels from i)
            select round(ce, 6) as cross_entropy, round(dice, 6) as dice_loss, valid_pixels,
                   round({ce} * ce + {dice} * dice, 6) as loss from l""",
    )


@query("a17_ce_dice_loss", _ce_dice_sql("1e-6::double", "label <> 255", "0.7::double", "0.3::double"))
def _a17(spark, sf_dir):
    return r6(losses.cross_entropy_dice_audit(_logits(spark, sf_dir), ce_weight=0.7, dice_weight=0.3))


@query(
    "a18_combined_loss",
    with_views(
        "px",
        """, e as (select image_id, target, (prob - 0.5::double) * 8 as logit,
                 1 / (1 + exp(-(prob - 0.5::double) * 8)) as p from px),
             b as (select *, greatest(logit, 0) - logit * target + ln(1 + exp(-abs(logit))) as bce,
                   p * target + (1 - p) * (1 - target) as pt,
                   0.25::double * target + 0.75::double * (1 - target) as w from e),
             i as (select image_id, count(*) as n, sum(bce) as bce, sum(w * pow(1 - pt, 2) * bce) as focal,
                   sum(p * target) as overlap, sum(p + target) as mass,
                   (count(*) filter (p >= 0.5 and target = 1))::double
                     / (count(*) filter (p >= 0.5 or target = 1)) as hard_iou from b group by image_id),
             l as (select sum(bce) / sum(n) as bce_loss,
                   1 - avg((2 * overlap + 1e-6::double) / (mass + 1e-6::double)) as dice_loss,
                   sum(focal) / sum(n) as focal_loss, avg(pow(0.5::double - hard_iou, 2)) as iou_head_loss from i)
           select round(bce_loss, 6) as bce_loss, round(dice_loss, 6) as dice_loss,
             round(focal_loss, 6) as focal_loss, round(iou_head_loss, 6) as iou_head_loss,
             round(0.35::double * bce_loss + 0.45::double * dice_loss + 0.2::double * focal_loss
                   + 0.1::double * iou_head_loss, 6) as loss from l""",
    ),
)
def _a18(spark, sf_dir):
    px = view(spark, sf_dir, "px")
    pixels = px.select("image_id", ((F.col("prob") - 0.5) * 8.0).alias("logit"), F.col("target").alias("label"))
    predicted = px.select("image_id").distinct().withColumn("predicted_iou", F.lit(0.5))
    return r6(losses.combined_loss_audit(pixels, predicted_iou=predicted))


@query("a19_historical_loss", _ce_dice_sql("1.0::double", "true", "0.5::double", "0.5::double"))
def _a19(spark, sf_dir):
    return r6(
        losses.cross_entropy_dice_audit(
            _logits(spark, sf_dir), ce_weight=0.5, dice_weight=0.5, smooth=1.0, ignore_label=None
        )
    )


# --- sweeps -------------------------------------------------------------------

STEPPED = cal.stepped_thresholds()
SPACED = cal.spaced_thresholds()


def _sweep_sql(thresholds, groups: str, ctes: str = "", source: str = "px") -> str:
    listed = ", ".join(f"{t!r}::double" for t in thresholds)
    keys = f"{groups}, " if groups else ""
    return f"""{ctes}, t as (select unnest([{listed}]) as threshold),
      counts as (select {keys}threshold,
        count(*) filter (prob >= threshold and target = 1) as tp,
        count(*) filter (prob >= threshold and target = 0) as fp,
        count(*) filter (prob < threshold and target = 1) as fn,
        count(*) filter (prob < threshold and target = 0) as tn
        from {source}, t group by all)"""


_C1_SWEEP = f"""{_sweep_sql(STEPPED, 'image_id')}, m as ({per_image_sql()}),
  sweep as (select threshold, avg(iou) as iou, avg(dice) as dice, avg(precision) as precision,
            avg(recall) as recall, count(*) as images from m group by threshold)"""


@query(
    "c1_macro_threshold_sweep",
    with_views(
        "px",
        f"""{_C1_SWEEP} select threshold, {rounded(['iou', 'dice', 'precision', 'recall'])}, images,
            false as test_split_used from sweep""",
    ),
)
def _c1(spark, sf_dir):
    return r6(cal.macro_sweep(view(spark, sf_dir, "px"), STEPPED), "threshold")


_C2_SWEEP = f"{_sweep_sql(SPACED, '')}, m as ({meter_sql('counts')})"


@query(
    "c2_pooled_threshold_sweep",
    with_views("px", f"{_C2_SWEEP} select round(threshold, 6) as threshold, {rounded(RATIO_METRICS)} from m"),
)
def _c2(spark, sf_dir):
    return r6(cal.pooled_sweep(view(spark, sf_dir, "px"), SPACED))


@query(
    "c3_threshold_grids",
    with_views(
        "px",
        f"""{_sweep_sql(STEPPED, '')}, s as (select 'stepped' as grid, threshold, tp from counts),
          t2 as (select unnest([{', '.join(f'{t!r}::double' for t in SPACED)}]) as threshold),
          c2 as (select 'spaced' as grid, threshold, count(*) filter (prob >= threshold and target = 1) as tp
                 from px, t2 group by all)
          select grid, round(threshold, 6) as threshold, tp from (from s union all from c2)""",
    ),
)
def _c3(spark, sf_dir):
    px = view(spark, sf_dir, "px")
    stepped = cal.sweep_counts(px, STEPPED).select(F.lit("stepped").alias("grid"), "threshold", "tp")
    spaced = cal.sweep_counts(px, SPACED).select(F.lit("spaced").alias("grid"), "threshold", "tp")
    return r6(stepped.unionByName(spaced))


@query(
    "c4_best_macro_threshold",
    with_views(
        "px",
        f"{_C1_SWEEP} select threshold, round(iou, 6) as iou, round(dice, 6) as dice from sweep"
        " order by sweep.iou desc, sweep.dice desc, threshold limit 1",
    ),
)
def _c4(spark, sf_dir):
    return r6(cal.best_threshold(cal.macro_sweep(view(spark, sf_dir, "px"), STEPPED)))


@query(
    "c5_best_pooled_by_metric",
    with_views(
        "px",
        f"""{_C2_SWEEP} select round(threshold, 6) as threshold, {rounded(RATIO_METRICS)} from m
            order by m.iou desc, m.threshold limit 1""",
    ),
)
def _c5(spark, sf_dir):
    return r6(cal.best_by_metric(cal.pooled_sweep(view(spark, sf_dir, "px"), SPACED)))


@query(
    "c6_threshold_per_mode",
    f"""with px as (select l_linestatus as mode,
            least(cast(1 as double), round(l_discount * 8 + cast(0.2 as double)
                  * (case when l_returnflag = 'R' then 1 else 0 end), 2)) as prob,
            case when l_returnflag = 'R' then 1 else 0 end as target from lineitem)
        {_sweep_sql(SPACED, 'mode')}, m as ({meter_sql('counts')}),
        best as (select mode, threshold from m
                 qualify row_number() over (partition by mode order by iou desc, threshold) = 1)
        select mode, round(threshold, 6) as threshold from best""",
)
def _c6(spark, sf_dir):
    from rasterledger.catalog.views import table

    px = table(spark, sf_dir, "lineitem").selectExpr(
        "l_linestatus as mode",
        "least(1.0D, round(l_discount * 8 + 0.2D * (case when l_returnflag = 'R' then 1 else 0 end), 2)) as prob",
        "case when l_returnflag = 'R' then 1 else 0 end as target",
    )
    mapped = cal.threshold_map(cal.pooled_sweep(px, SPACED, ["mode"]), "mode")
    return r6(mapped.select(F.explode("thresholds").alias("mode", "threshold")))


# --- calibration --------------------------------------------------------------

_EDGES = ", ".join(f"{e!r}::double" for e in cal.unit_edges(15)[1:-1])
_LISTED_EDGES = ", ".join(f"{e!r}::double" for e in cal.unit_edges(15))
_BINNED = f""", b0 as (select {SPLIT.format(key="image_id")} as split, prob, target,
     len(list_filter([{_EDGES}], lambda e: e <= prob)) as bin_index from px),
  b as (from b0 union all select 'overall' as split, prob, target, bin_index from b0)"""


@query(
    "c7_reliability_table",
    with_views(
        "px",
        f"""{_BINNED}, s as (select split, bin_index, count(*) as n, avg(prob) as p, avg(target) as t
              from b group by all), totals as (select split, count(*) as total from b group by split),
          spine as (select split, total, unnest(range(15)) as bin_index from totals)
          select split, bin_index::int as bin_index,
            round([{_LISTED_EDGES}][bin_index + 1], 6) as lower_bound,
            round([{_LISTED_EDGES}][bin_index + 2], 6) as upper_bound,
            coalesce(n, 0)::bigint as pixel_count, round(coalesce(n, 0) / total, 6) as pixel_fraction,
            round(p, 6) as mean_confidence, round(t, 6) as empirical_frequency,
            round(abs(p - t), 6) as absolute_calibration_gap
          from spine left join s using (split, bin_index)""",
    ),
)
def _c7(spark, sf_dir):
    return r6(cal.reliability_table(split_of_image(view(spark, sf_dir, "px")), split="split"))


_ENTROPY = "-(prob * ln(greatest(prob, 1e-12::double)) + (1 - prob) * ln(greatest(1 - prob, 1e-12::double)))"


@query(
    "c8_calibration_metrics",
    with_views(
        "px",
        f"""{_BINNED}, s as (select split, bin_index, abs(avg(prob) - avg(target)) * count(*) as gap
              from b group by all), g as (select split, sum(gap) as gap from s group by split)
          select split, count(*) as sampled_pixels, round(avg(pow(prob - target, 2)), 6) as brier_score,
            round(any_value(gap) / count(*), 6) as expected_calibration_error,
            round(avg({_ENTROPY}), 6) as mean_predictive_entropy,
            round(avg((prob >= 0.4::double and prob <= 0.6::double)::int), 6) as low_confidence_fraction
          from b join g using (split) group by split""",
    ),
)
def _c8(spark, sf_dir):
    return r6(cal.calibration_metrics(split_of_image(view(spark, sf_dir, "px")), split="split"))


@query(
    "c9_meter_calibration",
    with_views(
        "px",
        """, s as (select least(floor(prob * 20), 19) as b, sum(prob) as p, sum(target) as t, count(*) as n,
                  sum(pow(prob - target, 2)) as sq from px group by 1)
           select sum(n)::bigint as pixels, round(sum(abs(p / n - t / n) * n) / sum(n), 6) as ece,
                  round(sum(sq) / sum(n), 6) as brier_score from s""",
    ),
)
def _c9(spark, sf_dir):
    return r6(cal.meter_calibration(view(spark, sf_dir, "px")))


_CURVE = """, h as (select least(floor(prob * 512), 511)::int as bin_index,
     count(*) filter (target = 1) as pos, count(*) filter (target = 0) as neg from px group by 1),
  f as (select s.bin_index, coalesce(pos, 0) as pos, coalesce(neg, 0) as neg
        from (select unnest(range(512)) as bin_index) s left join h using (bin_index)),
  c as (select bin_index, sum(pos) over d as tp, sum(neg) over d as fp,
        greatest(sum(pos) over (), 1) as p, greatest(sum(neg) over (), 1) as n from f
        window d as (order by bin_index desc rows unbounded preceding)),
  curve as (select bin_index::int as bin_index, tp::bigint as tp, fp::bigint as fp, tp / p as recall,
        fp / n as false_positive_rate, tp / greatest(tp + fp, 1) as precision from c)"""


@query(
    "c10_ranking_curve",
    with_views("px", _CURVE + " select bin_index, tp, fp, " + rounded(["recall", "false_positive_rate", "precision"]) + " from curve"),
)
def _c10(spark, sf_dir):
    return r6(cal.ranking_curve(view(spark, sf_dir, "px")))


@query(
    "c11_auroc_auprc",
    with_views(
        "px",
        _CURVE
        + """, d as (select (false_positive_rate - lag(false_positive_rate) over w) * (recall + lag(recall) over w) / 2 as roc,
              (recall - lag(recall) over w) * (precision + lag(precision) over w) / 2 as pr
              from curve window w as (order by bin_index desc))
           select round(sum(roc), 6) as auroc_hist, round(sum(pr), 6) as auprc_hist from d""",
    ),
)
def _c11(spark, sf_dir):
    return r6(cal.area_under_curves(cal.ranking_curve(view(spark, sf_dir, "px"))))


@query(
    "c12_area_error",
    with_views(
        "px",
        f"""{RESULTS_SQL} select image_id, {rounded(['predicted_fraction', 'target_fraction', 'fraction_error'])},
            round(abs(fraction_error), 6) as absolute_area_error from results""",
    ),
)
def _c12(spark, sf_dir):
    rows = cal.area_error(results_of(spark, sf_dir)).select(
        "image_id", "predicted_fraction", "target_fraction", "fraction_error", "absolute_area_error"
    )
    return r6(rows)


@query(
    "f13_probability_quantisation",
    with_views(
        "px",
        """, q as (select image_id, prob, round_even(least(greatest(prob, 0), 1) * 65535, 0)::int as code from px)
           select image_id, count(*) as pixels, sum(code)::bigint as code_sum,
                  round(max(abs(code / 65535.0::double - prob)), 6) as worst_error,
                  round(sum(code / 65535.0::double), 6) as decoded_sum from q group by image_id""",
    ),
)
def _f13(spark, sf_dir):
    coded = view(spark, sf_dir, "px").withColumn("code", quantise_u16(F.col("prob")))
    decoded = dequantise_u16(F.col("code"))
    return r6(
        coded.groupBy("image_id").agg(
            F.count(F.lit(1)).alias("pixels"),
            F.sum("code").alias("code_sum"),
            F.max(F.abs(decoded - F.col("prob"))).alias("worst_error"),
            F.sum(decoded).alias("decoded_sum"),
        )
    )
