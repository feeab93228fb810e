"""Report, statistics, ranking and governance-table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterledger.catalog.evaluation import RESULTS_SQL, r6, results_of
from rasterledger.catalog.governance import (
    COVERAGE_CASE,
    PAIRED_SQL,
    bin_sql,
    edges_sql,
    manifest,
    paired_runs,
)
from rasterledger.catalog.registry import query
from rasterledger.catalog.views import table, view, with_views
from rasterledger.operators import binning, governance, ranking, reports, statistics
from rasterledger.operators.ordered import top_k_per_group


def runs(spark, sf_dir):
    return view(spark, sf_dir, "runs")


# --- reports ------------------------------------------------------------------


@query(
    "a10_dataset_summary",
    with_views(
        "manifest",
        """, w as (select count(*)::double as "pairs", min(width)::double as "minimum width",
              max(width)::double as "maximum width", min(height)::double as "minimum height",
              max(height)::double as "maximum height", quantile_cont(coverage, 0.5) as "median fraction",
              (count(*) filter (coverage = 0))::double as "empty masks",
              (count(*) filter (coverage >= 0.75::double))::double as "images above 75%" from manifest)
           select metric, round(value, 6) as value from (unpivot w on columns(*) into name metric value value)""",
    ),
)
def _a10(spark, sf_dir):
    return r6(reports.dataset_summary(manifest(spark, sf_dir), "coverage"))


@query(
    "a11_split_overview",
    with_views(
        "manifest",
        """select coalesce(split, 'total') as split, count(*) as images, round(avg(coverage), 6) as mean_fraction,
           count(*) filter (coverage = 0) as empty_masks from manifest group by rollup(split)""",
    ),
)
def _a11(spark, sf_dir):
    return r6(reports.split_overview(manifest(spark, sf_dir), "coverage"))


@query(
    "a12_shape_counts",
    with_views(
        "manifest",
        "select height, width, count(*) as images from manifest group by 1, 2",
    ),
)
def _a12(spark, sf_dir):
    return reports.shape_counts(manifest(spark, sf_dir))


@query(
    "a13_histogram_per_split",
    with_views(
        "manifest",
        """, l as (select split, min(coverage) as lo, max(coverage) as hi from manifest group by split),
           c as (select split, least(floor((coverage - lo) / (hi - lo) * 30), 29)::int as bin_index, count(*) as images
                 from manifest join l using (split) group by 1, 2),
           s as (select split, lo, hi, unnest(range(30))::int as bin_index from l)
           select split, bin_index, round(lo + (hi - lo) / 30 * bin_index, 6) as left_edge,
                  coalesce(images, 0)::bigint as images from s left join c using (split, bin_index)""",
    ),
)
def _a13(spark, sf_dir):
    return r6(binning.fixed_width_histogram(manifest(spark, sf_dir), "coverage", 30, ["split"]))


@query("a14_value_counts", with_views("runs", "select prompt_mode, count(*) as rows from runs group by 1"))
def _a14(spark, sf_dir):
    return reports.value_counts(runs(spark, sf_dir), "prompt_mode")


@query(
    "a15_prompt_summary",
    with_views(
        "runs",
        """select prompt_mode, count(*) as images, round(avg(iou), 6) as mean_iou,
           round(quantile_cont(iou, 0.5), 6) as median_iou from runs where split = 'test' group by 1""",
    ),
)
def _a15(spark, sf_dir):
    return r6(reports.prompt_summary(runs(spark, sf_dir).where("split = 'test'"), "prompt_mode"))


@query(
    "a20_seed_stability",
    with_views(
        "runs",
        """select image_id, count(*) as runs, round(avg(iou), 6) as mean, round(coalesce(stddev_samp(iou), 0), 6) as std,
           round(min(iou), 6) as minimum, round(max(iou), 6) as maximum from runs group by 1""",
    ),
)
def _a20(spark, sf_dir):
    return r6(reports.seed_stability(runs(spark, sf_dir), "iou", ["image_id"]))


@query(
    "a21_epoch_means",
    """select l_suppkey as run, year(l_shipdate)::int as epoch, count(*) as optimizer_steps,
         round(avg(l_tax), 6) as loss_mean, round(avg(l_discount), 6) as gradient_norm_mean,
         round(sum(l_quantity), 6) as examples_seen,
         round(sum(l_quantity) / greatest(sum(l_extendedprice / 1000), 1e-9), 6) as examples_per_second
       from lineitem group by 1, 2""",
)
def _a21(spark, sf_dir):
    steps = table(spark, sf_dir, "lineitem").selectExpr(
        "l_suppkey as run",
        "year(l_shipdate) as epoch",
        "l_tax as loss",
        "l_discount as gradient_norm",
        "l_quantity as examples",
        "l_extendedprice / 1000 as seconds",
    )
    return r6(
        reports.epoch_summary(
            steps, ["run", "epoch"], ["loss", "gradient_norm"], examples="examples", seconds="seconds"
        )
    )


@query(
    "a22_latency_summary",
    with_views(
        "reqlog",
        """select model_version, count(*) as requests, round(avg(total_ms), 6) as mean_ms,
           round(1000 / avg(total_ms), 6) as throughput_per_second, round(quantile_cont(total_ms, 0.5), 6) as p50_ms,
           round(quantile_cont(total_ms, 0.95), 6) as p95_ms from reqlog group by 1""",
    ),
)
def _a22(spark, sf_dir):
    return r6(reports.latency_summary(view(spark, sf_dir, "reqlog"), "total_ms", ["model_version"]))


_TRIALS = """select run_id as number, iou as value,
    case prompt_mode when 'F' then 'COMPLETE' when 'O' then 'FAIL' else 'PRUNED' end as state,
    case image_id % 3 when 0 then '0.3' when 1 then '0.5' else '0.7' end as ce_weight,
    case image_id % 3 when 0 then '0.7' when 1 then '0.5' else '0.3' end as dice_weight,
    experiment as profile from runs"""


def trials(spark, sf_dir):
    return spark.sql(_TRIALS.replace("from runs", "from {runs}"), runs=runs(spark, sf_dir))


@query(
    "a23_best_trial",
    with_views(
        "runs",
        f""", t as ({_TRIALS}), b as (select * from t where state = 'COMPLETE' order by value desc, number limit 1)
            select count(*) filter (state = 'COMPLETE') as completed_trials, count(*) as attempted_trials,
              count(*) filter (state = 'PRUNED') as pruned_trials, count(*) filter (state = 'FAIL') as failed_trials,
              (select number from b) as best_trial, (select value from b) as best_value,
              (select ce_weight from b) as best_ce_weight, (select profile from b) as best_profile from t""",
    ),
)
def _a23(spark, sf_dir):
    return r6(reports.best_trial(trials(spark, sf_dir), ["ce_weight", "profile"]))


@query(
    "a24_distinct_per_key",
    with_views("runs", "select experiment, count(distinct image_id) as distinct_values from runs group by 1"),
)
def _a24(spark, sf_dir):
    return reports.distinct_per_key(runs(spark, sf_dir), "experiment", "image_id")


# --- statistics ---------------------------------------------------------------

_DIFF = f"{PAIRED_SQL}, d as (select *, iou_current - iou_reference as difference from paired)"


def differences(spark, sf_dir):
    return statistics.with_difference(paired_runs(spark, sf_dir), "iou_current", "iou_reference")


_T1 = """count(*) as paired_count, round(avg(difference), 6) as mean_difference,
  round(quantile_cont(difference, 0.5), 6) as median_difference, round(avg((difference > 0)::int), 6) as improved_fraction,
  round(avg((difference < 0)::int), 6) as degraded_fraction, round(avg((difference = 0)::int), 6) as unchanged_fraction"""


@query("t1_paired_difference", with_views("runs", f"{_DIFF} select {_T1} from d"))
def _t1(spark, sf_dir):
    return r6(statistics.difference_summary(differences(spark, sf_dir)))


def _times_sql(x: str, factor: int) -> str:
    """Product modulo 2 ** 64 of a UBIGINT column, from halves of 32 bits so that nothing overflows."""
    low, high, mask, unit = factor & 0xFFFFFFFF, factor >> 32, "4294967295::ubigint", "4294967296::ubigint"
    least = f"(({x} & {mask}) * {low}::ubigint)"
    cross = f"((({x} >> 32) * {low}::ubigint) & {mask}) + ((({x} & {mask}) * {high}::ubigint) & {mask})"
    return f"((({least} >> 32) + {cross}) & {mask}) * {unit} + ({least} & {mask})"


def _mixed_sql(source: str, name: str) -> str:
    """CTEs that mix the 64-bit column x of ``source``; the last is ``name``."""
    first, second = _times_sql("x", 0xBF58476D1CE4E5B9), _times_sql("x", 0x94D049BB133111EB)
    shifted = "select * exclude (x), xor(x, x >> {n}) as x from {source}"
    return f"""{name}_1 as (select * exclude (x), {first} as x from ({shifted.format(n=30, source=source)})),
      {name}_2 as (select * exclude (x), {second} as x from ({shifted.format(n=27, source=name + '_1')})),
      {name} as ({shifted.format(n=31, source=name + '_2')})"""


def _weight_draws(source: str, groups: str, keys: str, value: str, iterations: int, seed: int = 42) -> str:
    """SQL twin of the Poisson weights: a mix of the row's digest with the iteration's number."""
    names = f"{groups}, " if groups else ""
    limits = " + ".join(f"(x >= {limit}::ubigint)::int" for limit in statistics._poisson_limits().tolist())
    return f"""keyed as (select {names}{value} as v, ('0x' || substr(sha256(concat_ws(':', {keys})), 1, 15))::ubigint as x
        from {source} where {value} is not null),
      {_mixed_sql('keyed', 'mixed')},
      steps as (select i as iteration, (((i + 1)::uhugeint * 11400714819323198485::uhugeint + {seed}) % 18446744073709551616::uhugeint)::ubigint as x
        from range({iterations}) t(i)),
      {_mixed_sql('steps', 'lanes')},
      crossed as (select {names}v, iteration, xor(m.x, l.x) as x from mixed m, lanes l),
      {_mixed_sql('crossed', 'draws')},
      means as (select {names}iteration, sum(v * w) / sum(w) as mean
        from (select {names}v, iteration, {limits} as w from draws) group by all having sum(w) > 0)"""


@query(
    "t2_paired_bootstrap",
    with_views(
        "runs",
        f"""{_DIFF}, {_weight_draws('d', '', 'image_id, experiment', 'difference', 5000)}
            select {_T1}, round((select quantile_cont(mean, 0.025) from means), 6) as ci_lower,
              round((select quantile_cont(mean, 0.975) from means), 6) as ci_upper, 0.95::double as confidence from d""",
    ),
)
def _t2(spark, sf_dir):
    return r6(statistics.paired_bootstrap(differences(spark, sf_dir), ["image_id", "experiment"]))


@query(
    "t3_metric_intervals",
    with_views(
        "runs",
        f""", r as (select prompt_mode, run_id, iou, 2 * iou / (1 + iou) as dice from runs where split = 'test'),
            l as (select prompt_mode, run_id, metric, score from (unpivot r on iou, dice into name metric value score)),
            {_weight_draws('l', 'prompt_mode, metric', 'run_id', 'score', 2000)},
            q as (select prompt_mode, metric, quantile_cont(mean, 0.025) as lo, quantile_cont(mean, 0.975) as hi
                  from means group by 1, 2)
            select prompt_mode, metric, round(avg(score), 6) as mean, round(any_value(lo), 6) as ci_lower,
              round(any_value(hi), 6) as ci_upper from l join q using (prompt_mode, metric) group by 1, 2""",
    ),
)
def _t3(spark, sf_dir):
    tested = runs(spark, sf_dir).where("split = 'test'").withColumn("dice", F.expr("2 * iou / (1 + iou)"))
    return r6(statistics.metric_intervals(tested, ["run_id"], "prompt_mode", ["iou", "dice"]))


@query(
    "t3_weight_bootstrap",
    with_views(
        "runs",
        f""", {_weight_draws('runs', 'prompt_mode', 'run_id', 'iou', 500)},
            q as (select prompt_mode, quantile_cont(mean, 0.025) as lo, quantile_cont(mean, 0.975) as hi from means group by 1)
            select prompt_mode, round(avg(iou), 6) as mean, round(any_value(lo), 6) as ci_lower,
              round(any_value(hi), 6) as ci_upper from runs join q using (prompt_mode) group by 1""",
    ),
)
def _t3_weights(spark, sf_dir):
    return r6(
        statistics.bootstrap_interval(
            runs(spark, sf_dir), "iou", ["run_id"], groups=["prompt_mode"], iterations=500
        )
    )


_RANKS = f""", z as (select round(difference, {statistics.DIFFERENCE_PLACES}) as difference from d),
  nz as (select difference, rank() over (order by abs(difference)) + (count(*) over (partition by abs(difference)) - 1) / 2.0::double as r
     from z where difference <> 0),
  tied as (select coalesce(sum(n * n * n - n), 0)::double as ties from (select count(*)::double as n from nz group by abs(difference))),
  s as (select count(*)::double as nonzero, sum(r) filter (difference > 0) as up, sum(r) filter (difference < 0) as down from nz),
  e as (select *, abs(least(up, down) - nonzero * (nonzero + 1) / 4) / (sqrt(nonzero * (nonzero + 1) * (2 * nonzero + 1) / 24 - ties / 48) * sqrt(2::double)) as x
     from s, tied),
  t as (select *, 1 / (1 + 0.5::double * x) as t from e)"""
_ERFC = "0"
for _c in reversed(statistics.ERFC):
    _ERFC = f"({_ERFC} * t + {_c}::double)"


@query(
    "t4_signed_rank_sums",
    with_views(
        "runs",
        f"""{_DIFF}{_RANKS} select nonzero::bigint as nonzero, round(up, 6) as positive_rank_sum, round(down, 6) as negative_rank_sum,
            round(least(up, down), 6) as wilcoxon_statistic, round((up - down) / (up + down), 6) as rank_biserial_effect from s""",
    ),
)
def _t4(spark, sf_dir):
    return r6(statistics.wilcoxon_paired(differences(spark, sf_dir)).drop("wilcoxon_p_value"))


@query(
    "t4_wilcoxon_p_value",
    with_views(
        "runs",
        f"""{_DIFF}{_RANKS} select nonzero::bigint as nonzero, round(least(up, down), 6) as wilcoxon_statistic,
            round(t * exp({_ERFC} - x * x), 6) as wilcoxon_p_value from t""",
    ),
)
def _t4_p(spark, sf_dir):
    return r6(statistics.wilcoxon_paired(differences(spark, sf_dir)).select("nonzero", "wilcoxon_statistic", "wilcoxon_p_value"))


@query(
    "t5_slice_summary",
    with_views(
        "manifest runs",
        f""", area as (select *, (width * height)::double as area from manifest), {edges_sql('area', 'area', 3, 'edges')},
            m as (select image_id, {COVERAGE_CASE} as coverage_slice,
                  ['small', 'medium', 'large'][{bin_sql('area', 'edges')} + 1] as image_size_slice, lang from area),
            j as (select r.iou, 2 * r.iou / (1 + r.iou) as dice, m.* from runs r join m using (image_id)),
            l as (select iou, dice, unnest([{{'d': 'coverage_slice', 'v': coverage_slice}},
                  {{'d': 'image_size_slice', 'v': image_size_slice}}, {{'d': 'lang', 'v': lang}}]) as s from j)
            select s.d as slice_dimension, s.v as slice_value, count(*) as images, round(avg(iou), 6) as iou,
              round(avg(dice), 6) as dice from l where s.v is not null group by 1, 2""",
    ),
)
def _t5(spark, sf_dir):
    m = manifest(spark, sf_dir).withColumn("area", (F.col("width") * F.col("height")).cast("double"))
    sliced = binning.tertile_labels(m, "area", binning.SIZE_LABELS, "image_size_slice").select(
        "image_id", binning.coverage_label(F.col("coverage")).alias("coverage_slice"), "image_size_slice", "lang"
    )
    joined = (
        runs(spark, sf_dir)
        .select("image_id", "iou", F.expr("2 * iou / (1 + iou)").alias("dice"))
        .join(sliced, "image_id")
    )
    return r6(
        statistics.summarize_slices(
            joined, ["coverage_slice", "image_size_slice", "lang"], ["iou", "dice", "boundary_f1"]
        )
    )


# --- ranking ------------------------------------------------------------------


@query(
    "w1_best_run",
    with_views(
        "runs",
        """select run_id, iou, 2 * iou / (1 + iou) as dice from runs
           order by iou desc, 3 desc, run_id limit 1""",
    ),
)
def _w1(spark, sf_dir):
    scored = runs(spark, sf_dir).select("run_id", "iou", F.expr("2 * iou / (1 + iou)").alias("dice"))
    return ranking.best_run(scored, "iou", "dice", "run_id")


_PARAMS_JSON = """'{"ce_weight":"' || ce_weight || '","dice_weight":"' || dice_weight || '","profile":"' || profile || '"}'"""
_BASELINE = '{"ce_weight":"0.5","dice_weight":"0.5","profile":"2-HIGH"}'


@query(
    "w2_top_unique_configurations",
    with_views(
        "runs",
        f""", t as ({_TRIALS}), c as (select number, value, {_PARAMS_JSON} as parameters_json from t where state = 'COMPLETE'),
            u as (select * from c where parameters_json <> '{_BASELINE}'
                  qualify row_number() over (partition by parameters_json order by value desc, number) = 1),
            k as (select *, row_number() over (order by value desc, number) as r from u)
            select number, value, parameters_json, 'optuna_rank_' || r as label from k where r <= 5""",
    ),
)
def _w2(spark, sf_dir):
    named = trials(spark, sf_dir).withColumn(
        "params",
        F.create_map(
            F.lit("profile"), F.col("profile"), F.lit("dice_weight"), F.col("dice_weight"), F.lit("ce_weight"), F.col("ce_weight")
        ),
    )
    return r6(ranking.top_unique_configurations(named, 5, F.lit(_BASELINE)))


@query("w3_worst_rows", with_views("runs", "select run_id, iou from runs order by iou, run_id limit 25"))
def _w3(spark, sf_dir):
    return ranking.smallest(runs(spark, sf_dir).select("run_id", "iou"), "iou", 25, ["run_id"])


@query(
    "w4_exemplars",
    with_views(
        "px",
        f"""{RESULTS_SQL}, o as (select image_id, iou, row_number() over (order by iou, image_id) as r, count(*) over () as n from results)
            select label, image_id, round(iou, 6) as iou from (
              select 'worst_1' as label, image_id, iou from o where r = 1
              union all select 'worst_2', image_id, iou from o where r = least(2, n)
              union all select 'median', image_id, iou from o where r = n // 2 + 1
              union all select 'best_2', image_id, iou from o where r = greatest(1, n - 1)
              union all select 'best_1', image_id, iou from o where r = n
              union all (select 'empty_false_positive', image_id, iou from results where empty_false_positive
                         order by predicted_fraction desc, image_id limit 1)
              union all (select 'lowest_recall', image_id, iou from results order by recall, image_id limit 1))""",
    ),
)
def _w4(spark, sf_dir):
    return r6(ranking.exemplars(results_of(spark, sf_dir)))


@query(
    "w5_validation_selected",
    with_views(
        "runs",
        """, v as (select experiment, prompt_mode, avg(iou) as s from runs where split = 'validation' group by 1, 2),
           c as (select * from v qualify row_number() over (partition by experiment order by s desc, prompt_mode) = 1)
           select experiment, prompt_mode, round(any_value(s), 6) as validation_score, count(*) as test_rows,
             round(avg(iou), 6) as iou from c join runs using (experiment, prompt_mode) where split = 'test' group by 1, 2""",
    ),
)
def _w5(spark, sf_dir):
    return r6(ranking.validation_selected(runs(spark, sf_dir), "experiment", "prompt_mode"))


def _history(spark, sf_dir):
    return runs(spark, sf_dir).select(F.col("image_id").alias("run"), F.col("run_id").alias("epoch"), "iou")


EARLY_STOPPING_SQL = with_views(
        "runs",
        """, h as (select image_id as run, run_id as epoch, iou, row_number() over (partition by image_id order by run_id) as pos,
                count(*) over (partition by image_id) as n from runs),
           rec as (
             with recursive f(run, pos, n, best, best_pos, best_epoch, stopped) as (
               select run, pos, n, iou, pos, epoch, false from h where pos = 1
               union all
               select h.run, h.pos, h.n,
                 case when h.iou > f.best + 1e-8::double then h.iou else f.best end,
                 case when h.iou > f.best + 1e-8::double then h.pos else f.best_pos end,
                 case when h.iou > f.best + 1e-8::double then h.epoch else f.best_epoch end,
                 false
               from f join h on h.run = f.run and h.pos = f.pos + 1 where f.pos - f.best_pos < 3)
             select * from f),
           l as (select * from rec qualify row_number() over (partition by run order by pos desc) = 1)
           select run, best_epoch, round(best, 6) as best_value, best_pos as best_position, pos as epochs_run,
                  pos - best_pos >= 3 as stopped_early from l""",
    )


@query("w6_early_stopping", EARLY_STOPPING_SQL)
def _w6(spark, sf_dir):
    return r6(ranking.early_stopping(_history(spark, sf_dir), "run", "epoch", "iou", patience=3))


@query(
    "w7_running_best",
    with_views(
        "runs",
        """, b as (select image_id as run, run_id as epoch, iou, max(iou) over (partition by image_id order by run_id) as running_best from runs)
           select run, epoch, iou, running_best, round(iou - running_best, 6) as delta_to_best from b""",
    ),
)
def _w7(spark, sf_dir):
    return r6(ranking.running_best(_history(spark, sf_dir), "run", "epoch", "iou"))


@query("w8_sorted_manifest", with_views("manifest", "select split, image_id, digest from manifest order by 1, 2"))
def _w8(spark, sf_dir):
    return manifest(spark, sf_dir).select("split", "image_id", "digest").orderBy("split", "image_id")


@query(
    "w9_largest_image",
    with_views("manifest", "select image_id, width, height from manifest order by width * height desc, image_id limit 1"),
)
def _w9(spark, sf_dir):
    return ranking.largest_image(manifest(spark, sf_dir))


@query(
    "w10_top_k_per_image",
    """select l_suppkey as image_id, l_orderkey, l_linenumber, l_partkey, l_extendedprice as area, position from
       (select *, row_number() over (partition by l_suppkey order by l_extendedprice desc, l_orderkey, l_linenumber, l_partkey)::int
          as position from lineitem) where position <= 3""",
)
def _w10(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("image_id"), "l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("area")
    )
    order = [F.desc("area"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")]
    return top_k_per_group(rows, ["image_id"], order, 3, spread_on=["l_orderkey", "l_partkey"])


# --- joins over results -------------------------------------------------------


@query(
    "j7_remaining_work",
    with_views(
        "runs",
        """select run_id, image_id, prompt_mode from runs r where not exists
           (select 1 from runs d where d.experiment = '1-URGENT' and d.image_id = r.image_id
              and d.prompt_mode = r.prompt_mode)""",
    ),
)
def _j7(spark, sf_dir):
    work = runs(spark, sf_dir)
    done = work.where("experiment = '1-URGENT'")
    return governance.remaining_work(work.select("run_id", "image_id", "prompt_mode"), done, ["image_id", "prompt_mode"])


@query(
    "j8_upsert",
    """select c_custkey as model_version, round(c_acctbal, 6) as score from customer
         where c_custkey not in (select o_custkey from orders)
       union all select o_custkey, round(max(o_totalprice), 6) from orders group by 1""",
)
def _j8(spark, sf_dir):
    stored = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("model_version"), F.col("c_acctbal").alias("score")
    )
    incoming = (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("model_version"))
        .agg(F.max("o_totalprice").alias("score"))
    )
    return r6(governance.upsert(stored, incoming, "model_version"))


@query(
    "j9_probability_fusion",
    with_views(
        "grid",
        """, c as (select image_id, y, x, (x + 2 * y) / 96.0::double as p, pred * 0.8::double as q, target from grid)
           select image_id, y, x, round(least(greatest(case when image_id % 5 <> 0 and target = 0
             then 0.6::double * q + (1 - 0.6::double) * p else p end, 0), 1), 6) as prob from c""",
    ),
)
def _j9(spark, sf_dir):
    grid = view(spark, sf_dir, "grid")
    coarse = grid.select("image_id", "y", "x", ((F.col("x") + 2 * F.col("y")) / 96.0).alias("prob"))
    refined = grid.where("target = 0").select("image_id", "y", "x", (F.col("pred") * 0.8).alias("prob"))
    status = grid.select("image_id").distinct().withColumn(
        "status", F.when(F.col("image_id") % 5 == 0, "no_coarse_candidate").otherwise("ok")
    )
    return r6(governance.fuse_probabilities(coarse, refined, status, 0.6, ["image_id", "y", "x"]))


_QS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.95]


@query(
    "j10_quantile_representatives",
    with_views(
        "manifest",
        f""", q as (select unnest([{', '.join(f'{q}::double' for q in _QS)}]) as quantile,
                unnest((select quantile_cont(coverage, [{', '.join(map(str, _QS))}]) from manifest)) as target),
            r as (select quantile, target, image_id, coverage, row_number() over
                  (partition by quantile order by abs(coverage - target), image_id) as r from q, manifest)
            select round(quantile, 6) as quantile, round(target, 6) as target, image_id, coverage from r where r = 1""",
    ),
)
def _j10(spark, sf_dir):
    return r6(ranking.quantile_representatives(manifest(spark, sf_dir), "coverage", _QS))


# --- governance tables --------------------------------------------------------

_REQUIREMENTS = [
    ("Validated ingestion", "1-URGENT/F", "exists", 0),
    ("Search trials", "2-HIGH/F", "at_least", 100),
    ("Search trials", "3-MEDIUM/F", "at_least", 100),
    ("Full inference", "4-NOT SPECIFIED/O", "equals", 12),
    ("Tracking store", "5-LOW/P", "exists", 0),
    ("Tracking store", "6-MISSING/P", "exists", 0),
]


@query(
    "k1_compliance",
    with_views(
        "runs",
        f""", e as (select experiment || '/' || prompt_mode as artefact, count(*) as amount from runs group by 1),
            q(requirement, artefact, rule, needed) as (values {', '.join(map(str, _REQUIREMENTS))})
            select requirement, bool_and(case rule when 'exists' then amount is not null
              when 'at_least' then coalesce(amount, 0) >= needed else coalesce(amount, 0) = needed end) as complete,
              string_agg(artefact, '; ' order by artefact) as evidence from q left join e using (artefact) group by 1""",
    ),
)
def _k1(spark, sf_dir):
    evidence = runs(spark, sf_dir).groupBy(F.concat_ws("/", "experiment", "prompt_mode").alias("artefact")).agg(
        F.count(F.lit(1)).alias("amount")
    )
    requirements = spark.createDataFrame(
        _REQUIREMENTS, "requirement string, artefact string, rule string, needed bigint"
    )
    return governance.compliance_table(requirements, evidence)


@query(
    "k2_completed_trials",
    with_views("runs", f", t as ({_TRIALS}) select count(*) filter (state like '%COMPLETE%') as completed_trials from t"),
)
def _k2(spark, sf_dir):
    return governance.completed_trials(trials(spark, sf_dir))


_RULES = [
    ("Quality: no material regression", "iou", ">=", 0.714),
    ("Robustness: empty-mask false positives", "empty_false_positive_rate", "<=", 0.05),
    ("Operational: p95 latency", "p95_ms", "<=", 1000.0),
    ("Quality: precision", "precision", ">=", 0.1),
]


@query(
    "k3_acceptance_gates",
    with_views(
        "px reqlog",
        f"""{RESULTS_SQL}, o as (select 'iou' as metric, avg(iou) as observed from results where split = 'test'
              union all select 'precision', avg(precision) from results where split = 'test'
              union all select 'empty_false_positive_rate', 'nan'::double
              union all select 'p95_ms', quantile_cont(total_ms, 0.95) from reqlog),
            r(criterion, metric, direction, threshold) as (values {', '.join(map(str, _RULES))}),
            j as (select *, observed is null or isnan(observed) as na from r left join o using (metric))
            select criterion, threshold::double as threshold, case when not na then round(observed, 6) end as observed,
              case when na then false when direction = '>=' then observed >= threshold else observed <= threshold end as passed,
              na as not_applicable from j""",
    ),
)
def _k3(spark, sf_dir):
    test = results_of(spark, sf_dir).where("split = 'test'")
    means = test.agg(F.avg("iou").alias("iou"), F.avg("precision").alias("precision"))
    long = means.select(
        F.explode(
            F.array(
                F.struct(F.lit("iou").alias("metric"), F.col("iou").alias("observed")),
                F.struct(F.lit("precision").alias("metric"), F.col("precision").alias("observed")),
                F.struct(F.lit("empty_false_positive_rate").alias("metric"), F.lit(float("nan")).alias("observed")),
            )
        ).alias("_f")
    ).select("_f.*")
    latency = reports.latency_summary(view(spark, sf_dir, "reqlog"), "total_ms").select(
        F.lit("p95_ms").alias("metric"), F.col("p95_ms").alias("observed")
    )
    rules = spark.createDataFrame(_RULES, "criterion string, metric string, direction string, threshold double")
    return r6(governance.acceptance_gates(rules, long.unionByName(latency)), "threshold")


_ORDER_SQL = "[" + ", ".join(f"'{s}'" for s in governance.STAGE_ORDER) + "]"
_EVENTS = f"""ev as (select user_id as run, {_ORDER_SQL}[event_id % 10 + 1] as stage,
    case event_type when 'error' then 'failed' when 'view' then 'running' else 'complete' end as status, event_id as seq, ts from events)"""
_LATEST = """, latest as (select run, stage, arg_max(status, seq) as status, max(seq) as seq from ev group by 1, 2)"""


def stage_events(spark, sf_dir):
    stages = F.array(*[F.lit(s) for s in governance.STAGE_ORDER])
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run"),
        F.element_at(stages, (F.col("event_id") % 10 + 1).cast("int")).alias("stage"),
        F.when(F.col("event_type") == "error", "failed")
        .when(F.col("event_type") == "view", "running")
        .otherwise("complete")
        .alias("status"),
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


@query("k4_latest_status", f"with {_EVENTS}{_LATEST} select run, stage, status, seq from latest")
def _k4(spark, sf_dir):
    return governance.latest_status(stage_events(spark, sf_dir))


@query(
    "k4_startable_stages",
    f"""with {_EVENTS}{_LATEST}, r as (select distinct run from ev),
        s as (select run, {_ORDER_SQL}[i + 1] as stage, i as i from r, range(10) t(i)),
        done as (select run, stage, list_position({_ORDER_SQL}, stage) - 1 as i from latest where status = 'complete'),
        need as (select s.run, s.stage, n.stage as missing, n.i as mi from s join s n on n.run = s.run and n.i < s.i
                 and n.stage not in ('stability', 'api_test') left join done d on d.run = n.run and d.stage = n.stage where d.run is null),
        f as (select run, stage, arg_min(missing, mi) as first_missing from need group by 1, 2)
        select s.run, s.stage, d.run is not null as complete, f.run is null as may_start, first_missing
        from s left join done d on d.run = s.run and d.stage = s.stage left join f on f.run = s.run and f.stage = s.stage""",
)
def _k4_start(spark, sf_dir):
    return governance.startable_stages(stage_events(spark, sf_dir))


@query(
    "k5_invalidate_downstream",
    f"""with {_EVENTS}{_LATEST} select run, stage, status, seq from latest
        where list_position({_ORDER_SQL}, stage) < list_position({_ORDER_SQL}, 'calibrate')""",
)
def _k5(spark, sf_dir):
    marked = governance.invalidate_from(stage_events(spark, sf_dir), "calibrate", F.max("seq") + 1)
    return governance.latest_status(marked)


@query(
    "k6_stage_durations",
    f"""with {_EVENTS}, d as (select run, stage, max(ts) filter (status = 'running') as s, max(ts) filter (status = 'complete') as c
          from ev group by 1, 2)
        select run, stage, round((epoch_us(c) - epoch_us(s)) / 1e6::double, 6) as seconds from d where c >= s""",
)
def _k6(spark, sf_dir):
    return r6(governance.stage_durations(stage_events(spark, sf_dir)))


_PROBES = [("health", 200), ("ready", 200), ("metadata", 200), ("valid_upload", 200), ("invalid_content_type", 415), ("missing_file", 422), ("oversized_upload", 413)]
_PROBE_SQL = """select case event_id % 6 when 0 then 'health' when 1 then 'ready' when 2 then 'metadata' when 3 then 'valid_upload'
    when 4 then 'invalid_content_type' else 'missing_file' end as probe,
    case event_id % 6 when 4 then 415 when 5 then 422 when 1 then case when event_type = 'error' then 503 else 200 end else 200 end as status
    from events"""


@query(
    "k7_status_contract",
    f"""with o as ({_PROBE_SQL}), e(probe, expected) as (values {', '.join(map(str, _PROBES))})
        select probe, any_value(expected)::int as expected, count(status) as answers,
          coalesce(bool_and(status = expected), false) as passed from e left join o using (probe) group by probe""",
)
def _k7(spark, sf_dir):
    observed = spark.sql(_PROBE_SQL.replace("from events", "from {events}"), events=table(spark, sf_dir, "events"))
    expected = spark.createDataFrame(_PROBES, "probe string, expected int")
    return governance.status_contract(expected, observed)


@query(
    "k8_invalid_model_records",
    """select * from (select doc_id as model_version, case when toxic = 1 then 'checkpoint_sha256' when quality = 0 then 'split_registry_sha256'
           when lang = 'es' then 'final_parameters_json' end as reason from documents left join labels using (doc_id)) where reason is not null""",
)
def _k8_invalid(spark, sf_dir):
    """Each document is a model: a short digest, a missing digest or parameters that are no JSON, by its labels and language."""
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    digest = F.sha2("text", 256)
    records = joined.select(
        F.col("doc_id").alias("model_version"),
        F.when(F.col("toxic") == 1, F.md5("text")).otherwise(digest).alias("checkpoint_sha256"),
        F.when(F.col("quality") == 0, F.lit(None)).otherwise(digest).alias("split_registry_sha256"),
        F.when(F.col("lang") == "es", F.concat(F.lit("n_chars="), "n_chars"))
        .otherwise(F.to_json(F.struct("n_chars", "lang")))
        .alias("final_parameters_json"),
    )
    return governance.invalid_model_records(records)


@query(
    "k8_model_records",
    with_views(
        "runs reqlog",
        """, i as (select experiment as model_version, prompt_mode || ':' || experiment as model_name,
                  max(run_id) as e from runs where prompt_mode = 'F' group by 1, 2),
           t as (select experiment as model_version, avg(iou) as test_iou from runs where split = 'test' group by 1),
           v as (select experiment as model_version, avg(iou) as validation_iou from runs where split = 'validation' group by 1)
           select model_version, model_name, round(test_iou, 6) as test_iou, round(validation_iou, 6) as validation_iou,
             null::double as test_dice, 30::bigint as columns from i left join t using (model_version) left join v using (model_version)""",
    ),
)
def _k8(spark, sf_dir):
    r = runs(spark, sf_dir)
    identity = r.where("prompt_mode = 'F'").select(
        F.col("experiment").alias("model_version"), F.concat_ws(":", "prompt_mode", "experiment").alias("model_name")
    ).distinct()
    metrics = (
        r.where("split in ('test', 'validation')")
        .groupBy(F.col("experiment").alias("model_version"), F.concat("split", F.lit("_iou")).alias("metric"))
        .agg(F.avg("iou").alias("value"))
    )
    records = governance.model_records(identity, metrics)
    return r6(
        records.select(
            "model_version",
            "model_name",
            "test_iou",
            "validation_iou",
            "test_dice",
            F.lit(len(records.columns)).cast("bigint").alias("columns"),
        )
    )


@query(
    "k9_failure_summary",
    """select event_type as stage, case when value > 100 then 'Timeout' else '' end as error_type, count(*) as failures,
         epoch_us(min(ts))::bigint as first_us, epoch_us(max(ts))::bigint as last_us, count(*) as pending
       from events where event_type in ('error', 'view') group by 1, 2""",
)
def _k9(spark, sf_dir):
    from rasterledger.sources.sinks import failure_rows

    failed = table(spark, sf_dir, "events").where("event_type in ('error', 'view')").select(
        F.col("event_type").alias("stage"),
        F.col("ts").cast("timestamp").alias("timestamp_utc"),
        F.when(F.col("value") > 100, "Timeout").alias("error_type"),
    )
    summary = governance.failure_summary(failure_rows(failed))
    return summary.select(
        "stage",
        "error_type",
        "failures",
        F.unix_micros("first_seen").alias("first_us"),
        F.unix_micros("last_seen").alias("last_us"),
        "pending",
    )
