"""Queries of joins, sets, reports and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from runledger.functions import classify as K
from runledger.operators import joins as J
from runledger.operators import report as R
from runledger.operators import windows as W
from runledger.operators.scale import stage
from runledger.plans.fixtures import (
    CALIB_SQL, COMMAND, GAINS_SQL, MAIN_PATTERNS_SQL, TRACE_SQL, WINDOWED_SQL, bin_sql, calib, params, query, r, regime_sql, rounded, runs, scored,
    table, trace, windowed, with_runs, with_scored,
)

REGIME = regime_sql("(target_final - target_initial)")
TOLS = (1, 2, 3, 5, 10)

# ---- joins and sets -------------------------------------------------------------------------


@query("jon_01_lookup_gain", f"WITH {GAINS_SQL.strip()}, " + with_runs(f"""
SELECT case_id, regime, "Kp" AS "Kp_used" FROM (SELECT case_id, {REGIME} AS regime FROM runs)
LEFT JOIN gains USING (regime)""").removeprefix("WITH "))
def lookup_gain(spark, sf):
    cases = runs(spark, sf).select("case_id", K.regime(F.col("target_initial"), F.col("target_final")).alias("regime"))
    return J.lookup_gain(cases)


@query("jon_01_lookup_fitted_gain", f"WITH {CALIB_SQL}, " + with_runs(f"""
SELECT case_id, regime, {r('g')} AS "Kp_used" FROM (SELECT case_id, {REGIME} AS regime FROM runs)
LEFT JOIN (SELECT {regime_sql('power_delta', False)} AS regime, abs(regr_slope(delta_step, power_delta)) AS g
  FROM calib WHERE abs(power_delta) > 1e-4 GROUP BY ALL) USING (regime)""").removeprefix("WITH "))
def lookup_fitted_gain(spark, sf):
    from runledger.operators.stats import fit_gain_by_regime

    fits = fit_gain_by_regime(J.assign_regime(calib(spark, sf), "power_delta"), "power_delta", "delta_step")
    cases = runs(spark, sf).select("case_id", K.regime(F.col("target_initial"), F.col("target_final")).alias("regime"))
    return rounded(J.lookup_gain(cases, fits))


@query("jon_02_assign_regime_range", f"""WITH {CALIB_SQL}
SELECT sample_id, {regime_sql('power_delta', False)} AS regime FROM calib WHERE power_delta >= -1 AND power_delta < 1""")
def assign_regime(spark, sf):
    return J.assign_regime(calib(spark, sf), "power_delta").select("sample_id", "regime")


@query("jon_02_assign_range_join", f"""WITH {CALIB_SQL}, ranges AS (
  SELECT s_suppkey AS range_id, (s_suppkey - 50) / 1e2 AS lo, (s_suppkey - 50) / 1e2 + 3e-2 AS hi FROM supplier)
SELECT sample_id, range_id FROM calib JOIN ranges ON power_delta >= lo AND power_delta < hi""")
def assign_range(spark, sf):
    lo = (F.col("s_suppkey") - 50) / 100.0
    ranges = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("range_id"), lo.alias("lo"), (lo + 3e-2).alias("hi"))
    return J.assign_range(calib(spark, sf), "power_delta", ranges, 0.02, ["sample_id"]).select("sample_id", "range_id")


@query("jon_03_pending", with_runs("SELECT case_id, model FROM runs WHERE NOT simulation_success"))
def pending(spark, sf):
    cases = runs(spark, sf)
    return J.pending(cases, cases.where("simulation_success"), ["case_id"]).select("case_id", "model")


@query("jon_04_bin_grid", with_scored("""
SELECT model, scenario_type, power_bin, coalesce(n, 0) AS n
FROM (SELECT * FROM (VALUES ('1K'), ('10K'), ('100K'), ('1M')) a(model),
  (VALUES ('single_b1'), ('single_b2'), ('simultaneous'), ('sequential')) b(scenario_type),
  (VALUES ('Small'), ('Medium'), ('Large')) c(power_bin)) g
LEFT JOIN (SELECT model, scenario_type, power_bin, count(*) AS n FROM scored GROUP BY ALL) USING (model, scenario_type, power_bin)"""))
def bin_grid(spark, sf):
    dims = {"model": ["1K", "10K", "100K", "1M"], "scenario_type": K.MAIN_PATTERNS, "power_bin": K.POWER_BINS}
    return J.bin_coverage(scored(spark, sf), dims)


@query("jon_05_cases_x_configs", with_runs("""
SELECT case_id, target_final, config, c.init_b1, c.init_b2 FROM runs,
  (VALUES ('default', 180, 100), ('mirror', 100, 180)) c(config, init_b1, init_b2)"""))
def cases_x_configs(spark, sf):
    return J.cases_x_configs(runs(spark, sf).select("case_id", "target_final"))


COUNTS_SQL = "counts AS (" + " UNION ALL ".join(
    f"SELECT model, {t} AS tolerance, count(*) AS total, count(*) FILTER (validation_success_{t}) AS successes "
    "FROM scored GROUP BY model" for t in TOLS) + ")"
PAIRS_SQL = """pairs AS (SELECT a.tolerance, a.model AS model_a, b.model AS model_b, a.successes AS successes_a,
  a.total AS total_a, b.successes AS successes_b, b.total AS total_b
  FROM counts a JOIN counts b ON a.tolerance = b.tolerance AND a.model < b.model)"""


@query("jon_06_model_pairs", with_scored("").rstrip() + f", {COUNTS_SQL}, {PAIRS_SQL} SELECT * FROM pairs")
def model_pairs(spark, sf):
    return J.model_pairs(R.band_counts(scored(spark, sf), ["model"]).drop("simulated"))


ERRORS = ", ".join(f"{r(f'abs(p.{c} - t.{c})')} AS {c}_error" for c in COMMAND)
TRUTH_SQL = """truth AS (SELECT case_id, 60 + case_id % 120 AS b1_pos, 2e0 + case_id % 11 AS b1_time, 1e0 AS b1_speed,
  70 + case_id % 90 AS b2_pos, 3e0 + case_id % 7 AS b2_time, 5e-1 AS b2_speed FROM runs)"""


def truth(spark, sf):
    key = F.col("case_id")
    return runs(spark, sf).select(
        "case_id", (60 + key % 120).alias("b1_pos"), (2.0 + key % 11).alias("b1_time"), F.lit(1.0).alias("b1_speed"),
        (70 + key % 90).alias("b2_pos"), (3.0 + key % 7).alias("b2_time"), F.lit(0.5).alias("b2_speed"))


@query("jon_07_pred_vs_truth", with_runs("").rstrip() + f""", {TRUTH_SQL}
SELECT p.case_id, {ERRORS} FROM runs p LEFT JOIN truth t USING (case_id)""")
def pred_vs_truth(spark, sf):
    out = J.pred_vs_truth(runs(spark, sf), truth(spark, sf))
    return rounded(out.select("case_id", *[F.col(f"{c}_error").cast("double") for c in COMMAND]))


MAIN_SQL = MAIN_PATTERNS_SQL


@query("jon_08_keep_classes", with_scored(f"SELECT case_id, scenario_type FROM scored WHERE {MAIN_SQL}"))
def keep_classes(spark, sf):
    return J.keep_classes(scored(spark, sf), "scenario_type", K.MAIN_PATTERNS).select("case_id", "scenario_type")


@query("set_01_union_aligned", with_runs("""
SELECT case_id, init_b1, init_b2, target_final FROM runs WHERE init_b1 = 180
UNION ALL SELECT case_id, init_b1, init_b2, target_final FROM runs WHERE init_b1 = 100"""))
def union_aligned(spark, sf):
    df = runs(spark, sf)
    return J.union_aligned(["case_id", "init_b1", "init_b2", "target_final"], df.where("init_b1 = 180"),
                           df.where("init_b1 = 100").select("target_final", "init_b2", "init_b1", "case_id"))


@query("set_02_distinct_sorted", with_runs("SELECT DISTINCT model FROM runs ORDER BY model"))
def distinct_sorted(spark, sf):
    return J.distinct_sorted(runs(spark, sf), "model")


@query("set_03_id_difference", "SELECT o_custkey FROM orders EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def id_difference(spark, sf):
    orders = table(spark, sf, "orders")
    return J.id_difference(orders, orders.where("o_orderstatus = 'F'"), "o_custkey")


# ---- reports --------------------------------------------------------------------------------


def _tolerance_sql(denom: str) -> str:
    return " UNION ALL ".join(f"""
SELECT model, {t} AS tolerance, count(*) FILTER (validation_success_{t}) AS successes, cast({denom} AS BIGINT) AS denominator,
  {r(f'count(*) FILTER (validation_success_{t}) / cast({denom} AS DOUBLE)')} AS success_rate
FROM scored GROUP BY model""" for t in TOLS)


@query("agg_01_success_by_tolerance", with_scored(_tolerance_sql("count(*)")))
def success_by_tolerance(spark, sf):
    return rounded(R.success_by_tolerance(scored(spark, sf), ["model"]))


@query("agg_01_success_of_simulated", with_scored(_tolerance_sql("count(*) FILTER (simulation_success)")))
def success_of_simulated(spark, sf):
    return rounded(R.success_by_tolerance(scored(spark, sf), ["model"], "simulated"))


@query("agg_01_success_of_fixed", with_scored(_tolerance_sql("2000")))
def success_of_fixed(spark, sf):
    return rounded(R.success_by_tolerance(scored(spark, sf), ["model"], 2000))


@query("agg_02_funnel", with_scored(f"""
SELECT model, total, parsed, simulated, valid, {r('parsed / total')} AS parsed_rate, {r('simulated / parsed')} AS simulated_rate,
  {r('valid / simulated')} AS valid_rate
FROM (SELECT model, count(*) AS total, count(*) FILTER (parsing_success) AS parsed,
    count(*) FILTER (simulation_success) AS simulated, count(*) FILTER (validation_success_5) AS valid
  FROM scored GROUP BY model)"""))
def funnel(spark, sf):
    return rounded(R.funnel(scored(spark, sf), ["model"]))


def _rate_sql(by: str, source: str = "scored") -> str:
    return f"""
SELECT {by}, count(*) AS n, count(*) FILTER (validation_success_5) AS successes,
  {r('count(*) FILTER (validation_success_5) / count(*)')} AS success_rate FROM {source} GROUP BY ALL"""


@query("agg_03_stratify", with_scored(_rate_sql("model, scenario_type, power_bin", f"scored WHERE {MAIN_SQL}")))
def stratify(spark, sf):
    return rounded(R.stratify(scored(spark, sf)))


@query("agg_03_stratify_pivot", with_scored("SELECT model, scenario_type, " + ", ".join(
    f'round(avg(CASE WHEN validation_success_5 THEN 1e0 ELSE 0e0 END) FILTER (power_bin = \'{b}\') * 1e2, 1) AS "{b}_rate_pct", '
    f"nullif(count(*) FILTER (power_bin = '{b}'), 0) AS \"{b}_n\"" for b in K.POWER_BINS)
    + f" FROM scored WHERE {MAIN_SQL} GROUP BY ALL"))
def stratify_pivot(spark, sf):
    return R.stratify_pivot(scored(spark, sf))


@query("agg_04_pattern_success", with_scored("""
SELECT model, scenario_type, round(count(*) FILTER (validation_success_5) / count(*) * 1e2, 1) AS success_rate,
  count(*) AS total_cases FROM scored GROUP BY ALL"""))
def pattern_success(spark, sf):
    return R.pattern_success(scored(spark, sf))


@query("agg_05_value_shares", with_scored(f"""
SELECT model, scenario_type, count(*) AS n, {r('count(*) / sum(count(*)) OVER (PARTITION BY model)')} AS share
FROM scored GROUP BY model, scenario_type"""))
def value_shares(spark, sf):
    return rounded(R.value_shares(scored(spark, sf), ["model"], "scenario_type"))


def _describe_sql(by: str, x: str) -> str:
    qs = ", ".join(f"{r(f'quantile_cont({x}, {q}e-2)')} AS p{q}" for q in (25, 50, 75, 95))
    return f"""
SELECT {by}, count(*) AS count, {r(f'avg({x})')} AS mean, {r(f'stddev_samp({x})')} AS std, {r(f'min({x})')} AS min,
  {r(f'max({x})')} AS max, {qs} FROM scored WHERE {x} IS NOT NULL GROUP BY ALL"""


@query("agg_06_describe", with_scored(_describe_sql("model, scenario_type", "final_error")))
def describe(spark, sf):
    return rounded(R.describe(scored(spark, sf), ["model", "scenario_type"], "final_error"))


@query("agg_07_error_summary", with_scored(f"""
SELECT model, count(*) AS n, {r('avg(final_error)')} AS mean, {r('max(final_error)')} AS max, {r('min(final_error)')} AS min,
  {r('stddev_pop(final_error)')} AS std_pop, {r('quantile_cont(final_error, 5e-1)')} AS median
FROM scored WHERE final_error IS NOT NULL GROUP BY model"""))
def error_summary(spark, sf):
    return rounded(R.error_summary(scored(spark, sf), ["model"]))


@query("agg_08_rank_percentile", with_scored(f"""
SELECT model, n, {r('max(CASE WHEN i = floor(95e-2 * n) THEN e END)')} AS p95, {r('max(CASE WHEN i = floor(99e-2 * n) THEN e END)')} AS p99
FROM (SELECT model, final_error AS e, row_number() OVER (PARTITION BY model ORDER BY final_error) - 1 AS i,
  count(*) OVER (PARTITION BY model) AS n FROM scored WHERE final_error IS NOT NULL) GROUP BY model, n"""))
def rank_percentile(spark, sf):
    return rounded(R.rank_percentile(scored(spark, sf), ["model"], "final_error"))


LONG_SQL = "errors AS (" + " UNION ALL ".join(
    f"SELECT p.case_id, scenario_type, '{c}' AS param, cast(abs(p.{c} - t.{c}) AS DOUBLE) AS error "
    "FROM scored p LEFT JOIN truth t USING (case_id)" for c in COMMAND) + ")"


def _errors(spark, sf):
    return J.pred_vs_truth(scored(spark, sf), truth(spark, sf)).withColumns(
        {f"{c}_error": F.col(f"{c}_error").cast("double") for c in COMMAND})


@query("agg_09_param_error_stats", with_scored("").rstrip() + f""", {TRUTH_SQL}, {LONG_SQL}
SELECT param, count(*) AS n, {r('avg(error)')} AS mae, {r('sqrt(avg(error * error))')} AS rmse,
  {r('quantile_cont(error, 5e-1)')} AS median FROM errors WHERE error IS NOT NULL GROUP BY param""")
def param_error_stats(spark, sf):
    return rounded(R.param_error_stats(_errors(spark, sf)))


@query("agg_10_param_mae_by_class", with_scored("").rstrip() + f""", {TRUTH_SQL}, {LONG_SQL}
SELECT scenario_type, param, count(*) AS n, {r('avg(error)')} AS mae FROM errors WHERE error IS NOT NULL GROUP BY ALL""")
def param_mae_by_class(spark, sf):
    return rounded(R.param_mae_by_class(_errors(spark, sf)))


@query("agg_11_failure_distribution", with_scored("").rstrip() + f""",
failed AS (SELECT *, abs(target_final - 1e0) AS delta_p FROM scored WHERE NOT validation_success_5),
stats AS (SELECT model, count(*) AS failures, avg(delta_p) AS mean_delta, quantile_cont(delta_p, 5e-1) AS median_delta,
  stddev_samp(delta_p) AS std_delta FROM failed GROUP BY model),
bins(power_bin) AS (VALUES ('Small'), ('Medium'), ('Large'))
SELECT model, failures, {r('mean_delta')} AS mean_delta, {r('median_delta')} AS median_delta, {r('std_delta')} AS std_delta,
  power_bin, coalesce(n, 0) AS n, {r('coalesce(n, 0) / failures * 1e2')} AS share_pct
FROM stats CROSS JOIN bins LEFT JOIN (SELECT model, power_bin, count(*) AS n FROM failed GROUP BY ALL) USING (model, power_bin)""")
def failure_distribution(spark, sf):
    return rounded(R.failure_distribution(scored(spark, sf)))


@query("agg_11_failure_rows", with_scored(f"""
SELECT model, case_id, 1e0 AS "P_initial", {r('target_final')} AS "P_target", {r('actual_final')} AS actual_final,
  {r('abs(target_final - 1e0)')} AS delta_p, power_bin, scenario_type, {r('final_error')} AS final_error
FROM scored WHERE NOT validation_success_5"""))
def failure_rows(spark, sf):
    return rounded(R.failure_rows(scored(spark, sf)))


WINDOW_BAND = """CASE WHEN w >= 60 AND w < 70 THEN '60-70' WHEN w >= 70 AND w < 80 THEN '70-80' WHEN w >= 80 AND w < 90 THEN
  '80-90' WHEN w >= 90 AND w <= 100 THEN '90-100' ELSE 'Outlier' END"""


@query("agg_12_success_by_band", with_scored("").rstrip() + WINDOWED_SQL + _rate_sql(
    "window_band", f"(SELECT *, {WINDOW_BAND.replace('w ', 'monitor_window ')} AS window_band FROM windowed WHERE simulation_success)"))
def success_by_band(spark, sf):
    df = windowed(spark, sf).withColumn("window_band", K.window_band(F.col("monitor_window")))
    return rounded(R.success_by_band(df))


@query("agg_13_multi_tol_by_band", with_scored("").rstrip() + f"""
, banded AS (SELECT *, CASE WHEN d < 1e-2 THEN 'Very Low (<1%)' WHEN d < 1e-1 THEN 'Low (1~10%)' WHEN d < 3e-1 THEN
  'Mid (10~30%)' WHEN d <= 5e-1 THEN 'High (30~50%)' ELSE 'Very High (>50%)' END AS delta_band
  FROM (SELECT *, abs(target_final - target_initial) / target_initial AS d FROM scored WHERE simulation_success))
SELECT delta_band, count(*) AS n, {", ".join(f"count(*) FILTER (validation_success_{t}) AS s{t}, {r(f'count(*) FILTER (validation_success_{t}) / count(*)')} AS rate_{t}" for t in (1, 3, 5))}
FROM banded WHERE delta_band IN ('Low (1~10%)', 'Mid (10~30%)', 'High (30~50%)') GROUP BY delta_band""")
def multi_tol_by_band(spark, sf):
    df = scored(spark, sf)
    return rounded(R.multi_tol_by_band(
        df.withColumn("delta_band", K.delta_band(F.col("target_initial"), F.col("target_final")))))


@query("agg_14_success_by_range", with_scored(_rate_sql(
    "model, range", f"(SELECT *, {bin_sql('target_final', '1001e-4', '3001e-4', '<')} AS range FROM scored)")))
def success_by_range(spark, sf):
    return rounded(R.success_by_range(scored(spark, sf), ["model"], "half_open"))


@query("agg_15_success_by_direction", with_scored(_rate_sql(
    "model, direction", """(SELECT *, CASE WHEN target_final > 1 THEN 'increase' WHEN target_final < 1 THEN 'decrease' END
  AS direction FROM scored) WHERE direction IS NOT NULL""")))
def success_by_direction(spark, sf):
    return rounded(R.success_by_direction(scored(spark, sf), ["model"]))


@query("agg_16_success_by_regime", f"WITH {GAINS_SQL.strip()}, " + with_scored(f"""
SELECT regime, regime_order, "Kp", count(*) AS n, count(*) FILTER (validation_success_5) AS successes,
  {r('count(*) FILTER (validation_success_5) / count(*)')} AS success_rate
FROM (SELECT *, {REGIME} AS regime FROM scored) JOIN gains USING (regime) GROUP BY ALL""").removeprefix("WITH "))
def success_by_regime(spark, sf):
    return rounded(R.success_by_regime(scored(spark, sf), J.SCHEDULED_GAINS))


@query("agg_17_severe_failures", with_scored("""
SELECT model, count(*) AS n, count(*) FILTER (final_error IS NOT NULL AND NOT validation_success_10) AS severe
FROM scored GROUP BY model"""))
def severe_failures(spark, sf):
    return R.severe_failures(scored(spark, sf), ["model"])


@query("agg_18_profile", with_runs(" UNION ALL ".join(f"""
SELECT '{c}' AS "column", count(*) AS rows, {r(f'min({c})')} AS min, {r(f'max({c})')} AS max, {r(f'avg({c})')} AS mean FROM runs"""
    for c in ("target_final", "actual_final", "b1_time"))))
def profile(spark, sf):
    return rounded(R.profile(runs(spark, sf), ["target_final", "actual_final", "b1_time"]))


MEASURES = [(f"pattern:{p}", f"scenario_type = '{p}'") for p in K.MAIN_PATTERNS]
MEASURES += [(f"within:{t}", f"validation_success_{t}") for t in (1, 5, 10)]


@query("agg_19_compare_configs", with_scored("").rstrip() + ", m AS (" + " UNION ALL ".join(f"""
SELECT '{n}' AS measure, count(*) FILTER (init_b1 = 180 AND {test}) / count(*) FILTER (init_b1 = 180) * 1e2 AS a,
  count(*) FILTER (init_b1 = 100 AND {test}) / count(*) FILTER (init_b1 = 100) * 1e2 AS b FROM scored""" for n, test in MEASURES)
    + f") SELECT measure, {r('a')} AS first_pct, {r('b')} AS second_pct, {r('b - a')} AS difference FROM m")
def compare_configs(spark, sf):
    df = scored(spark, sf).withColumn("config", F.when(F.col("init_b1") == 180, "default").otherwise("mirror"))
    return rounded(R.compare_configs(df, "config", "default", "mirror"))


@query("agg_19_summarize_configs", with_scored("").rstrip() + f""",
moved AS (SELECT *, coalesce(b1_speed > 0 AND abs(b1_pos - init_b1) > 5e-1, false) AS m1,
  coalesce(b2_speed > 0 AND abs(b2_pos - init_b2) > 5e-1, false) AS m2 FROM scored),
named AS (SELECT *, CASE WHEN NOT parsing_success THEN NULL WHEN NOT m1 AND NOT m2 THEN 'no_motion' WHEN NOT m2 THEN 'single_b1'
  WHEN NOT m1 THEN 'single_b2' WHEN abs(b1_time - b2_time) <= greatest(1e-9 * greatest(abs(b1_time), abs(b2_time)), 5e-2) THEN 'simultaneous'
  ELSE 'sequential' END AS pattern FROM moved)
SELECT CASE WHEN init_b1 = 180 THEN 'default' ELSE 'mirror' END AS config, count(*) AS n,
  {r('count(*) FILTER (parsing_success) / count(*) * 1e2')} AS parsed_pct,
  {r('count(*) FILTER (simulation_success) / count(*) * 1e2')} AS simulated_pct,
  {", ".join(f"{r(f'count(*) FILTER (validation_success_{t}) / count(*) * 1e2')} AS within_{t}_pct" for t in (1, 5, 10))},
  {", ".join(f"count(*) FILTER (pattern = '{p}') AS {p}" for p in ("single_b1", "single_b2", "simultaneous", "sequential", "no_motion"))},
  {r('avg(final_error) * 1e2')} AS mean_error_pct, {r('max(final_error) * 1e2')} AS max_error_pct,
  {r('quantile_cont(final_error * 1e2, 5e-1)')} AS median_error_pct FROM named GROUP BY ALL""")
def summarize_configs(spark, sf):
    df = scored(spark, sf).withColumns({
        "config": F.when(F.col("init_b1") == 180, "default").otherwise("mirror"), "predicted_params": params()})
    return rounded(R.summarize_configs(df, "config"))


@query("agg_20_range_per_regime", f"""WITH {CALIB_SQL}
SELECT {regime_sql('power_delta', False)} AS regime, count(*) AS n, {r('min(power_delta)')} AS x_min, {r('max(power_delta)')} AS x_max,
  min(delta_step) AS y_min, max(delta_step) AS y_max FROM calib WHERE power_delta >= -1 AND power_delta < 1 GROUP BY ALL""")
def range_per_regime(spark, sf):
    samples = J.assign_regime(calib(spark, sf), "power_delta")
    return rounded(R.range_per_regime(samples, "power_delta", "delta_step"))


@query("agg_20_upper_median", f"""WITH {CALIB_SQL}
SELECT grp, n, {r('min(x)')} AS min, {r('max(CASE WHEN i = n // 2 THEN x END)')} AS upper_median, {r('max(x)')} AS max
FROM (SELECT grp, power_delta AS x, row_number() OVER (PARTITION BY grp ORDER BY power_delta) - 1 AS i,
  count(*) OVER (PARTITION BY grp) AS n FROM calib) GROUP BY grp, n""")
def upper_median(spark, sf):
    return rounded(R.upper_median(calib(spark, sf), ["grp"], "power_delta"))


@query("agg_21_latest_per_source", """
SELECT user_id, event_id, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1""")
def latest_per_source(spark, sf):
    events = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return R.latest_per_source(events, ["user_id"], ["ts", "event_id"]).drop("ts")


# ---- windows --------------------------------------------------------------------------------


@query("win_01_running_success", with_scored(f"""
SELECT model, case_id, row_number() OVER w AS n_so_far,
  cast(sum(CASE WHEN validation_success_5 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS successes_so_far,
  {r('avg(CASE WHEN validation_success_5 THEN 1e0 ELSE 0e0 END) OVER w')} AS running_rate
FROM scored WINDOW w AS (PARTITION BY model ORDER BY case_id ROWS UNBOUNDED PRECEDING)"""))
def running_success(spark, sf):
    df = scored(spark, sf).select("model", "case_id", "validation_success_5")
    return rounded(W.running_success(df, ["model"]).drop("validation_success_5"))


RUNNING = ", ".join(
    f"cast(sum(CASE WHEN {c} THEN 1 ELSE 0 END) OVER w AS BIGINT) AS {n}" for c, n in (
        ("parsing_success", "parsed"), ("simulation_success", "simulated"), ("validation_success_1", "ok_1"),
        ("validation_success_2", "ok_2"), ("validation_success_5", "ok_5")))


@query("win_02_snapshots", with_scored(f"""
SELECT * FROM (SELECT model, case_id, row_number() OVER w AS n, {RUNNING}
  FROM scored WINDOW w AS (PARTITION BY model ORDER BY case_id ROWS UNBOUNDED PRECEDING)) WHERE n % 50 = 0"""))
def snapshots(spark, sf):
    return W.snapshots(scored(spark, sf), ["model"], 50)


@query("win_03_run_summary", f"""WITH {TRACE_SQL}
SELECT run_id, arg_min(power, step) AS initial_power, arg_max(power, step) AS final_power, max(power) AS peak_power,
  count(*) AS points FROM trace GROUP BY run_id""")
def run_summary(spark, sf):
    return W.run_summary(trace(spark, sf))


@query("win_04_at_nearest_time", f"""WITH {TRACE_SQL},
near AS (SELECT run_id, arg_min(step, {{'d': abs(t - 105e-1), 's': step}}) AS s,
  arg_min(power, {{'d': abs(t - 105e-1), 's': step}}) AS v, arg_max(power, step) AS f FROM trace GROUP BY run_id)
SELECT run_id, v AS initial_value, f AS final_value, min(power) AS min_value, max(power) AS max_value
FROM trace JOIN near USING (run_id) WHERE step >= s GROUP BY run_id, v, f""")
def at_nearest_time(spark, sf):
    # a trace is a stored table; here it is derived, so it is written before it is read twice
    return W.at_nearest_time(stage(trace(spark, sf), "trace"), 10.5, "t", "power")


@query("win_05_order_by_case", with_runs("SELECT case_id, model, target_final FROM runs ORDER BY case_id"))
def order_by_case(spark, sf):
    return W.order_by_case(runs(spark, sf).select("case_id", "model", "target_final"))


@query("win_06_head", with_scored("SELECT case_id, model, final_error FROM scored ORDER BY case_id LIMIT 5"))
def head(spark, sf):
    return W.head(scored(spark, sf).select("case_id", "model", "final_error"), 5, ["case_id"])


@query("win_07_failed_cases", """WITH """ + with_scored("").rstrip().removeprefix("WITH ") + f""",
failed AS (SELECT case_id, o_custkey AS suite, final_error FROM scored JOIN orders ON case_id = o_orderkey
  WHERE NOT validation_success_5)
SELECT suite, case_id, {r('final_error')} AS final_error, failures
FROM failed JOIN (SELECT suite, count(*) AS failures FROM failed GROUP BY suite HAVING count(*) <= 3) USING (suite)
WHERE final_error > 0""")
def failed_cases(spark, sf):
    owner = table(spark, sf, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_custkey").alias("suite"))
    df = scored(spark, sf).select("case_id", "validation_success_5", "final_error").join(owner, "case_id")
    return rounded(W.failed_cases(df, ["suite"], 3).select("suite", "case_id", "final_error", "failures"))
