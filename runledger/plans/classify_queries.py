"""Queries of the classifiers and derived columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from runledger.functions import classify as K
from runledger.functions import derive as D
from runledger.operators.joins import scheduled_command
from runledger.operators.report import unpivot_errors
from runledger.plans.fixtures import (
    COMMAND, GAINS_SQL, PATTERN_SQL, bin_sql, query, r, regime_sql, rounded, runs, scored, table, with_runs,
    with_scored, trace, TRACE_SQL,
)


@query("cls_01_pattern_by_time", with_runs(f"""
SELECT case_id, {PATTERN_SQL} AS report_pattern,
  CASE WHEN b1_time IS NULL THEN NULL ELSE replace({PATTERN_SQL}, 'none_active', 'none') END AS training_pattern,
  nullif(nullif({PATTERN_SQL}, 'none_active'), 'parsing_failure') AS figure_pattern FROM runs"""))
def pattern_by_time(spark, sf):
    t1, t2 = F.col("b1_time"), F.col("b2_time")
    return runs(spark, sf).select(
        "case_id",
        K.pattern_by_time(t1, t2).alias("report_pattern"),
        K.pattern_by_time(t1, t2, none_label="none", missing_label=None).alias("training_pattern"),
        K.pattern_by_time(t1, t2, none_label=None, missing_label=None).alias("figure_pattern"))


MOTION_SQL = """CASE WHEN b1_speed IS NULL AND b2_speed IS NULL THEN NULL
  WHEN NOT (b1_speed > 0 AND abs(b1_pos - init_b1) > {tol}) AND NOT (b2_speed > 0 AND abs(b2_pos - init_b2) > {tol})
    THEN 'no_motion'
  WHEN NOT (b2_speed > 0 AND abs(b2_pos - init_b2) > {tol}) THEN 'single_b1'
  WHEN NOT (b1_speed > 0 AND abs(b1_pos - init_b1) > {tol}) THEN 'single_b2'
  WHEN abs(b1_time - b2_time) <= greatest(1e-9 * greatest(abs(b1_time), abs(b2_time)), 5e-2) THEN 'simultaneous'
  ELSE 'sequential' END"""


@query("cls_02_pattern_by_motion", with_runs(f"""
SELECT case_id, {MOTION_SQL.format(tol='5e-1')} AS analysis_pattern, {MOTION_SQL.format(tol='0')} AS sampling_pattern
FROM runs"""))
def pattern_by_motion(spark, sf):
    cmd = {c: F.col(c) for c in COMMAND}
    motion = lambda tol: K.pattern_by_motion(cmd, F.col("init_b1"), F.col("init_b2"), tol)
    return runs(spark, sf).select(
        "case_id", motion(0.5).alias("analysis_pattern"), motion(0.0).alias("sampling_pattern"))


@query("cls_03_power_bin", with_runs(f"""
SELECT case_id, {bin_sql('target_final')} AS closed,
  {bin_sql('target_final', '10001e-5', '30001e-5')} AS closed_eps,
  {bin_sql('target_final', '1001e-4', '3001e-4', '<')} AS half_open FROM runs"""))
def power_bin(spark, sf):
    t = F.col("target_final")
    return runs(spark, sf).select("case_id", *[K.power_bin(t, m).alias(m) for m in K.POWER_BIN_LIMITS])


@query("cls_04_regime", with_runs(f"""
SELECT case_id, {regime_sql('(target_final - target_initial)')} AS regime FROM runs"""))
def regime(spark, sf):
    return runs(spark, sf).select("case_id", K.regime(F.col("target_initial"), F.col("target_final")).alias("regime"))


@query("cls_05_window_bin", """
SELECT event_id, CASE WHEN w < 599e-1 OR w > 1001e-1 THEN 'nan' WHEN w <= 70 THEN '60_70' WHEN w <= 80 THEN '70_80'
  WHEN w <= 90 THEN '80_90' ELSE '90_100' END AS window_bin
FROM (SELECT event_id, 55e0 + (event_id % 500) / 1e1 AS w FROM events)""")
def window_bin(spark, sf):
    w = 55.0 + (F.col("event_id") % 500) / 10.0
    return table(spark, sf, "events").select("event_id", K.window_bin(w).alias("window_bin"))


@query("cls_06_window_band", """
SELECT event_id, CASE WHEN w IS NULL THEN 'Error' WHEN w >= 60 AND w < 70 THEN '60-70' WHEN w >= 70 AND w < 80 THEN '70-80'
  WHEN w >= 80 AND w < 90 THEN '80-90' WHEN w >= 90 AND w <= 100 THEN '90-100' ELSE 'Outlier' END AS window_band
FROM (SELECT event_id, CASE WHEN event_id % 37 <> 0 THEN 55e0 + (event_id % 500) / 1e1 END AS w FROM events)""")
def window_band(spark, sf):
    key = F.col("event_id")
    text = F.when(key % 37 == 0, "n/a").otherwise((55.0 + (key % 500) / 10.0).cast("string"))
    return table(spark, sf, "events").select("event_id", K.window_band(text).alias("window_band"))


@query("cls_07_delta_band", with_runs("""
SELECT case_id, CASE WHEN p0 = 0 THEN 'Error' WHEN d < 1e-2 THEN 'Very Low (<1%)' WHEN d < 1e-1 THEN 'Low (1~10%)'
  WHEN d < 3e-1 THEN 'Mid (10~30%)' WHEN d <= 5e-1 THEN 'High (30~50%)' ELSE 'Very High (>50%)' END AS delta_band
FROM (SELECT case_id, p0, CASE WHEN p0 <> 0 THEN abs(target_final - p0) / p0 END AS d
  FROM (SELECT *, CASE WHEN case_id % 43 = 0 THEN 0e0 WHEN case_id % 3 = 0 THEN 9e-1 ELSE 1e0 END AS p0 FROM runs))"""))
def delta_band(spark, sf):
    key = F.col("case_id")
    p0 = F.when(key % 43 == 0, 0.0).when(key % 3 == 0, 0.9).otherwise(1.0)
    return runs(spark, sf).select("case_id", K.delta_band(p0, F.col("target_final")).alias("delta_band"))


@query("cls_08_level_band", with_runs("""
SELECT case_id, CASE WHEN lvl >= 2209e-1 THEN 'small' WHEN lvl >= 1718e-1 THEN 'medium' ELSE 'large' END AS level_band
FROM (SELECT case_id, 12272e-2 + (target_final - 5e-1) * 12272e-2 AS lvl FROM runs)"""))
def level_band(spark, sf):
    level = 122.72 + (F.col("target_final") - 0.5) * 122.72
    return runs(spark, sf).select("case_id", K.level_band(level).alias("level_band"))


@query("cls_09_severity_status", with_runs("""
SELECT case_id, CASE WHEN rho > -9e-3 THEN 'normal' WHEN rho >= -15e-3 THEN 'risky' ELSE 'shutdown' END AS severity,
  CASE WHEN mw < 10 THEN 'SD' ELSE 'OP' END AS status
FROM (SELECT case_id, -1e-3 * (case_id % 21) AS rho, (case_id % 250) * 1e0 AS mw FROM runs)"""))
def severity_status(spark, sf):
    rho, mw = -1e-3 * (F.col("case_id") % 21), (F.col("case_id") % 250) * 1.0
    return runs(spark, sf).select("case_id", K.severity3(rho).alias("severity"), K.status2(mw).alias("status"))


@query("cls_10_direction", with_runs("""
SELECT case_id, CASE WHEN t > 1 THEN 'increase' WHEN t < 1 THEN 'decrease' END AS direction
FROM (SELECT case_id, CASE WHEN case_id % 50 = 0 THEN 1e0 ELSE target_final END AS t FROM runs)"""))
def direction(spark, sf):
    t = F.when(F.col("case_id") % 50 == 0, 1.0).otherwise(F.col("target_final"))
    return runs(spark, sf).select("case_id", K.direction(t).alias("direction"))


@query("cls_11_best_tier", with_scored("""
SELECT case_id, CASE WHEN final_error IS NULL THEN NULL WHEN validation_success_1 THEN '1' WHEN validation_success_2 THEN '2'
  WHEN validation_success_3 THEN '3' WHEN validation_success_5 THEN '5' WHEN validation_success_10 THEN '10'
  ELSE 'fail' END AS tier FROM scored"""))
def best_tier(spark, sf):
    return scored(spark, sf).select("case_id", K.best_tier(F.col("final_error"), F.col("target_final")).alias("tier"))


@query("cls_12_outcome_stage", with_runs("""
SELECT case_id, CASE WHEN NOT parsing_success THEN 'parse_failure' WHEN NOT simulation_success THEN 'simulation_failure'
    WHEN case_id % 83 = 0 THEN 'result_parse_failure' ELSE 'scored' END AS stage,
  CASE WHEN NOT parsing_success THEN 'Parsing failed' WHEN NOT simulation_success THEN
    CASE WHEN case_id % 2 = 0 THEN 'timeout' ELSE 'Simulation failed' END
    WHEN case_id % 83 = 0 THEN 'Result parsing failed' END AS error FROM runs"""))
def outcome_stage(spark, sf):
    key = F.col("case_id")
    actual = F.when(key % 83 != 0, F.col("actual_final"))
    stage, error = K.outcome_stage(F.col("parsing_success"), F.col("simulation_success"), actual,
                                   F.when(key % 2 == 0, "timeout"))
    return runs(spark, sf).select("case_id", stage.alias("stage"), error.alias("error"))


@query("cls_13_change_label", with_runs("""
SELECT case_id, concat(CASE WHEN target_final > target_initial THEN 'increase' ELSE 'decrease' END, ' ',
  printf('%.1f', abs((target_final - target_initial) / target_initial * 1e2)), '%') AS label FROM runs"""))
def change_label(spark, sf):
    return runs(spark, sf).select("case_id", K.change_label(F.col("target_initial"), F.col("target_final")).alias("label"))


# ---- derived columns ------------------------------------------------------------------------


@query("scl_01_score", with_scored(f"""
SELECT case_id, {r('final_error')} AS final_error, validation_success_1, validation_success_2, validation_success_3,
  validation_success_5, validation_success_10 FROM scored"""))
def score(spark, sf):
    df = runs(spark, sf)
    error = D.final_error(F.col("actual_final"), F.col("target_final"))
    out = df.withColumns({"final_error": error, **D.success_columns(error, F.col("target_final"))})
    return rounded(out.select("case_id", "final_error", *D.success_columns(error, F.col("target_final"))))


@query("scl_02_pct_error_fallback", with_scored(f"""
SELECT case_id, 'full' AS kind, {r('abs(actual_final - target_final) * 1e2')} AS pct_error FROM scored
UNION ALL SELECT case_id, 'reduced', {r('final_error * 1e2')} FROM scored"""))
def pct_error_fallback(spark, sf):
    """Reduced records have no powers, only the error."""
    full = D.with_pct_error(scored(spark, sf)).select("case_id", F.lit("full").alias("kind"), "pct_error")
    reduced = D.with_pct_error(scored(spark, sf).select("case_id", "final_error")).select("case_id", F.lit("reduced").alias("kind"), "pct_error")
    return rounded(full.union(reduced))


@query("scl_02_pct_error", with_runs(f"""
SELECT case_id, {r('d * 1e2')} AS absolute, {r('CASE WHEN t <> 0 THEN d / abs(t) END * 1e2')} AS relative,
  CASE WHEN d IS NULL THEN NULL WHEN t = 0 THEN 'inf' ELSE 'finite' END AS inf_kind,
  {r('CASE WHEN t > 0 THEN d / t * 1e2 WHEN d IS NOT NULL THEN 0e0 END')} AS positive,
  {r('d / CASE WHEN abs(t) > 1e-6 THEN abs(t) ELSE 1e0 END * 1e2')} AS floored
FROM (SELECT case_id, t, abs(actual_final - t) AS d
  FROM (SELECT *, CASE WHEN case_id % 101 = 0 THEN 0e0 ELSE target_final END AS t FROM runs))"""))
def pct_error(spark, sf):
    a = F.col("actual_final")
    t = F.when(F.col("case_id") % 101 == 0, 0.0).otherwise(F.col("target_final"))
    unbounded = D.pct_error(a, t, "inf")
    kind = F.when(unbounded.isNull(), F.lit(None)).when(unbounded == float("inf"), "inf").otherwise("finite")
    modes = [D.pct_error(a, t, m).alias(m) for m in ("absolute", "relative", "positive", "floored")]
    return rounded(runs(spark, sf).select("case_id", *modes, kind.alias("inf_kind")))


@query("scl_03_success_from", with_scored("""
SELECT case_id, cast(coalesce(abs(actual_final - target_final) * 1e2 <= 5, false) AS INTEGER) AS from_error,
  cast(coalesce(validation_success_5, false) AS INTEGER) AS from_flag FROM scored"""))
def success_from(spark, sf):
    pct = D.pct_error(F.col("actual_final"), F.col("target_final"), "absolute")
    return scored(spark, sf).select(
        "case_id", D.success_from_error(pct).alias("from_error"),
        D.success_from_flag(F.when(F.col("simulation_success"), F.col("validation_success_5"))).alias("from_flag"))


@query("scl_04_relative_change", with_runs(f"""
SELECT case_id, {r('(target_final - target_initial) / target_initial * 1e2')} AS change_pct FROM runs"""))
def relative_change(spark, sf):
    change = D.relative_change(F.col("target_initial"), F.col("target_final"))
    return rounded(runs(spark, sf).select("case_id", change.alias("change_pct")))


@query("scl_05_round_clip", """
SELECT event_id, cast(least(180, greatest(0, round_even(x, 0))) AS INTEGER) AS pos
FROM (SELECT event_id, (event_id % 800) / 4e0 - 10 AS x FROM events)""")
def round_clip(spark, sf):
    x = (F.col("event_id") % 800) / 4.0 - 10
    return table(spark, sf, "events").select("event_id", D.round_clip(x).alias("pos"))


COMMAND_SQL = f"""
SELECT case_id, {{extra}}{r('b1', 3)} AS b1_pos, CASE WHEN abs(b1 - 180) > 0 THEN {r('greatest(1e-1, abs(b1 - 180) / 2)', 3)}
    ELSE 0e0 END AS b1_time, CASE WHEN abs(b1 - 180) > 0 THEN 2e0 ELSE 0e0 END AS b1_speed,
  {r('b2', 3)} AS b2_pos, CASE WHEN abs(b2 - 100) > 0 THEN {r('greatest(1e-1, abs(b2 - 100) / 2)', 3)} ELSE 0e0 END AS b2_time,
  CASE WHEN abs(b2 - 100) > 0 THEN 2e0 ELSE 0e0 END AS b2_speed
FROM (SELECT *, least(180e0, greatest(0e0, w)) AS b2,
    least(180e0, greatest(0e0, 180e0 + CASE WHEN w > 180 THEN w - 180e0 WHEN w < 0 THEN w ELSE 0e0 END)) AS b1
  FROM ({{source}}))"""


@query("scl_06_single_gain_command", with_runs(COMMAND_SQL.format(
    extra="", source="SELECT case_id, 100e0 + (target_final - target_initial) * 260e0 AS w FROM runs")))
def single_gain_command(spark, sf):
    cmd = D.gain_command(F.col("target_initial"), F.col("target_final"), F.lit(260.0))
    return runs(spark, sf).select("case_id", *[c.alias(n) for n, c in cmd.items()])


@query("scl_07_scheduled_command", f"WITH {GAINS_SQL.strip()}, " + with_runs(COMMAND_SQL.format(
    extra='regime, "Kp_used", ',
    source=f"""SELECT x.case_id, x.regime, "Kp" AS "Kp_used", 100e0 + (x.target_final - x.target_initial) * "Kp" AS w
    FROM (SELECT *, {regime_sql('(target_final - target_initial)')} AS regime FROM runs) x JOIN gains USING (regime)"""
)).removeprefix("WITH "))
def scheduled(spark, sf):
    return scheduled_command(runs(spark, sf)).select("case_id", "regime", "Kp_used", *COMMAND)


@query("scl_08_log_floor", with_scored(f"""
SELECT case_id, {r('CASE WHEN e = 0 THEN 1e-3 ELSE e END', 9)} AS floored_3,
  {r('CASE WHEN e = 0 THEN 1e-4 ELSE e END', 9)} AS floored_4
FROM (SELECT case_id, CASE WHEN case_id % 19 = 0 THEN 0e0 ELSE final_error END AS e FROM scored)"""))
def log_floor(spark, sf):
    e = F.when(F.col("case_id") % 19 == 0, 0.0).otherwise(F.col("final_error"))
    out = scored(spark, sf).select("case_id", D.log_floor(e).alias("floored_3"), D.log_floor(e, 1e-4).alias("floored_4"))
    return rounded(out, 9)


@query("scl_09_valid_run", with_runs("""
SELECT case_id FROM runs WHERE case_id % 7 <> 0 AND case_id % 9 <> 0 AND NOT (case_id % 400 - 250e0 < -200)"""))
def valid_run(spark, sf):
    key = F.col("case_id")
    power = F.when(key % 7 == 0, float("nan")).when(key % 9 == 0, float("-inf")).otherwise(F.col("target_final"))
    return runs(spark, sf).where(D.valid_run(key % 400 - 250.0, F.lit(300.0), power)).select("case_id")


@query("scl_10_plausible", with_runs("""
SELECT case_id, coalesce(abs(actual_final - target_final) < 5e-3 AND abs(b1_time - b2_time) < 5e0, false) AS plausible
FROM runs"""))
def plausible(spark, sf):
    test = D.plausible(F.col("actual_final"), F.col("target_final"), F.col("b1_time"), F.col("b2_time"))
    return runs(spark, sf).select("case_id", test.alias("plausible"))


@query("scl_11_to_units", f"WITH {TRACE_SQL}" + f"""
SELECT run_id, step, {r('power * 250')} AS power_mw, {r('power + 300 - 27315e-2')} AS celsius FROM trace""")
def to_units(spark, sf):
    p = F.col("power")
    return rounded(trace(spark, sf).select(
        "run_id", "step", D.power_to_mw(p).alias("power_mw"), D.kelvin_to_celsius(p + 300).alias("celsius")))


@query("scl_12_ramp_profile", with_runs(f"""
SELECT case_id, cast(t AS INTEGER) AS t, {r('CASE WHEN t < 100 THEN 0e0 WHEN t < 100 + dur THEN -1e-2 / dur * (t - 100) ELSE -1e-2 END', 9)} AS v
FROM (SELECT case_id, 3e0 + case_id % 38 AS dur, cast(unnest(range(0, 301, 15)) AS DOUBLE) AS t FROM runs)"""))
def ramp_profile(spark, sf):
    """The points of every profile."""
    grid = F.explode(F.sequence(F.lit(0), F.lit(300), F.lit(15)))
    rows = runs(spark, sf).select("case_id", (3.0 + F.col("case_id") % 38).alias("dur"), grid.alias("t"))
    v = D.ramp_value(F.col("t").cast("double"), F.lit(100.0), F.col("dur"), F.lit(-1e-2))
    return rounded(rows.select("case_id", "t", v.alias("v")), 9)


TRUTH = {"b1_pos": 120.0, "b1_time": 5.0, "b1_speed": 1.0, "b2_pos": 110.0, "b2_time": 5.0, "b2_speed": 1.0}


@query("scl_13_param_errors", with_runs("\nUNION ALL\n".join(
    f"SELECT case_id, '{p}' AS param, {r(f'abs({p} - {v:.0f})')} AS error FROM runs" for p, v in TRUTH.items())))
def param_errors(spark, sf):
    errors = D.param_errors({p: F.col(p) for p in TRUTH}, {p: F.lit(v) for p, v in TRUTH.items()})
    return rounded(unpivot_errors(runs(spark, sf).withColumns(errors), ["case_id"]))
