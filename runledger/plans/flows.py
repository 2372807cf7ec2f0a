"""Whole jobs composed of the operators: scoring, the set of report tables, training text, gain scheduling, mixed data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.functions import classify as K
from runledger.functions import derive as D
from runledger.functions import text as X
from runledger.operators import joins as J
from runledger.operators import report as R
from runledger.operators import split as S
from runledger.operators import stats as T
from runledger.operators.report import normalize_results
from runledger.operators.scale import stage
from runledger.operators.stats import fit_gain_by_regime
from runledger.operators.windows import run_summary
from runledger.sources.readers import require_columns
from runledger.sources.runlog import run_log_points
from runledger.sources.writers import write_report_csv

COMMAND = D.COMMAND


def score_closed_loop(cases: DataFrame, texts: DataFrame, logs: DataFrame, min_numbers: int = 8) -> DataFrame:
    """Cases + generated texts + simulator logs -> result records.

    `cases` has case_id, target_initial, target_final; `texts` and `logs` have case_id and text. A case without a
    parsed text failed to parse, one without a log failed to simulate, one without data lines has no result.
    """
    commands = texts.select("case_id", X.as_command(X.parse_last6(F.col("text"), min_numbers)).alias("predicted_params"))
    summary = run_summary(run_log_points(logs, ["case_id"]), run="case_id", step="line")
    simulated = logs.select("case_id", F.lit(True).alias("_simulated"))
    powers = simulated.join(summary, "case_id", "left").select(
        "case_id", "_simulated", F.col("initial_power").alias("actual_initial"),
        F.col("final_power").alias("actual_final"), F.col("peak_power").alias("actual_peak"))
    joined = cases.join(commands, "case_id", "left").join(powers, "case_id", "left")
    parsed = F.col("predicted_params").isNotNull()
    ran = parsed & D.flag(F.col("_simulated"))
    stage, error = K.outcome_stage(parsed, ran, F.col("actual_final"))
    reached = {c: F.when(ran, F.col(c)) for c in ("actual_initial", "actual_final", "actual_peak")}
    staged = joined.withColumns({"parsing_success": parsed, "simulation_success": F.when(parsed, ran),
                                 "stage": stage, "error": error, **reached})
    miss = D.final_error(F.col("actual_final"), F.col("target_final"))
    return staged.withColumns({"final_error": miss, **D.success_columns(miss, F.col("target_final"))}).drop("_simulated")


def report_tables(results: DataFrame, replicates: int = 10_000) -> dict[str, DataFrame]:
    """The six report tables of a comparison, from result records labelled with `model`.

    Records are cleaned and classified once and kept as a narrow table: the reports read it several times, and the
    records usually come from JSON.
    """
    clean = normalize_results(results).select(
        "model", "case_id", "target_final", "actual_final", "final_error", "simulation_success", "power_bin",
        "scenario_type", *[f"validation_success_{t}" for t in K.TOLERANCES])
    runs = stage(clean, "reports")
    return {
        "bootstrap_ci": T.bootstrap_ci(runs, ["model"], replicates),
        "stratification": R.stratify(runs),
        "fdr_comparison": T.fdr_bh(T.chi2_pairwise(runs), "p_value", ["model_a", "model_b", "tolerance"]),
        "failure_distribution": R.failure_rows(runs),
        "pattern_success": R.pattern_success(runs),
        "percentiles": R.describe(runs, ["model"], "final_error"),
    }


def write_report_tables(results: DataFrame, folder: str, replicates: int = 10_000) -> list[str]:
    """Write every report table as CSV below `folder`; returns the paths."""
    paths = []
    for name, table in report_tables(results, replicates).items():
        paths.append(f"{folder}/{name}")
        write_report_csv(table, paths[-1])
    return paths


def training_text(runs: DataFrame, ids: list[str], seed: int = 42) -> DataFrame:
    """Run table -> scenario, 80/10/10 part, full text, masked prompt and learned completion."""
    scenario = K.pattern_by_time(F.col("b1_time"), F.col("b2_time"), none_label="none", missing_label=None)
    numbers = [F.col("initial_power"), X.plain_number(F.round("final_power", 5)), *[F.col(c) for c in COMMAND]]
    formatted = runs.select(*ids, scenario.alias("scenario"), X.to_number_list(numbers).alias("text"))
    parts = S.stratified_split3(formatted, ["scenario"], ids, seed)
    return parts.withColumns({"prompt": X.prompt_part(F.col("text"), 2), "completion": X.completion_part(F.col("text"), 2)})


def schedule_pending(samples: DataFrame, cases: DataFrame, done: DataFrame) -> DataFrame:
    """Calibrate one gain per regime and compute the command of every case that has no result yet."""
    fits = fit_gain_by_regime(J.assign_regime(samples, "power_delta"), "power_delta", "delta_step")
    return J.scheduled_command(J.pending(cases, done, ["case_id"]), fits)


def mixed_training_set(default: DataFrame, mirror: DataFrame, n: int, order: str, seed: int = 42) -> DataFrame:
    """Quota sample of the default runs plus the mirrored runs: new ids, shuffled positions, stratified parts.

    Ranking reads its input more than once, so each step's table is written before the next one, as subsets
    usually are.
    """
    needed = [order, "init_b1", "init_b2", *COMMAND]
    cmd = {c: F.col(c) for c in COMMAND}
    moved = K.pattern_by_motion(cmd, F.col("init_b1"), F.col("init_b2"), pos_tol=0.0)
    sampled = S.quota_sample(require_columns(default, needed).withColumn("pattern", moved), "pattern", n, [order], seed=seed)
    sampled = stage(sampled.select(*needed), "subset")
    columns = ["run_id", *needed]
    both = J.union_aligned(columns, S.rekey(sampled, "def_", order), S.rekey(require_columns(mirror, needed), "mir_", order))
    scenario = K.pattern_by_time(F.col("b1_time"), F.col("b2_time"), none_label="none", missing_label=None)
    keyed = stage(both.withColumn("strat", S.strat_key(F.col("init_b1"), scenario)), "combined")
    placed = stage(S.shuffle_position(keyed, ["run_id"], seed), "shuffled")
    return S.stratified_split3(placed, ["strat"], ["run_id"], seed)
