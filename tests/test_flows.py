"""Composed jobs on small inputs."""

import pytest
from pyspark.sql import functions as F

from runledger.operators.report import score_runs
from runledger.plans import flows
from runledger.plans.fixtures import params, runs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark):
    scored = score_runs(runs(spark, SF)).drop("scenario_type", "power_bin")
    return scored.withColumn("predicted_params", params())


def test_report_tables(results, tmp_path):
    spark, n = results.sparkSession, results.count()
    paths = flows.write_report_tables(results, str(tmp_path), replicates=200)
    tables = {p.rsplit("/", 1)[1]: spark.read.option("header", True).option("inferSchema", True).csv(p) for p in paths}
    assert len(tables) == 6
    assert tables["bootstrap_ci"].count() == 15 and tables["fdr_comparison"].count() == 15
    assert tables["bootstrap_ci"].where("ci_lower > success_rate or ci_upper < success_rate").count() == 0
    misses = results.where(~F.coalesce("validation_success_5", F.lit(False))).count()
    assert tables["failure_distribution"].count() == misses
    assert tables["pattern_success"].agg(F.sum("total_cases")).first()[0] == n
    assert [r.model for r in tables["percentiles"].orderBy("model").collect()] == ["100K", "10K", "1K"]


def test_closed_loop_stages(spark):
    cases = spark.createDataFrame([(i, 1.0, 1.2) for i in range(1, 5)], "case_id long, target_initial double, target_final double")
    good = "[1.0, 1.2, 180, 0.0, 0.0, 110, 5.0, 2.0]"
    texts = spark.createDataFrame([(1, good), (2, "no"), (3, good), (4, good)], "case_id long, text string")
    log = "TRANSIENT RESULTS\n-\n-\n1 0.0 0 1.0\n2 1.0 0 1.25\n3 2.0 0 1.21\nCPU time"
    logs = spark.createDataFrame([(1, log), (2, log), (4, "TRANSIENT RESULTS\n-\n-\nCPU time")], "case_id long, text string")
    got = {r.case_id: r for r in flows.score_closed_loop(cases, texts, logs).collect()}
    assert [got[i].stage for i in range(1, 5)] == ["scored", "parse_failure", "simulation_failure", "result_parse_failure"]
    assert (got[1].actual_initial, got[1].actual_final, got[1].actual_peak) == (1.0, 1.21, 1.25)
    assert (got[1].validation_success_1, got[1].validation_success_10, got[2].actual_final) == (True, True, None)
    assert got[1].predicted_params.b2_time == 5.0 and got[2].simulation_success is None
