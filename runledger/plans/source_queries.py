"""Queries of readers, writers and streams: the run table is written to the work folder and read back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger import schemas
from runledger.functions.derive import COMMAND
from runledger.functions.text import run_name
from runledger.operators.report import normalize_results, stratify
from runledger.operators.scale import new_path
from runledger.plans.fixtures import (
    MAIN_PATTERNS_SQL, params, query, r, rounded, runs, scored, with_runs, with_scored,
)
from runledger.sources import readers as R
from runledger.sources import writers as W
from runledger.streaming import results as Q

COMMANDS = ", ".join(COMMAND)
CHUNK = 5000


def run_table(spark, sf) -> DataFrame:
    df = R.failed_sims_filter(runs(spark, sf), "actual_final")
    return df.select(
        run_name("run_", F.col("case_id"), 4).alias("run_id"), *COMMAND, F.col("target_initial").alias("initial_power"),
        F.col("actual_final").alias("final_power"), F.greatest("actual_final", "target_initial").alias("peak_power"))


RUN_TABLE_SQL = f"""
SELECT concat('run_', lpad(cast(case_id AS VARCHAR), cast(greatest(4, length(cast(case_id AS VARCHAR))) AS INTEGER), '0')) AS run_id,
  {COMMANDS}, target_initial AS initial_power, actual_final AS final_power, greatest(actual_final, 1e0) AS peak_power
FROM runs WHERE actual_final IS NOT NULL"""


@query("src_01_runs_csv", with_runs(RUN_TABLE_SQL))
def runs_csv(spark, sf):
    path = new_path(spark, "runs-csv")
    W.write_report_csv(run_table(spark, sf), path)
    return R.read_runs_csv(spark, path)


def records(spark, sf) -> DataFrame:
    """Result records; the fields a failed stage never produced are absent (null)."""
    df = scored(spark, sf)
    flags = [F.when(F.col("simulation_success"), F.col(f"validation_success_{t}")).alias(f"validation_success_{t}")
             for t in (1, 2, 3, 5, 10)]
    return df.select(
        "case_id", "model", "init_b1", "init_b2", "target_initial", "target_final", "parsing_success",
        params().alias("predicted_params"), F.when(F.col("parsing_success"), F.col("simulation_success"))
        .alias("simulation_success"), "actual_final", "final_error", *flags)


RECORD_COLUMNS = ["case_id", "model", "init_b1", "init_b2", "target_initial", "target_final", "parsing_success", "b1_time",
                  "b2_pos", "simulation_success", "actual_final", "final_error", "validation_success_5"]
RECORDS_SQL = f"""
SELECT case_id, model, init_b1, init_b2, target_initial, {r('target_final', 9)} AS target_final, parsing_success, b1_time,
  cast(b2_pos AS DOUBLE) AS b2_pos, CASE WHEN parsing_success THEN simulation_success END AS simulation_success,
  {r('actual_final', 9)} AS actual_final, {r('final_error', 9)} AS final_error,
  CASE WHEN simulation_success THEN validation_success_5 END AS validation_success_5 FROM scored"""


def _shown(df: DataFrame) -> DataFrame:
    flat = df.withColumns({"b1_time": F.col("predicted_params.b1_time"), "b2_pos": F.col("predicted_params.b2_pos")})
    return rounded(flat.select(*RECORD_COLUMNS), 9)


def _arrays(spark, sf) -> DataFrame:
    """One array per document; a document holds at most CHUNK records, as case ids are unique."""
    chunk = F.floor(F.col("case_id") / CHUNK).cast("string")
    return records(spark, sf).groupBy(chunk.alias("doc")).agg(F.to_json(F.collect_list(F.struct("*"))).alias("value"))


@query("src_02_results_json", with_scored(RECORDS_SQL))
def results_json(spark, sf):
    path = new_path(spark, "arrays")
    W.write_documents(_arrays(spark, sf), "doc", "value", path)
    return _shown(R.read_results_json(spark, f"{path}/*"))


@query("src_03_results_enveloped", with_scored(RECORDS_SQL))
def results_enveloped(spark, sf):
    """The first record of every chunk is a file of its own; the other chunks are lists and envelopes in turn."""
    df = records(spark, sf)
    chunk = F.floor(F.col("case_id") / CHUNK)
    alone = F.col("case_id") % CHUNK == 0
    single = df.where(alone).select(F.concat(F.lit("one"), F.col("case_id").cast("string")).alias("doc"),
                                    F.to_json(F.struct(*df.columns)).alias("value"))
    rest = df.where(~alone).groupBy(chunk.alias("_c")).agg(F.collect_list(F.struct(*df.columns)).alias("results"))
    many = rest.select(F.concat(F.lit("many"), F.col("_c").cast("string")).alias("doc"),
                       F.when(F.col("_c") % 2 == 0, F.to_json(F.struct("results")))
                       .otherwise(F.to_json("results")).alias("value"))
    path = new_path(spark, "enveloped")
    W.write_documents(single.unionByName(many), "doc", "value", path)
    return _shown(R.read_results_enveloped(spark, f"{path}/*"))


def _write_lines(df: DataFrame, path: str, compression: str = "none") -> None:
    """JSON lines; every 50th record is followed by a blank and a cut-off line."""
    good = F.to_json(F.struct(*df.columns))
    damaged = F.when(F.col("case_id") % 50 == 0, F.array(good, F.lit(""), F.concat(
        F.lit('{"case_id": '), F.col("case_id").cast("string"), F.lit(', "mod')))).otherwise(F.array(good))
    df.select(F.explode(damaged).alias("value")).write.text(path, compression=compression)


@query("src_04_results_jsonl", with_scored(RECORDS_SQL))
def results_jsonl(spark, sf):
    path = new_path(spark, "lines")
    _write_lines(records(spark, sf), path)
    return _shown(R.read_results_jsonl(spark, path))


def _write_typed_lines(df: DataFrame, path: str) -> None:
    """As `_write_lines`; every 7th record has text in a number's place and every 11th is followed by a line that is no object.

    Every 13th ends with a field that is a bare NaN, Infinity or -Infinity, as diverged runs are written.
    """
    key = F.col("case_id")
    token = F.element_at(F.array(F.lit("NaN"), F.lit("Infinity"), F.lit("-Infinity")), (key % 3 + 1).cast("int"))
    good = F.to_json(F.struct(*df.columns))
    good = F.when(key % 13 == 0, F.concat(F.regexp_replace(good, "[}]$", ', "peak_rate": '), token, F.lit("}"))).otherwise(good)
    wrong = F.regexp_replace(good, '"target_final":[^,}]+', '"target_final":"high"')
    lines = F.array(F.when(key % 7 == 0, wrong).otherwise(good), F.when(key % 11 == 0, F.lit("[1, 2]")), F.when(
        key % 50 == 0, F.concat(F.lit('{"case_id": '), key.cast("string"), F.lit(', "mod'))))
    df.select(F.explode(F.filter(lines, lambda x: x.isNotNull())).alias("value")).write.text(path)


@query("src_04_results_jsonl_typed", with_scored(RECORDS_SQL.replace(
    "FROM scored", "FROM (SELECT * REPLACE (CASE WHEN case_id % 7 <> 0 THEN target_final END AS target_final) FROM scored)")))
def results_jsonl_typed(spark, sf):
    """A field of the wrong type is null; the line stays."""
    path = new_path(spark, "typed-lines")
    _write_typed_lines(records(spark, sf), path)
    return _shown(R.read_results_jsonl(spark, path))


@query("src_04_jsonl_counts", with_runs("""
SELECT count(*) AS good, count(*) FILTER (case_id % 7 = 0) AS damaged,
  count(*) FILTER (case_id % 11 = 0) + count(*) FILTER (case_id % 50 = 0) AS broken, count(*) AS n_all, count(*) AS n_one,
  count(*) AS n_wide FROM runs"""))
def jsonl_counts(spark, sf):
    """The same number of records whatever columns are read."""
    path = new_path(spark, "typed-lines")
    _write_typed_lines(records(spark, sf), path)
    read = R.read_results_jsonl(spark, path)
    one = read.select("model").agg(F.count("*").alias("n_one"))
    wide = read.select(F.struct(*read.columns).alias("s")).agg(F.count("s").alias("n_wide"))
    counted = read.agg(F.count("*").alias("n_all"))
    tables = [t.withColumn("_k", F.lit(0)) for t in (R.jsonl_health(spark, path), counted, one, wide)]
    return reduce(lambda a, b: a.join(b, "_k"), tables).drop("_k")


@query("src_04_jsonl_health", with_runs("""
SELECT count(*) AS good, cast(0 AS BIGINT) AS damaged, count(*) FILTER (case_id % 50 = 0) AS broken FROM runs"""))
def jsonl_health(spark, sf):
    path = new_path(spark, "lines")
    _write_lines(records(spark, sf), path)
    return R.jsonl_health(spark, path)


PREDICTION_INPUT_SQL = """p AS (SELECT *, case_id % 31 = 0 AS bad, CASE WHEN case_id % 31 = 0 OR case_id % 29 = 0 THEN NULL
  ELSE 60 + case_id % 41 END AS w, CASE WHEN case_id % 37 = 0 THEN NULL ELSE round(target_final, 4) END AS target FROM runs)"""


def _predictions(spark, sf, has_parsed: bool) -> DataFrame:
    key = F.col("case_id")
    raw = runs(spark, sf).select(
        run_name("val_", key, 4).alias("run_id"),
        F.when(key % 31 == 0, "wide").when(key % 29 == 0, "n/a").otherwise((60 + key % 41).cast("string"))
        .alias("monitor_window"),
        F.lit("1.0").alias("initial_power"),
        F.when(key % 37 == 0, F.lit(None)).otherwise(F.round("target_final", 4)).cast("string").alias("final_power"),
        F.concat(F.lit('said "['), key.cast("string"), F.lit(', 1]"')).alias("full_text"),
        *[F.col(c).cast("string").alias(c) for c in COMMAND],
        F.when(F.col("parsing_success"), "True").otherwise("False").alias("parsed"))
    path = new_path(spark, "predictions")
    out = raw if has_parsed else raw.drop("parsed")
    out.write.option("header", True).option("escape", '"').csv(path)
    return R.read_predictions_csv(spark, path, has_parsed)


def _predictions_sql(parsed: str) -> str:
    commands = ", ".join(f"cast({c} AS DOUBLE) AS {c}" for c in COMMAND)
    return with_runs("").rstrip() + f""", {PREDICTION_INPUT_SQL}
SELECT concat('val_', lpad(cast(case_id AS VARCHAR), cast(greatest(4, length(cast(case_id AS VARCHAR))) AS INTEGER), '0')) AS run_id,
  cast(w AS DOUBLE) AS monitor_window, 1e0 AS initial_power, target AS final_power, concat('said "[', case_id, ', 1]"') AS full_text,
  {commands}, NOT bad AND {parsed} AS parsed,
  CASE WHEN bad THEN 'Invalid Input' WHEN NOT ({parsed}) THEN 'Parsing Failed' END AS error FROM p"""


@query("src_05_predictions_csv", _predictions_sql("parsing_success"))
def predictions_csv(spark, sf):
    return _predictions(spark, sf, True)


@query("src_05_predictions_without_flag", _predictions_sql("b1_pos IS NOT NULL"))
def predictions_without_flag(spark, sf):
    return _predictions(spark, sf, False)


@query("src_06_union_labeled", with_scored(f"""
SELECT 'scheduled' AS model, case_id, {r('final_error')} AS final_error, validation_success_5, parsing_success,
  NULL AS validation_success_10 FROM scored WHERE model = '100K'
UNION ALL SELECT 'small', case_id, {r('final_error')}, validation_success_5, parsing_success, validation_success_10 FROM scored
  WHERE model = '1K'
UNION ALL SELECT 'gain', case_id, {r('final_error')}, validation_success_5, NULL, validation_success_10 FROM scored
  WHERE model = '10K' AND actual_final IS NOT NULL"""))
def union_labeled(spark, sf):
    df = scored(spark, sf)
    full = df.where("model = '100K'").select("case_id", "final_error", "validation_success_5", "parsing_success")
    reduced = R.failed_sims_filter(df.where("model = '10K'"), "actual_final").select(
        "case_id", "final_error", "validation_success_5", "validation_success_10")
    small = df.where("model = '1K'").select("case_id", "final_error", "validation_success_5", "parsing_success", "validation_success_10")
    return rounded(R.union_labeled({"scheduled": full, "gain": reduced, "missing": None, "small": small}))


FLAGS = ", ".join(
    f"sim AND validation_success_{t} AS validation_success_{t}, cast(sim AND validation_success_{t} AS INTEGER) AS is_success_{t}"
    for t in (1, 2, 3, 5, 10))


@query("src_07_normalize_results", with_scored(f"""
SELECT case_id, {r('t')} AS target_final, {FLAGS}, 1 - cast(sim AND validation_success_5 AS INTEGER) AS is_failure_5pct,
  {r('abs(t - 1)')} AS delta_p, CASE WHEN abs(t - 1e0) <= 1e-1 THEN 'Small' WHEN abs(t - 1e0) <= 3e-1 THEN 'Medium' ELSE 'Large' END
  AS power_bin, scenario_type
FROM (SELECT *, simulation_success AS sim, CASE WHEN case_id % 41 = 0 THEN 1e0 ELSE target_final END AS t FROM scored)"""))
def normalized(spark, sf):
    raw = records(spark, sf).withColumn("target_final", F.when(F.col("case_id") % 41 != 0, F.col("target_final")))
    out = normalize_results(raw)
    flags = [c for t in (1, 2, 3, 5, 10) for c in (f"validation_success_{t}", f"is_success_{t}")]
    return rounded(out.select("case_id", "target_final", *flags, "is_failure_5pct", "delta_p", "power_bin", "scenario_type"))


@query("src_08_require_columns", with_runs("SELECT init_b1, init_b2, count(*) AS n FROM runs GROUP BY ALL"))
def require_columns(spark, sf):
    needed = ["init_b1", "init_b2", *COMMAND]
    return R.require_columns(runs(spark, sf), needed).groupBy("init_b1", "init_b2").agg(F.count("*").alias("n"))


@query("src_09_write_report_csv", with_scored(f"""
SELECT model, scenario_type, power_bin, count(*) AS n, count(*) FILTER (validation_success_5) AS successes,
  {r('count(*) FILTER (validation_success_5) / count(*)')} AS success_rate
FROM scored WHERE {MAIN_PATTERNS_SQL} GROUP BY ALL"""))
def report_csv(spark, sf):
    report = rounded(stratify(scored(spark, sf)))
    path = new_path(spark, "report")
    W.write_report_csv(report, path)
    return spark.read.schema(report.schema).option("header", True).csv(path)


@query("src_10_write_results_json", with_scored(RECORDS_SQL))
def write_results(spark, sf):
    df = records(spark, sf)
    folder = new_path(spark, "results")
    W.write_results_json(df, folder, stamp="20250101_000000")
    return _shown(R.read_results_jsonl(spark, W.latest_results(spark, folder)))


@query("src_11_append_results", with_runs(RUN_TABLE_SQL))
def append_results(spark, sf):
    df, path = run_table(spark, sf), new_path(spark, "appended")
    first = F.col("final_power") < 1.0
    for _ in range(2):  # the retry of a job whose append had been done
        W.append_results(df.where(first), path, batch="1")
    W.append_results(df.where(~first), path, batch="2")
    return R.read_runs_csv(spark, path)


@query("src_12_completeness", with_runs("""
SELECT count(*) AS n, cast(1500 AS BIGINT) AS expected, count(*) >= 1500 AS complete FROM runs WHERE simulation_success"""))
def completeness(spark, sf):
    return R.completeness(runs(spark, sf).where("simulation_success"), 1500)


@query("src_13_failed_sims_filter", with_runs(f"""
SELECT case_id, model, {r('actual_final')} AS actual_final FROM runs WHERE actual_final IS NOT NULL"""))
def failed_sims(spark, sf):
    df = runs(spark, sf).select("case_id", "model", "actual_final")
    return rounded(R.failed_sims_filter(df, "actual_final"))


# ---- streams --------------------------------------------------------------------------------


def _drop_zone(spark, sf) -> str:
    """A folder of JSON lines as two runs of the same suite leave it, zipped: the second one repeats some cases."""
    folder = new_path(spark, "drop")
    df = records(spark, sf)
    _write_lines(df.where("case_id % 3 <> 0"), f"{folder}/first", "gzip")
    _write_lines(df.where("case_id % 3 = 0 OR case_id % 5 = 0"), f"{folder}/second", "gzip")
    return folder


TWICE = f"""(SELECT * FROM scored WHERE case_id % 3 <> 0 UNION ALL
  SELECT * FROM scored WHERE case_id % 3 = 0 OR case_id % 5 = 0)"""


def _ingest(spark, source: DataFrame, checkpoint: str, table: str) -> DataFrame:
    Q.append_stream(source, table, checkpoint).awaitTermination()
    return spark.read.schema(source.schema).parquet(table)


@query("str_01_stream_results", with_scored(RECORDS_SQL.replace("FROM scored", f"FROM {TWICE}")))
def stream_results(spark, sf):
    source = Q.stream_results(spark, f"{_drop_zone(spark, sf)}/*")
    return _shown(_ingest(spark, source, new_path(spark, "ckpt"), new_path(spark, "sink")))


@query("str_02_stream_dedup", with_scored(RECORDS_SQL))
def stream_dedup(spark, sf):
    source, table = Q.stream_results(spark, f"{_drop_zone(spark, sf)}/*"), new_path(spark, "sink")
    Q.append_new(source, ["model", "case_id"], table, new_path(spark, "ckpt")).awaitTermination()
    return _shown(spark.read.schema(source.schema).parquet(table))


@query("str_03_stream_running_success", with_scored(f"""
SELECT model, init_b1, count(*) AS n, count(*) FILTER (validation_success_5) AS ok_5,
  {r('count(*) FILTER (validation_success_5) / count(*)')} AS success_rate FROM {TWICE} GROUP BY ALL"""))
def stream_running_success(spark, sf):
    source = Q.stream_results(spark, f"{_drop_zone(spark, sf)}/*")
    by = ["model", "init_b1"]
    live = Q.stream_running_success(source, by)
    table = new_path(spark, "live")
    Q.snapshot_stream(live, by, table, new_path(spark, "ckpt")).awaitTermination()
    return rounded(Q.read_snapshot(spark, table, by, live.schema))


@query("str_04_stream_resume", with_scored(RECORDS_SQL))
def stream_resume(spark, sf):
    """The folder grows between two starts of the same query; the second start takes up the new files only."""
    folder, checkpoint, table = new_path(spark, "drop"), new_path(spark, "ckpt"), new_path(spark, "sink")
    df = records(spark, sf)
    _write_lines(df.where("case_id % 3 <> 0"), f"{folder}/first")
    _ingest(spark, Q.stream_results(spark, f"{folder}/*"), checkpoint, table)
    _write_lines(df.where("case_id % 3 = 0"), f"{folder}/second")
    return _shown(_ingest(spark, Q.stream_results(spark, f"{folder}/*"), checkpoint, table))


@query("str_05_stream_to_latest", with_scored(RECORDS_SQL))
def stream_to_latest(spark, sf):
    table = new_path(spark, "sink")
    source = Q.stream_results(spark, f"{_drop_zone(spark, sf)}/*")
    Q.append_new(source, ["model", "case_id"], table, new_path(spark, "ckpt")).awaitTermination()
    folder = new_path(spark, "results")
    Q.stream_to_latest(spark, table, schemas.RESULTS, folder, stamp="20250101_000000")
    return _shown(R.read_results_jsonl(spark, W.latest_results(spark, folder)))
