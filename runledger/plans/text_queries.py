"""Queries of the text, JSON and log functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from runledger.functions import text as X
from runledger.operators.joins import assign_regime
from runledger.operators.scale import new_path, spread
from runledger.operators.stats import fit_gain_by_regime
from runledger.plans.fixtures import (
    ALL_REGIMES_SQL, CALIB_SQL, COMMAND, FEW_SQL, FITS_SQL, GEN_TEXT_SQL, LOGS_SQL, PAIR_TEXT_SQL, REGIMES_SQL, calib, few_regimes, gen_text, logs, pair_text, params, query, r,
    rounded, runs, table, with_runs,
)
from runledger.sources.runlog import ANY_CPU_TIME, read_log_points, run_log_points, run_log_points_unskipped
from runledger.sources.writers import calibration_map, flatten_params, records_to_json

COMMAND_TEXT = "concat(b1_pos, ', ', b1_time, ', ', b1_speed, ', ', b2_pos, ', ', b2_time, ', ', b2_speed, ']')"


@query("txt_01_number_lists", with_runs(f"""
SELECT case_id, CASE WHEN parsing_success THEN concat('[', {COMMAND_TEXT}) END AS six,
  CASE WHEN parsing_success THEN concat('[', target_initial, ', ', round(target_final, 5), ', ', {COMMAND_TEXT}) END AS eight,
  CASE WHEN parsing_success THEN concat('[', init_b1, ', ', init_b2, ', ', target_initial, ', ', round(target_final, 5), ', ', {COMMAND_TEXT})
    END AS ten,
  concat('[', printf('%.6f', rho), ', ', printf('%.4f', dur), ']') AS pair,
  concat('[', printf('%.2f', p0), ', ', printf('%.2f', p1), ', ', printf('%.6f', rho), ', ', printf('%.4f', dur), ']') AS four
FROM (SELECT *, -1e-2 * target_final AS rho, 3e0 + (case_id % 296) / 8e0 AS dur, 24544e-2 AS p0, target_final * 1637e-1 AS p1
  FROM runs)"""))
def number_lists(spark, sf):
    """A missing command has no text."""
    df = runs(spark, sf)
    cmd = [F.col(c) for c in COMMAND]
    target = F.round("target_final", 5)
    rho, dur = -1e-2 * F.col("target_final"), 3.0 + (F.col("case_id") % 296) / 8.0
    p0, p1 = F.lit(245.44), F.col("target_final") * 163.7
    plain = lambda cols: X.to_number_list([X.plain_number(c) if i in (1, 3) else c for i, c in enumerate(cols)])
    return df.select(
        "case_id", X.to_number_list(cmd).alias("six"),
        plain([F.col("target_initial"), target, *cmd]).alias("eight"),
        X.to_number_list([F.col("init_b1"), F.col("init_b2"), F.col("target_initial"), X.plain_number(target), *cmd]).alias("ten"),
        X.to_number_list([rho, dur], [6, 4]).alias("pair"),
        X.to_number_list([p0, p1, rho, dur], [2, 2, 6, 4]).alias("four"))


def _prompt_sql(k: int) -> str:
    head = f"concat(array_to_string(list_slice(string_split(text, ','), 1, {k}), ','), ',')"
    return f"{head} AS prompt_{k}, substr(text, length({head}) + 1) AS completion_{k}"


@query("txt_02_prompt_completion", f"WITH {GEN_TEXT_SQL}\nSELECT case_id, {_prompt_sql(2)}, {_prompt_sql(4)} FROM gen_text")
def prompt_completion(spark, sf):
    t = F.col("text")
    return gen_text(spark, sf).select(
        "case_id", *[f(t, k).alias(f"{n}_{k}") for k in (2, 4)
                     for n, f in (("prompt", X.prompt_part), ("completion", X.completion_part))])


@query("txt_03_prompt", with_runs("""
SELECT case_id, concat('[', target_initial, ', ', round(target_final, 5), ',') AS two,
  concat('[', init_b1, ', ', init_b2, ', ', target_initial, ', ', round(target_final, 5), ',') AS four,
  concat('[', printf('%.2f', 24544e-2), ', ', printf('%.2f', target_final * 1637e-1), ',') AS level FROM runs"""))
def prompt(spark, sf):
    target = [F.col("target_initial"), F.round("target_final", 5)]
    return runs(spark, sf).select(
        "case_id", X.prompt(target).alias("two"), X.prompt([F.col("init_b1"), F.col("init_b2"), *target]).alias("four"),
        X.prompt([F.lit(245.44), F.col("target_final") * 163.7], [2, 2]).alias("level"))


FLOAT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def _number(token: str) -> str:
    return f"CASE WHEN regexp_matches(trim({token}), '{FLOAT}') THEN try_cast(trim({token}) AS DOUBLE) END"


def _log_number(token: str) -> str:
    return f"CASE WHEN regexp_matches({token}, '{FLOAT}|(?i)^[+-]?(inf|infinity|nan)$') THEN try_cast({token} AS DOUBLE) END"


def _last6_sql(pattern: str, least: int, source: str, key: str) -> str:
    cols = ", ".join(f"v[{i + 1}] AS {c}" for i, c in enumerate(COMMAND))
    return f"""
SELECT {key}, n, {cols} FROM (
  SELECT {key}, n, CASE WHEN n >= {least} AND len(list_filter(w, lambda x: x IS NULL)) = 0 THEN w END AS v FROM (
    SELECT {key}, len(tokens) AS n, list_transform(list_slice(tokens, -6, -1), lambda x: {_number('x')}) AS w
    FROM (SELECT {key}, regexp_extract_all(text, '{pattern}') AS tokens FROM {source})))"""


def _last6(df, key, values, pattern):
    n = F.size(F.regexp_extract_all("text", F.lit(pattern), 1)).cast("long")
    return df.select(key, n.alias("n"), X.as_command(values).alias("c")).select(key, "n", "c.*")


@query("txt_04_parse_last6", f"WITH {GEN_TEXT_SQL}" + _last6_sql(r"[\d.]+", 8, "gen_text", "case_id"))
def parse_last6(spark, sf):
    return _last6(gen_text(spark, sf), "case_id", X.parse_last6(F.col("text")), X.UNSIGNED_TOKEN)


@query("txt_04_parse_last6_documents", _last6_sql(r"[\d.]+", 10, "documents", "doc_id"))
def parse_last6_documents(spark, sf):
    return _last6(spread(table(spark, sf, "documents")), "doc_id", X.parse_last6(F.col("text"), 10), X.UNSIGNED_TOKEN)


@query("txt_05_parse_signed_last6", f"WITH {GEN_TEXT_SQL}" + _last6_sql(r"-?\d+\.?\d*", 8, "gen_text", "case_id"))
def parse_signed_last6(spark, sf):
    return _last6(gen_text(spark, sf), "case_id", X.parse_signed_last6(F.col("text")), X.SIGNED_TOKEN)


@query("txt_06_parse_bracket6", f"""WITH {GEN_TEXT_SQL}
SELECT case_id, {", ".join(f"v[{i + 1}] AS {c}" for i, c in enumerate(COMMAND))} FROM (
  SELECT case_id, CASE WHEN len(w) = 6 AND len(list_filter(w, lambda x: x IS NULL)) = 0 THEN w END AS v FROM (
    SELECT case_id, list_transform(string_split(string_split(string_split(t, '[')[-1], ']')[1], ','),
      lambda x: {_number('x')}) AS w
    FROM (SELECT case_id, CASE WHEN case_id % 2 = 0 THEN concat('Output: [', substr(text, strpos(text, ',') + 1)) ELSE text END AS t
      FROM gen_text)))""")
def parse_bracket6(spark, sf):
    t = F.col("text")
    shorter = F.concat(F.lit("Output: ["), F.substring(t, F.instr(t, ",") + 1, F.length(t)))
    text = F.when(F.col("case_id") % 2 == 0, shorter).otherwise(t)
    out = gen_text(spark, sf).select("case_id", X.as_command(X.parse_bracket6(text)).alias("c"))
    return out.select("case_id", "c.*")


def _pair_sql(first: str, second: str) -> str:
    return (f"CASE WHEN {_number(first)} < 0 AND {_number(second)} > 0 "
            f"THEN struct_pack(rho := {_number(first)}, dur := {_number(second)}) END")


@query("txt_07_parse_pair", f"""WITH {PAIR_TEXT_SQL}
SELECT case_id, v.rho AS reactivity, v.dur AS duration, loose_rho, loose_dur FROM (
  SELECT case_id, coalesce(CASE WHEN len(k) >= 4 THEN {_pair_sql('k[3]', 'k[4]')} END,
      CASE WHEN len(k) >= 2 THEN {_pair_sql('k[len(k) - 1]', 'k[len(k)]')} END) AS v,
    CASE WHEN len(j) >= 4 AND {_number('j[4]')} IS NOT NULL THEN {_number('j[3]')} END AS loose_rho,
    CASE WHEN len(j) >= 4 AND {_number('j[3]')} IS NOT NULL THEN {_number('j[4]')} END AS loose_dur
  FROM (SELECT case_id, regexp_extract_all(text, '[-+]?\\d*\\.?\\d+(?:[eE][-+]?\\d+)?') AS k,
      regexp_extract_all(text, '[-\\d.]+') AS j FROM pair_text))""")
def parse_pair(spark, sf):
    out = pair_text(spark, sf).select(
        "case_id", X.parse_pair_signed(F.col("text")).alias("p"), X.parse_pair_loose(F.col("text")).alias("l"))
    return out.select("case_id", "p.*", F.col("l.reactivity").alias("loose_rho"), F.col("l.duration").alias("loose_dur"))


def _format_sql(key: str, source: str) -> str:
    words = " ".join(f"WHEN contains(lower(text), '{w}') THEN 'field name: {w}'" for w in X.FIELD_WORDS)
    return f"""
SELECT {key}, CASE WHEN len(regexp_extract_all(text, '[\\d.]+')) < 6 THEN 'too few numbers'
  WHEN NOT contains(text, '[') THEN 'no bracket' {words} END AS problem FROM {source}"""


@query("txt_08_valid_format", f"WITH {GEN_TEXT_SQL}" + _format_sql("case_id", "gen_text"))
def valid_format(spark, sf):
    return gen_text(spark, sf).select("case_id", X.format_problem(F.col("text")).alias("problem"))


@query("txt_08_valid_format_documents", _format_sql("doc_id", "documents"))
def valid_format_documents(spark, sf):
    return spread(table(spark, sf, "documents")).select("doc_id", X.format_problem(F.col("text")).alias("problem"))


DECK = """initial {init_b1}. {init_b2}.
move bank 1 to {b1_pos} at {b1_time} with {b1_speed}
move bank 2 to {b2_pos} at {b2_time} with {b2_speed}
watch {monitor_window} then {monitor_window}
"""


@query("txt_09_render_deck", with_runs(f"""
SELECT case_id, {''.join(f"replace(" for _ in (*COMMAND, 1, 2, 3))}'{DECK}'
  {' '.join(f", '{{{c}}}', cast({c} AS VARCHAR))" for c in COMMAND)}, '{{monitor_window}}', cast(60 + case_id % 41 AS VARCHAR)),
  '{{init_b1}}', cast(init_b1 AS VARCHAR)), '{{init_b2}}', cast(init_b2 AS VARCHAR)) AS deck
FROM runs"""))
def render_deck(spark, sf):
    values = {c: F.col(c) for c in (*COMMAND, "init_b1", "init_b2")} | {"monitor_window": 60 + F.col("case_id") % 41}
    return runs(spark, sf).select("case_id", X.render_deck(DECK, values).alias("deck"))


def lines_sql(is_end: str = "starts_with(trim(s), 'CPU time breakdown')") -> str:
    return f"""WITH {LOGS_SQL},
lines AS (SELECT run_id, unnest(range(0, len(l))) AS line, unnest(l) AS s
  FROM (SELECT run_id, string_split(text, chr(10)) AS l FROM logs)),
marked AS (SELECT *, max(CASE WHEN contains(s, 'TRANSIENT RESULTS') THEN line END)
  OVER (PARTITION BY run_id ORDER BY line) AS header FROM lines),
ended AS (SELECT *, min(CASE WHEN line > header + 2 AND {is_end} THEN line END)
  OVER (PARTITION BY run_id) AS stop FROM marked),
tokens AS (SELECT *, list_filter(string_split(regexp_replace(trim(s), '\\s+', ' ', 'g'), ' '), lambda x: x <> '') AS k FROM ended),
numbers AS (SELECT *, {_log_number('k[2]')} AS t, {_log_number('k[4]')} AS power FROM tokens)
"""


LINES_SQL = lines_sql()
POINTS_SQL = """
SELECT run_id, line, t, power FROM numbers
WHERE line > header + 2 AND (stop IS NULL OR line < stop) AND t IS NOT NULL AND power IS NOT NULL"""


def _points(points):
    return points.withColumn("line", F.col("line").cast("long"))


@query("txt_10_parse_run_log", LINES_SQL + POINTS_SQL)
def parse_run_log(spark, sf):
    return _points(run_log_points(logs(spark, sf), ["run_id"]))


@query("txt_10_run_log_any_cpu_time", lines_sql("starts_with(trim(s), 'CPU time')") + POINTS_SQL)
def run_log_any_cpu_time(spark, sf):
    return _points(run_log_points(logs(spark, sf), ["run_id"], end=ANY_CPU_TIME))


@query("txt_10_run_log_end_anywhere", lines_sql("contains(s, 'time breakdown')") + POINTS_SQL)
def run_log_end_anywhere(spark, sf):
    return _points(run_log_points(logs(spark, sf), ["run_id"], end="time breakdown", end_anywhere=True))


@query("txt_10_run_log_files", """
SELECT concat('run=', run) AS run_id, line, k % 1000 + 5e-1 AS t, cast(concat('1.', k % 997) AS DOUBLE) AS power
FROM (SELECT o_orderkey AS k, o_orderkey % 4 AS run, 2 + row_number() OVER (PARTITION BY o_orderkey % 4 ORDER BY o_orderkey) AS line
  FROM orders) WHERE k % 10 <> 3""")
def run_log_files(spark, sf):
    """Four long logs in one file each, a line for every order, read in blocks by many tasks."""
    key = F.col("o_orderkey")
    text = F.when(key % 10 == 3, "no data here").otherwise(F.format_string("  %d   %d.5   0.001   1.%d   ok", key, key % 1000, key % 997))
    data = table(spark, sf, "orders").select((key % 4).alias("run"), key.cast("long").alias("seq"), text.alias("value"))
    around = F.array(*[F.struct(F.lit(n).cast("long").alias("seq"), F.lit(t).alias("value")) for n, t in (
        (-3, " TRANSIENT RESULTS"), (-2, "0 0.0 0 0.0"), (-1, ""), (1 << 60, " CPU time breakdown"), ((1 << 60) + 1, "9 9.0 9 9.0"))])
    every = data.union(spark.range(4).select("id", F.explode(around).alias("l")).select("id", "l.*"))
    path = new_path(spark, "logs")
    # the fixture itself: a log is one file, as a solver writes it
    every.repartition(4, "run").sortWithinPartitions("run", "seq").select("run", "value").write.partitionBy("run").text(path)
    return read_log_points(spark, f"{path}/*", by_folder=True)


FINITE = "CASE WHEN isfinite(power) THEN power END"


@query("txt_10_run_log_summary", LINES_SQL + f"""
SELECT run_id, arg_min_null({FINITE}, line) AS initial_power, arg_max_null({FINITE}, line) AS final_power, max({FINITE}) AS peak_power,
  count(*) AS points FROM numbers
WHERE line > header + 2 AND (stop IS NULL OR line < stop) AND power IS NOT NULL GROUP BY run_id""")
def run_log_summary(spark, sf):
    from runledger.operators.windows import run_summary

    return run_summary(run_log_points(logs(spark, sf), ["run_id"], power_only=True), step="line")


@query("txt_10_run_log_unskipped", LINES_SQL + """
SELECT run_id, line, power FROM numbers
WHERE line > header AND NOT contains(s, 'TRANSIENT RESULTS') AND NOT starts_with(trim(s), 'Time')
  AND NOT starts_with(trim(s), 'CPU') AND power IS NOT NULL""")
def run_log_unskipped(spark, sf):
    points = run_log_points_unskipped(logs(spark, sf), ["run_id"])
    return points.select("run_id", F.col("line").cast("long").alias("line"), "power")


@query("jsn_01_flatten_params", with_runs(
    "SELECT case_id, " + ", ".join(f"coalesce(cast({c} AS DOUBLE), 0e0) AS {c}" for c in COMMAND) + " FROM runs"))
def flatten(spark, sf):
    records = runs(spark, sf).select("case_id", params().alias("predicted_params"))
    return flatten_params(records).select("case_id", *COMMAND)


@query("jsn_02_records_to_json", with_runs("""
SELECT concat('{"case_id":', case_id, ',"model":"', model, '","init_b1":', init_b1, ',"parsing_success":',
  parsing_success, ',"b1_time":', coalesce(cast(b1_time AS VARCHAR), 'null'), '}') AS json FROM runs"""))
def to_json(spark, sf):
    return records_to_json(runs(spark, sf).select("case_id", "model", "init_b1", "parsing_success", "b1_time"))


def _record_sql(source: str) -> str:
    span = lambda c: f"CASE WHEN n_samples >= 2 THEN [{r(f'min_{c}')}, {r(f'max_{c}')}] END"
    return f"""WITH {source}, {REGIMES_SQL}, {FITS_SQL}, {ALL_REGIMES_SQL},
t AS (SELECT count(*) AS n_total_samples, {r('min(power_delta)')} AS x_min, {r('max(power_delta)')} AS x_max,
  min(delta_step) AS y_min, max(delta_step) AS y_max FROM samples),
spans AS (SELECT regime, min(delta_step) AS min_d, max(delta_step) AS max_d, min(power_delta) AS min_p, max(power_delta) AS max_p
  FROM samples GROUP BY regime),
borders(regime, lo, hi) AS (VALUES ('large_dec', -1e0, -3e-1), ('medium_dec', -3e-1, -1e-1), ('small_dec', -1e-1, 0e0),
  ('small_inc', 0e0, 1e-1), ('medium_inc', 1e-1, 3e-1), ('large_inc', 3e-1, 1e0))
SELECT a.*, lo, hi, cast({span('d')} AS VARCHAR) AS ds_range, cast({span('p')} AS VARCHAR) AS pd_range, t.*
FROM all_regimes a JOIN borders USING (regime) LEFT JOIN spans USING (regime), t"""


def _record(samples):
    """The record with its map opened again, so that every entry can be compared."""
    assigned = assign_regime(samples, "power_delta")
    record = calibration_map(fit_gain_by_regime(assigned, "power_delta", "delta_step"), assigned)
    ranges = [c for c in record.columns if c != "regimes"]
    flat = record.select(*ranges, F.explode("regimes").alias("regime", "fit")).select("regime", "fit.*", *ranges)
    shown = lambda c: F.transform(c, lambda v: F.round(v, 6) + 0.0).cast("string")
    return rounded(flat.withColumns({c: shown(c) for c in ("ds_range", "pd_range")}))


@query("jsn_03_calibration_map", _record_sql(CALIB_SQL))
def calibration(spark, sf):
    return _record(calib(spark, sf))


@query("jsn_03_calibration_few_regimes", _record_sql(FEW_SQL))
def calibration_few_regimes(spark, sf):
    return _record(few_regimes(spark, sf))


@query("jsn_03_calibration_samples", f"""WITH {CALIB_SQL}
SELECT delta_step, {r('power_delta', 9)} AS power_delta FROM calib""")
def calibration_samples(spark, sf):
    """Samples as JSON numbers beside the record, read back."""
    written = records_to_json(calib(spark, sf).select("delta_step", "power_delta"))
    back = written.select(F.from_json("json", "delta_step double, power_delta double").alias("s"))
    return rounded(back.select("s.*"), 9)


@query("txt_06_parse_bracket6_spaced", f"""WITH {GEN_TEXT_SQL}
SELECT case_id, {", ".join(f"v[{i + 1}] AS {c}" for i, c in enumerate(COMMAND))} FROM (
  SELECT case_id, CASE WHEN len(w) = 6 AND len(list_filter(w, lambda x: x IS NULL)) = 0 THEN w END AS v FROM (
    SELECT case_id, list_transform(string_split(string_split(string_split(t, '[')[-1], ']')[1], ','),
      lambda x: {_number('x')}) AS w
    FROM (SELECT case_id, CASE WHEN case_id % 2 = 0 THEN concat('Output: [', substr(text, strpos(text, ',') + 1)) ELSE text END AS t
      FROM gen_text)))""")
def parse_bracket6_spaced(spark, sf):
    """Line breaks and tabs around the numbers change nothing."""
    t = F.col("text")
    shorter = F.concat(F.lit("Output: ["), F.substring(t, F.instr(t, ",") + 1, F.length(t)))
    text = F.replace(F.when(F.col("case_id") % 2 == 0, shorter).otherwise(t), F.lit(","), F.lit("\n,\t "))
    out = gen_text(spark, sf).select("case_id", X.as_command(X.parse_bracket6(text)).alias("c"))
    return out.select("case_id", "c.*")
