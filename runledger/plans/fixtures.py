"""Run tables derived from the given warehouse tables, as DataFrames and as the SQL the oracle queries start with.

The given tables hold no control runs, so each order stands for one run, each line item for one calibration sample
and each event for one point of a time series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.operators.report import score_runs
from runledger.operators.scale import ordered_rank, spread, stage
from runledger.schemas import COMMAND_STRUCT

COMMAND = [f.name for f in COMMAND_STRUCT.fields]

# the columns in use; with a schema at hand no job reads file footers
TABLES = {
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_tax double, "
                "l_returnflag string",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double",
    "documents": "doc_id long, text string",
    "part": "p_partkey long",
    "supplier": "s_suppkey long",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def r(expr: str, digits: int = 6) -> str:
    return f"(round({expr}, {digits}) + 0e0)"


# ---- runs: one row per order ----------------------------------------------------------------


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets within 0.5..1.5, misses within 20 / 8 / 3 % by model, all four patterns, both initial configurations,
    failed parses (1 in 97) and failed simulations (1 in 89). Commands of failed parses are null."""
    base = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS case_id",
        "CASE o_orderstatus WHEN 'F' THEN '1K' WHEN 'O' THEN '10K' ELSE '100K' END AS model",
        "if(o_custkey % 2 = 0, 180, 100) AS init_b1", "if(o_custkey % 2 = 0, 100, 180) AS init_b2",
        "5e-1 + (o_totalprice - 1e3) / 499e3 AS target_final",
        "o_orderkey % 97 <> 0 AS parsing_success",
        "o_orderkey % 97 <> 0 AND o_orderkey % 89 <> 0 AS simulation_success",
        "o_custkey % 10 < 3 OR o_custkey % 10 >= 7 AS on1", "o_custkey % 10 >= 3 AS on2",
        "if(o_custkey % 10 = 9, 5e0, 2e0) + o_orderkey % 13 AS start2",
        "((o_orderkey * 7919 + o_custkey * 104729) % 2001 / 1e3 - 1e0)"
        " * CASE o_orderstatus WHEN 'F' THEN 20e-2 WHEN 'O' THEN 8e-2 ELSE 3e-2 END AS rel")
    command = {
        "b1_pos": "if(on1, int(60 + case_id % 121), init_b1)", "b1_time": "if(on1, 2e0 + case_id % 13, 0e0)",
        "b1_speed": "if(on1, 5e-1 + (case_id % 26) / 1e1, 0e0)",
        "b2_pos": "if(on2, int(70 + case_id % 91), init_b2)", "b2_time": "if(on2, start2, 0e0)",
        "b2_speed": "if(on2, 2e-1 + (case_id % 19) / 1e1, 0e0)",
    }
    return base.selectExpr(
        "case_id", "model", "init_b1", "init_b2", "1e0 AS target_initial", "target_final", "parsing_success",
        "simulation_success", *[f"CASE WHEN parsing_success THEN {c} END AS {n}" for n, c in command.items()],
        "CASE WHEN simulation_success THEN target_final * (1e0 + rel) END AS actual_final")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_runs(runs(spark, sf_dir))


def params(present: Column | None = None) -> Column:
    """The six command columns as the struct of a result record."""
    here = present if present is not None else F.col("parsing_success")
    return F.when(here, F.struct(*[F.col(c).cast("double").alias(c) for c in COMMAND]))


RUNS_SQL = """
runs AS (
  SELECT case_id, model, init_b1, init_b2, 1e0 AS target_initial, target_final, ok AS parsing_success,
    sim AS simulation_success,
    CASE WHEN ok THEN CASE WHEN on1 THEN cast(60 + case_id % 121 AS INTEGER) ELSE init_b1 END END AS b1_pos,
    CASE WHEN ok THEN CASE WHEN on1 THEN 2e0 + case_id % 13 ELSE 0e0 END END AS b1_time,
    CASE WHEN ok THEN CASE WHEN on1 THEN 5e-1 + (case_id % 26) / 1e1 ELSE 0e0 END END AS b1_speed,
    CASE WHEN ok THEN CASE WHEN on2 THEN cast(70 + case_id % 91 AS INTEGER) ELSE init_b2 END END AS b2_pos,
    CASE WHEN ok THEN CASE WHEN digit = 9 THEN 5e0 + case_id % 13 WHEN on2 THEN 2e0 + case_id % 13
         ELSE 0e0 END END AS b2_time,
    CASE WHEN ok THEN CASE WHEN on2 THEN 2e-1 + (case_id % 19) / 1e1 ELSE 0e0 END END AS b2_speed,
    CASE WHEN sim THEN target_final * (1e0 + rel) END AS actual_final
  FROM (
    SELECT o_orderkey AS case_id, o_custkey % 10 AS digit,
      CASE o_orderstatus WHEN 'F' THEN '1K' WHEN 'O' THEN '10K' ELSE '100K' END AS model,
      cast(CASE WHEN o_custkey % 2 = 0 THEN 180 ELSE 100 END AS INTEGER) AS init_b1,
      cast(CASE WHEN o_custkey % 2 = 0 THEN 100 ELSE 180 END AS INTEGER) AS init_b2,
      5e-1 + (o_totalprice - 1e3) / 499e3 AS target_final,
      o_orderkey % 97 <> 0 AS ok, o_orderkey % 97 <> 0 AND o_orderkey % 89 <> 0 AS sim,
      o_custkey % 10 < 3 OR o_custkey % 10 >= 7 AS on1, o_custkey % 10 >= 3 AS on2,
      ((o_orderkey * 7919 + o_custkey * 104729) % 2001 / 1e3 - 1e0)
        * CASE o_orderstatus WHEN 'F' THEN 20e-2 WHEN 'O' THEN 8e-2 ELSE 3e-2 END AS rel
    FROM orders) b)"""

PATTERN_SQL = """CASE WHEN b1_time IS NULL AND b2_time IS NULL THEN 'parsing_failure'
    WHEN b1_time > 0 AND b2_time <= 0 THEN 'single_b1' WHEN b2_time > 0 AND b1_time <= 0 THEN 'single_b2'
    WHEN b1_time > 0 AND b2_time > 0 THEN CASE WHEN abs(b1_time - b2_time) < 1e-2 THEN 'simultaneous'
      ELSE 'sequential' END ELSE 'none_active' END"""


def bin_sql(target: str, small: str = "1e-1", medium: str = "3e-1", op: str = "<=") -> str:
    return (f"CASE WHEN {target} IS NULL THEN 'Unknown' WHEN abs({target} - 1e0) {op} {small} THEN 'Small' "
            f"WHEN abs({target} - 1e0) {op} {medium} THEN 'Medium' ELSE 'Large' END")


SCORED_SQL = RUNS_SQL + ",\nscored AS (SELECT *, abs(actual_final - target_final) AS final_error, " + ", ".join(
    f"coalesce(abs(actual_final - target_final) <= abs(target_final) * {t}e-2, false) AS validation_success_{t}"
    for t in (1, 2, 3, 5, 10)) + f", {PATTERN_SQL} AS scenario_type, {bin_sql('target_final')} AS power_bin FROM runs)"


MAIN_PATTERNS_SQL = "scenario_type IN ('single_b1', 'single_b2', 'simultaneous', 'sequential')"


def with_runs(body: str) -> str:
    return f"WITH {RUNS_SQL}\n{body}"


def with_scored(body: str) -> str:
    return f"WITH {SCORED_SQL}\n{body}"


# ---- calib: one calibration sample per line item --------------------------------------------


def calib(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = F.col("l_quantity") - 25.5
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
        .alias("sample_id"),
        F.col("l_returnflag").alias("grp"), steps.alias("delta_step"),
        (steps * 2e-2 + (F.col("l_tax") - 4e-2)).alias("power_delta"))


CALIB_SQL = """
calib AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS sample_id, l_returnflag AS grp,
    l_quantity - 255e-1 AS delta_step, (l_quantity - 255e-1) * 2e-2 + (l_tax - 4e-2) AS power_delta
  FROM lineitem)"""

REGIME_CASE = """CASE WHEN {d} IS NULL THEN NULL WHEN {d} >= -1e0 AND {d} < -3e-1 THEN 'large_dec'
  WHEN {d} >= -3e-1 AND {d} < -1e-1 THEN 'medium_dec' WHEN {d} >= -1e-1 AND {d} < 0e0 THEN 'small_dec'
  WHEN {d} >= 0e0 AND {d} < 1e-1 THEN 'small_inc' WHEN {d} >= 1e-1 AND {d} < 3e-1 THEN 'medium_inc'
  WHEN {d} >= 3e-1 AND {d} < 1e0 THEN 'large_inc' {rest} END"""


def regime_sql(delta: str, fallback: bool = True) -> str:
    rest = f"WHEN {delta} >= 0 THEN 'large_inc' ELSE 'large_dec'" if fallback else ""
    return REGIME_CASE.format(d=delta, rest=rest)


REGIMES_SQL = f"""samples AS (SELECT *, {regime_sql('power_delta', False)} AS regime FROM calib
  WHERE power_delta >= -1 AND power_delta < 1)"""

FITS_SQL = f"""fits AS (SELECT regime, count(*) AS n_samples, count(*) FILTER (u) AS n_used,
    regr_slope(delta_step, power_delta) FILTER (u) AS slope, regr_r2(delta_step, power_delta) FILTER (u) AS r2,
    quantile_cont(abs(delta_step / power_delta), 5e-1) FILTER (u) AS med
  FROM (SELECT *, abs(power_delta) > 1e-4 AS u FROM samples) GROUP BY regime),
fitted AS (SELECT regime, n_samples, {r("CASE WHEN n_used < 2 THEN 355e-1 WHEN r2 >= 5e-1 AND abs(slope) > 0 THEN abs(slope) ELSE med END")} AS "Kp",
  {r('r2')} AS r2, CASE WHEN n_used < 2 THEN 'fallback' WHEN r2 >= 5e-1 AND abs(slope) > 0 THEN 'linear_regression'
    ELSE 'median_ratio (low R^2)' END AS method, 'ok' AS status FROM fits)"""

def few_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All samples, moved into one regime but for one sample of another; four regimes are empty.

    Calibration samples are a stored table; here they are derived, so they are written before they are read several times. The
    optimizer would otherwise put the comparison of the id and the sine into every condition on `power_delta`. The id, of which
    no reader asks, is not written.
    """
    first = F.col("sample_id") == table(spark, sf_dir, "lineitem").agg(F.min(F.concat_ws("-", *[
        F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]))).scalar()
    moved = F.when(first, -0.5).otherwise(0.2 + 0.0999 * F.sin("power_delta"))
    return stage(calib(spark, sf_dir).withColumn("power_delta", moved).drop("sample_id"), "few-regimes")


FEW_SQL = CALIB_SQL.replace("calib AS", "wide AS") + """,
calib AS (SELECT * REPLACE (CASE WHEN sample_id = (SELECT min(sample_id) FROM wide) THEN -5e-1
  ELSE 2e-1 + 999e-4 * sin(power_delta) END AS power_delta) FROM wide)"""

#: Rows of `fitted` for regimes that have no sample or one.
ALL_REGIMES_SQL = """all_regimes AS (SELECT regime, coalesce(n_samples, 0) AS n_samples,
    CASE WHEN coalesce(n_samples, 0) < 2 THEN 355e-1 ELSE "Kp" END AS "Kp", CASE WHEN coalesce(n_samples, 0) < 2 THEN 0e0 ELSE r2 END AS r2,
    CASE WHEN coalesce(n_samples, 0) < 2 THEN 'fallback' ELSE method END AS method,
    CASE WHEN coalesce(n_samples, 0) < 2 THEN 'fallback (insufficient samples)' ELSE status END AS status
  FROM (VALUES ('large_dec'), ('medium_dec'), ('small_dec'), ('small_inc'), ('medium_inc'), ('large_inc')) v(regime)
  LEFT JOIN fitted USING (regime))"""

GAINS_SQL = """
gains(regime, regime_order, "Kp") AS (VALUES ('large_dec', 0, 945e-1), ('medium_dec', 1, 4576e-2),
  ('small_dec', 2, 3123e-2), ('small_inc', 3, 25e0), ('medium_inc', 4, 2335e-2), ('large_inc', 5, 1992e-2))"""


# ---- trace: one time series per user --------------------------------------------------------


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps numbered from 0 in time order; one point per second. Numbered by user and minute, so that a user
    with a large share of the events is not one task."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    ts = F.col("ts")  # without time zone: the parts order like the value in any session
    minute = (F.unix_date(ts.cast("date")) * 24 + F.hour(ts)) * 60 + F.minute(ts)
    ranked = ordered_rank(events, ["user_id"], minute, ["ts", "event_id"], "_rank")
    return ranked.select(F.col("user_id").alias("run_id"), (F.col("_rank") - 1).alias("step"),
                         (F.col("_rank") - 1).cast("double").alias("t"), F.col("value").alias("power"))


TRACE_SQL = """
trace AS (
  SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step,
    cast(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS DOUBLE) AS t, value AS power
  FROM events)"""


# ---- generated text -------------------------------------------------------------------------


def gen_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    s = lambda c: c.cast("string")
    text = F.concat(
        F.lit("[1.0, "), s(key % 2), F.lit("."), s(key % 97), F.lit(", "), s(60 + key % 121), F.lit(", "),
        s(cust % 13), F.lit(".5, 0."), s(key % 10), F.lit(", 100, "),
        F.when(key % 7 == 0, "1.2.3").when(key % 11 == 0, "-4.5").otherwise("0.0"),
        F.when(key % 5 == 0, "").otherwise(", 0.0]"))
    return table(spark, sf_dir, "orders").select(key.alias("case_id"), text.alias("text"))


GEN_TEXT_SQL = """
gen_text AS (
  SELECT o_orderkey AS case_id, concat('[1.0, ', o_orderkey % 2, '.', o_orderkey % 97, ', ', 60 + o_orderkey % 121,
    ', ', o_custkey % 13, '.5, 0.', o_orderkey % 10, ', 100, ',
    CASE WHEN o_orderkey % 7 = 0 THEN '1.2.3' WHEN o_orderkey % 11 = 0 THEN '-4.5' ELSE '0.0' END,
    CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE ', 0.0]' END) AS text
  FROM orders)"""


def pair_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-number texts with exponents, wrong signs and truncated lists."""
    key = F.col("o_orderkey")
    s = lambda c: c.cast("string")
    text = F.concat(
        F.lit("[245.44, "), s(120 + key % 120), F.lit("."), s(key % 10), F.lit(", "),
        F.when(key % 6 == 0, "-2.5e-3").when(key % 6 == 1, "0.004").otherwise(F.concat(F.lit("-0.00"), s(1 + key % 8))),
        F.when(key % 9 == 0, "").otherwise(F.concat(F.lit(", "), s(3 + key % 37), F.lit(".5"))),
        F.when(key % 12 == 1, ", -0.001, 7.5").otherwise(""), F.lit("]"))
    return table(spark, sf_dir, "orders").select(key.alias("case_id"), text.alias("text"))


PAIR_TEXT_SQL = """
pair_text AS (
  SELECT o_orderkey AS case_id, concat('[245.44, ', 120 + o_orderkey % 120, '.', o_orderkey % 10, ', ',
    CASE WHEN o_orderkey % 6 = 0 THEN '-2.5e-3' WHEN o_orderkey % 6 = 1 THEN '0.004'
      ELSE concat('-0.00', 1 + o_orderkey % 8) END,
    CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE concat(', ', 3 + o_orderkey % 37, '.5') END,
    CASE WHEN o_orderkey % 12 = 1 THEN ', -0.001, 7.5' ELSE '' END, ']') AS text
  FROM orders)"""


# ---- run logs: one text per order -----------------------------------------------------------


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Solver logs of 3..9 data lines with broken lines, powers that are no finite number (some at the end of the run), a note on the
    CPU time between data lines, a second results header and text after the end."""
    key = F.col("o_orderkey")
    s = lambda c: c.cast("string")

    def line(i):
        power = F.when((key % 17 == 0) & (i == 2 + key % 7), "NaN").when((key % 19 == 0) & (i == 1), "Infinity").otherwise(
            F.concat(F.lit("1."), s((key * 31 + i * 17) % 1000)))
        good = F.concat(F.lit("  "), s(i), F.lit("   "), s(i), F.lit("."), s(key % 10), F.lit("   0.001   "), power, F.lit("   ok"))
        note = F.when((key % 3 == 0) & (i == 2), "\n CPU time so far").otherwise("")
        return F.concat(F.when((i + key) % 5 == 4, F.concat(s(i), F.lit(" x 2.0 y"))).otherwise(good), note)

    body = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), 2 + key % 7), line), "\n")
    again = F.when(key % 11 == 0, "\n TRANSIENT RESULTS\n 9 9.0 9.0 9.0\n 9 9.5 9.0 9.5\n 10 10.0 0.0 1.25").otherwise("")
    end = F.when(key % 13 == 0, "").otherwise("\n CPU time breakdown\n 99 99.0 0.0 99.0")
    text = F.concat(F.lit("1 2.0 3.0 4.0\n CPU time so far\n TRANSIENT RESULTS\n ------\n Step Time Rho Power\n"),
                    body, again, end)
    return spread(table(spark, sf_dir, "orders").select("o_orderkey")).select(key.alias("run_id"), text.alias("text"))


LOGS_SQL = """
logs AS (
  SELECT o_orderkey AS run_id, concat('1 2.0 3.0 4.0', chr(10), ' CPU time so far', chr(10), ' TRANSIENT RESULTS', chr(10),
    ' ------', chr(10), ' Step Time Rho Power', chr(10),
    array_to_string(list_transform(range(0, 3 + o_orderkey % 7), lambda i: concat(CASE WHEN (i + o_orderkey) % 5 = 4
      THEN concat(i, ' x 2.0 y')
      ELSE concat('  ', i, '   ', i, '.', o_orderkey % 10, '   0.001   ', CASE WHEN o_orderkey % 17 = 0 AND i = 2 + o_orderkey % 7 THEN 'NaN'
        WHEN o_orderkey % 19 = 0 AND i = 1 THEN 'Infinity' ELSE concat('1.', (o_orderkey * 31 + i * 17) % 1000) END, '   ok')
      END, CASE WHEN o_orderkey % 3 = 0 AND i = 2 THEN concat(chr(10), ' CPU time so far') ELSE '' END)), chr(10)),
    CASE WHEN o_orderkey % 11 = 0 THEN concat(chr(10), ' TRANSIENT RESULTS', chr(10), ' 9 9.0 9.0 9.0', chr(10),
      ' 9 9.5 9.0 9.5', chr(10), ' 10 10.0 0.0 1.25') ELSE '' END,
    CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE concat(chr(10), ' CPU time breakdown', chr(10), ' 99 99.0 0.0 99.0') END)
    AS text
  FROM orders)"""


# ---- result records with monitoring windows -------------------------------------------------


def windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).withColumn("monitor_window", 55.0 + (F.col("case_id") % 500) / 10.0)


WINDOWED_SQL = ",\nwindowed AS (SELECT *, 55e0 + (case_id % 500) / 1e1 AS monitor_window FROM scored)"


# ---- the registry of queries ----------------------------------------------------------------

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query function (spark, sf_dir) -> DataFrame and the SQL that must give the same rows."""
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double: two engines add floats in different orders."""
    doubles = [n for n, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.round(F.col(c), digits) for c in doubles}) if doubles else df
