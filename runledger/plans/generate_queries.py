"""Queries of the generators. The id tables are the keys of the given tables, so the output grows with them."""

from __future__ import annotations

from pyspark.sql import functions as F

from runledger.functions.hashing import add_draws
from runledger.operators import generate as G
from runledger.operators.scale import spread
from runledger.plans.fixtures import query, r, rounded, table


def ids(spark, sf):
    return spread(table(spark, sf, "orders").select(F.col("o_orderkey").alias("id")))


IDS = "ids AS (SELECT o_orderkey AS id FROM orders)"


def u(tag: str, names: list[str], name: str, key: str = "id", seed: str = "42") -> str:
    k = names.index(name)
    return f"(cast('0x' || substr(md5('{seed}:{tag}{k // 4}:' || {key}), {k % 4 * 8 + 1}, 8) AS UBIGINT) / 4294967296e0)"


def real(x: str, lo, hi, digits: int | None = None) -> str:
    """lo + x * (hi - lo) in doubles; the ends are numbers or SQL."""
    e = lambda v: f"{float(v)!r}e0" if not isinstance(v, str) else v
    out = f"({e(lo)} + {x} * ({e(hi)} - {e(lo)}))"
    return out if digits is None else f"round({out}, {digits})"


def integer(x: str, lo, hi) -> str:
    return f"cast({lo} + floor({x} * ({hi} - {lo} + 1)) AS INTEGER)"


def _mixture_sql(mirror: bool) -> str:
    roles = {"b1": "fine", "b2": "coarse"} if mirror else {"b1": "coarse", "b2": "fine"}
    d = lambda name: u("mix", G.MIXTURE_DRAWS, name)
    fam = lambda pick, tail="": "(CASE family " + " ".join(f"WHEN '{f}' THEN {pick(f)}{tail}" for f in G.FAMILY_SHARES) + " END)"
    first = real(d("start"), fam(lambda f: G.MIXTURE_TIMES[f][0], "e0"), fam(lambda f: G.MIXTURE_TIMES[f][1], "e0"), 1)
    cols = []
    for bank, role in roles.items():
        start = 180 if role == "coarse" else 100
        end = lambda k, tail="", role=role: fam(lambda f: G.MIXTURE_RANGES[f][role][k], tail)
        moves = f"family <> 'single' OR lone = '{bank}'"
        gap = f" + CASE WHEN family = 'sequential' THEN {real(d('gap'), 3, 8, 1)} ELSE 0 END" if role == "coarse" else ""
        cols += [f"CASE WHEN {moves} THEN {integer(d(role + '_pos'), end(0), end(1))} ELSE {start} END AS {bank}_pos",
                 f"{r(f'CASE WHEN {moves} THEN first{gap} ELSE 0e0 END')} AS {bank}_time",
                 f"{r(f'CASE WHEN {moves} THEN ' + real(d(role + '_speed'), end(2, 'e0'), end(3, 'e0'), 1) + ' ELSE 0e0 END')} AS {bank}_speed"]
    return f"""WITH {IDS},
families AS (SELECT id, CASE WHEN {d('family')} < 6e-1 THEN 'single' WHEN {d('family')} < {0.6 + 0.3!r}e0 THEN 'simultaneous'
  ELSE 'sequential' END AS family, CASE WHEN {d('lone')} < 5e-1 THEN 'b1' ELSE 'b2' END AS lone FROM ids),
starts AS (SELECT *, {first} AS first FROM families)
SELECT id, family, {', '.join(cols)} FROM starts"""


@query("gen_01_mixture", _mixture_sql(False))
def mixture(spark, sf):
    return rounded(G.gen_mixture(ids(spark, sf)))


@query("gen_02_mixture_mirror", _mixture_sql(True))
def mixture_mirror(spark, sf):
    return rounded(G.gen_mixture(ids(spark, sf), mirror=True))


def _binned_sql() -> str:
    d = lambda name: u("bin", G.BINNED_DRAWS, name)
    cols = []
    for bank, init, alone, first in (("b1", "i1", "A_only", "lead"), ("b2", "i2", "B_only", "NOT lead")):
        active = f"move_type IN ('{alone}', 'Simultaneous', 'Sequential')"
        time = f"CASE WHEN move_type = 'Sequential' THEN CASE WHEN {first} THEN t1 ELSE t2 END ELSE t0 END"
        cols += [f"CASE WHEN {active} THEN {integer(d(bank + '_pos'), 0, f'({init} - 10)')} ELSE {init} END AS {bank}_pos",
                 f"{r(f'CASE WHEN {active} THEN {time} ELSE 0e0 END')} AS {bank}_time",
                 f"CASE WHEN {active} THEN {real(d(bank + '_speed'), 1, 10, 1)} ELSE 0e0 END AS {bank}_speed"]
    return f"""WITH {IDS},
cells AS (SELECT id, 60 + 20 * (k // 40) AS w0, 200 * ((k // 8) % 5) AS b0, ['case1', 'case2'][(k // 4) % 2 + 1] AS init_case,
  ['A_only', 'B_only', 'Simultaneous', 'Sequential'][k % 4 + 1] AS move_type FROM (SELECT id, id % 200 AS k FROM ids)),
draws AS (SELECT *, CASE init_case WHEN 'case1' THEN 180 ELSE 100 END AS i1, CASE init_case WHEN 'case1' THEN 100 ELSE 180 END AS i2,
  round(w0 + {d('window')} * 20, 1) AS monitor_window, round(b0 + {d('boron')} * 200, 2) AS boron_ppm, {d('mover')} < 5e-1 AS lead,
  {real(d('start'), 1, 40, 1)} AS t0, {real(d('first'), 1, 20, 1)} AS t1,
  {real(d('first'), 1, 20, 1)} + {real(d('lag'), 5, 15, 1)} AS t2 FROM cells)
SELECT concat('data_', lpad(cast(id AS VARCHAR), cast(greatest(6, length(cast(id AS VARCHAR))) AS INTEGER), '0')) AS run_name, id,
  concat(w0, '-', w0 + 20) AS win_range, concat(b0, '-', b0 + 200) AS boron_range, init_case, move_type, {r('boron_ppm')} AS boron_ppm,
  {r('monitor_window')} AS monitor_window, {', '.join(cols)}, {r('greatest(monitor_window - 10, 5e1)')} AS switch_time FROM draws"""


@query("gen_03_binned", _binned_sql())
def binned(spark, sf):
    plan = ids(spark, sf).withColumn("bin_index", F.col("id") % 200)
    return rounded(G.gen_binned(plan))


def _task(name: str) -> str:
    return u("uniform", list(G.UNIFORM_RANGES), name, key="(42 + id * 137)", seed="task")


@query("gen_04_uniform", f"""WITH {IDS}
SELECT id, 42 + id * 137 AS task_seed, {r(real(_task('input_reactivity'), -0.02, -0.0001), 9)} AS input_reactivity,
  {r(real(_task('input_duration'), 3, 40), 9)} AS input_duration FROM ids""")
def uniform_runs(spark, sf):
    return rounded(G.gen_uniform(ids(spark, sf)), 9)


def _cases_sql(init: str, fixed: list[float], lo: float, hi: float, digits: int) -> str:
    known = "CASE id " + " ".join(f"WHEN {i + 1} THEN {t!r}e0" for i, t in enumerate(fixed)) + " END"
    return f"""WITH {IDS} SELECT id AS case_id, {init} AS target_initial,
  CASE WHEN id BETWEEN 1 AND 12 THEN {known} ELSE {real(u('case', ['target'], 'target'), lo, hi, digits)} END AS target_final,
  CASE WHEN id BETWEEN 1 AND 12 THEN 'fixed' ELSE 'random' END AS kind FROM ids"""


@query("gen_05_test_cases", _cases_sql("1e0", G.FIXED_TARGETS, 0.5, 1.5, 5))
def test_cases(spark, sf):
    return G.gen_test_cases(ids(spark, sf))


@query("gen_05_level_cases", _cases_sql("24544e-2", G.FIXED_LEVEL_TARGETS, *G.LEVEL_TARGET_RANGE, 2))
def level_cases(spark, sf):
    return G.gen_level_cases(ids(spark, sf))


WINDOW_DRAWS = ["window", "jitter", "target"]


@query("gen_06_window_cases", f"""WITH {IDS}
SELECT concat('val_', lpad(cast(id AS VARCHAR), cast(greatest(4, length(cast(id AS VARCHAR))) AS INTEGER), '0')) AS run_id,
  greatest(6e1, least(1e2, round([6e1, 7e1, 8e1, 9e1, 1e2][cast(floor({u('case', WINDOW_DRAWS, 'window')} * 5) AS INTEGER) + 1]
    + {real(u('case', WINDOW_DRAWS, 'jitter'), -1, 1)}, 1))) AS monitor_window, 1e0 AS initial_power,
  {real(u('case', WINDOW_DRAWS, 'target'), 0.5, 1.5, 4)} AS final_power
FROM ids""")
def window_cases(spark, sf):
    return G.gen_window_cases(ids(spark, sf))


SWEEP_STARTS = "starts AS (SELECT p_partkey, cast(5 + (p_partkey * 37) % 176 AS INTEGER) AS start FROM part)"


def _starts(spark, sf):
    key = F.col("p_partkey")
    return table(spark, sf, "part").select(key, (5 + (key * 37) % 176).cast("int").alias("start"))


@query("gen_07_sweep", f"""WITH {SWEEP_STARTS}
SELECT p_partkey, start, cast(d AS INTEGER) AS delta_step, cast(start + d AS INTEGER) AS target_pos
FROM starts, range(-25, 16) t(d) WHERE d <> 0 AND start + d BETWEEN 0 AND 180""")
def sweep(spark, sf):
    return G.gen_sweep(_starts(spark, sf), "start", -25, 15)


@query("gen_07_symmetric_sweep", f"""WITH {SWEEP_STARTS}
SELECT p_partkey, start, cast(d AS INTEGER) AS delta_step, cast(start + d AS INTEGER) AS target_pos
FROM starts, (VALUES (10), (-10), (30), (-30), (50), (-50)) t(d) WHERE start + d BETWEEN 0 AND 180""")
def symmetric_sweep(spark, sf):
    return G.gen_symmetric_sweep(_starts(spark, sf), "start")


DRAWS = f"""draws AS (SELECT id AS slot, id % 8 AS cell, cast(a AS INTEGER) AS attempt,
  {u('draw', ['value'], 'value', "(id || ':' || a)")} AS value FROM ids, range(1, 51) t(a))"""


def _slots(spark, sf):
    return ids(spark, sf).select(F.col("id").alias("slot"), (F.col("id") % 8).alias("cell"))


def _filled(spark, sf):
    draw = lambda tries: add_draws(tries, 42, "draw", [F.col("slot"), F.col("attempt")], ["value"])
    return G.fill_slots(_slots(spark, sf), draw, F.col("value") < (F.col("cell") + 1) / 10.0)


@query("gen_08_fill_quota", f"""WITH {IDS}, {DRAWS}
SELECT slot, cell, attempt, {r('value', 9)} AS value FROM (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY attempt) AS k
  FROM draws WHERE value < (cell + 1) / 1e1) WHERE k = 1""")
def fill_quota(spark, sf):
    return rounded(_filled(spark, sf), 9)


@query("gen_08_quota_shortfall", f"""WITH {IDS}, {DRAWS}
SELECT cell, count(*) AS planned, count(*) FILTER (ok) AS filled, count(*) FILTER (NOT ok) AS missing FROM (
  SELECT slot, cell, bool_or(value < (cell + 1) / 1e1) AS ok FROM draws GROUP BY slot, cell) GROUP BY cell""")
def quota_shortfall(spark, sf):
    return G.quota_shortfall(_filled(spark, sf), _slots(spark, sf), ["cell"])
