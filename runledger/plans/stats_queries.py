"""Queries of the statistics, split and sampling operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from runledger.operators import joins as J
from runledger.operators import report as R
from runledger.operators import split as S
from runledger.operators import stats as T
from runledger.plans.fixtures import (
    ALL_REGIMES_SQL, CALIB_SQL, FEW_SQL, FITS_SQL, REGIMES_SQL, calib, few_regimes, query, r, rounded, runs, scored, with_runs, with_scored, windowed, WINDOWED_SQL,
)
from runledger.plans.report_queries import COUNTS_SQL, MAIN_SQL, PAIRS_SQL, TOLS
from runledger.functions.classify import window_bin

REPLICATES = 50
POISSON_CASE = "CASE " + " ".join(f"WHEN u < {p!r}e0 THEN {k}" for k, p in enumerate(T.POISSON_CDF)) + " ELSE 6 END"


def hex_sql(digest: str, slot: str = "0") -> str:
    return f"(cast('0x' || substr({digest}, {slot} * 8 + 1, 8) AS UBIGINT) / 4294967296e0)"


@query("sta_01_bootstrap_ci", with_scored("").rstrip() + f""", {COUNTS_SQL},
draws AS (SELECT s.*, b * 4 + k AS rep, {hex_sql("md5('42:boot:' || case_id || ':' || b)", 'k')} AS u
  FROM scored s, range(0, {(REPLICATES - 1) // 4 + 1}) x(b), range(0, 4) y(k) WHERE b * 4 + k < {REPLICATES}),
weights AS (SELECT *, {POISSON_CASE} AS w FROM draws),
rates AS ({" UNION ALL ".join(f"SELECT model, rep, {t} AS tolerance, sum(CASE WHEN validation_success_{t} THEN w ELSE 0 END) / cast(sum(w) AS DOUBLE) AS v FROM weights GROUP BY model, rep HAVING sum(w) > 0" for t in TOLS)})
SELECT model, tolerance, {r('successes / total')} AS success_rate, successes, total, {r('lo')} AS ci_lower, {r('hi')} AS ci_upper
FROM counts JOIN (SELECT model, tolerance, quantile_cont(v, 25e-3) AS lo, quantile_cont(v, 975e-3) AS hi FROM rates
  GROUP BY model, tolerance) USING (model, tolerance)""")
def poisson_bootstrap(spark, sf):
    return rounded(T.poisson_bootstrap_ci(scored(spark, sf), ["model"], ["case_id"], REPLICATES))


LOG_MASS = "lgamma(total + 1) - lgamma(k + 1) - lgamma(total - k + 1) + k * ln(p) + (total - k) * ln(1 - p)"


@query("sta_01_bootstrap_ci_exact", with_scored("").rstrip() + f""", {COUNTS_SQL},
rates AS (SELECT *, successes / cast(total AS DOUBLE) AS p FROM counts),
mass AS (SELECT model, tolerance, k, sum(exp({LOG_MASS})) OVER (PARTITION BY model, tolerance ORDER BY k) AS upto
  FROM (SELECT *, unnest(range(0, total + 1)) AS k FROM rates WHERE successes NOT IN (0, total))),
bounds AS (SELECT model, tolerance, min(k) FILTER (upto >= 25e-3) AS lo, min(k) FILTER (upto >= 975e-3) AS hi FROM mass GROUP BY ALL)
SELECT model, tolerance, successes, total, {r('p')} AS success_rate, {r('coalesce(lo / total, p)')} AS ci_lower,
  {r('coalesce(hi / total, p)')} AS ci_upper, {r('coalesce((hi - lo) / total, 0)')} AS ci_width
FROM rates LEFT JOIN bounds USING (model, tolerance)""")
def exact_bootstrap(spark, sf):
    return rounded(T.binomial_ci(scored(spark, sf), ["model"]))


@query("sta_01_bootstrap_ci_binomial", with_scored("").rstrip() + f""", {COUNTS_SQL}
SELECT model, tolerance, successes, total, {r('successes / total')} AS success_rate, true AS lower_near_normal,
  true AS upper_near_normal, true AS covers_rate FROM counts""")
def bootstrap(spark, sf):
    """The draws have no SQL, so the bounds are shown as tests: both lie where the normal approximation puts them
    (within 0.4 standard errors and one case), and the rate lies between them."""
    ci = T.bootstrap_ci(scored(spark, sf), ["model"])
    p, n = F.col("success_rate"), F.col("total")
    error = F.sqrt(p * (1 - p) / n)
    near = lambda bound, side: F.abs(F.col(bound) - (p + side * 1.96 * error)) <= 0.4 * error + 1 / n
    return rounded(ci.select(
        "model", "tolerance", "successes", "total", "success_rate", near("ci_lower", -1).alias("lower_near_normal"),
        near("ci_upper", 1).alias("upper_near_normal"), p.between(F.col("ci_lower"), F.col("ci_upper")).alias("covers_rate")))


_POLY = f"{T.ERFC_FIT[-1]}e0"
for _c in reversed(T.ERFC_FIT[:-1]):
    _POLY = f"({_c}e0 + k * {_POLY})"
CHI2_SQL = f"""{COUNTS_SQL}, {PAIRS_SQL},
chi AS (SELECT *, (na + nb) * (sa * (nb - sb) - (na - sa) * sb) * (sa * (nb - sb) - (na - sa) * sb)
    / (na * nb * (sa + sb) * (na - sa + nb - sb)) AS chi2
  FROM (SELECT *, cast(successes_a AS DOUBLE) AS sa, cast(total_a AS DOUBLE) AS na, cast(successes_b AS DOUBLE) AS sb,
    cast(total_b AS DOUBLE) AS nb FROM pairs)),
tests AS (SELECT model_a, model_b, tolerance, successes_a, total_a, successes_b, total_b, chi2,
    k * exp(-z * z + {_POLY}) AS p_value
  FROM (SELECT *, sqrt(chi2 / 2) AS z, 1e0 / (1e0 + 5e-1 * sqrt(chi2 / 2)) AS k FROM chi))"""


@query("sta_02_chi2_pairwise", with_scored("").rstrip() + f""", {CHI2_SQL}
SELECT model_a, model_b, tolerance, successes_a, total_a, successes_b, total_b, {r('chi2')} AS chi2,
  {r('p_value', 12)} AS p_value FROM tests""")
def chi2(spark, sf):
    tests = T.chi2_pairwise(scored(spark, sf))
    return tests.withColumns({"chi2": F.round("chi2", 6), "p_value": F.round("p_value", 12)})


@query("sta_03_fdr_bh", with_scored("").rstrip() + f""", {CHI2_SQL},
ranked AS (SELECT *, row_number() OVER (ORDER BY p_value, model_a, model_b, tolerance) AS bh_rank, count(*) OVER () AS m
  FROM tests WHERE p_value IS NOT NULL),
adjusted AS (SELECT *, least(1e0, min(p_value * m / bh_rank) OVER (ORDER BY bh_rank ROWS BETWEEN CURRENT ROW AND
  UNBOUNDED FOLLOWING)) AS p_adjusted FROM ranked)
SELECT model_a, model_b, tolerance, bh_rank, {r('p_value', 9)} AS p_value, {r('p_adjusted', 9)} AS p_adjusted,
  p_adjusted <= 5e-2 AS significant FROM adjusted""")
def fdr(spark, sf):
    ids = ["model_a", "model_b", "tolerance"]
    tests = T.chi2_pairwise(scored(spark, sf)).select(*ids, "p_value")
    return rounded(T.fdr_bh(tests, "p_value", ids), 9)


CLASS_SQL = f"""cls AS (SELECT m.model, c.scenario_type, q, coalesce(n, 0) AS n, n_records, n_in_taxonomy,
    coalesce(n, 0) / n_in_taxonomy AS p
  FROM (SELECT model, count(*) AS n_records, count(*) FILTER ({MAIN_SQL}) AS n_in_taxonomy FROM scored GROUP BY model) m
  CROSS JOIN (VALUES ('single_b1', 3e-1), ('single_b2', 3e-1), ('simultaneous', 3e-1), ('sequential', 1e-1)) c(scenario_type, q)
  LEFT JOIN (SELECT model, scenario_type, count(*) AS n FROM scored GROUP BY ALL) t
    ON t.model = m.model AND t.scenario_type = c.scenario_type),
kl AS (SELECT model, n_in_taxonomy, sum(f / total * ln(f / total / q)) AS kl_nats
  FROM (SELECT *, greatest(p, 1e-3) AS f, sum(greatest(p, 1e-3)) OVER (PARTITION BY model) AS total FROM cls)
  GROUP BY model, n_in_taxonomy)"""


@query("sta_04_entropy", with_scored("").rstrip() + f""", {CLASS_SQL}
SELECT model, n_records, n_in_taxonomy, n_records - n_in_taxonomy AS n_other,
  {r('-sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END)')} AS h_nats, {r('ln(4e0)')} AS h_max_nats FROM cls GROUP BY ALL""")
def entropy(spark, sf):
    return rounded(T.entropy(scored(spark, sf), ["model"], "scenario_type"))


@query("sta_05_kl_divergence", with_scored("").rstrip() + f""", {CLASS_SQL}
SELECT model, n_in_taxonomy, {r('kl_nats')} AS kl_nats FROM kl""")
def kl(spark, sf):
    return rounded(T.kl_divergence(scored(spark, sf), ["model"], "scenario_type"))


@query("sta_06_is_monotonic", with_scored("").rstrip() + f""", {CLASS_SQL}
SELECT count(*) AS n_scales, bool_and(coalesce(kl_nats >= before, true)) AS monotonic FROM (
  SELECT kl_nats, lag(kl_nats) OVER (ORDER BY CASE model WHEN '1K' THEN 1 WHEN '10K' THEN 2 ELSE 3 END) AS before FROM kl)""")
def monotonic(spark, sf):
    return T.is_monotonic(T.kl_divergence(scored(spark, sf), ["model"], "scenario_type"), "kl_nats")


@query("sta_07_fit_gain", f"""WITH {CALIB_SQL}
SELECT grp, count(*) AS n_used, {r('regr_slope(delta_step, power_delta)')} AS slope, {r('regr_r2(delta_step, power_delta)')} AS r2,
  {r('abs(regr_slope(delta_step, power_delta))')} AS gain FROM calib GROUP BY grp""")
def fit_gain(spark, sf):
    return rounded(T.fit_gain(calib(spark, sf), "power_delta", "delta_step", ["grp"]))


@query("sta_08_fit_gain_by_regime", f"WITH {CALIB_SQL}, {REGIMES_SQL}, {FITS_SQL}, {ALL_REGIMES_SQL} SELECT * FROM all_regimes")
def fit_by_regime(spark, sf):
    samples = J.assign_regime(calib(spark, sf), "power_delta")
    return rounded(T.fit_gain_by_regime(samples, "power_delta", "delta_step"))


@query("sta_08_fit_gain_few_regimes", f"WITH {FEW_SQL}, {REGIMES_SQL}, {FITS_SQL}, {ALL_REGIMES_SQL} SELECT * FROM all_regimes")
def fit_few_regimes(spark, sf):
    samples = J.assign_regime(few_regimes(spark, sf), "power_delta")
    return rounded(T.fit_gain_by_regime(samples, "power_delta", "delta_step"))


@query("sta_09_single_gain", f"""WITH {CALIB_SQL}
SELECT step, count(*) FILTER (abs(power_delta) > 1e-5) AS n_used, {r('''CASE WHEN count(*) FILTER (abs(power_delta) > 1e-5) < 3 THEN 200e0
  ELSE abs(regr_slope(delta_step, power_delta) FILTER (abs(power_delta) > 1e-5)) END''')} AS gain
FROM (SELECT *, cast(split_part(sample_id, '-', 3) AS BIGINT) AS step FROM calib) GROUP BY step""")
def single_gain(spark, sf):
    part = F.split_part("sample_id", F.lit("-"), F.lit(3)).cast("long")
    return rounded(T.single_gain(calib(spark, sf).withColumn("step", part), "power_delta", "delta_step", ["step"]))


@query("sta_10_origin_fit", f"""WITH {CALIB_SQL}, {REGIMES_SQL}
SELECT regime, count(*) AS n, {r('sum(power_delta * delta_step) / sum(power_delta * power_delta)')} AS gain
FROM samples GROUP BY regime""")
def origin_fit(spark, sf):
    samples = J.assign_regime(calib(spark, sf), "power_delta")
    return rounded(T.origin_fit(samples, "power_delta", "delta_step", ["regime"]))


SCALE_SQL = "CASE model WHEN '1K' THEN 1 WHEN '10K' THEN 2 ELSE 3 END"


@query("sta_11_improvement", with_scored("").rstrip() + f""",
stats AS (SELECT model, {SCALE_SQL} AS k, avg(final_error) AS mean, quantile_cont(final_error, 5e-1) AS med
  FROM scored WHERE final_error IS NOT NULL GROUP BY model)
SELECT a.model AS from_model, b.model AS to_model, {r('(a.mean - b.mean) / a.mean * 1e2')} AS mean_improvement,
  {r('(a.med - b.med) / a.med * 1e2')} AS median_improvement FROM stats a JOIN stats b ON b.k = a.k + 1""")
def improvement(spark, sf):
    return rounded(T.improvement(R.error_summary(scored(spark, sf), ["model"])))


@query("sta_12_scaling_exponent", with_scored("").rstrip() + f""",
rates AS (SELECT model, {SCALE_SQL} AS k, count(*) FILTER (validation_success_1) / count(*) AS v FROM scored GROUP BY model)
SELECT a.model AS from_model, b.model AS to_model, {r('ln(b.v / a.v) / ln(1e1)')} AS exponent
FROM rates a JOIN rates b ON b.k = a.k + 1""")
def scaling_exponent(spark, sf):
    rates = R.success_by_tolerance(scored(spark, sf), ["model"]).where("tolerance = 1")
    return rounded(T.scaling_exponent(rates))


@query("sta_13_variance_ratio", with_scored("").rstrip() + f""",
spread AS (SELECT model, {SCALE_SQL} AS k, var_samp(final_error) AS v FROM scored GROUP BY model)
SELECT a.model AS from_model, b.model AS to_model, {r('a.v / b.v')} AS variance_ratio
FROM spread a JOIN spread b ON b.k = a.k + 1""")
def variance_ratio(spark, sf):
    return rounded(T.variance_ratio(scored(spark, sf)))


@query("sta_14_histogram", with_scored("").rstrip() + f""",
spans AS (SELECT model, min(final_error) AS lo, max(final_error) AS hi FROM scored GROUP BY model),
edges AS (SELECT model, lo, hi, cast(b AS INTEGER) AS bin, b * ((hi - lo) / 50) + lo AS low, (b + 1) * ((hi - lo) / 50) + lo AS high
  FROM spans, range(0, 50) t(b)),
binned AS (SELECT model, e.bin, count(*) AS n FROM scored JOIN edges e USING (model)
  WHERE final_error >= low AND (final_error < high OR bin = 49) GROUP BY ALL)
SELECT model, bin, {r('lo + bin * (hi - lo) / 50')} AS "left", {r('lo + (bin + 1) * (hi - lo) / 50')} AS "right", coalesce(n, 0) AS n
FROM edges LEFT JOIN binned USING (model, bin)""")
def histogram(spark, sf):
    return rounded(T.histogram(scored(spark, sf), ["model"], "final_error"))


@query("sta_14_histogram_with_gaps", with_scored("").rstrip() + f""",
shifted AS (SELECT model, final_error + CASE WHEN case_id % 3 = 0 THEN 7e0 ELSE 0e0 END AS e FROM scored WHERE final_error IS NOT NULL),
spans AS (SELECT model, min(e) AS lo, max(e) AS hi FROM shifted GROUP BY model),
edges AS (SELECT model, lo, hi, cast(b AS INTEGER) AS bin, b * ((hi - lo) / 50) + lo AS low, (b + 1) * ((hi - lo) / 50) + lo AS high
  FROM spans, range(0, 50) t(b)),
binned AS (SELECT model, x.bin, count(*) AS n FROM shifted JOIN edges x USING (model) WHERE e >= low AND (e < high OR bin = 49) GROUP BY ALL)
SELECT model, bin, {r('low')} AS "left", {r('high')} AS "right", coalesce(n, 0) AS n FROM edges LEFT JOIN binned USING (model, bin)""")
def histogram_with_gaps(spark, sf):
    shifted = F.col("final_error") + F.when(F.col("case_id") % 3 == 0, 7.0).otherwise(0.0)
    return rounded(T.histogram(scored(spark, sf).withColumn("e", shifted), ["model"], "e"))


def _ecdf_sql(first: str, last: str) -> str:
    return with_scored("").rstrip() + f""",
placed AS (SELECT model, final_error AS v, row_number() OVER (PARTITION BY model ORDER BY final_error) AS k,
  count(*) OVER (PARTITION BY model) AS n FROM scored WHERE final_error IS NOT NULL)
SELECT model, {r('v', 12)} AS value, count(*) AS copies, min(k) AS first_rank, max(k) AS last_rank,
  {r(first)} AS y_first, {r(last)} AS y_last FROM placed GROUP BY model, v, n"""


def _ecdf(spark, sf, mode):
    out = T.ecdf(scored(spark, sf), ["model"], "final_error", mode)
    return out.withColumns({"value": F.round("value", 12), "y_first": F.round("y_first", 6), "y_last": F.round("y_last", 6)})


@query("sta_15_ecdf", _ecdf_sql("min(k) / n * 1e2", "max(k) / n * 1e2"))
def ecdf(spark, sf):
    return _ecdf(spark, sf, "rank")


@query("sta_15_ecdf_unit", _ecdf_sql("(min(k) - 1) / (n - 1) * 1e2", "(max(k) - 1) / (n - 1) * 1e2"))
def ecdf_unit(spark, sf):
    return _ecdf(spark, sf, "unit")


@query("sta_16_box_stats", with_scored("").rstrip() + f""",
q AS (SELECT model, power_bin, count(*) AS n, quantile_cont(final_error, 25e-2) AS q1, quantile_cont(final_error, 5e-1) AS median,
  quantile_cont(final_error, 75e-2) AS q3 FROM scored WHERE final_error IS NOT NULL GROUP BY ALL),
f AS (SELECT *, q1 - 15e-1 * (q3 - q1) AS lo, q3 + 15e-1 * (q3 - q1) AS hi FROM q)
SELECT model, power_bin, n, {r('q1')} AS q1, {r('median')} AS median, {r('q3')} AS q3,
  {r('least(q1, min(final_error) FILTER (final_error BETWEEN lo AND hi))')} AS whisker_low,
  {r('greatest(q3, max(final_error) FILTER (final_error BETWEEN lo AND hi))')} AS whisker_high,
  count(*) FILTER (final_error < lo OR final_error > hi) AS outliers
FROM scored JOIN f USING (model, power_bin) GROUP BY model, power_bin, n, q1, median, q3""")
def box_stats(spark, sf):
    return rounded(T.box_stats(scored(spark, sf), ["model", "power_bin"], "final_error"))


@query("sta_17_kde_grid", with_scored("").rstrip() + f""",
spans AS (SELECT model, count(final_error) AS n, min(final_error) AS lo, max(final_error) AS hi,
  stddev_samp(final_error) * pow(count(final_error), -2e-1) AS h FROM scored GROUP BY model),
grid AS (SELECT *, lo + g * (hi - lo) / 99 AS x FROM spans, range(0, 100) t(g))
SELECT model, cast(g AS INTEGER) AS grid, {r('x')} AS x,
  {r('sum(exp(-5e-1 * ((final_error - x) / h) * ((final_error - x) / h))) / (n * h * sqrt(2 * pi()))')} AS density
FROM scored JOIN grid USING (model) WHERE final_error IS NOT NULL GROUP BY model, g, x, n, h""")
def kde_grid(spark, sf):
    return rounded(T.kde_grid(scored(spark, sf), ["model"], "final_error"))


@query("sta_18_rate_margin", with_scored("").rstrip() + f", {COUNTS_SQL}" + f"""
SELECT model, tolerance, total, {r('196e-2 * sqrt(p * (1 - p) / total)')} AS margin
FROM (SELECT *, successes / total AS p FROM counts)""")
def rate_margin(spark, sf):
    rates = R.success_by_tolerance(scored(spark, sf), ["model"])
    margin = T.rate_margin(F.col("success_rate"), F.col("denominator"))
    return rounded(rates.select("model", "tolerance", F.col("denominator").alias("total"), margin.alias("margin")))


# ---- splits and samples ---------------------------------------------------------------------


def _rank_sql(strata: str, source: str = "scored", key: str = "case_id", keep: str = "") -> str:
    part = f"PARTITION BY {strata}" if strata else ""
    return f"""(SELECT *, row_number() OVER ({part} ORDER BY md5('42:' || {key}), {key}) AS place,
  count(*) OVER ({part}) AS size FROM {source}{keep})"""


THREE_WAY = "CASE WHEN place <= floor(size * 8e-1) THEN 'train' WHEN place <= floor(size * 9e-1) THEN 'val' ELSE 'test' END"
TWO_WAY = "CASE WHEN place <= floor(size * 9e-1) THEN 'train' ELSE 'val' END"


@query("spl_01_stratified_split2", with_scored(f"""
SELECT case_id, scenario_type, {TWO_WAY} AS part FROM {_rank_sql('scenario_type')}"""))
def split2(spark, sf):
    return S.stratified_split2(scored(spark, sf).select("case_id", "scenario_type"), ["scenario_type"], ["case_id"])


@query("spl_02_stratified_split3", with_scored(f"""
SELECT case_id, scenario_type, {THREE_WAY} AS part FROM {_rank_sql('scenario_type')}"""))
def split3(spark, sf):
    return S.stratified_split3(scored(spark, sf).select("case_id", "scenario_type"), ["scenario_type"], ["case_id"])


@query("spl_03_strat_key", with_scored("").rstrip() + WINDOWED_SQL + f""",
keyed AS (SELECT case_id, concat_ws('_', init_b1, scenario_type) AS init_key, concat_ws('_', CASE WHEN monitor_window < 599e-1
  OR monitor_window > 1001e-1 THEN 'nan' WHEN monitor_window <= 70 THEN '60_70' WHEN monitor_window <= 80 THEN '70_80'
  WHEN monitor_window <= 90 THEN '80_90' ELSE '90_100' END, scenario_type) AS window_key FROM windowed)
SELECT case_id, init_key, window_key, {THREE_WAY} AS part FROM {_rank_sql('window_key', 'keyed')}""")
def strat_key(spark, sf):
    df = windowed(spark, sf).select(
        "case_id", S.strat_key(F.col("init_b1"), F.col("scenario_type")).alias("init_key"),
        S.strat_key(window_bin(F.col("monitor_window")), F.col("scenario_type")).alias("window_key"))
    return S.stratified_split3(df, ["window_key"], ["case_id"])


@query("spl_04_random_split", with_runs(f"SELECT case_id, {THREE_WAY} AS part FROM {_rank_sql('', 'runs')}"))
def random_split(spark, sf):
    # the stratum column is missing, so this takes the fallback
    return S.random_split(runs(spark, sf).select("case_id"), ["case_id"], strata=["pattern"])


QUOTA_SQL = """CASE scenario_type WHEN 'single_b1' THEN 300 WHEN 'single_b2' THEN 300 WHEN 'simultaneous' THEN 300
  WHEN 'sequential' THEN 100 END"""


@query("spl_05_quota_sample", with_scored(f"""
SELECT case_id, scenario_type FROM {_rank_sql('scenario_type')} WHERE place <= {QUOTA_SQL}"""))
def quota_sample(spark, sf):
    return S.quota_sample(scored(spark, sf).select("case_id", "scenario_type"), "scenario_type", 1000, ["case_id"])


@query("spl_05_quota_shortfalls", with_scored(f"""
SELECT scenario_type, count(*) AS available, cast({QUOTA_SQL} AS BIGINT) AS requested,
  cast(greatest({QUOTA_SQL} - count(*), 0) AS BIGINT) AS missing FROM scored WHERE {MAIN_SQL} GROUP BY scenario_type"""))
def quota_shortfalls(spark, sf):
    return S.quota_shortfalls(scored(spark, sf), "scenario_type", 1000)


@query("spl_06_shuffle", with_runs(f"SELECT case_id, place AS position FROM {_rank_sql('', 'runs')}"))
def shuffle(spark, sf):
    return S.shuffle_position(runs(spark, sf).select("case_id"), ["case_id"])


@query("spl_06_shuffled_table", with_runs("SELECT case_id, model FROM runs ORDER BY md5('42:' || case_id), case_id"))
def shuffled(spark, sf):
    return S.shuffle(runs(spark, sf).select("case_id", "model"), ["case_id"])


@query("spl_07_rekey", with_runs("""
SELECT case_id, printf('%s%05d', 'def_', row_number() OVER (ORDER BY case_id) - 1) AS run_id FROM runs"""))
def rekey(spark, sf):
    return S.rekey(runs(spark, sf).select("case_id"), "def_", "case_id")


@query("spl_08_sample_n", with_runs(f"SELECT case_id, model FROM {_rank_sql('', 'runs')} WHERE place <= 500"))
def sample_n(spark, sf):
    return S.sample_n(runs(spark, sf).select("case_id", "model"), 500, ["case_id"])


@query("spl_09_split_balance", with_scored(f"""
SELECT part, scenario_type, n, {r('n / sum(n) OVER (PARTITION BY part)')} AS share FROM (
  SELECT {THREE_WAY} AS part, scenario_type, count(*) AS n FROM {_rank_sql('scenario_type')} GROUP BY ALL)"""))
def split_balance(spark, sf):
    df = scored(spark, sf).select("case_id", "scenario_type")
    return rounded(S.split_balance(S.stratified_split3(df, ["scenario_type"], ["case_id"]), "part", "scenario_type"))
