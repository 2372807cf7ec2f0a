"""Intervals, tests, distributions and gain fits."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runledger.functions import classify as K
from runledger.functions import derive as D
from runledger.functions.hashing import HEX_DIGITS, HEX_RANGE, order_hash
from runledger.operators.joins import FALLBACK_GAIN, bin_grid, literal_map, model_pairs
from runledger.operators.report import _join_groups, band_counts, rate
from runledger.operators.scale import (
    group_key, group_values, merged_with_stats, ordered_scan, quantiles, salted_join, spread, stage,
    with_order_bucket,
)

# ---- fixed values ---------------------------------------------------------------------------
TRAIN_MIX = {"single_b1": 0.30, "single_b2": 0.30, "simultaneous": 0.30, "sequential": 0.10}
KL_FLOOR = 1e-3
SCALES = ["1K", "10K", "100K"]
SCALE_SIZES = {"1K": 1_000, "10K": 10_000, "100K": 100_000}
DEFAULT_SINGLE_GAIN = 200.0
# Poisson(1) cumulative probabilities for weights 0..5; larger draws count as 6
POISSON_CDF = [math.exp(-1.0) * sum(1.0 / math.factorial(j) for j in range(k + 1)) for k in range(6)]
# coefficients of the published Chebyshev fit of erfc (fractional error below 1.2e-7)
ERFC_FIT = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587,
            -0.82215223, 0.17087277]
# ---------------------------------------------------------------------------------------------


# ---- bootstrap ------------------------------------------------------------------------------


def bootstrap_ci(df: DataFrame, by: list[str], replicates: int = 10_000, seed: int = 42) -> DataFrame:
    """Percentile interval (2.5 / 97.5) of every band's success rate.

    Resampling n zeros and ones with replacement and counting the ones is a binomial draw, so the resamples need
    only (successes, n): one aggregate over the rows, then `replicates` draws for each (group, band) row. The cost
    of the resampling does not depend on the number of runs.
    """
    counts = band_counts(df, by).withColumn("success_rate", rate(F.col("successes"), F.col("total")))

    @F.pandas_udf(T.StructType([T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType())]))
    def interval(successes: pd.Series, total: pd.Series, key: pd.Series) -> pd.DataFrame:
        rows = []
        for k, n, digest in zip(successes, total, key):
            draws = np.random.default_rng(int(digest, 16)).binomial(n, k / n, replicates) / n
            rows.append(np.percentile(draws, [2.5, 97.5]))
        return pd.DataFrame(rows, columns=["lo", "hi"])

    key = order_hash(seed, *[F.col(c) for c in by], F.col("tolerance"))
    out = counts.withColumn("_ci", interval("successes", "total", key))
    return out.select(
        *by, "tolerance", "success_rate", F.col("_ci.lo").alias("ci_lower"), F.col("_ci.hi").alias("ci_upper"),
        (F.col("_ci.hi") - F.col("_ci.lo")).alias("ci_width"), "successes", "total")


def binomial_bounds(n: int, k: int, tails: tuple[float, float] = (0.025, 0.975)) -> list[float]:
    """Quantiles of Binomial(n, k / n) / n: the least rate whose distribution function reaches each tail.

    The probabilities are summed from the mode outwards, 40 standard deviations to each side, so the work grows with sqrt(n).
    """
    if k in (0, n):
        return [k / n] * len(tails)
    p = k / n
    reach = int(40 * math.sqrt(n * p * (1 - p))) + 10
    lo, hi = max(0, k - reach), min(n, k + reach)
    at = np.arange(lo, hi, dtype=np.float64)
    ratios = np.log(n - at) - np.log(at + 1) + math.log(p) - math.log1p(-p)
    logs = np.concatenate([[0.0], np.cumsum(ratios)])
    mass = np.cumsum(np.exp(logs - logs.max()))
    return [(lo + int(np.searchsorted(mass / mass[-1], t - 1e-12))) / n for t in tails]


def binomial_ci(df: DataFrame, by: list[str]) -> DataFrame:
    """The interval that `bootstrap_ci` estimates, exactly: the resampled rate of zeros and ones has a binomial distribution.

    One aggregate over the runs; the quantiles are computed on one row per group and band.
    """
    counts = band_counts(df, by).withColumn("success_rate", rate(F.col("successes"), F.col("total")))

    @F.pandas_udf(T.StructType([T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType())]))
    def interval(successes: pd.Series, total: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([binomial_bounds(int(n), int(k)) for k, n in zip(successes, total)], columns=["lo", "hi"])

    out = counts.withColumn("_ci", interval("successes", "total"))
    return out.select(
        *by, "tolerance", "success_rate", F.col("_ci.lo").alias("ci_lower"), F.col("_ci.hi").alias("ci_upper"),
        (F.col("_ci.hi") - F.col("_ci.lo")).alias("ci_width"), "successes", "total")


def poisson_weight(hex_draw: Column) -> Column:
    """Poisson(1) draw from 8 hex digits, by inverting the distribution function.

    k / 16^8 < p is k < ceil(p * 16^8); hex texts of one length compare like their numbers.
    """
    expr = F
    for k, p in enumerate(POISSON_CDF):
        expr = expr.when(hex_draw < format(math.ceil(p * HEX_RANGE), f"0{HEX_DIGITS}x"), k)
    return expr.otherwise(len(POISSON_CDF))


def poisson_bootstrap_ci(df: DataFrame, by: list[str], ids: list[str], replicates: int = 50,
                         seed: int = 42) -> DataFrame:
    """Interval from hash-weighted resamples: reproducible row by row in any SQL engine.

    Each row draws a weight per replicate (one md5 serves four of them); weights are summed map-side, so the
    shuffle carries replicates x groups rows. The resample size is random, and the work is rows x replicates:
    `bootstrap_ci` is the choice for large tables.
    """
    per_digest = 32 // HEX_DIGITS
    digest = order_hash(f"{seed}:boot", *[F.col(c) for c in ids], F.col("_block"))
    weights = F.array(*[
        poisson_weight(F.substring("_digest", k * HEX_DIGITS + 1, HEX_DIGITS)) for k in range(per_digest)])
    flags = [F.col(f"validation_success_{t}") for t in K.TOLERANCES]
    rows = spread(df.select(*by, *ids, *flags))
    blocks = rows.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // per_digest))))
    drawn = blocks.withColumn("_digest", digest).select(
        *by, *flags, "_block", F.posexplode(weights).alias("_slot", "_w"))
    drawn = drawn.withColumn("rep", F.col("_block") * per_digest + F.col("_slot")).where(F.col("rep") < replicates)
    sums = drawn.groupBy(*by, "rep").agg(
        F.sum("_w").alias("_n"),
        *[F.sum(F.when(F.col(f"validation_success_{t}"), F.col("_w")).otherwise(0)).alias(f"_s{t}")
          for t in K.TOLERANCES])
    bands = F.array(*[F.struct(F.lit(t).alias("tolerance"), F.col(f"_s{t}").alias("s")) for t in K.TOLERANCES])
    rates = sums.where(F.col("_n") > 0).select(*by, "_n", F.inline(bands)).withColumn("r", rate(F.col("s"), F.col("_n")))
    # one group holds at most `replicates` rates
    bounds = rates.groupBy(*by, "tolerance").agg(
        F.percentile("r", 0.025).alias("ci_lower"), F.percentile("r", 0.975).alias("ci_upper"))
    counts = band_counts(df, by).withColumn("success_rate", rate(F.col("successes"), F.col("total")))
    counts = counts.select(*by, "tolerance", "success_rate", "successes", "total")
    return _join_groups(counts, bounds, [*by, "tolerance"])


def rate_margin(p: Column, n: Column, z: float = 1.96) -> Column:
    """Half-width of a proportion's normal interval."""
    return F.lit(z) * F.sqrt(p * (1.0 - p) / n)


# ---- tests ----------------------------------------------------------------------------------


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0."""
    t = 1.0 / (1.0 + 0.5 * x)
    poly = F.lit(ERFC_FIT[-1])
    for c in reversed(ERFC_FIT[:-1]):
        poly = F.lit(c) + t * poly
    return t * F.exp(-x * x + poly)


def chi2_pairwise(df: DataFrame, model: str = "model") -> DataFrame:
    """2x2 Pearson chi-square without correction, every pair of models in every band.

    Works on one (model, band) count row each, not on runs.
    """
    pairs = model_pairs(band_counts(df, [model]).drop("simulated"), model=model)
    sa, na, sb, nb = (F.col(c).cast("double") for c in ("successes_a", "total_a", "successes_b", "total_b"))
    fa, fb = na - sa, nb - sb
    numerator = (na + nb) * (sa * fb - fa * sb) * (sa * fb - fa * sb)
    chi2 = F.try_divide(numerator, na * nb * (sa + sb) * (fa + fb))
    return pairs.select(
        F.col(f"{model}_a").alias("model_a"), F.col(f"{model}_b").alias("model_b"), "tolerance",
        "successes_a", "total_a", "successes_b", "total_b", chi2.alias("chi2"),
        erfc(F.sqrt(chi2 / 2.0)).alias("p_value"))


def fdr_bh(tests: DataFrame, p: str, ids: list[str], alpha: float = 0.05) -> DataFrame:
    """Benjamini-Hochberg over all rows at once: adjusted p-value and decision.

    The m tests are ranked and the running minimum from the largest p down is taken in buckets of p, so the table
    of tests may itself be large. `ids` makes the order unique. The tests are written once before they are ranked:
    they are the end of a long plan that would otherwise run again for every pass.
    """
    known = stage(tests.where(F.col(p).isNotNull()), "tests")
    m = known.agg(F.count("*")).scalar()
    placed = with_order_bucket(known, [p, *ids], "_bucket")
    ranked = ordered_scan(placed, [], F.col("_bucket"), [p, *ids], {"bh_rank": ("sum", F.lit(1).cast("long"))})
    scaled = ranked.withColumn("_scaled", F.col(p) * m / F.col("bh_rank"))
    best = ordered_scan(scaled, [], F.col("_bucket"), [p, *ids], {"_best": ("min", F.col("_scaled"))}, descending=True)
    adjusted = best.withColumn("p_adjusted", F.least(F.lit(1.0), F.col("_best")))
    return adjusted.withColumn("significant", F.col("p_adjusted") <= alpha).drop("_scaled", "_best", "_bucket")


# ---- class distributions --------------------------------------------------------------------


def class_counts(df: DataFrame, by: list[str], cls: str, classes: list[str] = K.MAIN_PATTERNS) -> DataFrame:
    """One row per group: array of counts in class order (empty classes are 0), their total, the rest."""
    counts = F.array(*[F.count_if(F.col(cls) == c) for c in classes])
    listed = F.col(cls).isin(*classes)
    return df.groupBy(*by).agg(
        counts.alias("counts"), F.count("*").alias("n_records"), F.count_if(D.flag(listed)).alias("n_in_taxonomy"))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def entropy(df: DataFrame, by: list[str], cls: str, classes: list[str] = K.MAIN_PATTERNS) -> DataFrame:
    """Shannon entropy in nats over the listed classes, with its maximum ln(#classes)."""
    counted = class_counts(df, by, cls, classes)
    shares = F.transform("counts", lambda c: F.try_divide(c.cast("double"), F.col("n_in_taxonomy").cast("double")))
    nats = _sum(F.transform(shares, lambda p: F.when(p > 0, -p * F.ln(p)).otherwise(F.lit(0.0))))
    return counted.select(
        *by, "n_records", "n_in_taxonomy", (F.col("n_records") - F.col("n_in_taxonomy")).alias("n_other"),
        nats.alias("h_nats"), F.lit(math.log(len(classes))).alias("h_max_nats"))


def kl_divergence(df: DataFrame, by: list[str], cls: str, target: dict[str, float] = TRAIN_MIX,
                  floor: float = KL_FLOOR) -> DataFrame:
    """KL(observed || target) in nats; shares are floored and renormalised, empty classes take part."""
    counted = class_counts(df, by, cls, list(target))
    shares = F.transform(
        "counts",
        lambda c: F.greatest(F.coalesce(F.try_divide(c.cast("double"), F.col("n_in_taxonomy").cast("double")),
                                        F.lit(0.0)), F.lit(floor)))
    floored = counted.select(*by, "n_in_taxonomy", shares.alias("_p")).withColumn("_total", _sum(F.col("_p")))
    q = F.array(*[F.lit(v) for v in target.values()])
    terms = F.zip_with("_p", q, lambda p, v: (p / F.col("_total")) * F.ln(p / F.col("_total") / v))
    return floored.select(*by, "n_in_taxonomy", _sum(terms).alias("kl_nats"))


def _in_scale_order(table: DataFrame, model: str, scales: list[str]) -> tuple[DataFrame, Window]:
    """Rows with the position of their scale, others behind the listed ones by name; one row per model, so one task may hold them."""
    listed = F.try_element_at(literal_map({s: i for i, s in enumerate(scales)}), F.col(model))
    ranked = table.withColumn("scale_order", F.coalesce(listed, F.lit(len(scales))))
    return ranked, Window.partitionBy(F.lit(0)).orderBy("scale_order", model)


def is_monotonic(table: DataFrame, col: str, model: str = "model", scales: list[str] = SCALES) -> DataFrame:
    """Whether `col` never falls along the scales; `table` has one row per scale."""
    ranked, w = _in_scale_order(table, model, scales)
    step = F.col(col) >= F.lag(col).over(w)
    return ranked.withColumn("_up", step).agg(F.count("*").alias("n_scales"),
                                              F.coalesce(F.bool_and("_up"), F.lit(True)).alias("monotonic"))


def improvement(table: DataFrame, mean: str = "mean", median: str = "median", model: str = "model",
                scales: list[str] = SCALES) -> DataFrame:
    """Fall of mean and median error from each scale to the next, in %; one row per scale in `table`."""
    ranked, w = _in_scale_order(table, model, scales)
    change = lambda c: (F.lag(c).over(w) - F.col(c)) / F.lag(c).over(w) * 100.0
    out = ranked.select(F.lag(model).over(w).alias("from_model"), F.col(model).alias("to_model"),
                        change(mean).alias("mean_improvement"), change(median).alias("median_improvement"))
    return out.where(F.col("from_model").isNotNull())


def scaling_exponent(table: DataFrame, value: str = "success_rate", model: str = "model",
                     sizes: dict[str, int] = SCALE_SIZES) -> DataFrame:
    """Log-log slope of `value` between neighbouring scales."""
    ranked, w = _in_scale_order(table, model, list(sizes))
    sized = ranked.withColumn("_size", F.try_element_at(literal_map(sizes), F.col(model)))
    slope = F.ln(F.col(value) / F.lag(value).over(w)) / F.ln(F.col("_size") / F.lag("_size").over(w))
    out = sized.select(F.lag(model).over(w).alias("from_model"), F.col(model).alias("to_model"),
                       slope.alias("exponent"))
    return out.where(F.col("from_model").isNotNull())


def variance_ratio(df: DataFrame, value: str = "final_error", model: str = "model",
                   scales: list[str] = SCALES) -> DataFrame:
    """Error variance of each scale divided by that of the next."""
    variances = df.groupBy(model).agg(F.var_samp(value).alias("variance"))
    ranked, w = _in_scale_order(variances, model, scales)
    out = ranked.select(F.lag(model).over(w).alias("from_model"), F.col(model).alias("to_model"),
                        (F.lag("variance").over(w) / F.col("variance")).alias("variance_ratio"))
    return out.where(F.col("from_model").isNotNull())


# ---- gain fits ------------------------------------------------------------------------------


def _slope_stats(x: Column, y: Column, keep: Column) -> list[Column]:
    kx, ky = F.when(keep, x), F.when(keep, y)
    flat = F.min(ky) == F.max(ky)  # a constant response has no correlation
    r2 = F.when(flat, F.lit(0.0)).otherwise(F.regr_r2(ky, kx))
    return [F.regr_slope(ky, kx).alias("slope"), r2.alias("r2"), F.count(kx).alias("n_used")]


def fit_gain(samples: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """Least-squares slope of y (steps) on x (power change); the gain is its size."""
    fitted = samples.groupBy(*(by or [])).agg(*_slope_stats(F.col(x), F.col(y), F.lit(True)))
    return fitted.withColumn("gain", F.abs("slope"))


def fit_gain_by_regime(samples: DataFrame, x: str, y: str, regime: str = "regime", min_x: float = 1e-4,
                       min_r2: float = 0.5, fallback: float = FALLBACK_GAIN, labels: list[str] | None = None) -> DataFrame:
    """Gain per regime: slope when the fit is good, else the median of |y / x|, else the fallback.

    Near-zero x is left out of the fit; fewer than two samples (before or after that) give the fallback. Every one of
    `labels` (the six regimes) has a row, also without samples.
    """
    xs, ys = F.col(x), F.col(y)
    usable = F.abs(xs) > min_x
    fitted = samples.groupBy(regime).agg(F.count("*").alias("n_samples"), *_slope_stats(xs, ys, usable))
    ratio = F.abs(ys / xs)
    medians = quantiles(samples.where(usable), [regime], ratio, {"_median": 0.5}).select(regime, "_median")
    every = bin_grid(samples.sparkSession.range(1), {regime: labels or [label for label, _, _ in K.REGIMES]})
    joined = every.join(fitted, regime, "left").join(medians, regime, "left").withColumns({
        "n_samples": F.coalesce("n_samples", F.lit(0)), "n_used": F.coalesce("n_used", F.lit(0))})
    enough = (F.col("n_samples") >= 2) & (F.col("n_used") >= 2)
    r2 = F.coalesce(F.col("r2"), F.lit(0.0))
    good = enough & (r2 >= min_r2) & (F.abs("slope") > 0)
    return joined.select(
        regime, "n_samples",
        F.when(good, F.abs("slope")).when(enough, F.col("_median")).otherwise(F.lit(fallback)).alias("Kp"),
        F.when(enough, r2).otherwise(F.lit(0.0)).alias("r2"),
        F.when(good, "linear_regression").when(enough, "median_ratio (low R^2)")
        .when(F.col("n_samples") < 2, "fallback").otherwise("fallback (samples too close to zero)").alias("method"),
        F.when(F.col("n_samples") < 2, "fallback (insufficient samples)").otherwise("ok").alias("status"))


def single_gain(samples: DataFrame, x: str, y: str, by: list[str], min_x: float = 1e-5, min_points: int = 3,
                default: float = DEFAULT_SINGLE_GAIN) -> DataFrame:
    """One gain per calibration set; too few usable points give the default."""
    fitted = samples.groupBy(*by).agg(*_slope_stats(F.col(x), F.col(y), F.abs(F.col(x)) > min_x))
    gain = F.when(F.col("n_used") < min_points, F.lit(default)).otherwise(F.abs("slope"))
    return fitted.select(*by, "n_used", gain.alias("gain"))


def origin_fit(samples: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Gain of a line through the origin: sum(xy) / sum(xx)."""
    xs, ys = F.col(x), F.col(y)
    return samples.groupBy(*by).agg(
        F.count("*").alias("n"), F.try_divide(F.sum(xs * ys), F.sum(xs * xs)).alias("gain"))


# ---- distribution tables --------------------------------------------------------------------


def histogram(df: DataFrame, by: list[str], col: str, bins: int = 50) -> DataFrame:
    """Equal-width bins from min to max per group, the last one closed; an empty bin has n = 0.

    A group with a single value gets bins from half a unit below to half a unit above it.
    """
    values = group_values(df, by, F.col(col))
    spans = values.groupBy("_g").agg(F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    margin = F.when(F.col("_min") == F.col("_max"), 0.5).otherwise(0.0)
    spans = spans.select("_g", (F.col("_min") - margin).alias("_lo"), (F.col("_max") + margin).alias("_hi"))
    spans = stage(spans, "spans")
    rows = merged_with_stats(values, spans)
    value, lo = F.col("_v"), F.col("_lo")
    width = (F.col("_hi") - lo) / bins
    edge = lambda k: k * width + lo
    guess = rows.withColumn("_k", F.least(F.floor((value - lo) / width), F.lit(bins - 1)).cast("int"))
    k = F.col("_k")  # the division may round across an edge; the edges decide
    at = F.when(value < edge(k), k - 1).when((value >= edge(k + 1)) & (k < bins - 1), k + 1).otherwise(k)
    counted = guess.groupBy("_g", at.alias("bin")).agg(F.sum("_c").alias("n"))
    every = spans.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return every.join(counted, ["_g", "bin"], "left").select(
        *[F.col(f"_g.{c}").alias(c) for c in by], "bin", edge(F.col("bin")).alias("left"), edge(F.col("bin") + 1).alias("right"),
        F.coalesce("n", F.lit(0)).alias("n"))


def ecdf(df: DataFrame, by: list[str], col: str, mode: str = "rank") -> DataFrame:
    """Empirical distribution, one row per distinct value with the span of positions its copies cover.

    y is position / n * 100 ("rank") or (position - 1) / (n - 1) * 100 ("unit") of the first and last copy.
    Copies are collapsed before anything is ordered, so ties cost nothing.
    """
    values = group_values(df, by, F.col(col))
    counted = values.groupBy("_g", F.col("_v").alias("value")).agg(F.count("*").alias("copies"))
    counted = counted.select(*[F.col(f"_g.{c}").alias(c) for c in by], "value", "copies")
    counted = stage(counted, "distinct")
    placed = ordered_scan(counted, by, None, ["value"], {"last_rank": ("sum", F.col("copies"))})
    totals = stage(values.groupBy("_g").agg(F.count("*").alias("n")), "sizes")
    joined = salted_join(placed.withColumn("_g", group_key(by)), totals, ["_g"], ["value"])
    first = F.col("last_rank") - F.col("copies") + 1
    y = (lambda r: r / F.col("n") * 100.0) if mode == "rank" else (
        lambda r: F.try_divide((r - 1).cast("double"), (F.col("n") - 1).cast("double")) * 100.0)
    return joined.select(*by, "value", "copies", first.alias("first_rank"), "last_rank",
                         y(first).alias("y_first"), y(F.col("last_rank")).alias("y_last"))


def box_stats(df: DataFrame, by: list[str], col: str) -> DataFrame:
    """Quartiles, whiskers (most extreme value within 1.5 IQR, at least the box edge) and the number of outliers."""
    quartiles = quantiles(df, by, F.col(col), {"q1": 0.25, "median": 0.5, "q3": 0.75})
    fences = quartiles.withColumns({
        "_low": F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), "_high": F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))})
    keyed = fences.select(group_key(by).alias("_g"), *[c for c in fences.columns if c not in by])
    fences = stage(keyed, "fences")
    rows = merged_with_stats(group_values(df, by, F.col(col)), fences)
    inside = F.col("_v").between(F.col("_low"), F.col("_high"))
    spans = rows.groupBy("_g").agg(
        F.min(F.when(inside, F.col("_v"))).alias("whisker_low"), F.max(F.when(inside, F.col("_v"))).alias("whisker_high"),
        F.sum(F.when(inside, 0).otherwise(F.col("_c"))).alias("outliers"))
    both = fences.join(spans, "_g").withColumns({
        "whisker_low": F.least("whisker_low", "q1"), "whisker_high": F.greatest("whisker_high", "q3")})
    return both.select(*[F.col(f"_g.{c}").alias(c) for c in by], "n", "q1", "median", "q3", "whisker_low",
                       "whisker_high", "outliers")


def kde_grid(df: DataFrame, by: list[str], col: str, points: int = 100) -> DataFrame:
    """Gaussian density on a grid from min to max per group, bandwidth std * n^(-1/5).

    Exact, in one aggregate: each value adds to `points` sums of its group, which are combined map-side, so rows are neither
    multiplied nor shuffled one by one.
    """
    values = group_values(df, by, F.col(col))
    spans = values.groupBy("_g").agg(
        F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.stddev_samp("_v").alias("_sd"))
    width = F.col("_sd") * F.pow(F.col("_n").cast("double"), F.lit(-0.2))
    spans = stage(spans.where(F.col("_sd") > 0).withColumn("_h", width).drop("_sd"), "spans")
    rows = merged_with_stats(values, spans)
    place = lambda grid: F.col("_lo") + grid * (F.col("_hi") - F.col("_lo")) / (points - 1)
    kernel = lambda i: F.col("_c") * F.exp(-0.5 * F.pow((F.col("_v") - place(i)) / F.col("_h"), F.lit(2.0)))
    sums = rows.groupBy("_g", "_n", "_lo", "_hi", "_h").agg(F.array(*[F.sum(kernel(i)) for i in range(points)]).alias("_k"))
    norm = F.col("_n") * F.col("_h") * math.sqrt(2.0 * math.pi)
    grid = sums.select("_g", "_n", "_lo", "_hi", "_h", F.posexplode("_k").alias("grid", "_s"))
    return grid.select(*[F.col(f"_g.{c}").alias(c) for c in by], "grid", place(F.col("grid")).alias("x"), (F.col("_s") / norm).alias("density"))
