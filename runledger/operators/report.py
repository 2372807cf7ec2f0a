"""Grouped report tables over scored runs.

Inputs carry `validation_success_1/2/3/5/10`, `final_error`, `scenario_type`, `power_bin` ... as produced by
`score_runs`. All bands come from one pass of conditional sums; nothing is filtered per model.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.functions import classify as K
from runledger.functions import derive as D
from runledger.operators.joins import literal_map
from runledger.operators.scale import order_stats, quantiles

TOLS = K.TOLERANCES


def score_runs(runs: DataFrame, bin_mode: str = "closed") -> DataFrame:
    """final_error, the five band flags, pattern and size bin of every run."""
    actual, target = F.col("actual_final"), F.col("target_final")
    error = D.final_error(actual, target)
    return runs.withColumns({
        "final_error": error,
        **D.success_columns(error, target),
        "scenario_type": K.pattern_by_time(F.col("b1_time"), F.col("b2_time")),
        "power_bin": K.power_bin(target, bin_mode),
    })


def normalize_results(df: DataFrame) -> DataFrame:
    """Report-ready records: missing target -> 1.0, missing flags -> false, 0/1 copies, |change|, classes.

    `predicted_params` is a struct; a missing one classifies as a parsing failure.
    """
    target = F.coalesce(F.col("target_final"), F.lit(1.0))
    flags = {f"validation_success_{t}": D.flag(F.col(f"validation_success_{t}")) for t in TOLS}
    ints = {f"is_success_{t}": F.col(f"validation_success_{t}").cast("int") for t in TOLS}
    cleaned = df.withColumns({"target_final": target, **flags}).withColumns(ints)
    params = F.col("predicted_params")
    return cleaned.withColumns({
        "is_failure_5pct": 1 - F.col("is_success_5"),
        "delta_p": F.abs(F.col("target_final") - 1.0),
        "power_bin": K.power_bin(F.col("target_final")),
        "scenario_type": K.pattern_by_time(params["b1_time"], params["b2_time"], has_params=params.isNotNull()),
    })


def rate(successes: Column, total: Column) -> Column:
    return F.try_divide(successes.cast("double"), total.cast("double"))


def _hits(tol: int) -> Column:
    return F.count_if(D.flag(F.col(f"validation_success_{tol}")))


def band_counts(df: DataFrame, by: list[str], tols: list[int] = TOLS) -> DataFrame:
    """Long table: by..., tolerance, successes, total, simulated (one pass for all bands)."""
    wide = df.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if(D.flag(F.col("simulation_success"))).alias("simulated"),
        *[_hits(t).alias(f"_s{t}") for t in tols],
    )
    bands = F.array(*[F.struct(F.lit(t).alias("tolerance"), F.col(f"_s{t}").alias("successes")) for t in tols])
    return wide.select(*by, "total", "simulated", F.inline(bands))


def success_by_tolerance(df: DataFrame, by: list[str], denom: str | int = "all") -> DataFrame:
    """Count and rate per band over all rows, the simulated rows, or a fixed number of cases."""
    long = band_counts(df, by)
    n = {"all": F.col("total"), "simulated": F.col("simulated")}.get(denom) if isinstance(denom, str) else F.lit(denom)
    return long.select(*by, "tolerance", "successes", n.cast("long").alias("denominator"),
                       rate(F.col("successes"), n).alias("success_rate"))


def funnel(df: DataFrame, by: list[str]) -> DataFrame:
    """parsed / total, simulated / parsed, within 5 % / simulated."""
    agg = df.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if(D.flag(F.col("parsing_success"))).alias("parsed"),
        F.count_if(D.flag(F.col("simulation_success"))).alias("simulated"),
        _hits(5).alias("valid"),
    )
    return agg.withColumns({
        "parsed_rate": rate(F.col("parsed"), F.col("total")),
        "simulated_rate": rate(F.col("simulated"), F.col("parsed")),
        "valid_rate": rate(F.col("valid"), F.col("simulated")),
    })


def success_rate_by(df: DataFrame, by: list[str], tol: int = 5) -> DataFrame:
    agg = df.groupBy(*by).agg(F.count("*").alias("n"), _hits(tol).alias("successes"))
    return agg.withColumn("success_rate", rate(F.col("successes"), F.col("n")))


def stratify(df: DataFrame, model: str = "model") -> DataFrame:
    """model x pattern x size bin, main patterns only, empty cells absent."""
    main = df.where(F.col("scenario_type").isin(*K.MAIN_PATTERNS))
    return success_rate_by(main, [model, "scenario_type", "power_bin"])


def stratify_pivot(df: DataFrame, model: str = "model") -> DataFrame:
    """The same as one column per size bin: rate in % and count, rounded to one digit."""
    main = df.where(F.col("scenario_type").isin(*K.MAIN_PATTERNS))
    cells = main.groupBy(model, "scenario_type").pivot("power_bin", K.POWER_BINS)
    return cells.agg(
        F.round(F.avg(F.col("validation_success_5").cast("int")) * 100.0, 1).alias("rate_pct"),
        F.count(F.lit(1)).alias("n"),
    )


def pattern_success(df: DataFrame, model: str = "model") -> DataFrame:
    out = success_rate_by(df, [model, "scenario_type"])
    return out.select(model, "scenario_type", F.round(F.col("success_rate") * 100.0, 1).alias("success_rate"),
                      F.col("n").alias("total_cases"))


def value_shares(df: DataFrame, by: list[str], col: str) -> DataFrame:
    """Value counts with their share inside the group (the window sees one row per distinct value)."""
    counts = df.groupBy(*by, col).agg(F.count("*").alias("n"))
    whole = Window.partitionBy(*by)
    return counts.withColumn("share", F.col("n") / F.sum("n").over(whole))


def _join_groups(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Inner join of two grouped results on null-safe group columns."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") for c in by], *[c for c in right.columns if c not in by])
    on = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in by]
    return left.join(renamed, on).drop(*[f"_r_{c}" for c in by])


def describe(df: DataFrame, by: list[str], col: str, qs: dict[str, float] | None = None) -> DataFrame:
    """count, mean, sample std, min, exact quantiles, max of the values; null and NaN are no values."""
    qs = qs or {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
    x = D.nan_to_null(F.col(col))
    basic = df.where(x.isNotNull()).groupBy(*by).agg(
        F.count("*").alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
        F.min(x).alias("min"), F.max(x).alias("max"),
    )
    return _join_groups(basic, quantiles(df, by, x, qs).drop("n"), by)


def error_summary(df: DataFrame, by: list[str], col: str = "final_error") -> DataFrame:
    """mean, median, max, min and the population standard deviation; null and NaN are no values."""
    x = D.nan_to_null(F.col(col))
    basic = df.where(x.isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(x).alias("mean"), F.max(x).alias("max"), F.min(x).alias("min"),
        F.stddev_pop(x).alias("std_pop"),
    )
    return _join_groups(basic, quantiles(df, by, x, {"median": 0.5}).drop("n"), by)


def rank_percentile(df: DataFrame, by: list[str], col: str, qs: dict[str, float] | None = None) -> DataFrame:
    """The sorted element at index int(q * n), without interpolation."""
    qs = qs or {"p95": 0.95, "p99": 0.99}
    return order_stats(df, by, F.col(col), {k: (lambda n, q=q: F.floor(n * F.lit(q))) for k, q in qs.items()})


def unpivot_errors(df: DataFrame, keep: list[str]) -> DataFrame:
    """One row per case and parameter with its absolute error."""
    pairs = F.array(*[F.struct(F.lit(p).alias("param"), F.col(f"{p}_error").alias("error")) for p in D.COMMAND])
    return df.select(*keep, F.inline(pairs))


def param_error_stats(df: DataFrame) -> DataFrame:
    """MAE, RMSE and median error per parameter over parsed rows."""
    long = unpivot_errors(df, []).withColumn("error", D.nan_to_null(F.col("error"))).where(F.col("error").isNotNull())
    basic = long.groupBy("param").agg(
        F.count("*").alias("n"), F.avg("error").alias("mae"),
        F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse"))
    return _join_groups(basic, quantiles(long, ["param"], F.col("error"), {"median": 0.5}).drop("n"), ["param"])


def param_mae_by_class(df: DataFrame, cls: str = "scenario_type") -> DataFrame:
    long = unpivot_errors(df, [cls]).where(F.col("error").isNotNull())
    return long.groupBy(cls, "param").agg(F.count("*").alias("n"), F.avg("error").alias("mae"))


def failure_rows(df: DataFrame) -> DataFrame:
    """Runs outside 5 % with the columns of the failure report."""
    cols = ["model", "case_id", "P_initial", "P_target", "actual_final", "delta_p", "power_bin", "scenario_type",
            "final_error"]
    failed = df.where(~D.flag(F.col("validation_success_5")))
    return failed.withColumns({
        "P_initial": F.lit(1.0), "P_target": F.col("target_final"), "delta_p": F.abs(F.col("target_final") - 1.0),
    }).select(*[c for c in cols if c in [*df.columns, "P_initial", "P_target", "delta_p"]])


def failure_distribution(df: DataFrame, model: str = "model") -> DataFrame:
    """Per model with failures: mean, median, std of |change| and the share of every size bin (0 included)."""
    failed = failure_rows(df)
    basic = failed.groupBy(model).agg(
        F.count("*").alias("failures"), F.avg("delta_p").alias("mean_delta"),
        F.stddev_samp("delta_p").alias("std_delta"),
        *[F.count_if(F.col("power_bin") == b).alias(f"_{b}") for b in K.POWER_BINS],
    )
    joined = _join_groups(basic, quantiles(failed, [model], F.col("delta_p"), {"median_delta": 0.5}).drop("n"), [model])
    bins = F.array(*[F.struct(F.lit(b).alias("power_bin"), F.col(f"_{b}").alias("n")) for b in K.POWER_BINS])
    return joined.select(model, "failures", "mean_delta", "median_delta", "std_delta", F.inline(bins)).withColumn(
        "share_pct", F.col("n") / F.col("failures") * 100.0)


def success_by_band(df: DataFrame, band: str = "window_band") -> DataFrame:
    return success_rate_by(df.where(D.flag(F.col("simulation_success"))), [band]).orderBy(band)


def multi_tol_by_band(df: DataFrame, band: str = "delta_band") -> DataFrame:
    """Rates within 1, 3 and 5 % for the Low, Mid and High bands."""
    shown = df.where(D.flag(F.col("simulation_success")) & F.col(band).isin(*K.DELTA_BANDS[1:4]))
    agg = shown.groupBy(band).agg(F.count("*").alias("n"), *[_hits(t).alias(f"s{t}") for t in (1, 3, 5)])
    return agg.withColumns({f"rate_{t}": rate(F.col(f"s{t}"), F.col("n")) for t in (1, 3, 5)})


def success_by_range(df: DataFrame, by: list[str], mode: str = "closed", target: str = "target_final") -> DataFrame:
    """Within 5 % by size bin under one of the three edge rules."""
    binned = df.where(F.col(target).isNotNull()).withColumn("range", K.power_bin(F.col(target), mode))
    return success_rate_by(binned, [*by, "range"])


def success_by_direction(df: DataFrame, by: list[str]) -> DataFrame:
    moved = df.withColumn("direction", K.direction(F.col("target_final"))).where(F.col("direction").isNotNull())
    return success_rate_by(moved, [*by, "direction"])


def success_by_regime(df: DataFrame, gains: dict[str, float]) -> DataFrame:
    """Within 5 % by regime, with its place in the fixed order and its gain."""
    labelled = df.withColumn("regime", K.regime(F.col("target_initial"), F.col("target_final")))
    order = {label: i for i, (label, _, _) in enumerate(K.REGIMES)}
    out = success_rate_by(labelled.where(F.col("regime").isNotNull()), ["regime"])
    return out.withColumns({
        "regime_order": F.try_element_at(literal_map(order), F.col("regime")),
        "Kp": F.try_element_at(literal_map(gains), F.col("regime")),
    }).orderBy("regime_order")


def severe_failures(df: DataFrame, by: list[str]) -> DataFrame:
    """Scored runs outside 10 % per group."""
    return df.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("final_error").isNotNull() & ~D.flag(F.col("validation_success_10"))).alias("severe"),
    )


def profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row per column: rows, min, max, mean."""
    aggs = [F.count("*").alias("_rows")]
    for c in cols:
        aggs += [F.min(c).alias(f"_min_{c}"), F.max(c).alias(f"_max_{c}"), F.avg(c).alias(f"_avg_{c}")]
    lines = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"_min_{c}").cast("double").alias("min"),
                 F.col(f"_max_{c}").cast("double").alias("max"), F.col(f"_avg_{c}").cast("double").alias("mean"))
        for c in cols
    ])
    return df.agg(*aggs).select(F.col("_rows").alias("rows"), F.inline(lines))


def compare_configs(df: DataFrame, config: str, first: str, second: str) -> DataFrame:
    """Pattern shares and band rates (in %) under two initial configurations, and second - first in points."""
    measures = [(f"pattern:{p}", F.col("scenario_type") == p) for p in K.MAIN_PATTERNS]
    measures += [(f"within:{t}", D.flag(F.col(f"validation_success_{t}"))) for t in (1, 5, 10)]
    aggs = []
    for side, name in (("a", first), ("b", second)):
        here = F.col(config) == name
        aggs.append(F.count_if(here).alias(f"_n_{side}"))
        aggs += [F.count_if(here & D.flag(test)).alias(f"_{side}{i}") for i, (_, test) in enumerate(measures)]
    row = df.where(F.col(config).isin(first, second)).agg(*aggs)
    pct = lambda side, i: rate(F.col(f"_{side}{i}"), F.col(f"_n_{side}")) * 100.0
    lines = F.array(*[
        F.struct(F.lit(name).alias("measure"), pct("a", i).alias("first_pct"), pct("b", i).alias("second_pct"))
        for i, (name, _) in enumerate(measures)
    ])
    return row.select(F.inline(lines)).withColumn("difference", F.col("second_pct") - F.col("first_pct"))


def summarize_configs(df: DataFrame, config: str) -> DataFrame:
    """One row per configuration: rates in %, use of the five motion patterns, and mean, median and largest error in %.

    A bank moves if its position leaves the run's own initial one; records without a command have no pattern.
    """
    moved = K.pattern_by_motion({c: F.col(f"predicted_params.{c}") for c in D.COMMAND}, F.col("init_b1"), F.col("init_b2"))
    rows = df.withColumns({"_pattern": F.when(F.col("predicted_params").isNotNull(), moved), "_pct": D.nan_to_null(F.col("final_error")) * 100.0})
    share = lambda test: F.count_if(D.flag(test)) / F.count("*") * 100.0
    basic = rows.groupBy(config).agg(
        F.count("*").alias("n"), share(F.col("parsing_success")).alias("parsed_pct"), share(F.col("simulation_success")).alias("simulated_pct"),
        *[share(F.col(f"validation_success_{t}")).alias(f"within_{t}_pct") for t in (1, 5, 10)],
        *[F.count_if(D.flag(F.col("_pattern") == p)).alias(p) for p in [*K.MAIN_PATTERNS, "no_motion"]],
        F.avg("_pct").alias("mean_error_pct"), F.max("_pct").alias("max_error_pct"))
    medians = quantiles(rows, [config], F.col("_pct"), {"median_error_pct": 0.5}).drop("n")
    renamed = medians.withColumnRenamed(config, "_config")
    return basic.join(renamed, basic[config].eqNullSafe(renamed["_config"]), "left").drop("_config")


def range_per_regime(samples: DataFrame, x: str, y: str, regime: str = "regime") -> DataFrame:
    return samples.groupBy(regime).agg(
        F.count("*").alias("n"), F.min(x).alias("x_min"), F.max(x).alias("x_max"),
        F.min(y).alias("y_min"), F.max(y).alias("y_max"))


def upper_median(df: DataFrame, by: list[str], col: str) -> DataFrame:
    """Smallest and largest value and the sorted element at n // 2."""
    ranks = {"min": lambda n: F.lit(0), "upper_median": lambda n: F.floor(n / 2), "max": lambda n: n - 1}
    return order_stats(df, by, F.col(col), ranks)


def latest_per_source(df: DataFrame, source: list[str], version: list[str]) -> DataFrame:
    """Newest row of every source; `version` orders the rows and must be unique inside a source."""
    rest = [c for c in df.columns if c not in source]
    newest = F.max_by(F.struct(*rest), F.struct(*[F.col(c) for c in version])).alias("_row")
    return df.groupBy(*source).agg(newest).select(*source, "_row.*")
