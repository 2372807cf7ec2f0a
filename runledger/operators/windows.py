"""Running and positional results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.functions.derive import flag
from runledger.operators.scale import ordered_scan, salted_join, stage


def running_success(df: DataFrame, by: list[str], order: str = "case_id", success: Column | None = None) -> DataFrame:
    """Cases, successes and success rate so far after every case, in the order of an integer case id."""
    hit = flag(success if success is not None else F.col("validation_success_5")).cast("long")
    scanned = ordered_scan(
        df, by, None, [order],
        {"n_so_far": ("sum", F.lit(1).cast("long")), "successes_so_far": ("sum", hit)},
    )
    return scanned.withColumn("running_rate", F.col("successes_so_far") / F.col("n_so_far"))


def snapshots(df: DataFrame, by: list[str], every: int = 50, order: str = "case_id") -> DataFrame:
    """Running counts of every stage at each `every`-th case."""
    count = lambda name: ("sum", flag(F.col(name)).cast("long"))
    scanned = ordered_scan(
        df.select(*by, order, "parsing_success", "simulation_success", "validation_success_1",
                  "validation_success_2", "validation_success_5"),
        by, None, [order],
        {"n": ("sum", F.lit(1).cast("long")), "parsed": count("parsing_success"),
         "simulated": count("simulation_success"), "ok_1": count("validation_success_1"),
         "ok_2": count("validation_success_2"), "ok_5": count("validation_success_5")},
    )
    return scanned.where(F.col("n") % every == 0).select(*by, order, "n", "parsed", "simulated", "ok_1", "ok_2", "ok_5")


def run_summary(trace: DataFrame, run: str = "run_id", step: str = "step", power: str = "power") -> DataFrame:
    """First, last and largest power of every run; partial aggregates, no sort.

    A power that is no finite number is missing: the final power of a run that ends in NaN is null, not its last number.
    """
    value = F.when(~F.isnan(power) & (F.abs(power) < float("inf")), F.col(power))
    return trace.groupBy(run).agg(
        F.min_by(value, F.col(step)).alias("initial_power"), F.max_by(value, F.col(step)).alias("final_power"),
        F.max(value).alias("peak_power"), F.count("*").alias("points"))


def at_nearest_time(trace: DataFrame, t0: float, t: str, value: str, run: str = "run_id",
                    step: str = "step") -> DataFrame:
    """Value at the sample nearest t0 (first on ties), last value, min and max from that sample on.

    The first aggregate finds the sample per run; the second one needs its step beside every row. The join is
    salted by step, so a run that holds a large share of the rows is read by many tasks.
    """
    nearest = trace.groupBy(run).agg(
        F.min_by(F.struct(F.col(step).alias("s"), F.col(value).alias("v")),
                 F.struct(F.abs(F.col(t) - t0), F.col(step))).alias("_at"),
        F.max_by(value, step).alias("final_value"))
    nearest = nearest.select(run, F.col("_at.s").alias("_from"), F.col("_at.v").alias("initial_value"), "final_value")
    nearest = stage(nearest, "nearest")
    later = salted_join(trace.select(run, step, value), nearest.select(run, "_from"), [run], [step])
    later = later.where(F.col(step) >= F.col("_from"))
    spread = later.groupBy(run).agg(F.min(value).alias("min_value"), F.max(value).alias("max_value"))
    return nearest.join(spread, run).drop("_from")


def order_by_case(df: DataFrame, case: str = "case_id") -> DataFrame:
    return df.orderBy(case)


def head(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    return df.orderBy(*order).limit(n)


def failed_cases(df: DataFrame, suite: list[str], cap: int | None = 20, ids: list[str] | None = None) -> DataFrame:
    """Failures of every suite that has at most `cap` of them (None: of all); only those with a computed error are listed.

    A suite that fails very often is dropped by the join, so its rows must not meet in one task on the way there:
    the join is broadcast or salted by `ids`.
    """
    failed = df.where(~flag(F.col("validation_success_5")))
    few = failed.groupBy(*suite).agg(F.count("*").alias("failures"))
    few = few if cap is None else few.where(F.col("failures") <= cap)
    return salted_join(failed.where(F.col("final_error") > 0), stage(few, "few"), suite, ids or ["case_id"])
