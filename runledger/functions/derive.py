"""Column -> Column derived values: scores, error rates, rod commands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from runledger.functions.classify import TOLERANCES

# ---- fixed values ---------------------------------------------------------------------------
INIT_B1, INIT_B2 = 180.0, 100.0
POSITION_MIN, POSITION_MAX = 0.0, 180.0
DEFAULT_SPEED = 2.0
MIN_MOVE_TIME = 0.1
COMMAND = ["b1_pos", "b1_time", "b1_speed", "b2_pos", "b2_time", "b2_speed"]
# ---------------------------------------------------------------------------------------------


def nan_to_null(c: Column) -> Column:
    """Spark orders NaN above every number; analytics here treat it as missing."""
    return F.when(~F.isnan(c), c)


def flag(c: Column) -> Column:
    """Missing counts as not successful."""
    return F.coalesce(c, F.lit(False))


def final_error(actual: Column, target: Column) -> Column:
    return F.abs(actual - target)


def within(error: Column, target: Column, tol_pct: float) -> Column:
    return flag(error <= F.abs(target) * (tol_pct / 100.0))


def success_columns(error: Column, target: Column, tols=TOLERANCES) -> dict[str, Column]:
    return {f"validation_success_{t}": within(error, target, t) for t in tols}


def pct_error(actual: Column, target: Column, mode: str = "relative") -> Column:
    """Terminal error.

    absolute  |a-t| * 100, right when the base level is 1.0
    relative  |a-t| / |t| * 100
    inf       |a-t| / |t|, infinity for a zero target (a rate, not a percentage)
    positive  |a-t| / t * 100, 0 unless the target is positive
    floored   |a-t| / |t| * 100 with the base forced to 1.0 when |t| <= 1e-6
    """
    diff = F.abs(actual - target)
    if mode == "absolute":
        return diff * 100.0
    if mode == "relative":
        return F.try_divide(diff, F.abs(target)) * 100.0
    if mode == "inf":
        return F.when(F.abs(target) > 0, diff / F.abs(target)).when(diff.isNotNull(), F.lit(float("inf")))
    if mode == "positive":
        return F.when(target > 0, diff / target * 100.0).when(diff.isNotNull(), F.lit(0.0))
    if mode == "floored":
        base = F.when(F.abs(target) > 1e-6, F.abs(target)).otherwise(F.lit(1.0))
        return diff / base * 100.0
    raise ValueError(f"unknown mode {mode!r}")


def with_pct_error(df, name: str = "pct_error"):
    """Add the error in % of the base level 1.0: from the two powers, or in reduced records without them from `final_error`."""
    if {"actual_final", "target_final"} <= set(df.columns):
        return df.withColumn(name, pct_error(F.col("actual_final"), F.col("target_final"), "absolute"))
    if "final_error" in df.columns:
        return df.withColumn(name, F.col("final_error") * 100.0)
    raise ValueError("neither powers nor final_error")


def success_from_error(pct: Column, limit: float = 5.0) -> Column:
    return flag(pct <= limit).cast("int")


def success_from_flag(stored: Column) -> Column:
    return flag(stored).cast("int")


def relative_change(init: Column, target: Column) -> Column:
    return (target - init) / init * 100.0


def round_clip(x: Column, lo: float = POSITION_MIN, hi: float = POSITION_MAX) -> Column:
    """Round half to even, then clip; an integer rod position."""
    rounded = F.bround(x.cast("double"), 0)
    return F.when(rounded.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), rounded))).cast("int")


def gain_command(init: Column, target: Column, gain: Column,
                 init_b1: float = INIT_B1, init_b2: float = INIT_B2) -> dict[str, Column]:
    """Proportional command: bank 2 takes error * gain steps, what it cannot take spills to bank 1."""
    wanted = F.lit(init_b2) + (target - init) * gain
    b2 = F.greatest(F.lit(POSITION_MIN), F.least(F.lit(POSITION_MAX), wanted))
    spill = (
        F.when(wanted > POSITION_MAX, wanted - POSITION_MAX).when(wanted < POSITION_MIN, wanted).otherwise(F.lit(0.0))
    )
    b1 = F.when(wanted.isNotNull(),
                F.greatest(F.lit(POSITION_MIN), F.least(F.lit(POSITION_MAX), F.lit(init_b1) + spill)))
    out = {}
    for name, pos, start in (("b1", b1, init_b1), ("b2", F.when(wanted.isNotNull(), b2), init_b2)):
        dist = F.abs(pos - start)
        moving = dist > 0
        out[f"{name}_pos"] = F.round(pos, 3)
        out[f"{name}_time"] = F.when(
            moving, F.round(F.greatest(F.lit(MIN_MOVE_TIME), dist / DEFAULT_SPEED), 3)
        ).when(dist.isNotNull(), F.lit(0.0))
        out[f"{name}_speed"] = F.when(moving, F.lit(DEFAULT_SPEED)).when(dist.isNotNull(), F.lit(0.0))
    return out


def log_floor(x: Column, eps: float = 1e-3) -> Column:
    """Replace exact zeros before a logarithmic display."""
    return F.when(x == 0, F.lit(eps)).otherwise(x)


def valid_run(t_fuel_final: Column, t_cool_final: Column, power_final: Column, coldest: float = -200.0) -> Column:
    """Predicate: physically possible temperatures and a finite power."""
    finite = ~F.isnan(power_final) & (F.abs(power_final) < float("inf"))
    return flag(~(t_fuel_final < coldest) & ~(t_cool_final < coldest) & finite)


def plausible(pred_rho: Column, rho: Column, pred_dur: Column, dur: Column) -> Column:
    return flag((F.abs(pred_rho - rho) < 0.005) & (F.abs(pred_dur - dur) < 5.0))


def power_to_mw(fraction: Column, nominal: float = 250.0) -> Column:
    return fraction * nominal


def kelvin_to_celsius(kelvin: Column) -> Column:
    return kelvin - 273.15


def ramp_value(t: Column, start: Column, duration: Column, total: Column) -> Column:
    """0 before `start`, linear to `total` over `duration`, constant afterwards."""
    return (
        F.when(t < start, F.lit(0.0)).when(t < start + duration, total / duration * (t - start)).otherwise(total)
    )


def param_errors(pred: dict[str, Column], truth: dict[str, Column]) -> dict[str, Column]:
    return {f"{p}_error": F.abs(pred[p] - truth[p]) for p in COMMAND}
