"""Column -> Column classifiers: actuation pattern, size and sign of the power change, outcome."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values ---------------------------------------------------------------------------
MAIN_PATTERNS = ["single_b1", "single_b2", "simultaneous", "sequential"]
POWER_BINS = ["Small", "Medium", "Large"]
TOLERANCES = [1, 2, 3, 5, 10]
# (label, low inclusive, high exclusive) on target - initial
REGIMES = [
    ("large_dec", -1.00, -0.30),
    ("medium_dec", -0.30, -0.10),
    ("small_dec", -0.10, 0.00),
    ("small_inc", 0.00, 0.10),
    ("medium_inc", 0.10, 0.30),
    ("large_inc", 0.30, 1.00),
]
POWER_BIN_LIMITS = {
    "closed": (0.1, 0.3),
    "closed_eps": (0.10001, 0.30001),
    "half_open": (0.1001, 0.3001),
}
DELTA_BANDS = ["Very Low (<1%)", "Low (1~10%)", "Mid (10~30%)", "High (30~50%)", "Very High (>50%)"]
# ---------------------------------------------------------------------------------------------


def pattern_by_time(b1_time: Column, b2_time: Column, none_label: str | None = "none_active",
                    missing_label: str | None = "parsing_failure", has_params: Column | None = None) -> Column:
    """Pattern from start times. A bank is active when its time is > 0; a missing time counts as 0.

    `has_params` is false where the whole command is missing (default: both times null).
    `none_label`: "none" for training tables, "none_active" for reports, None for figures.
    """
    t1, t2 = F.coalesce(b1_time, F.lit(0.0)), F.coalesce(b2_time, F.lit(0.0))
    present = has_params if has_params is not None else (b1_time.isNotNull() | b2_time.isNotNull())
    on1, on2 = t1 > 0, t2 > 0
    return (
        F.when(~present, F.lit(missing_label))
        .when(on1 & ~on2, "single_b1")
        .when(on2 & ~on1, "single_b2")
        .when(on1 & on2 & (F.abs(t1 - t2) < 0.01), "simultaneous")
        .when(on1 & on2, "sequential")
        .otherwise(F.lit(none_label))
    )


def is_close(a: Column, b: Column, abs_tol: float, rel_tol: float = 1e-9) -> Column:
    """|a-b| <= max(rel_tol * max(|a|, |b|), abs_tol)."""
    return F.abs(a - b) <= F.greatest(F.greatest(F.abs(a), F.abs(b)) * rel_tol, F.lit(abs_tol))


def pattern_by_motion(cmd: dict[str, Column], init_b1: Column, init_b2: Column,
                      pos_tol: float = 0.5, time_tol: float = 0.05) -> Column:
    """Pattern from motion: a bank moves when its speed is > 0 and it ends more than `pos_tol` away."""
    moves1 = F.coalesce((cmd["b1_speed"] > 0) & (F.abs(cmd["b1_pos"] - init_b1) > pos_tol), F.lit(False))
    moves2 = F.coalesce((cmd["b2_speed"] > 0) & (F.abs(cmd["b2_pos"] - init_b2) > pos_tol), F.lit(False))
    return (
        F.when(cmd["b1_speed"].isNull() & cmd["b2_speed"].isNull(), F.lit(None))
        .when(~moves1 & ~moves2, "no_motion")
        .when(~moves2, "single_b1")
        .when(~moves1, "single_b2")
        .when(is_close(cmd["b1_time"], cmd["b2_time"], time_tol), "simultaneous")
        .otherwise("sequential")
    )


def power_bin(target: Column, mode: str = "closed") -> Column:
    """Small / Medium / Large by |target - 1|; `mode` picks one of the three published edge rules."""
    small, medium = POWER_BIN_LIMITS[mode]
    size = F.abs(target - 1.0)
    below = (lambda limit: size < limit) if mode == "half_open" else (lambda limit: size <= limit)
    return (
        F.when(target.isNull(), "Unknown").when(below(small), "Small").when(below(medium), "Medium").otherwise("Large")
    )


def regime_of_delta(delta: Column) -> Column:
    """Signed regime; a change outside every range belongs to the outer regime of its sign."""
    expr = F.when(delta.isNull(), F.lit(None))
    for label, lo, hi in REGIMES:
        expr = expr.when((delta >= lo) & (delta < hi), label)
    return expr.when(delta >= 0, "large_inc").otherwise("large_dec")


def regime(init: Column, target: Column) -> Column:
    return regime_of_delta(target - init)


def window_bin(window: Column) -> Column:
    """Right-closed cut at 59.9 / 70 / 80 / 90 / 100.1, first edge included; outside -> "nan"."""
    return (
        F.when(window.isNull() | (window < 59.9) | (window > 100.1), "nan")
        .when(window <= 70.0, "60_70")
        .when(window <= 80.0, "70_80")
        .when(window <= 90.0, "80_90")
        .otherwise("90_100")
    )


def window_band(window: Column) -> Column:
    """Left-closed bands of width 10 from 60 to 100 (100 included); accepts text."""
    w = window.try_cast("double")
    return (
        F.when(w.isNull(), "Error")
        .when((w >= 60) & (w < 70), "60-70")
        .when((w >= 70) & (w < 80), "70-80")
        .when((w >= 80) & (w < 90), "80-90")
        .when((w >= 90) & (w <= 100), "90-100")
        .otherwise("Outlier")
    )


def delta_band(init: Column, target: Column) -> Column:
    """Size of the relative change |target - init| / init."""
    p0, p1 = init.try_cast("double"), target.try_cast("double")
    delta = F.try_divide(F.abs(p1 - p0), p0)
    very_low, low, mid, high, very_high = DELTA_BANDS
    return (
        F.when(p0.isNull() | p1.isNull() | (p0 == 0), "Error")
        .when(delta < 0.01, very_low)
        .when(delta < 0.10, low)
        .when(delta < 0.30, mid)
        .when(delta <= 0.50, high)
        .otherwise(very_high)
    )


def level_band(target: Column, small_from: float = 220.9, medium_from: float = 171.8) -> Column:
    """Bands on the absolute target level: a small reduction stays above 220.9."""
    return (
        F.when(target.isNull(), F.lit(None))
        .when(target >= small_from, "small")
        .when(target >= medium_from, "medium")
        .otherwise("large")
    )


def severity3(reactivity: Column) -> Column:
    return (
        F.when(reactivity.isNull(), F.lit(None))
        .when(reactivity > -0.009, "normal")
        .when(reactivity >= -0.015, "risky")
        .otherwise("shutdown")
    )


def status2(power_final: Column) -> Column:
    return F.when(power_final < 10.0, "SD").otherwise("OP")


def direction(target: Column, base: float = 1.0) -> Column:
    """increase / decrease; equal to the base level is neither."""
    return F.when(target > base, "increase").when(target < base, "decrease")


def best_tier(error: Column, target: Column) -> Column:
    """Tightest tolerance band met, as text; "fail" outside the widest; null when not scored."""
    expr = F.when(error.isNull() | target.isNull(), F.lit(None))
    for tol in TOLERANCES:
        expr = expr.when(error <= F.abs(target) * (tol / 100.0), str(tol))
    return expr.otherwise("fail")


def outcome_stage(parsed: Column, simulated: Column, actual_final: Column, sim_error: Column | None = None):
    """(stage, error text) of a case: the first step that failed, or "scored"."""
    ok = lambda flag: F.coalesce(flag, F.lit(False))
    stage = (
        F.when(~ok(parsed), "parse_failure")
        .when(~ok(simulated), "simulation_failure")
        .when(actual_final.isNull(), "result_parse_failure")
        .otherwise("scored")
    )
    sim_text = F.coalesce(sim_error, F.lit("Simulation failed")) if sim_error is not None else F.lit("Simulation failed")
    error = (
        F.when(~ok(parsed), "Parsing failed")
        .when(~ok(simulated), sim_text)
        .when(actual_final.isNull(), "Result parsing failed")
    )
    return stage, error


def change_label(init: Column, target: Column, up: str = "increase", down: str = "decrease") -> Column:
    """Text such as "increase 12.3%"."""
    from runledger.functions.text import fixed

    change = (target - init) / init * 100.0
    return F.concat(F.when(target > init, up).otherwise(down), F.lit(" "), fixed(F.abs(change), 1), F.lit("%"))
