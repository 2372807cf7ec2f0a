"""Parameter tables. Every generator maps an id table to rows, so it scales with the ids and any lost
partition is regenerated identically: all draws are hashes of (seed, tag, id)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.functions.derive import COMMAND
from runledger.functions.hashing import add_draws, choice, integer_between, real_between
from runledger.functions.text import run_name
from runledger.operators.scale import stage

# ---- fixed values ---------------------------------------------------------------------------
FAMILY_SHARES = {"single": 0.60, "simultaneous": 0.30, "sequential": 0.10}
# Ranges of the default configuration; bank "coarse" starts at 180, bank "fine" at 100.
# family -> bank -> (position lo, hi, speed lo, hi)
MIXTURE_RANGES = {
    "single": {"coarse": (60, 180, 0.5, 3.0), "fine": (70, 160, 0.2, 2.0)},
    "simultaneous": {"coarse": (80, 180, 0.5, 2.5), "fine": (70, 140, 0.2, 1.5)},
    "sequential": {"coarse": (70, 180, 0.5, 3.0), "fine": (80, 150, 0.3, 2.0)},
}
# family -> (start time lo, hi); the second mover of a sequence starts 3..8 s after the first
MIXTURE_TIMES = {"single": (2.0, 15.0), "simultaneous": (2.0, 10.0), "sequential": (2.0, 8.0)}
SEQUENCE_GAP = (3.0, 8.0)
COARSE_START, FINE_START = 180, 100

WINDOW_RANGES = [(60, 80), (80, 100), (100, 120), (120, 140), (140, 160)]
BORON_RANGES = [(0, 200), (200, 400), (400, 600), (600, 800), (800, 1000)]
INIT_CASES = ["case1", "case2"]
MOVE_TYPES = ["A_only", "B_only", "Simultaneous", "Sequential"]

UNIFORM_RANGES = {"input_reactivity": (-0.020, -0.0001), "input_duration": (3.0, 40.0)}
TASK_SEED_BASE, TASK_SEED_STEP = 42, 137

FIXED_TARGETS = [1.05, 1.10, 1.20, 1.30, 1.40, 1.50, 0.95, 0.90, 0.80, 0.70, 0.60, 0.50]
LEVEL_INIT = 245.44
FIXED_LEVEL_TARGETS = [238.0, 232.0, 225.0, 221.0, 215.0, 200.0, 185.0, 172.0, 165.0, 150.0, 135.0, 123.0]
LEVEL_TARGET_RANGE = (122.72, 240.0)
WINDOW_CHOICES = [60.0, 70.0, 80.0, 90.0, 100.0]
SYMMETRIC_SWEEP = [10, -10, 30, -30, 50, -50]
# ---------------------------------------------------------------------------------------------


def id_table(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(1, n + 1)


MIXTURE_DRAWS = ["family", "lone", "start", "gap", "coarse_pos", "coarse_speed", "fine_pos", "fine_speed"]


def gen_mixture(ids: DataFrame, seed: int = 42, mirror: bool = False) -> DataFrame:
    """60/30/10 mixture of single / simultaneous / sequential commands, one per `id`.

    `mirror` swaps the roles of the banks: bank 1 then starts at 100 with the fine bank's ranges.
    """
    single, both = FAMILY_SHARES["single"], FAMILY_SHARES["single"] + FAMILY_SHARES["simultaneous"]
    u = {n: F.col(f"_{n}") for n in MIXTURE_DRAWS}
    family = F.when(u["family"] < single, "single").when(u["family"] < both, "simultaneous").otherwise("sequential")
    # the bank that moves alone: bank 1 in half of the single runs, whichever its role is
    lone = F.when(u["lone"] < 0.5, "b1").otherwise("b2")
    drawn = add_draws(ids.select("id"), seed, "mix", [F.col("id")], [f"_{n}" for n in MIXTURE_DRAWS])
    df = drawn.withColumn("family", family)
    first = real_between(u["start"], _by_family(lambda f: MIXTURE_TIMES[f][0]), _by_family(lambda f: MIXTURE_TIMES[f][1]), 1)
    df = df.withColumn("_first", first)
    roles = {"b1": "fine", "b2": "coarse"} if mirror else {"b1": "coarse", "b2": "fine"}
    single_run, sequence = F.col("family") == "single", F.col("family") == "sequential"
    out = {}
    for bank, role in roles.items():
        start = COARSE_START if role == "coarse" else FINE_START
        moves = ~single_run | (lone == bank)
        limit = lambda k: _by_family(lambda f: MIXTURE_RANGES[f][role][k])  # noqa: B023, E731
        gap = F.when(sequence, real_between(u["gap"], *SEQUENCE_GAP, 1)).otherwise(F.lit(0.0))
        time = F.col("_first") + gap if role == "coarse" else F.col("_first")
        out[f"{bank}_pos"] = F.when(moves, integer_between(u[f"{role}_pos"], limit(0), limit(1))).otherwise(F.lit(start))
        out[f"{bank}_time"] = F.when(moves, time).otherwise(F.lit(0.0))
        out[f"{bank}_speed"] = F.when(moves, real_between(u[f"{role}_speed"], limit(2), limit(3), 1)).otherwise(F.lit(0.0))
    return df.select("id", "family", *[out[c].alias(c) for c in COMMAND])


def _by_family(value) -> Column:
    *others, last = FAMILY_SHARES
    expr = F
    for family in others:
        expr = expr.when(F.col("family") == family, F.lit(value(family)))
    return expr.otherwise(F.lit(value(last)))


BINNED_DRAWS = ["window", "boron", "start", "first", "lag", "mover", "b1_pos", "b1_speed", "b2_pos", "b2_speed"]


def gen_binned(plan: DataFrame, seed: int = 42) -> DataFrame:
    """Commands inside given cells; `plan` has `id` and `bin_index`.

    The 200 cells window x boron x initial case x move type are numbered 0..199 in nested-loop order; `bin_plan`
    builds the usual plan with the same number of runs per cell.
    """
    i, k = F.col("id"), F.col("bin_index").cast("int")
    pick = lambda options, pos: F.element_at(F.array(*[F.lit(o) for o in options]), pos.cast("int") + 1)
    n_move, n_init, n_boron = len(MOVE_TYPES), len(INIT_CASES), len(BORON_RANGES)
    per_boron, per_window = n_move * n_init, n_move * n_init * n_boron
    boron_at, window_at = F.floor(k / per_boron) % n_boron, F.floor(k / per_window)
    u = {n: F.col(f"_{n}") for n in BINNED_DRAWS}
    drawn = add_draws(plan.select("id", "bin_index"), seed, "bin", [i], [f"_{n}" for n in BINNED_DRAWS])
    cell = drawn.select(
        i, *u.values(),
        pick([r[0] for r in WINDOW_RANGES], window_at).alias("_w0"),
        pick([r[1] for r in WINDOW_RANGES], window_at).alias("_w1"),
        pick([r[0] for r in BORON_RANGES], boron_at).alias("_b0"),
        pick([r[1] for r in BORON_RANGES], boron_at).alias("_b1"),
        pick(INIT_CASES, F.floor(k / n_move) % n_init).alias("init_case"),
        pick(MOVE_TYPES, k % n_move).alias("move_type"),
    )
    move = F.col("move_type")
    init1 = F.when(F.col("init_case") == "case1", COARSE_START).otherwise(FINE_START)
    init2 = F.when(F.col("init_case") == "case1", FINE_START).otherwise(COARSE_START)
    window = real_between(u["window"], F.col("_w0"), F.col("_w1"), 1)
    boron = real_between(u["boron"], F.col("_b0"), F.col("_b1"), 2)
    start = real_between(u["start"], 1.0, 40.0, 1)
    t1 = real_between(u["first"], 1.0, 20.0, 1)
    t2 = t1 + real_between(u["lag"], 5.0, 15.0, 1)
    a_first = u["mover"] < 0.5
    out = {}
    for bank, init, alone, leads in (("b1", init1, "A_only", a_first), ("b2", init2, "B_only", ~a_first)):
        active = move.isin(alone, "Simultaneous", "Sequential")
        time = F.when(move == "Sequential", F.when(leads, t1).otherwise(t2)).otherwise(start)
        out[f"{bank}_pos"] = F.when(active, integer_between(u[f"{bank}_pos"], 0, init - 10)).otherwise(init)
        out[f"{bank}_time"] = F.when(active, time).otherwise(F.lit(0.0))
        out[f"{bank}_speed"] = F.when(active, real_between(u[f"{bank}_speed"], 1.0, 10.0, 1)).otherwise(F.lit(0.0))
    dash = lambda a, b: F.concat(F.col(a).cast("string"), F.lit("-"), F.col(b).cast("string"))
    named = cell.select(
        run_name("data_", i, 6).alias("run_name"), "id",
        dash("_w0", "_w1").alias("win_range"), dash("_b0", "_b1").alias("boron_range"), "init_case", "move_type",
        boron.alias("boron_ppm"), window.alias("monitor_window"),
        *[out[c].alias(c) for c in COMMAND],
    )
    return named.withColumn("switch_time", F.greatest(F.col("monitor_window") - 10.0, F.lit(50.0)))


def bin_plan(spark: SparkSession, per_bin: int) -> DataFrame:
    cells = len(WINDOW_RANGES) * len(BORON_RANGES) * len(INIT_CASES) * len(MOVE_TYPES)
    return id_table(spark, cells * per_bin).withColumn("bin_index", F.floor((F.col("id") - 1) / per_bin).cast("int"))


def gen_uniform(ids: DataFrame, ranges: dict[str, tuple[float, float]] = UNIFORM_RANGES) -> DataFrame:
    """Independent uniforms; task i has its own seed 42 + 137 i."""
    seeded = ids.select("id", (F.lit(TASK_SEED_BASE) + F.col("id") * TASK_SEED_STEP).alias("task_seed"))
    drawn = add_draws(seeded, "task", "uniform", [F.col("task_seed")], [f"_{n}" for n in ranges])
    return drawn.select("id", "task_seed", *[real_between(F.col(f"_{n}"), *r).alias(n) for n, r in ranges.items()])


def gen_test_cases(ids: DataFrame, seed: int = 42, init: float = 1.0, fixed: list[float] = FIXED_TARGETS,
                   span: tuple[float, float] = (0.5, 1.5), decimals: int = 5) -> DataFrame:
    """The fixed targets for the first ids (1..12), rounded uniform targets after them."""
    i = F.col("id")
    known = F.try_element_at(F.array(*[F.lit(t) for t in fixed]), i.cast("int"))
    drawn = real_between(F.col("_target"), *span, decimals)
    return add_draws(ids.select("id"), seed, "case", [i], ["_target"]).select(
        i.alias("case_id"),
        F.lit(init).alias("target_initial"),
        F.when(i.between(1, len(fixed)), known).otherwise(drawn).alias("target_final"),
        F.when(i.between(1, len(fixed)), "fixed").otherwise("random").alias("kind"),
    )


def published_cases(spark: SparkSession, n: int = 2000) -> DataFrame:
    """The published case list itself, from the seeded generator it was drawn with. A few thousand rows by nature;
    `gen_test_cases` has the same distribution at any size."""
    drawn = np.random.RandomState(42).uniform(0.5, 1.5, max(0, n - len(FIXED_TARGETS)))
    targets = (FIXED_TARGETS + [round(float(t), 5) for t in drawn])[:n]
    rows = [(i, 1.0, t) for i, t in enumerate(targets, 1)]
    return spark.createDataFrame(rows, "case_id long, target_initial double, target_final double")


def gen_level_cases(ids: DataFrame, seed: int = 42) -> DataFrame:
    """Absolute-level version: from 245.44 down to at most half."""
    return gen_test_cases(ids, seed, LEVEL_INIT, FIXED_LEVEL_TARGETS, LEVEL_TARGET_RANGE, 2)


def gen_window_cases(ids: DataFrame, seed: int = 42) -> DataFrame:
    """Monitoring window near one of five values, clamped to 60..100, and a target of 50..150 %."""
    i = F.col("id")
    jittered = choice(F.col("_window"), WINDOW_CHOICES) + real_between(F.col("_jitter"), -1.0, 1.0)
    return add_draws(ids.select("id"), seed, "case", [i], ["_window", "_jitter", "_target"]).select(
        run_name("val_", i, 4).alias("run_id"),
        F.greatest(F.lit(60.0), F.least(F.lit(100.0), F.round(jittered, 1))).alias("monitor_window"),
        F.lit(1.0).alias("initial_power"),
        real_between(F.col("_target"), 0.5, 1.5, 4).alias("final_power"),
    )


def gen_sweep(starts: DataFrame, start: str, lo: int, hi: int, step: int = 1, pos_min: float = 0.0,
              pos_max: float = 180.0) -> DataFrame:
    """Displacements lo..hi without 0 around each starting position; positions out of range are dropped."""
    return _displaced(starts, start, F.sequence(F.lit(lo), F.lit(hi), F.lit(step)), pos_min, pos_max)


def gen_symmetric_sweep(starts: DataFrame, start: str, points: list[int] = SYMMETRIC_SWEEP, pos_min: float = 0.0,
                        pos_max: float = 180.0) -> DataFrame:
    return _displaced(starts, start, F.array(*[F.lit(p) for p in points]), pos_min, pos_max)


def _displaced(starts: DataFrame, start: str, grid: Column, pos_min: float, pos_max: float) -> DataFrame:
    rows = starts.select("*", F.explode(grid).alias("delta_step")).where(F.col("delta_step") != 0)
    rows = rows.withColumn("target_pos", F.col(start) + F.col("delta_step"))
    return rows.where(F.col("target_pos").between(pos_min, pos_max))


def fill_quota(draws: DataFrame, slot: list[str], attempt: str, accepted: Column, max_attempts: int = 50) -> DataFrame:
    """First accepted draw of every slot within the allowed attempts; slots without one are absent."""
    kept = draws.where((F.col(attempt) <= max_attempts) & F.coalesce(accepted, F.lit(False)))
    others = [c for c in draws.columns if c not in slot]
    first = kept.groupBy(*slot).agg(F.min_by(F.struct(*others), F.col(attempt)).alias("_row"))
    return first.select(*slot, "_row.*")


def fill_slots(slots: DataFrame, draw, accepted: Column, max_attempts: int = 50) -> DataFrame:
    """As `fill_quota`, but draws only for slots that are still open: rounds of 2, 4, 8, ... attempts until all are filled.

    `draw` turns rows (slot columns, attempt) into drawn rows. What a round fills is staged, and the rest goes on.
    """
    key, filled, first, width = slots.columns, None, 1, 2
    while first <= max_attempts:
        last = min(max_attempts, first + width - 1)
        tries = slots.withColumn("attempt", F.explode(F.sequence(F.lit(first), F.lit(last))))
        found = stage(fill_quota(draw(tries), key, "attempt", accepted, max_attempts), "filled")
        filled = found if filled is None else filled.union(found)
        slots = stage(slots.join(found.select(*key), key, "left_anti"), "open-slots")
        if slots.isEmpty():
            break
        first, width = last + 1, width * 2
    return filled


def quota_shortfall(filled: DataFrame, planned: DataFrame, bin_cols: list[str]) -> DataFrame:
    """Per bin: planned slots, filled slots and what is missing."""
    want = planned.groupBy(*bin_cols).agg(F.count("*").alias("planned"))
    have = filled.groupBy(*bin_cols).agg(F.count("*").alias("filled"))
    joined = want.join(have, bin_cols, "left").withColumn("filled", F.coalesce("filled", F.lit(0)))
    return joined.withColumn("missing", F.col("planned") - F.col("filled"))
