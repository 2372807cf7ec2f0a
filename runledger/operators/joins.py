"""Lookups, pairings and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.functions.classify import REGIMES, regime
from runledger.functions.derive import COMMAND, gain_command, param_errors
from runledger.operators.scale import salted_join, stage

# ---- fixed values ---------------------------------------------------------------------------
SCHEDULED_GAINS = {
    "large_dec": 94.50, "medium_dec": 45.76, "small_dec": 31.23,
    "small_inc": 25.00, "medium_inc": 23.35, "large_inc": 19.92,
}
FALLBACK_GAIN = 35.5
INIT_CONFIGS = [("default", 180, 100), ("mirror", 100, 180)]
# ---------------------------------------------------------------------------------------------


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def lookup_gain(cases: DataFrame, gains: dict[str, float] | DataFrame = SCHEDULED_GAINS, key: str = "regime",
                name: str = "Kp_used") -> DataFrame:
    """Add the gain of each case's regime; unknown regimes get null.

    Constant gains are a literal map, no join at all. Fitted gains (columns regime, Kp) are restricted to the
    six regime labels, one row each, so the broadcast side has at most six rows.
    """
    if isinstance(gains, dict):
        return cases.withColumn(name, F.try_element_at(literal_map(gains), F.col(key)))
    labels = [label for label, _, _ in REGIMES]
    six = gains.where(F.col("regime").isin(labels)).groupBy(F.col("regime").alias(key)).agg(F.max("Kp").alias(name))
    return cases.join(F.broadcast(six), key, "left")


def scheduled_command(cases: DataFrame, gains: dict[str, float] | DataFrame = SCHEDULED_GAINS,
                      init: str = "target_initial", target: str = "target_final") -> DataFrame:
    """Regime, gain and proportional command of every case."""
    with_regime = cases.withColumn("regime", regime(F.col(init), F.col(target)))
    with_gain = lookup_gain(with_regime, gains)
    return with_gain.withColumns(gain_command(F.col(init), F.col(target), F.col("Kp_used")))


#: Cells are numbered within this bound; what lies beyond shares the outermost cell.
CELLS = 1 << 60


def _cell(value: Column, width: float) -> Column:
    return F.greatest(F.least(F.floor(value / width), F.lit(CELLS)), F.lit(-CELLS))


def listed_ranges(ranges: DataFrame, width: float) -> DataFrame:
    """The ranges with (_level, _cell): the level's cells, of width * 2^level, are as wide as the range at least, so that it
    touches one or two of them, whatever its length."""
    first, last = _cell(F.col("lo"), width), _cell(F.col("hi"), width)
    level = F.when(last > first, F.length(F.bin(last - first))).otherwise(0)
    spans = ranges.where("lo < hi").withColumns({"_level": level.cast("int"), "_first": first, "_last": last})
    up = lambda c: F.call_function("shiftright", F.col(c), F.col("_level"))
    return spans.withColumn("_cell", F.explode(F.sequence(up("_first"), up("_last")))).drop("_first", "_last")


def assign_range(samples: DataFrame, value: str, ranges: DataFrame, width: float, ids: list[str]) -> DataFrame:
    """Range join lo <= value < hi without comparing every pair.

    Cells come in levels, each twice as wide as the one below, from `width` on. A range is listed in the level of its own length,
    twice at most; a value looks up its cell in each level that some range is in, and cells are joined by equality. So one range
    over everything costs a level, not a row for each cell. Exact for any width; choose it near the smallest ranges. The listed
    ranges are broadcast when they are few; otherwise a cell that many samples share is salted by `ids`.
    """
    listed = stage(listed_ranges(ranges, width), "ranges")
    levels = sorted(r[0] for r in listed.select("_level").distinct().collect())  # 62 at most
    own = F.explode(F.array(*[F.lit(n) for n in levels]).cast("array<int>"))
    placed = samples.select("*", own.alias("_level"))
    placed = placed.withColumn("_cell", F.call_function("shiftright", _cell(F.col(value), width), F.col("_level")))
    inside = (F.col(value) >= F.col("lo")) & (F.col(value) < F.col("hi"))
    return salted_join(placed, listed, ["_level", "_cell"], ids).where(inside).drop("_level", "_cell")


def assign_regime(samples: DataFrame, value: str, regimes: list[tuple[str, float, float]] = REGIMES,
                  name: str = "regime") -> DataFrame:
    """The same for a short constant list of ranges: a projection; values outside all ranges are dropped."""
    expr = F
    for label, lo, hi in regimes:
        expr = expr.when((F.col(value) >= lo) & (F.col(value) < hi), label)
    return samples.withColumn(name, expr).where(F.col(name).isNotNull())


def pending(cases: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Cases that have no finished record yet."""
    return cases.join(done.select(*key), key, "left_anti")


def bin_grid(one_row: DataFrame, dims: dict[str, list]) -> DataFrame:
    """All combinations of short literal lists, from one row by one explode per dimension."""
    grid = one_row
    for name, values in dims.items():
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return grid.select(*dims)


def bin_coverage(df: DataFrame, dims: dict[str, list]) -> DataFrame:
    """Rows per cell of the full grid, empty cells included."""
    grid = bin_grid(df.sparkSession.range(1), dims)
    counts = df.groupBy(*dims).agg(F.count("*").alias("n"))
    return grid.join(counts, list(dims), "left").withColumn("n", F.coalesce("n", F.lit(0)))


def cases_x_configs(cases: DataFrame, configs: list[tuple[str, int, int]] = INIT_CONFIGS) -> DataFrame:
    """Every case under each initial configuration (an explode of a literal array)."""
    options = F.array(*[
        F.struct(F.lit(tag).alias("config"), F.lit(b1).alias("init_b1"), F.lit(b2).alias("init_b2"))
        for tag, b1, b2 in configs
    ])
    return cases.withColumn("_c", F.explode(options)).select(*cases.columns, "_c.*")


def model_pairs(counts: DataFrame, band: str = "tolerance", model: str = "model") -> DataFrame:
    """Unordered pairs of models per band, first < second by name; input is one row per (model, band)."""
    left = counts.select(band, *[F.col(c).alias(f"{c}_a") for c in counts.columns if c != band])
    right = counts.select(band, *[F.col(c).alias(f"{c}_b") for c in counts.columns if c != band])
    return left.join(right, band).where(F.col(f"{model}_a") < F.col(f"{model}_b"))


def pred_vs_truth(pred: DataFrame, truth: DataFrame, key: str = "case_id") -> DataFrame:
    """Predictions next to the truth with one absolute error per parameter; unparsed rows stay."""
    renamed = truth.select(key, *[F.col(p).alias(f"{p}_truth") for p in COMMAND])
    joined = pred.join(renamed, key, "left")
    errors = param_errors({p: F.col(p) for p in COMMAND}, {p: F.col(f"{p}_truth") for p in COMMAND})
    return joined.withColumns(errors)


def keep_classes(df: DataFrame, col: str, classes: list[str]) -> DataFrame:
    return df.where(F.col(col).isin(*classes))


def union_aligned(cols: list[str], *tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [t.select(*cols) for t in tables])


def distinct_sorted(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct().orderBy(col)


def id_difference(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """Distinct ids of a that are not in b."""
    return a.select(col).subtract(b.select(col))
