"""Reproducible splits and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.functions.text import run_name
from runledger.functions.hashing import order_hash
from runledger.operators.scale import label_by_hash_rank, ordered_rank

# ---- fixed values ---------------------------------------------------------------------------
PATTERN_QUOTA = {"single_b1": 0.30, "single_b2": 0.30, "simultaneous": 0.30, "sequential": 0.10}
# ---------------------------------------------------------------------------------------------


def _share(fraction: float):
    return lambda n: F.floor(n * F.lit(float(fraction)))


def stratified_split(df: DataFrame, strata: list[str], ids: list[str], seed: int = 42,
                     parts: dict[str, float] | None = None, rest: str = "val") -> DataFrame:
    """Label `part` so that every stratum is cut at the same shares.

    `parts` gives the cumulative shares in order, e.g. {"train": .8, "val": .9} with rest "test".
    """
    cuts = [(label, _share(upto)) for label, upto in (parts or {"train": 0.9}).items()]
    return label_by_hash_rank(df, strata, ids, seed, cuts, rest, "part")


def stratified_split2(df: DataFrame, strata: list[str], ids: list[str], seed: int = 42) -> DataFrame:
    """90/10 train and val."""
    return stratified_split(df, strata, ids, seed)


def stratified_split3(df: DataFrame, strata: list[str], ids: list[str], seed: int = 42) -> DataFrame:
    """80/10/10 train, val and test."""
    return stratified_split(df, strata, ids, seed, {"train": 0.8, "val": 0.9}, "test")


def strat_key(*cols: Column) -> Column:
    return F.concat_ws("_", *[c.cast("string") for c in cols])


def random_split(df: DataFrame, ids: list[str], seed: int = 42, parts: dict[str, float] | None = None,
                 rest: str = "test", strata: list[str] | None = None) -> DataFrame:
    """Plain 80/10/10 split; with `strata` it stratifies and falls back to the plain split when a stratum
    column is missing from the table."""
    usable = strata if strata and all(c in df.columns for c in strata) else []
    return stratified_split(df, usable, ids, seed, parts or {"train": 0.8, "val": 0.9}, rest)


def quota_sample(df: DataFrame, cls: str, n: int, ids: list[str], fractions: dict[str, float] = PATTERN_QUOTA,
                 seed: int = 42) -> DataFrame:
    """round(n * fraction) rows per class, or all a class has; other classes are left out."""
    quota = _quota_column(cls, n, fractions)
    known = df.where(F.col(cls).isin(*fractions)).withColumn("_quota", quota)
    sampled = label_by_hash_rank(known, [cls, "_quota"], ids, seed, [("in", lambda _: F.col("_g._quota"))])
    return sampled.drop("_quota", "part")


def quota_shortfalls(df: DataFrame, cls: str, n: int, fractions: dict[str, float] = PATTERN_QUOTA) -> DataFrame:
    """Per class: requested, available and what is missing."""
    counts = df.where(F.col(cls).isin(*fractions)).groupBy(cls).agg(F.count("*").alias("available"))
    asked = counts.withColumn("requested", _quota_column(cls, n, fractions))
    return asked.withColumn("missing", F.greatest(F.col("requested") - F.col("available"), F.lit(0)))


def _quota_column(cls: str, n: int, fractions: dict[str, float]) -> Column:
    expr = F
    for label, share in fractions.items():
        expr = expr.when(F.col(cls) == label, F.lit(int(round(n * share))))
    return expr.cast("long")


def shuffle(df: DataFrame, ids: list[str], seed: int = 42) -> DataFrame:
    """Whole table in a reproducible random order (a range-partitioned sort)."""
    return df.orderBy(order_hash(seed, *[F.col(c) for c in ids]), *ids)


def shuffle_position(df: DataFrame, ids: list[str], seed: int = 42, digits: int = 4) -> DataFrame:
    """The place of every row in `shuffle`, without sorting the table in one task."""
    hashed = df.withColumn("_h", order_hash(seed, *[F.col(c) for c in ids]))
    return ordered_rank(hashed, [], F.substring("_h", 1, digits), ["_h", *ids], "position").drop("_h")


def rekey(df: DataFrame, prefix: str, order: str, name: str = "run_id", width: int = 5):
    """New ids prefix00000, prefix00001, ... in the order of a unique integer column."""
    ranked = ordered_rank(df, [], None, [order], "_rank")
    return ranked.withColumn(name, run_name(prefix, F.col("_rank") - 1, width)).drop("_rank")


def sample_n(df: DataFrame, n: int, ids: list[str], seed: int = 42) -> DataFrame:
    """The n rows that come first in hash order (all when there are fewer)."""
    return label_by_hash_rank(df, [], ids, seed, [("in", lambda _: F.lit(n))]).drop("part")


def split_balance(df: DataFrame, part: str, cls: str) -> DataFrame:
    """Class counts and shares inside every part."""
    counts = df.groupBy(part, cls).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(part)))
