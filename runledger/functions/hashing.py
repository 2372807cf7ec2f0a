"""Deterministic pseudo-random columns.

Every "random" choice in the library is a pure function of (seed, tag, row id), so a lost task that
is recomputed elsewhere, a repartitioned input or another SQL engine gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEX_DIGITS = 8
HEX_RANGE = float(16**HEX_DIGITS)
DRAWS_PER_DIGEST = 32 // HEX_DIGITS


def order_hash(seed: int | str, *ids: Column) -> Column:
    """32 hex digits; sorting by it shuffles the rows."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[i.cast("string") for i in ids]))


def hex_uniform(digest: Column, slot: int) -> Column:
    """Uniform double from the `slot`-th group of 8 hex digits (0..3) of an md5 digest."""
    part = F.substring(digest, slot * HEX_DIGITS + 1, HEX_DIGITS)
    return F.conv(part, 16, 10).cast("double") / F.lit(HEX_RANGE)


def add_draws(df: DataFrame, seed: int | str, tag: str, ids: list[Column], names: list[str]) -> DataFrame:
    """Add independent uniforms, one column per name. Four of them share one digest."""
    digests = {f"_{tag}{b}": order_hash(f"{seed}:{tag}{b}", *ids) for b in range(-(-len(names) // DRAWS_PER_DIGEST))}
    draws = {n: hex_uniform(F.col(f"_{tag}{k // DRAWS_PER_DIGEST}"), k % DRAWS_PER_DIGEST) for k, n in enumerate(names)}
    return df.withColumns(digests).withColumns(draws).drop(*digests)


def _column(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def real_between(u: Column, lo: float | Column, hi: float | Column, digits: int | None = None) -> Column:
    """Uniform in lo..hi from a uniform draw, optionally rounded."""
    x = _column(lo) + u * (_column(hi) - _column(lo))
    return x if digits is None else F.round(x, digits)


def integer_between(u: Column, lo: int | Column, hi: int | Column) -> Column:
    """Integer in lo..hi, both ends included."""
    return (_column(lo) + F.floor(u * (_column(hi) - _column(lo) + 1))).cast("int")


def choice(u: Column, options: list) -> Column:
    """One of a short literal list, equally likely."""
    return F.element_at(F.array(*[F.lit(o) for o in options]), F.floor(u * len(options)).cast("int") + 1)
