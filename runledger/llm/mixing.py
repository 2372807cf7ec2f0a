"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runledger.llm.common import n_words, staged

#: No document is taken more often.
MOST_COPIES = 3
#: Documents of a source that are rounded together.
ROUND_TOGETHER = 2_000
TOLERANCE = 1e-9
STEPS = 40


def base_rate(size: Column) -> Column:
    """Prior rate of a document: fragments below 200 words count for less, down to a quarter."""
    return F.greatest(F.lit(0.25), F.least(F.lit(1.0), size / F.lit(200.0)))


def targets(sources: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), cap: int = MOST_COPIES) -> DataFrame:
    """Target words of each source from (source, source_size, n): weights in turn, by code point, null last.

    A target stops at `cap` times its source's size; the excess goes to the others by weight until none is above. That is the
    level `t` at which the sum of min(weight * t, cap * size) is the size of all, found with one ordered scan of the sources.
    """
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(c)) for c in cycle]), F.pmod(turn, F.lit(len(cycle))) + 1)
    weighted = sources.select("*", turn.alias("source_no"), weight.alias("weight"))
    filled = Window.orderBy(F.col("most") / F.col("weight"), "source_no")
    before, rest = filled.rowsBetween(Window.unboundedPreceding, -1), filled.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    levels = weighted.withColumn("most", F.lit(float(cap)) * F.col("source_size")).withColumns({
        "total": F.sum("source_size").over(every),
        "capped": F.coalesce(F.sum("most").over(before), F.lit(0.0)), "open": F.sum("weight").over(rest),
    }).withColumn("t", (F.col("total") - F.col("capped")) / F.col("open"))
    first = F.first(F.when(F.col("t") * F.col("weight") <= F.col("most"), F.col("t")), ignorenulls=True).over(
        filled.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return levels.select("source", "source_no", "source_size", "n", F.least(first * F.col("weight"), F.col("most")).alias("target"))


def tilted(base: Column, tilt: Column, cap: int) -> Column:
    """Document rate: the base rate tilted by exp(tilt), with the odds taken against the cap so that it stays below it."""
    up = base * F.exp(tilt)
    return F.lit(float(cap)) * up / (F.lit(float(cap)) - base + up)


def exact_sum(value: Column) -> Column:
    """Sum in steps of a millionth, which does not depend on the order of the rows."""
    return F.sum(F.round(value * 1e6).cast("decimal(38,0)")).cast("double") / 1e6


def solve_tilts(hist: DataFrame, wanted: DataFrame, cap: int = MOST_COPIES) -> DataFrame:
    """Tilt of each source from hist (source_no, base, words) and wanted (source_no, source_size, target).

    The dual of the entropy problem is convex and separates into one multiplier per source; its gradient is the words taken
    less the target. Each Newton step is one distributed aggregation over all sources, whose result is staged. A source whose
    target is none of its words or `cap` times all of them needs no tilt: its rate is fixed (column `fixed`).
    """
    hist = staged(hist, "mix-hist")
    full, none = F.col("target") >= float(cap) * F.col("source_size") * (1 - 1e-12), F.col("target") <= 0
    share = F.col("target") / F.col("source_size")
    mean = hist.groupBy("source_no").agg((exact_sum(F.col("base") * F.col("words")) / F.sum("words")).alias("mean"))
    start = F.log(share * (cap - F.col("mean")) / (F.col("mean") * (cap - share)))
    tilts = wanted.join(mean, "source_no", "left").select(
        "source_no", "target", F.when(none, 0.0).when(full, float(cap)).alias("fixed"),
        F.when(none | full, 0.0).otherwise(start).alias("tilt"))
    for _ in range(STEPS):
        tilts = staged(tilts, "mix-tilt")
        rate = tilted(F.col("base"), F.col("tilt"), cap)
        open_sources = hist.join(tilts.where(F.col("fixed").isNull()), "source_no").select(
            "source_no", (F.col("words") * rate).alias("taken"), (F.col("words") * rate * (1 - rate / cap)).alias("slope"))
        steps = staged(open_sources.groupBy("source_no").agg(exact_sum(F.col("taken")).alias("taken"), exact_sum(F.col("slope")).alias("slope")), "mix-step")
        moved = tilts.join(steps, "source_no", "left")
        gap = F.col("taken") - F.col("target")
        if (moved.agg(F.max((F.abs(gap) - 1e-5) / F.col("target"))).first()[0] or 0.0) <= TOLERANCE:
            break
        step = F.greatest(F.lit(-2.0), F.least(F.lit(2.0), gap / F.col("slope")))
        tilts = moved.select("source_no", "target", "fixed", F.when(F.col("fixed").isNull(), F.col("tilt") - step).otherwise(0.0).alias("tilt"))
    return tilts.select("source_no", "fixed", "tilt")


def _round(table: pa.Table, cap: int) -> np.ndarray:
    """Copies of documents of one source: whole rates, and fractions carried on from large documents to small ones."""
    size, rate = table["size"].to_numpy(), table["rate"].to_numpy()
    copies = np.minimum(np.floor(rate), cap).astype(np.int64)
    part = np.where(copies < cap, rate - copies, 0.0)
    carried = 0.0
    for i in np.lexsort((table["key"].to_numpy(), -size)):
        if copies[i] < cap and size[i] > 0:
            carried += part[i] * size[i]
            if carried >= size[i] / 2:
                copies[i] += 1
                carried -= size[i]
    return copies


def mix(docs: DataFrame, keep: list[str], cycle: tuple[int, ...] = (1, 2, 3), cap: int = MOST_COPIES, id: str = "doc_id",
        text: str = "text", source: str = "source") -> DataFrame:
    """How often each row of `docs` is taken so that the sources' words meet their targets.

    Returns `row` (the columns of `keep`) and `mix` (size, source_size, target, rate, copies). Rates minimise the relative
    entropy to `base_rate`, counted per word, under one constraint on the words of each source; they are rounded to copies in
    groups of about ROUND_TOGETHER documents of a source, the largest first, so that what a group takes misses its share by no
    more than half a small document. All draws come from hashes of id and text: reruns agree.

    A null source is a source of its own, last in order. A null or empty text has no words and is never taken. Repeated rows are
    rows like others. An empty table gives no rows.
    """
    size = n_words(F.col(text))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(source).alias("source"), size.alias("size"),
        base_rate(size).alias("base"), F.xxhash64(F.col(id), F.col(text)).alias("key"))
    sources = staged(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), cycle, cap), "mix-source")
    hist = rows.groupBy("source", "base").agg(F.sum("size").alias("words")).where("words > 0")
    hist = hist.join(sources, hist["source"].eqNullSafe(sources["source"])).select("source_no", "base", "words")
    tilts = solve_tilts(hist, sources.select("source_no", "source_size", "target"), cap)
    known = staged(sources.join(tilts, "source_no"), "mix-known")
    known = known.withColumnRenamed("source", "of")
    rate = F.coalesce(F.col("fixed"), tilted(F.col("base"), F.col("tilt"), cap))
    rated = rows.join(known, rows["source"].eqNullSafe(known["of"])).select(
        "row", "source_no", "size", "source_size", "target", rate.alias("rate"), "key",
        F.pmod(F.col("key"), F.ceil(F.col("n") / ROUND_TOGETHER)).cast("int").alias("part"))
    inner = T.StructType([T.StructField("size", T.LongType()), T.StructField("source_size", T.LongType()),
                          T.StructField("target", T.DoubleType()), T.StructField("rate", T.DoubleType()), T.StructField("copies", T.LongType())])
    schema = T.StructType([T.StructField("row", rated.schema["row"].dataType), T.StructField("mix", inner)])

    def rounded(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        names = ["size", "source_size", "target", "rate"]
        copies = pa.array(_round(table, cap), pa.int64())
        parts = [table[n].combine_chunks() for n in names]
        both = pa.StructArray.from_arrays([*parts, copies], [*names, "copies"])
        return pa.table({"row": table["row"], "mix": both})

    return rated.groupBy("source_no", "part").applyInArrow(rounded, schema)


def repeated(mixed: DataFrame) -> DataFrame:
    """The rows of a mix, each as often as it is taken."""
    return mixed.where("mix.copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix.copies"))).alias("copy")).select("row.*")
