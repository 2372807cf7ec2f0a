"""Audit of text filters: what each removes, alone and behind the others, in every order.

A counting Bloom sketch of all texts clears those that are unique; only the texts of possible repeats are shuffled.
"""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.llm.common import SEPARATORS, fits, staged

#: Filters by letter; bit i of a mask is the failure of filter i.
FILTERS = "ABCDE"
DUPLICATE = 1 << FILTERS.index("E")
#: A block of the sketch has PARTS parts of CELLS counters; a text counts in one cell of each part of its block.
PARTS, CELLS = 4, 16
#: Texts for each block on average: a unique text meets others in all of its cells less than once in a hundred.
TEXTS_A_BLOCK = 4
#: Bytes and rows of a sketch that is copied to every executor.
SKETCH_BYTES, SKETCH_ROWS = 16 << 20, 1_000_000


def with_text_failures(docs: DataFrame, name: str = "mask") -> DataFrame:
    """Adds the mask of the filters that judge the column `text` by itself: A under 200 words, B under half of the words distinct,
    C more than 2 % of the code points are letters A to Z, D holds any of #$%&*|."""
    text = F.col("text")
    # a column of its own, so that a text is split once
    split = docs.withColumn("_words", F.array_remove(F.split(text, f"{SEPARATORS}+"), ""))
    counted = split.withColumns({"_n": F.size("_words").cast("long"), "_distinct": F.size(F.array_distinct("_words")).cast("long")})
    checks = [
        F.col("_n") < 200,
        100 * F.col("_distinct") < 50 * F.col("_n"),
        100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 2 * F.length(text).cast("long"),
        text.rlike("[#$%&*|]"),
    ]
    mask = sum((F.when(failed, 1 << i).otherwise(0) for i, failed in enumerate(checks)), F.lit(0)).cast("int")
    return counted.withColumn(name, mask).drop("_words", "_n", "_distinct")


def _block(text: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(71), text), F.lit(blocks).cast("long"))


def _cells(text: Column) -> list[Column]:
    """The cell of each part, as a number from 0 to PARTS * CELLS - 1."""
    code = F.xxhash64(F.lit(72), text)
    return [F.pmod(F.shiftright(code, 4 * p), F.lit(CELLS)).cast("int") + p * CELLS for p in range(PARTS)]


def _bits(cells: list[Column]) -> Column:
    """A 64-bit mask of cells. Bit 63 makes it negative, which bit operations do not mind."""
    mask = F.lit(0).cast("long")
    for cell in cells:
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), cell))
    return mask


def repeat_sketch(texts: DataFrame, blocks: int) -> DataFrame:
    """(block, bits): cells that count two texts or more, of the blocks that have one in every part.

    `texts` has a column `text`. Each task counts its own cells, and the counts of all tasks are added.
    """
    cells = texts.select(_block(F.col("text"), blocks).alias("block"), F.explode(F.array(*_cells(F.col("text")))).alias("cell"))
    counted = cells.groupBy("block", "cell").agg(F.count("*").alias("n")).where("n > 1")
    sketch = counted.groupBy("block").agg(F.bit_or(_bits([F.col("cell")])).alias("bits"))
    for part in range(PARTS):
        own = F.call_function("shiftrightunsigned", F.col("bits"), F.lit(part * CELLS)).bitwiseAND(F.lit((1 << CELLS) - 1).cast("long"))
        sketch = sketch.where(own != 0)
    return sketch


def failures(docs: DataFrame, id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(doc_id, part, mask, n): how many rows of an id and part fail exactly the filters of the mask, duplicates (E) included.

    A row is a duplicate where its text is that of a row with a smaller id. The first scan counts all texts in the sketch, which
    has a block for every TEXTS_A_BLOCK rows; the second probes it. Texts that it does not clear are grouped as whole texts for
    their least id, with partial aggregation, so a group of copies is one row of a task; rows then find out by id and SHA-256
    whether they are that first one. A sketch too large to copy to every executor is joined by block instead, in a shuffle.
    """
    base = docs.select(F.col(id).alias("doc_id"), F.coalesce(F.col(part), F.lit("")).cast("string").alias("part"),
                       F.coalesce(F.col(text), F.lit("")).alias("text"))
    blocks = max(1, base.count() // TEXTS_A_BLOCK)
    sketch = staged(repeat_sketch(base.select("text"), blocks), "repeat-sketch")
    if fits(sketch, SKETCH_BYTES, SKETCH_ROWS):
        sketch = F.broadcast(sketch)
    own = _bits(_cells(F.col("text")))
    probed = base.withColumn("block", _block(F.col("text"), blocks)).join(sketch, "block", "left")
    possible = probed.withColumn("repeat", F.coalesce(F.col("bits").bitwiseAND(own) == own, F.lit(False)) & F.col("doc_id").isNotNull())
    digest = F.when(F.col("repeat"), F.sha2(F.col("text"), 256))
    marked = with_text_failures(possible).withColumn("digest", digest)
    rows = staged(marked.groupBy("doc_id", "part", "mask", "digest").agg(F.count("*").alias("n")), "filter-flags")

    least = possible.where("repeat").groupBy("text").agg(F.min("doc_id").alias("first"))
    least = least.select(F.col("first").alias("doc_id"), F.sha2("text", 256).alias("digest"), F.lit(True).alias("is_first"))
    judged = rows.where("digest is not null").join(least, ["doc_id", "digest"], "left")
    judged = judged.withColumn("mask", F.col("mask") + F.when(F.col("is_first"), 0).otherwise(DUPLICATE))
    return rows.where("digest is null").select("doc_id", "part", "mask", "n").union(judged.select("doc_id", "part", "mask", "n"))


def mask_counts(failed: DataFrame, labels: DataFrame, id: str = "doc_id") -> DataFrame:
    """(part, mask, n, good, toxic): rows, and how many of them have a label of good quality or of toxic text.

    An id with several labels counts as good, and as toxic, where any of them says so; labels without an id count nowhere.
    """
    says = labels.where(F.col(id).isNotNull()).groupBy(F.col(id).alias("doc_id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    joined = failed.join(says.where("good + toxic > 0"), "doc_id", "left")
    return joined.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"),
        F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"))


def audit(counts: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley of additive mask counts.

    A part has at most 32 masks, so a row of the result is a sum over a bounded array.
    """
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    steps = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, i in enumerate(order, 1):
            steps.append({"filter_order": "".join(FILTERS[j] for j in order), "step": step, "before": before, "own": 1 << i})
            before |= 1 << i
    # one literal: an array of 600 structs of literals takes the optimizer seconds
    table = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order: string, step: int, before: int, own: int>>")
    rows = parts.select("part", "cells", F.explode(table).alias("s")).select("part", "cells", "s.*")

    def total(value, holds) -> Column:
        zero = F.lit(0).cast("long")
        return F.aggregate("cells", zero, lambda t, c: t + F.when(holds(c["mask"]), value(c)).otherwise(zero))

    fails = lambda m: m.bitwiseAND(F.col("own")) != 0
    earlier = lambda m: m.bitwiseAND(F.col("before")) != 0
    here = lambda m: fails(m) & ~earlier(m)
    n = lambda c: c["n"]
    return rows.select(
        "part", "filter_order", "step",
        total(n, lambda m: ~fails(m) & ~earlier(m)).alias("kept"),
        total(n, here).alias("removed"),
        total(n, lambda m: fails(m) & earlier(m)).alias("redundant"),
        total(n, lambda m: m == F.col("own")).alias("unique_fails"),
        total(lambda c: c["good"], here).alias("good_lost"),
        total(lambda c: c["toxic"], here).alias("toxic_lost"),
        # of the 120 orders, a filter is the first of the k that fail in 120 / k
        total(lambda c: (c["n"] * 120 / F.bit_count(c["mask"])).cast("long"), fails).alias("shapley"))


def filter_audit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """Counts of five filters within each part of `docs`, for every order of the filters and every step, zeros included.

    Words are maximal runs of other signs than blanks; a null text is empty, a null part the empty string. Rows that repeat count
    each; those with the same id and text are no duplicates of each other. A row without an id is no duplicate, makes no other row
    one, and has no label. An empty table has no parts, hence no rows. Other columns are not read.
    """
    return audit(staged(mask_counts(failures(docs, id, text, part), labels, id), "mask-counts"))
