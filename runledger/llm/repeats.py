"""Pieces of text that can repeat: what exact removal of repeated words and of repeated bytes have in common.

A window is `span` units (words or bytes) of one text. Among the runs of `gram` units inside a window, the one of lowest hash
is its minimizer; equal windows have equal minimizers at the same place. A piece is a maximal run of consecutive windows
that share one minimizer occurrence. Pieces are a small fraction of the windows, and only pieces whose minimizer also occurs
elsewhere can hold a repeated window; all others are dropped after one aggregation over the minimizers' hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runledger.llm.common import PrimeSpans, Words, column_bytes, mix, staged, texts_in_steps

#: Bytes of text that one vectorised step handles.
STEP_BYTES = 1_500_000
#: Names of documents (8 bytes each) that are copied to every executor to pick texts; more are joined by a shuffle.
FEW_NAMES = 1_000_000


class Units:
    """Units of several texts: text i has those from first[i] on, count[i] of them; `spans` hashes runs of units."""

    def __init__(self, texts: list[bytes], of_words: bool):
        if of_words:
            words = Words(texts, PrimeSpans)
            self.spans, self.first, self.words = PrimeSpans(words.hash), words.first[:-1], words
            self.count = np.diff(words.first)
        else:
            data = np.frombuffer(b"".join(texts), np.uint8)
            self.spans, self.count = PrimeSpans(data), np.array([len(t) for t in texts], np.int64)
            self.first = np.cumsum(self.count) - self.count


@dataclass(frozen=True)
class Unit:
    """A kind of window: `span` words or bytes, with minimizers of `gram` of them."""

    of_words: bool
    span: int
    gram: int

    @property
    def grams(self) -> int:
        """Runs of `gram` units in a window."""
        return self.span - self.gram + 1

    @property
    def bits(self) -> int:
        return self.grams.bit_length()

    def pack(self, at, before, after):
        """Place of a piece: its minimizer's unit, and how far the first and the last window start before that."""
        return at << 2 * self.bits | before << self.bits | after

    def unpack(self, place):
        low = (1 << self.bits) - 1
        return place >> 2 * self.bits, place >> self.bits & low, place & low


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values, by running minima of blocks from both ends."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(values)] = values
    blocks = padded.reshape(-1, width)
    forward = np.minimum.accumulate(blocks, 1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(backward[:n], forward[width - 1:width - 1 + n])


def find_pieces(units: Units, unit: Unit) -> tuple[np.ndarray, ...]:
    """Text, place of the minimizer, starts of the first and last window (units of all texts in a row), minimizer's hash."""
    total = int(units.count.sum())
    n = total - unit.gram + 1
    none = np.zeros(0, np.int64)
    if n < unit.grams:
        return none, none, none, none, none.view(np.uint64)
    start = np.arange(n)
    grams = units.spans(start, start + unit.gram)
    # the place in the lower half breaks ties towards the left
    least = sliding_least((grams >> np.uint64(32) << np.uint64(32)) | start.astype(np.uint64), unit.grams)
    text = np.repeat(np.arange(len(units.count)), units.count)
    windows = len(least)
    inside = text[:windows] == text[unit.span - 1:unit.span - 1 + windows]
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    valid = np.flatnonzero(inside)
    if not len(valid):
        return none, none, none, none, none.view(np.uint64)
    own = at[valid]
    breaks = np.flatnonzero((own[1:] != own[:-1]) | (valid[1:] != valid[:-1] + 1)) + 1
    lo, hi = valid[np.concatenate([[0], breaks])], valid[np.concatenate([breaks - 1, [len(valid) - 1]])]
    places = at[lo]
    return text[lo], places, lo, hi, grams[places]


def steps(batches, column: int = 1) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches whose texts are one vectorised step, with the texts."""
    for batch in batches:
        for first, part in texts_in_steps(column_bytes(batch.column(column)), STEP_BYTES):
            yield batch.slice(first, len(part)), part


def named(docs: DataFrame, doc: Column, text: str) -> DataFrame:
    """(doc, text): what the functions below take. `doc` names a document; rows of one name are told apart by their text."""
    return docs.select(doc.alias("doc"), F.col(text).alias("text"))


def _content(units: Units, unit: Unit, at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hash of all units of a piece and of its minimizer's place in it."""
    return mix(units.spans(lo, hi + unit.span) + (at - lo).astype(np.uint64)).view(np.int64)


def pieces(texts: DataFrame, unit: Unit) -> DataFrame:
    """(key, content, doc, place) of all pieces of all texts: hashes of the minimizer and of the whole piece."""
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("content", T.LongType()), texts.schema["doc"],
                           T.StructField("place", T.LongType())])

    def run(batches):
        for batch, data in steps(batches):
            units = Units(data, unit.of_words)
            owner, at, lo, hi, key = find_pieces(units, unit)
            place = unit.pack(at - units.first[owner], at - lo, at - hi)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(_content(units, unit, at, lo, hi)), batch.column(0).take(pa.array(owner)), pa.array(place)],
                schema.names)

    return texts.mapInArrow(run, schema)


def _with_lists(texts: DataFrame, listed: DataFrame) -> DataFrame:
    """Texts beside the lists (doc, list) about them. The names are copied to the executors while they are few enough, so that
    no other text is shuffled."""
    listed = staged(listed, "lists")
    if listed.count() <= FEW_NAMES:
        texts = texts.join(F.broadcast(listed.select("doc")), "doc", "left_semi")
    return texts.join(listed, "doc")


def _own_places(batch: pa.RecordBatch, units: Units, unit: Unit, column: int) -> tuple[np.ndarray, ...]:
    """Number of the text, entry of the flat list, content, and units (at, lo, hi) of the listed pieces that the text really has."""
    lists = batch.column(column)
    owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    flat = lists.flatten()
    place, content = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("place", "content"))
    at, before, after = unit.unpack(place)
    entry = np.flatnonzero((at - after + unit.span <= units.count[owner]) & (at >= before))
    owner, content, at, before, after = (x[entry] for x in (owner, content, at, before, after))
    at = at + units.first[owner]
    lo, hi = at - before, at - after
    same = _content(units, unit, at, lo, hi) == content
    return tuple(x[same] for x in (owner, entry, content, at, lo, hi))


def of_pieces(texts: DataFrame, wanted: DataFrame, unit: Unit, fn, schema: T.StructType) -> DataFrame:
    """Batches that `fn(units, data, content, at, lo, hi)` gives for the wanted pieces (doc, place, content)."""
    rows = _with_lists(texts, wanted.groupBy("doc").agg(F.collect_list(F.struct("place", "content")).alias("list")))

    def run(batches):
        for batch, data in steps(batches):
            units = Units(data, unit.of_words)
            _, _, content, at, lo, hi = _own_places(batch, units, unit, 2)
            yield from fn(units, data, content, at, lo, hi)

    return rows.select("doc", "text", "list").mapInArrow(run, schema)


def covered(count: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Which of `count` units lie in any of the spans."""
    edges = np.zeros(count + 1, np.int64)
    np.add.at(edges, lo, 1)
    np.subtract.at(edges, hi, 1)
    return np.cumsum(edges[:-1]) > 0


def with_removed(docs: DataFrame, doc: Column, spans: DataFrame, unit: Unit, plain, cut, names: list[str], types: list[T.DataType],
                 id: str, text: str) -> DataFrame:
    """One row per row of `docs`: id and the columns `names`, from `plain(text)` or, where spans go, from `cut(text, lo, hi)`.

    `spans` (doc, place, content, first, last) are windows of pieces, by how far they start before the minimizer. The texts of
    documents that lose nothing are not moved.
    """
    fields = [T.StructField(n, t) for n, t in zip(names, types, strict=True)]
    own = named(docs, doc, text)
    kinds = [pa.string() if isinstance(t, T.StringType) else pa.int64() for t in types]

    def made(columns, values):
        filled = list(zip(*values, strict=True)) or [[] for _ in names]
        return pa.RecordBatch.from_arrays([*columns, *[pa.array(c, k) for c, k in zip(filled, kinds, strict=True)]],
                                          [f"c{i}" for i in range(len(columns) + len(names))])

    def whole(batches):
        for batch, data in steps(batches, 3):
            yield made([batch.column(i) for i in range(3)], [plain(t) for t in data])

    def rest(batches):
        for batch, data in steps(batches):
            units = Units(data, unit.of_words)
            owner, entry, _, at, _, _ = _own_places(batch, units, unit, 3)
            flat = batch.column(3).flatten()
            first, last = (flat.field(n).to_numpy(zero_copy_only=False)[entry] for n in ("first", "last"))
            start = at - units.first[owner]
            border = np.searchsorted(owner, np.arange(len(data) + 1))
            yield made([batch.column(0), batch.column(2)], [
                cut(t, (start - first)[a:b], (start - last + unit.span)[a:b]) for t, a, b in zip(data, border[:-1], border[1:], strict=True)])

    hashed = F.xxhash64(F.col(text)).alias("text_hash")
    schema = T.StructType([T.StructField("id", docs.schema[id].dataType), own.schema["doc"], T.StructField("text_hash", T.LongType()), *fields])
    all_rows = docs.select(F.col(id).alias("id"), doc.alias("doc"), hashed, F.col(text).alias("text")).mapInArrow(whole, schema)
    lists = spans.groupBy("doc").agg(F.collect_list(F.struct("place", "content", "first", "last")).alias("list"))
    losing = _with_lists(own.where(own["doc"].isNotNull()), lists).select("doc", "text", F.xxhash64("text").alias("text_hash"), "list")
    renamed = [T.StructField(f"c_{f.name}", f.dataType) for f in fields]
    schema = T.StructType([T.StructField("c_doc", own.schema["doc"].dataType), T.StructField("c_hash", T.LongType()), *renamed])
    changed = losing.mapInArrow(rest, schema).dropDuplicates(["c_doc", "c_hash"])
    both = all_rows.join(changed, (F.col("doc") == F.col("c_doc")) & (F.col("text_hash") == F.col("c_hash")), "left")
    return both.select(F.col("id").alias(id), *[F.coalesce(f"c_{n}", n).alias(n) for n in names])
