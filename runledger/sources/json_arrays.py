"""Records of large JSON documents - arrays, envelopes, single objects - read by many tasks.

A file is read in segments that end at a closing brace, by Spark's text reader, which cuts a file into blocks at any byte and on
any file system. Whether a block begins inside a string, and how deep, follows from what all earlier blocks of its file hold: a
first pass adds up quotes and brackets per block (for both answers to "inside a string?"), a scan over the few block totals gives
the state at every block's start, and a second pass cuts out the records. Only records that cross a block border are put together
in a shuffle. Neither a file nor an array is ever held by one task.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runledger.operators.scale import BROADCAST_BYTES, planned_bytes, stage

_QUOTE, _BACKSLASH, _OPEN, _CLOSE = (np.frombuffer(x, np.uint8) for x in (b'"', b"\\", b"[{", b"]}"))
_KEY = re.compile(rb'"((?:[^"\\]|\\.)*)"\s*:\s*$', re.S)
#: Bytes before an array's bracket in which its key must end.
_KEY_BYTES = 4_096


class Structure:
    """Quotes and brackets of one stretch of a document; `escaped` says that a backslash came right before it."""

    def __init__(self, data: bytes, escaped: bool = False):
        self.data = data
        signs = np.frombuffer(data, np.uint8)
        back = signs == _BACKSLASH
        masked = np.zeros(len(signs), bool)
        self.escaped = False
        if escaped and len(signs):
            masked[0] = True
            back[0] = False
        if back.any():
            at = np.flatnonzero(back)
            begin = np.concatenate([[True], np.diff(at) > 1])
            place = np.arange(len(at)) - np.maximum.accumulate(np.where(begin, np.arange(len(at)), 0))
            after = at[place % 2 == 0] + 1  # what every first, third, ... backslash of a run stands before
            self.escaped = bool(len(after) and after[-1] == len(signs))
            masked[after[after < len(signs)]] = True
        quotes = (signs == _QUOTE) & ~masked
        self.quotes = int(quotes.sum())
        self._odd = np.cumsum(quotes) % 2 == 1
        self._step = np.isin(signs, _OPEN).astype(np.int64) - np.isin(signs, _CLOSE)

    def depth(self, in_string: bool) -> np.ndarray:
        """Depth after every sign, from 0 before the first; brackets inside strings don't count."""
        return np.cumsum(np.where(self._odd == in_string, self._step, 0))

    def steps(self, in_string: bool) -> np.ndarray:
        return np.where(self._odd == in_string, self._step, 0)


def _segments(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, size, value) in the order of the file within each block."""
    read = spark.read.option("lineSep", "}").text(path)
    return read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                       F.col("_metadata.file_size").alias("size"), "value")


def _stretches(batches):
    """(file, block, columns of the block's first row, bytes) of the batches' runs of one block; the braces are back in place."""
    for batch in batches:
        files, blocks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        values = batch.column(3).cast(pa.binary()).to_pylist()
        first = 0
        for i in range(1, len(values) + 1):
            if i == len(values) or (files[i], blocks[i]) != (files[first], blocks[first]):
                yield files[first], blocks[first], [c[first].as_py() for c in batch.columns[4:]], b"}".join([*values[first:i], b""])
                first = i


def _totals(segments: DataFrame) -> DataFrame:
    """(file, block, size, bytes, quotes, deep, deep_inside, root): per block, with the depth it adds if it begins outside or
    inside a string, and its first sign that isn't blank."""

    def run(batches):
        state, out = None, []
        for file, block, (), data in _stretches(batches):
            if state is None or state[:2] != [file, block]:
                if state:
                    out.append(state)
                state = [file, block, 0, 0, 0, 0, None, False]
            part = Structure(data, state[7])
            odd = state[3] % 2 == 1
            state[4] += int(part.steps(odd).sum())
            state[5] += int(part.steps(not odd).sum())
            state[2] += len(data)
            state[3] += part.quotes
            state[6] = state[6] or data.lstrip()[:1].decode("latin-1") or None
            state[7] = part.escaped
        if state:
            out.append(state)
        if out:
            columns = list(zip(*out, strict=True))[:7]
            kinds = [pa.string(), *[pa.int64()] * 5, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                             ["file", "block", "bytes", "quotes", "deep", "deep_inside", "root"])

    schema = "file string, block long, bytes long, quotes long, deep long, deep_inside long, root string"
    return segments.select("file", "block", "size", "value").mapInArrow(run, schema)


def _starts(totals: DataFrame) -> DataFrame:
    """(file, block, inside, depth, root) at the start of each block; a row for each block, so a file's rows are few."""
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    quoted = totals.withColumn("inside", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2 == 1)
    adds = quoted.withColumn("adds", F.when(F.col("inside"), F.col("deep_inside")).otherwise(F.col("deep")))
    return adds.select("file", "block", "inside", F.coalesce(F.sum("adds").over(earlier), F.lit(0)).alias("depth"),
                       F.first("root", ignorenulls=True).over(upto).alias("root"))


def _with_starts(segments: DataFrame, starts: DataFrame, columns: list[str]) -> DataFrame:
    """Segments beside the state at their block's start. The copy of a broadcast join keeps the order of the segments."""
    if planned_bytes(starts) > 16 * BROADCAST_BYTES:  # a row for each 128 MB of input
        raise ValueError("too many blocks; read fewer files at once or raise spark.sql.files.maxPartitionBytes")
    return segments.join(F.broadcast(starts), ["file", "block"]).select("file", "block", "size", "value", *columns)


def _arrays_at(data: bytes, step: np.ndarray, depth: np.ndarray) -> list[tuple[int, bytes | None]]:
    """(position, key) of brackets that open an array right inside the root object, (position, None) of those that close one."""
    signs = np.frombuffer(data, np.uint8)
    opens = np.flatnonzero((step == 1) & (depth == 2) & (signs == ord("[")))
    closes = np.flatnonzero((step == -1) & (depth == 1) & (signs == ord("]")))
    found = []
    for at in opens.tolist():
        key = _KEY.search(data, max(0, at - _KEY_BYTES), at)
        found.append((at, key.group(1) if key else b""))
    return sorted([*found, *((at, None) for at in closes.tolist())])


def _array_events(placed: DataFrame, key: str) -> DataFrame:
    """(file, block, within, opened): for blocks of root objects where arrays of the root open or close, whether the block ends
    inside the array of `key`, and whether that opened in it."""
    wanted = key.encode()

    def run(batches):
        state, out = None, []
        for file, block, (inside, depth, root), data in _stretches(batches):
            if root != "{":
                continue
            if state is None or state[:2] != [file, block]:
                if state and state[2] is not None:
                    out.append(state)
                state = [file, block, None, False, inside, depth, False, b""]
            part = Structure(data, state[6])
            step = part.steps(state[4])
            deep = np.cumsum(step) + state[5]
            before = state[7]  # a key may end in the stretch before
            joined = before + data
            pad = np.zeros(len(before), np.int64)
            for _, name in _arrays_at(joined, np.concatenate([pad, step]), np.concatenate([pad, deep])):
                state[2] = name == wanted
                state[3] = state[3] or name == wanted
            state[4] ^= part.quotes % 2 == 1
            state[5] = int(deep[-1]) if len(deep) else state[5]
            state[6], state[7] = part.escaped, joined[-_KEY_BYTES:]
        if state and state[2] is not None:
            out.append(state)
        if out:
            columns = list(zip(*out, strict=True))[:4]
            kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["file", "block", "within", "opened"])

    return placed.mapInArrow(run, "file string, block long, within boolean, opened boolean")


#: Kinds of texts that blocks give: a whole record, the end or a middle part of one that an earlier block began, a beginning.
WHOLE, END, MIDDLE, BEGIN = range(4)


@dataclass
class _Reader:
    """Where a task is inside one block."""

    file: str
    block: int
    in_string: bool
    depth: int
    base: int
    within: bool
    in_record: bool = False
    began: bool = False
    escaped: bool = False
    held: list[bytes] = field(default_factory=list)
    before: bytes = b""

    def read(self, data: bytes, wanted: bytes | None):
        """(file, block, kind, text) of the records that end in a stretch."""
        part = Structure(data, self.escaped)
        step = part.steps(self.in_string)
        deep = np.cumsum(step) + self.depth
        events = [(int(at), 0, None) for at in np.flatnonzero(((step == 1) & (deep == self.base + 1)) | ((step == -1) & (deep == self.base)))]
        if self.base == 2:
            joined, shift = self.before + data, len(self.before)
            pad = np.zeros(shift, np.int64)
            events += [(at - shift, 1, key) for at, key in _arrays_at(joined, np.concatenate([pad, step]), np.concatenate([pad, deep]))]
            self.before = joined[-_KEY_BYTES:]
        start = 0
        for at, kind, key in sorted(events, key=lambda e: e[:2]):
            if kind == 1:
                self.within = key == wanted
            elif step[at] == 1:
                self.in_record = data[at:at + 1] == b"{" and (self.base < 2 or self.within)
                self.began, start = self.in_record, at
            else:
                if self.in_record and data[at:at + 1] == b"}":
                    yield self.file, self.block, WHOLE if self.began else END, b"".join([*self.held, data[start:at + 1]])
                self.held.clear()
                self.in_record = self.began = False
        if self.in_record:
            self.held.append(data[start:])
        self.in_string ^= part.quotes % 2 == 1
        self.depth = int(deep[-1]) if len(deep) else self.depth
        self.escaped = part.escaped

    def leave(self):
        """What the block ends inside of."""
        if self.in_record and self.held:
            yield self.file, self.block, BEGIN if self.began else MIDDLE, b"".join(self.held)


def _cut(placed: DataFrame, key: str | None) -> DataFrame:
    """(file, block, kind, value): records and parts of records, by kind."""
    wanted = None if key is None else key.encode()

    def texts(batches):
        at = None
        for file, block, (inside, depth, root, base, within), data in _stretches(batches):
            if at is None or (at.file, at.block) != (file, block):
                if at:
                    yield from at.leave()
                at = _Reader(file, block, inside, depth, base, within, in_record=depth > base and (base < 2 or within))
            yield from at.read(data, wanted)
        if at:
            yield from at.leave()

    def run(batches):
        out, held = [], 0
        for row in texts(batches):
            out.append(row)
            held += len(row[3])
            if held >= 4 << 20:
                yield batch_of(out)
                out, held = [], 0
        if out:
            yield batch_of(out)

    def batch_of(rows):
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["file", "block", "kind", "value"])

    return placed.mapInArrow(run, "file string, block long, kind int, value binary")


def json_objects(spark: SparkSession, path: str, envelope: str | None = None) -> DataFrame:
    """Column `value`: the JSON text of every record in the files of `path`.

    The records of a file that holds an array are the objects in it, of one that holds an object that object itself. With
    `envelope`, an object that has an array of that name stands for the objects in the array. Other members of an array are
    skipped. Strings are in double quotes; a document that breaks off loses the record it breaks off in.
    """
    segments = _segments(spark, path)
    starts = stage(_starts(_totals(segments)), "json-blocks")
    placed = _with_starts(segments, starts, ["inside", "depth", "root"])
    base: Column = F.when(F.col("root") == "[", 1).otherwise(0)
    if envelope is None:
        starts = starts.select("*", base.alias("base"), F.lit(False).alias("within"))
    else:
        events = stage(_array_events(placed, envelope), "json-events")
        enveloped = events.where("opened").select("file", F.lit(True).alias("enveloped")).distinct()
        known = starts.join(events.drop("opened"), ["file", "block"], "left").join(enveloped, "file", "left")
        earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        within = F.coalesce(F.last("within", ignorenulls=True).over(earlier), F.lit(False))
        starts = known.select("file", "block", "inside", "depth", "root", F.when(F.col("enveloped"), 2).otherwise(base).alias("base"),
                              within.alias("within"))
        starts = stage(starts, "json-blocks")
    cut = _cut(_with_starts(segments, starts, ["inside", "depth", "root", "base", "within"]), envelope)
    cut = stage(cut, "json-records")
    # by block the end of a record comes before the beginning of the next
    order = Window.partitionBy("file").orderBy("block", "kind")
    pieces = cut.where(F.col("kind") != WHOLE).withColumn("record", F.sum(F.when(F.col("kind") == BEGIN, 1).otherwise(0)).over(order))
    joined = pieces.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("block", "kind", "value"))).alias("p"))
    upto = F.array_position(F.transform("p", lambda x: x["kind"]), END).cast("int")
    complete = joined.where((F.get("p", F.lit(0))["kind"] == BEGIN) & (upto > 0)).select(F.slice("p", F.lit(1), upto).alias("p"))
    text = F.aggregate("p", F.lit(b""), lambda t, x: F.concat(t, x["value"]))
    every = cut.where(F.col("kind") == WHOLE).select("value").union(complete.select(text.alias("value")))
    return every.select(F.col("value").cast("string").alias("value"))
