"""Removal of repeated byte strings by bucket-pointer refinement."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runledger.llm.common import PrimeSpans, staged
from runledger.llm.repeats import Unit, covered, named, of_pieces, pieces, with_removed

#: Bytes of the initial buckets' q-grams.
GRAM = 32
#: Pieces of an initial bucket that one task refines; larger buckets are opened into their strings and joined on them.
TOGETHER = 50_000


def _plain(text: bytes) -> tuple:
    return len(text), 0, 0, hashlib.sha256(text).hexdigest()


def _cut(text: bytes, lo: np.ndarray, hi: np.ndarray) -> tuple:
    gone = covered(len(text), lo, hi)
    runs = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
    return len(text), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(text, np.uint8)[~gone].tobytes()).hexdigest()


def refine(data: list[bytes], span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of every suffix by its first `span` bytes, -1 where no other suffix has them; text and offset of the suffixes.

    Suffixes start in buckets of short q-grams. A round sorts them by the pair of their bucket and the bucket at the offset
    they are sorted to, which doubles the depth; pairs overlap in the last round. Suffixes alone in their bucket, and those
    whose later bucket is gone, drop out of all further rounds.
    """
    sizes = np.array([len(d) for d in data], np.int64)
    flat = np.frombuffer(b"".join(data), np.uint8)
    text = np.repeat(np.arange(len(data)), sizes)
    offset = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    left = np.repeat(sizes, sizes) - offset
    depth = min(16, span)
    bucket = np.full(len(flat), -1)

    def regroup(at: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Give `at` its new buckets; those alone in theirs get none. Returns the places that stay."""
        _, number, copies = np.unique(value, return_inverse=True, return_counts=True)
        several = copies[number] > 1
        fresh = np.full(len(flat), -1)
        fresh[at[several]] = number[several]
        bucket[:] = fresh
        return at[several]

    live = np.flatnonzero(left >= depth)
    live = regroup(live, PrimeSpans(flat)(live, live + depth))
    while depth < span and len(live):
        step = min(depth, span - depth)
        live = live[left[live] >= depth + step]
        later = bucket[live + step]
        live, later = live[later >= 0], later[later >= 0]
        live = regroup(live, bucket[live] * (len(flat) + 1) + later)
        depth += step
    return bucket, text, offset


def repeated_spans(docs: DataFrame, span: int = 400, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Strings (doc, place, content, first, last) of `span` bytes that start at two places at least, as parts of pieces.

    The q-gram of lowest hash in each string is the suffixes' initial bucket; buckets with one occurrence are dropped by one
    aggregation. Pieces of a bucket - strings around one q-gram occurrence - with equal content repeat as a whole. Where a
    bucket holds several contents, the suffixes of one copy of each are refined to the full length by bucket pointers, and
    strings that two contents share are found. A bucket too large for one task is opened into its strings instead, which
    are joined on their hashes.
    """
    unit = _unit(span)
    texts = named(docs, _name(id, text), text)
    every = pieces(texts, unit)
    several = every.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    rows = staged(every.join(several, "key"), "bucket-pieces")
    one = F.min(F.struct("doc", "place")).alias("r")
    kinds = staged(rows.groupBy("content").agg(F.count("*").alias("copies"), F.min("key").alias("key"), one).select(
        "content", "key", "copies", "r.*"), "bucket-contents")
    low = (1 << unit.bits) - 1
    back, ahead = F.shiftright("place", unit.bits).bitwiseAND(low), F.col("place").bitwiseAND(low)
    twice = kinds.where("copies > 1").select("content")
    whole = rows.select("doc", "place", "content").join(twice, "content").select(
        "doc", "place", "content", back.alias("first"), ahead.alias("last"))

    mixed = kinds.groupBy("key").agg(F.count("*").alias("n"), F.min("copies").alias("least")).where("n > 1 and least = 1").select("key", "n")
    opened = staged(kinds.join(mixed, "key"), "open-contents")
    schema = T.StructType([T.StructField("content", T.LongType()), T.StructField("back", T.LongType()), T.StructField("bytes", T.BinaryType())])

    def cut_out(units, data, content, at, lo, hi):
        flat = b"".join(data)
        cut = [flat[a:b] for a, b in zip(lo.tolist(), (hi + span).tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(content), pa.array(at - lo), pa.array(cut, pa.binary())], schema.names)

    found = T.StructType([T.StructField(n, T.LongType()) for n in ("content", "first", "last")])

    def refined(table: pa.Table) -> pa.Table:
        data, back = table["bytes"].to_pylist(), table["back"].to_numpy()
        bucket, of, offset = refine(data, span)
        hit = bucket >= 0
        # runs of consecutive repeated strings of one piece
        place = np.flatnonzero(hit)
        begin = place[np.concatenate([[True], (np.diff(place) != 1) | (of[place[1:]] != of[place[:-1]])])] if len(place) else place
        end = place[np.concatenate([(np.diff(place) != 1) | (of[place[1:]] != of[place[:-1]]), [True]])] if len(place) else place
        return pa.table({
            "content": table["content"].take(pa.array(of[begin])),
            "first": pa.array(back[of[begin]] - offset[begin]), "last": pa.array(back[of[begin]] - offset[end])})

    keys = opened.select("content", "key")
    in_tasks = of_pieces(texts, opened.where(F.col("n") <= TOGETHER).select("doc", "place", "content"), unit, cut_out, schema)
    parts = in_tasks.join(keys, "content").groupBy("key").applyInArrow(refined, found)
    strings = T.StructType([T.StructField("content", T.LongType()), T.StructField("back", T.LongType()), T.StructField("string", T.LongType())])

    def open_up(units, data, content, at, lo, hi):
        for i in range(len(content)):
            start = np.arange(lo[i], hi[i] + 1)
            string = units.spans(start, start + span).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(start), content[i])), pa.array(at[i] - start), pa.array(string)], strings.names)

    large = opened.where(F.col("n") > TOGETHER).select("doc", "place", "content")
    if not large.isEmpty():
        each = staged(of_pieces(texts, large, unit, open_up, strings), "bucket-strings")
        again = each.groupBy("string").agg(F.count("*").alias("c")).where("c > 1").select("string")
        parts = parts.union(each.join(again, "string").select("content", F.col("back").alias("first"), F.col("back").alias("last")))
    # contents of several copies are repeated as a whole already; the others occur once
    single = opened.where("copies = 1").select("content", "doc", "place").join(parts, "content")
    return whole.union(single.select("doc", "place", "content", "first", "last"))


def _unit(span: int) -> Unit:
    return Unit(False, span, min(GRAM, span))


def _name(id: str, text: str) -> Column:
    """Rows of equal id and text share a name; each of them is an occurrence of its strings."""
    return F.xxhash64(F.col(id), F.col(text))


def without_repeats(docs: DataFrame, span: int = 400, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (of the bytes that stay).

    A byte goes if a string of `span` bytes (UTF-8) covers it that also starts anywhere else: in the same text, in another, or
    in a repeated row. Strings do not cross texts and are judged on the input. A null text is the empty one; rows without an id
    are documents like others.
    """
    spans = repeated_spans(docs, span, id, text)
    return with_removed(docs, _name(id, text), spans, _unit(span), _plain, _cut, ["n_bytes", "n_removed", "n_spans", "kept_sha256"],
                        [T.LongType(), T.LongType(), T.LongType(), T.StringType()], id, text)
