"""Lempel-Ziv phrase fingerprints, and likeness to an edited text and to the next document."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runledger.llm.common import CHUNK_BYTES, SpanHash

#: Smallest phrase hashes that a fingerprint keeps.
KEPT = 64
#: Text bytes of an ordered part, which one task reads in order.
PART_BYTES = 16 << 20
#: Parts that documents without an id are dealt to.
NULL_PARTS = 64


class Parse:
    """LZ78 parse of bytes: ends of its phrases, and the dictionary as a tree of (node, byte) edges."""

    def __init__(self):
        self.tree: dict[int, int] = {}
        self.node, self.count, self.length, self.ends = 0, 0, 0, []

    def copy(self) -> Parse:
        other = Parse()
        other.tree, other.ends = dict(self.tree), list(self.ends)
        other.node, other.count, other.length = self.node, self.count, self.length
        return other

    def feed(self, data: bytes) -> Parse:
        tree, node, count, end = self.tree, self.node, self.count, self.length
        known, push = tree.get, self.ends.append
        for byte in data:
            end += 1
            edge = node << 8 | byte
            after = known(edge)
            if after:
                node = after
            else:
                count += 1
                tree[edge] = count
                node = 0
                push(end)
        self.node, self.count, self.length = node, count, end
        return self


def sketches(parsed: list[tuple[bytes, list[int]]]) -> list[np.ndarray]:
    """The KEPT smallest distinct 32-bit hashes of the phrases of each (text, ends of phrases)."""
    data = np.frombuffer(b"".join(d for d, _ in parsed), np.uint8)
    counts = [len(e) for _, e in parsed]
    base = np.cumsum([0, *[len(d) for d, _ in parsed]])[:-1]
    ends = np.concatenate([np.asarray(e, np.int64) + b for (_, e), b in zip(parsed, base, strict=True)]) if parsed else np.zeros(0, np.int64)
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    at = np.cumsum([0, *counts])
    has = np.array(counts, np.int64) > 0
    starts[at[:-1][has]] = base[has]
    hashes = (SpanHash(data)(starts, ends) >> np.uint64(32)).astype(np.uint32)
    return [np.unique(hashes[a:b])[:KEPT] for a, b in zip(at[:-1], at[1:], strict=True)]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of common phrases, estimated on the smallest hashes of both; of two empty sets it is 1."""
    either = np.union1d(a, b)[:KEPT]
    if not len(either):
        return 1.0
    return float(np.count_nonzero(np.isin(either, a, assume_unique=True) & np.isin(either, b, assume_unique=True)) / len(either))


def as_hex(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def _ordered(docs: DataFrame, id: str, text: str) -> DataFrame:
    """Rows (part, tail, id, text) in descending id order inside parts; each part ends with the first row of the next as `tail`.

    Parts are ranges of ids, so that no task needs more than its part; after the last part comes the first again.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    n, total = narrow.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    parts = max(1, math.ceil((total or 0) / PART_BYTES))
    cuts = []
    if parts > 1:
        cuts = narrow.agg(F.percentile_approx("id", [i / parts for i in range(1, parts)], 100 * parts)).first()[0] or []
    cuts = np.unique(np.array(cuts, np.int64))

    @F.pandas_udf(T.IntegerType())
    def part_of(ids):
        # ids at or above the last cut are in part 0
        return (len(cuts) - ids.map(lambda i: np.searchsorted(cuts, i, side="right"))).astype("int32")

    spread = len(cuts) + 1 + F.shiftright(F.col("h"), 58).cast("int") + NULL_PARTS // 2
    dealt = narrow.withColumn("part", F.when(F.col("id").isNull(), spread).otherwise(part_of(F.coalesce("id", F.lit(0)))))
    top = F.max(F.struct(F.col("id").isNotNull().alias("known"), "id", F.bitwise_not("h").alias("turned")))
    heads = [(r["part"], r["top"]["id"], ~r["top"]["turned"]) for r in dealt.groupBy("part").agg(top.alias("top")).orderBy("part").collect()]
    before = [(heads[k - 1][0], i, h) for k, (_, i, h) in enumerate(heads)]
    small = spark.createDataFrame(before, T.StructType([
        T.StructField("to", T.IntegerType()), T.StructField("head_id", docs.schema[id].dataType), T.StructField("head_h", T.LongType())]))
    is_head = dealt["id"].eqNullSafe(small["head_id"]) & (dealt["h"] == small["head_h"])
    both = dealt.join(F.broadcast(small), is_head, "left").select(
        "id", "text", "h", F.posexplode(F.when(F.col("to").isNull(), F.array("part")).otherwise(F.array("part", "to"))).alias("tail", "part"))
    count = len(cuts) + 1 + NULL_PARTS
    order = ["part", "tail", F.col("id").desc_nulls_last(), "h"]
    return both.repartitionById(count, F.col("part")).sortWithinPartitions(*order).select("part", "tail", "id", "text")


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Whole texts are parsed into the phrases of an LZ78 dictionary of their own; the fingerprint is the KEPT smallest distinct
    hashes of the phrase set, in hex. The edited text has its last half (code points, rounded down) replaced by the start of the
    next document in descending id order; after the last document comes the first. Ids are integers or null: rows without an
    id come last, by a hash of their text, as do rows of one id. Null and blank texts: null is the empty text, whose phrase set is
    empty and like another empty one only. Repeated rows are rows like others, equal texts have equal fingerprints. Other columns
    are not read.
    """
    id_type = docs.schema[id].dataType
    schema = T.StructType([
        T.StructField(id, id_type), T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())])

    def run(batches):
        last = None  # (part, id, text, whole parse, parse of the half that stays) of the row that waits for the next
        jobs, held, id_arrow = [], 0, None

        def done():
            made = sketches([x for job in jobs for x in job[2:5]])
            rows = []
            for k, (key, n, *_, digest) in enumerate(jobs):
                own, edited, following = made[3 * k:3 * k + 3]
                rows.append((key, n, digest, as_hex(own), as_hex(edited), likeness(own, edited), likeness(own, following)))
            kinds = [id_arrow, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], schema.names)

        for batch in batches:
            id_arrow = batch.column(2).type
            for part, tail, key, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if tail and (last is None or last[0] != part):
                    continue  # a repeated row at the head of the next part
                data = text.encode()
                stays = len(text) - len(text) // 2
                half = Parse().feed(text[:stays].encode())
                whole = half.copy().feed(text[stays:].encode())
                if last is not None and last[0] == part:
                    _, other, old, old_whole, old_half = last
                    kept, start = old[:len(old) - len(old) // 2], text[:len(old) // 2].encode()
                    edited = kept.encode() + start
                    jobs.append((other, len(old), (old.encode(), old_whole.ends), (edited, old_half.feed(start).ends), (data, whole.ends),
                                 hashlib.sha256(edited).hexdigest()))
                    held += 3 * len(data) + len(edited)
                    if held >= CHUNK_BYTES:
                        yield done()
                        jobs, held = [], 0
                last = None if tail else (part, key, text, whole, half)
        if jobs:
            yield done()

    return _ordered(docs, id, text).mapInArrow(run, schema)
