"""Removal of repeated word windows on a compacted de Bruijn graph."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runledger.llm.common import staged
from runledger.llm.repeats import Unit, covered, named, of_pieces, pieces, with_removed

#: Words of a minimizer.
GRAM = 5


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _plain(text: bytes) -> tuple:
    words = text.split()
    return len(words), 0, _sha(words)


def _cut(text: bytes, lo: np.ndarray, hi: np.ndarray) -> tuple:
    words = text.split()
    gone = covered(len(words), lo, hi)
    return len(words), int(gone.sum()), _sha([w for w, g in zip(words, gone.tolist(), strict=True) if not g])


def repeated_spans(docs: DataFrame, window: int = 13, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Windows (doc, place, content, first, last) whose words also start in a document of smaller id, as parts of pieces.

    The graph's edges are the windows, its nodes what two consecutive windows share. A piece - consecutive windows under one
    minimizer - is a path of edges, found inside a text. One aggregation over minimizers leaves the pieces that can repeat
    across documents, and equal paths are compacted to one row with the smallest id they occur in:

    * every occurrence in another document than that is repeated as a whole, without looking inside;
    * a minimizer with one path has no branch, so its first occurrence is the first of all its windows;
    * a minimizer with several paths branches: the first occurrence of each path is opened into its edges at its source
      coordinates, equal edges are joined, and those that an earlier document has are repeated there too.
    """
    unit = _unit(window)
    texts = named(docs.where(docs[id].isNotNull()), docs[id], text)
    every = pieces(texts, unit)
    across = every.groupBy("key").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low != high").select("key")
    rows = staged(every.join(across, "key"), "repeat-pieces")
    paths = staged(rows.groupBy("content").agg(F.min("doc").alias("earliest"), F.min("key").alias("key")), "paths")
    branching = paths.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.lit(True).alias("open"))
    opened = paths.join(branching, "key", "left").select("content", "earliest", F.coalesce("open", F.lit(False)).alias("open"))
    marked = rows.select("content", "doc", "place").join(opened, "content").withColumn("later", F.col("doc") > F.col("earliest"))
    marked = staged(marked.where("later or open").select("doc", "place", "content", "later"), "marked-pieces")

    first = marked.where("not later")
    chosen = first.groupBy("content").agg(F.min(F.struct("doc", "place")).alias("r")).select("r.doc", "r.place", "content")
    schema = T.StructType([T.StructField("content", T.LongType()), T.StructField("back", T.LongType()), T.StructField("edge", T.LongType())])

    def edges(units, data, content, at, lo, hi):
        n = hi - lo + 1
        row = np.repeat(np.arange(len(n)), n)
        start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[row]
        edge = units.spans(start, start + unit.span).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(content[row]), pa.array(at[row] - start), pa.array(edge)], schema.names)

    own = paths.select("content", "earliest")
    inside = staged(of_pieces(texts, chosen, unit, edges, schema).join(own, "content"), "path-edges")
    before = inside.groupBy("edge").agg(F.min("earliest").alias("low"))
    early = inside.join(before, "edge").where("low < earliest").select("content", "back")
    low = (1 << unit.bits) - 1
    back, ahead = F.shiftright("place", unit.bits).bitwiseAND(low), F.col("place").bitwiseAND(low)
    whole = marked.where("later").select("doc", "place", "content", back.alias("first"), ahead.alias("last"))
    single = first.join(early, "content").select("doc", "place", "content", F.col("back").alias("first"), F.col("back").alias("last"))
    return whole.union(single)


def _unit(window: int) -> Unit:
    return Unit(True, window, min(GRAM, window))


def without_repeats(docs: DataFrame, window: int = 13, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: id, n_words, n_removed, kept_sha256 (of the kept words, joined by one blank).

    A word goes if a window of `window` words covers it whose words also start in a document with a smaller id. Windows are
    judged on the input. Repeats inside one document stay; rows that share an id are one document in that sense, each cut by its
    own text. Rows without an id lose nothing and take nothing from others. A null or blank text has no words.
    """
    spans = repeated_spans(docs, window, id, text)
    return with_removed(docs, F.col(id), spans, _unit(window), _plain, _cut, ["n_words", "n_removed", "kept_sha256"],
                        [T.LongType(), T.LongType(), T.StringType()], id, text)
