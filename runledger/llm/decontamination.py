"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.llm.common import staged, word_array

#: Rows of the items' sketches (a hash, two small numbers, a digest) that are copied to every executor; more are shuffled.
BROADCAST_SKETCH = 500_000


def _shingles(words: DataFrame, k: int, *keep: str) -> DataFrame:
    """One row per run of k words, after the columns of `keep`: its hash `h` and the words `w` with the place `i`."""
    return words.where(F.size("w") >= k).select(*keep, "w", F.explode(F.sequence(F.lit(0), F.size("w") - k)).alias("i"))


def _hash(k: int) -> Column:
    return F.xxhash64(*[F.col("w")[F.col("i") + j] for j in range(k)])


def _string(k: int) -> Column:
    return F.concat_ws(" ", *[F.col("w")[F.col("i") + j] for j in range(k)])


def _small(df: DataFrame) -> DataFrame:
    """Copied to the executors if its counted size allows."""
    return F.broadcast(df) if df.count() <= BROADCAST_SKETCH else df


def _size_class(n: Column) -> Column:
    """Powers of two."""
    return F.floor(F.log2(n.cast("double"))).cast("int")


def find_leaks(docs: DataFrame, items: DataFrame, k: int = 5, threshold: float = 0.8, id: str = "doc_id", text: str = "text",
               item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Pairs of a document and an item of which at least `threshold` of the distinct k-word shingles stand in the document.

    Columns: id, text_hash, item_id, n_shingles (of the item), n_common, containment. Items of equal words are one, under the
    smallest id. Words are lower-cased and split at white space. An item with fewer than k words has no shingle and a null or
    blank text no words: they match nothing. Repeated rows of a document give one pair; a null id is an id like others.

    An item with q shingles may miss q - need of them, need = ceil(threshold * q). So of the q - need + 1 shingles of lowest
    hash - its MinHash sketch - a document that contains the item holds at least one: the search loses nothing. Sketches are
    partitioned by the size class of `need`, and a document is only looked up in classes that it is long enough for. What is
    found is verified on all shingles as strings.
    """
    lower = lambda c: word_array(F.lower(F.col(c)))
    item_words = items.select(F.col(item_id).alias("item_id"), lower(item_text).alias("w")).groupBy("w").agg(F.min("item_id").alias("item_id"))
    own = _shingles(item_words, k, "item_id").select(F.md5(F.concat_ws(" ", "w")).alias("item"), "item_id", _hash(k).alias("h"), _string(k).alias("shingle")).distinct()
    each = Window.partitionBy("item")
    need = F.ceil(F.col("q") * threshold - 1e-9).cast("long")
    ranked = own.withColumns({"q": F.count("*").over(each), "rank": F.row_number().over(each.orderBy("h", "shingle"))})
    index = staged(ranked.withColumn("need", need), "leak-items")
    sketch = index.where(F.col("rank") <= F.col("q") - F.col("need") + 1).groupBy("h").agg(F.min("need").alias("need"))
    sketch = staged(sketch.withColumn("least_class", _size_class(F.col("need"))), "leak-sketch")

    texts = docs.select(F.col(id).alias("id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("text"))
    words = texts.select("id", "text_hash", word_array(F.lower("text")).alias("w"))
    shortest = sketch.agg(F.min("need")).first()[0] or 0
    searched = _shingles(words.where(F.size("w") - (k - 1) >= shortest), k, "id", "text_hash").select(
        "id", "text_hash", _size_class(F.size("w") - (k - 1)).alias("class"), _hash(k).alias("h"))
    found = searched.join(_small(sketch), "h").where(F.col("class") >= F.col("least_class"))
    candidates = staged(found.select("id", "text_hash").distinct(), "leak-candidates").withColumnsRenamed({"id": "c_id", "text_hash": "c_hash"})

    same = words["id"].eqNullSafe(candidates["c_id"]) & (words["text_hash"] == candidates["c_hash"])
    held = words.join(candidates, same, "left_semi").dropDuplicates(["id", "text_hash"])
    strings = _shingles(held, k, "id", "text_hash").select("id", "text_hash", _hash(k).alias("h"), _string(k).alias("s"))
    matched = strings.join(_small(index), "h").where(F.col("s") == F.col("shingle"))
    pairs = matched.select("id", "text_hash", "item", "item_id", "q", "need", "shingle").distinct()
    counted = pairs.groupBy("id", "text_hash", "item", "item_id", "q", "need").agg(F.count("*").alias("n_common"))
    return counted.where(F.col("n_common") >= F.col("need")).select(
        F.col("id").alias(id), "text_hash", "item_id", F.col("q").alias("n_shingles"), "n_common",
        (F.col("n_common") / F.col("q")).alias("containment"))


def without_leaks(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of `docs` that contain no item."""
    leaks = find_leaks(docs, items, id=id, text=text, **how).select(F.col(id).alias("_leak_id"), F.col("text_hash").alias("_leak_hash")).distinct()
    leaks = staged(leaks, "leaks")
    return docs.join(leaks, docs[id].eqNullSafe(leaks["_leak_id"]) & (F.xxhash64(docs[text]) == leaks["_leak_hash"]), "left_anti")
