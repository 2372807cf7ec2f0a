"""Two-pass external shuffle into shards."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runledger.llm.common import staged

#: Text bytes of a bucket, the unit that one task holds in memory.
BUCKET_BYTES = 64 << 20


def record_bytes(text: str = "text"):
    """UTF-8 bytes of a text (null: none) plus 1."""
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 1


def shuffle_into_shards(docs: DataFrame, shards: int = 8, seed: int = 17, bucket_bytes: int = BUCKET_BYTES, text: str = "text") -> DataFrame:
    """All rows of `docs` as a column `row`, with shard (from 0) and slot (gapless from 0 in each shard), in random order.

    Pass 1 scatters records into buckets by a seeded hash of all their columns. Pass 2 holds one bucket per task, sorts it by
    that hash, so that its order does not depend on the layout of the input, and runs a seeded Fisher-Yates shuffle over it
    (Spark's `shuffle` of an array); the result is written to the shared folder. The buckets one after the other are one random
    permutation, dealt out to the shards in turn: counts differ by one at most (law `rows`), and each shard is a random sample.

    Nulls in any column and empty texts are ordinary values; equal rows are kept, each with a slot of its own. An empty table
    gives no rows. The columns of `docs` stay inside `row`, so that none can clash; they must be orderable (no maps).
    """
    total = docs.agg(F.sum(record_bytes(text))).first()[0] or 0
    buckets = max(1, math.ceil(total / bucket_bytes))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select(F.struct(*columns).alias("row"), F.xxhash64(F.lit(seed), *columns).alias("key"))
    scattered = keyed.withColumn("bucket", F.pmod("key", F.lit(buckets)).cast("int")).repartitionById(buckets, F.col("bucket"))
    held = scattered.groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("key", "row"))).alias("rows"))
    dealt = held.select("bucket", F.posexplode(F.shuffle("rows", seed)).alias("at", "r")).select("bucket", "at", "r.row")
    dealt = staged(dealt, "shuffled")
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("bucket").agg(F.count("*").alias("n")).select("bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    place = F.col("before") + F.col("at")
    placed = dealt.join(F.broadcast(offsets), "bucket")  # a row for each 64 MB of text
    return placed.select("row", F.pmod(place, F.lit(shards)).cast("int").alias("shard"), F.floor(place / shards).cast("long").alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, the rows of each file in the order of their slots."""
    flat = sharded.select("shard", "slot", "row")
    flat.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
