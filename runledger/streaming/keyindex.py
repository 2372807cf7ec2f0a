"""An index of the keys that a growing table holds, of which a batch reads only what may hold its keys.

The index is a list of runs, named by the table's manifest. A run is what one batch added, or several runs merged: its keys in
folders by hash bucket, and for every bucket a blocked Bloom filter as rows (word, bits). A batch looks its keys up in the filters
and then reads the key folders that answered; keys are compared as they are, so a filter's error costs a read and no case. After
MOST_RUNS runs all are merged, with a bucket for every BUCKET_ROWS keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FOLDER = "_keys"
MOST_RUNS = 8
BUCKET_ROWS, FEWEST_BUCKETS = 1_000_000, 16
#: Keys for each 64-bit word of a filter; a key sets BITS of them.
KEYS_A_WORD, BITS = 4, 4
_BLOOM = "word long, bits long, bucket int"


def _hash(key: list[str], seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *[F.col(k) for k in key])


def _bucket(key: list[str], run: dict) -> Column:
    return F.pmod(_hash(key, 1), F.lit(run["buckets"]).cast("long")).cast("int")


def _word(key: list[str], run: dict) -> Column:
    return F.pmod(_hash(key, 2), F.lit(run["words"]).cast("long"))


def _mask(key: list[str]) -> Column:
    mask, code = F.lit(0).cast("long"), _hash(key, 3)
    for i in range(BITS):
        place = F.shiftright(code, 6 * i).bitwiseAND(F.lit(63).cast("long")).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))
    return mask


def write_run(keys: DataFrame, key: list[str], table: str, name: str) -> dict | None:
    """Write the run of some distinct keys; what the manifest says about it, None without keys."""
    rows = keys.count()
    if not rows:
        return None
    buckets = max(FEWEST_BUCKETS, -(-rows // BUCKET_ROWS))
    run = {"name": name, "rows": rows, "buckets": buckets, "words": max(1, rows // buckets // KEYS_A_WORD)}
    path, placed = f"{table}/{FOLDER}/{name}", keys.select(*key, _bucket(key, run).alias("bucket"))
    # a bucket is one task's files
    placed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/keys")
    bits = placed.groupBy("bucket", _word(key, run).alias("word")).agg(F.bit_or(_mask(key)).alias("bits"))
    bits.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/bloom")
    return run


def folders_with(keys: DataFrame, key: list[str], table: str, runs: list[dict]) -> list[str]:
    """The key folders that may hold one of the keys: a bucket of a run each, of which there are few."""
    spark, found = keys.sparkSession, []
    for run in runs:
        path = f"{table}/{FOLDER}/{run['name']}"
        bloom = spark.read.schema(_BLOOM).parquet(f"{path}/bloom")
        asked = keys.select(_bucket(key, run).alias("bucket"), _word(key, run).alias("word"), _mask(key).alias("mask"))
        hits = bloom.join(asked, ["bucket", "word"]).where(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"))
        found += [f"{path}/keys/bucket={r.bucket}" for r in hits.select("bucket").distinct().collect()]
    return found


def without_known(rows: DataFrame, key: list[str], table: str, runs: list[dict]) -> DataFrame:
    """The rows whose key no run holds, `rows` itself where no folder has to be read; nulls in a key are equal to each other."""
    folders = folders_with(rows, key, table, runs)
    if not folders:
        return rows
    stored = _read(rows.sparkSession, folders, rows, key).select(*[F.col(k).alias(f"_{k}") for k in key])
    return rows.join(stored, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key], "left_anti")


def _read(spark: SparkSession, folders: list[str], like: DataFrame, key: list[str]) -> DataFrame:
    return spark.read.schema(StructType([like.schema[k] for k in key])).parquet(*folders)


def merged(spark: SparkSession, key: list[str], table: str, runs: list[dict], like: DataFrame, name: str) -> list[dict]:
    """The runs, or one instead of them where there are too many. Their keys are distinct, as a batch adds only new ones."""
    if len(runs) <= MOST_RUNS:
        return runs
    every = reduce(DataFrame.union, [_read(spark, [f"{table}/{FOLDER}/{r['name']}/keys"], like, key).select(*key) for r in runs])
    return [write_run(every, key, table, name)]
