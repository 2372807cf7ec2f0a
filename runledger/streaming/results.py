"""Incremental ingestion of growing result folders (JSON lines)."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from runledger import schemas
from runledger.functions.derive import flag
from runledger.sources import manifest
from runledger.sources.readers import json_records
from runledger.sources.writers import move_files, write_results_json
from runledger.streaming import keyindex

#: Column of `stream_results` that can bound the state of streaming operators.
FILE_TIME = "file_time"
#: Spark's file source leaves out files that are older than its newest by more than this, seven days unless it is set.
FILE_AGE = "36500d"


def stream_results(spark: SparkSession, folder: str, schema: StructType = schemas.RESULTS,
                   files_per_batch: int | None = None) -> DataFrame:
    """Stream of records as files arrive, by the rules of the batch reader, with the time their file was written (`file_time`).

    Files count however old they are, so the driver remembers the names of all it has read.
    """
    reader = spark.readStream.option("maxFileAge", FILE_AGE)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    lines = reader.text(folder).select("value", F.col("_metadata.file_modification_time").alias(FILE_TIME))
    return json_records(lines, schema, [FILE_TIME])


def stream_dedup(results: DataFrame, key: list[str], event_time: str | None = None, keep_for: str = "7 days") -> DataFrame:
    """A case counts once, also across restarts and however long the folder grows. Every key stays in the state;
    `append_new` does the same without one.

    With `event_time` the state is bounded and the result is not exact: only repeats within `keep_for` of each other are
    dropped, and so are rows that come later than that.
    """
    if event_time:
        return results.withWatermark(event_time, keep_for).dropDuplicatesWithinWatermark(key)
    return results.dropDuplicates(key)


def stream_running_success(results: DataFrame, by: list[str]) -> DataFrame:
    """Live counts and accuracy per group."""
    agg = results.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(flag(F.col("validation_success_5"))).alias("ok_5"))
    return agg.withColumn("success_rate", F.col("ok_5") / F.col("n"))


def append_stream(results: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append everything available to a parquet folder, exactly once per checkpoint, then stop.

    Starting it again with the same checkpoint resumes; a new checkpoint and table start over.
    """
    writer = results.writeStream.format("parquet").outputMode("append").option("path", table)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_new(results: DataFrame, key: list[str], table: str, checkpoint: str) -> StreamingQuery:
    """As `append_stream`, but a case (its `key`, nulls being equal) is stored once, however far apart its repeats are.

    There is no state: a batch is deduplicated, and its keys are looked up in the table's key index (`keyindex`), of which it reads
    the folders only that may hold one of them. Its files carry its name and count once a manifest says so: a batch that is done
    again after a failure first removes what the failed attempt left. Rows that were in `table` before are indexed at the first
    start. Only one query may write to `table`, which must not be one of `append_stream`: readers of those see no files but its own.
    """
    spark = results.sparkSession
    log = spark._jvm.org.apache.hadoop.fs.Path(table, "_spark_metadata")
    if log.getFileSystem(spark._jsc.hadoopConfiguration()).exists(log):
        raise ValueError(f"{table} is written by append_stream")
    schema = results.schema
    if manifest.current(spark, table) is None:
        spark.createDataFrame([], schema).write.mode("append").parquet(table)
        before = spark.read.schema(schema).parquet(table).dropDuplicates(key)
        first = keyindex.write_run(before, key, table, "run-before")
        manifest.commit(spark, table, {"done": {}, "runs": [first] if first else []})
    query = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = manifest.current(spark, table)
        if known["done"].get(query, -1) >= number:
            return
        name, staged = f"{query}.{number}", f"{table}/_staged-{query}.{number}"
        for left in manifest.names(spark, table):
            if left.startswith(f"{name}-"):
                manifest.delete(spark, f"{table}/{left}")
        batch.dropDuplicates(key).write.mode("overwrite").parquet(staged)
        asked = spark.read.schema(schema).parquet(staged)
        new = keyindex.without_known(asked, key, table, known["runs"])
        if new is not asked:  # else no key can be known, and the rows stay as they are written
            new.write.mode("overwrite").parquet(f"{staged}-new")
            manifest.delete(spark, staged)
            staged = f"{staged}-new"
        run = keyindex.write_run(spark.read.schema(schema).parquet(staged), key, table, f"run-{name}")
        move_files(spark, staged, table, name)
        runs = keyindex.merged(spark, key, table, [*known["runs"], *([run] if run else [])], batch, f"merged-{name}")
        manifest.commit(spark, table, {"done": {**known["done"], query: number}, "runs": runs})
        manifest.forget_old(spark, table, lambda m: [f"{keyindex.FOLDER}/{r['name']}" for r in m.get("runs", [])])

    writer = results.writeStream.foreachBatch(add)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Changes that a reader folds at most; more are folded into one by the writer.
DELTAS = 16


def snapshot_stream(aggregated: DataFrame, by: list[str], table: str, checkpoint: str) -> StreamingQuery:
    """Keep the newest result of a streaming aggregate with one row for each group `by`, for `read_snapshot`.

    A batch writes the groups that it changed, not the table, to a folder of its own, and then publishes it in a manifest. A
    reader gets the state before a batch or after it. A batch that is done again replaces its own folder, which nobody has seen.
    After DELTAS of them the changes are folded into one.
    """
    def change(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = (manifest.current(spark, table) or {"deltas": []})["deltas"]
        if any(d["batch"] >= number for d in known):
            return
        name = f"delta-{number}"
        batch.write.mode("overwrite").parquet(f"{table}/{name}")
        deltas = [*known, {"batch": number, "name": name}]
        if len(deltas) > DELTAS:
            name = f"folded-{number}"
            _fold(spark, table, deltas, by, batch.schema).write.mode("overwrite").parquet(f"{table}/{name}")
            deltas = [{"batch": number, "name": name}]
        manifest.commit(spark, table, {"deltas": deltas})
        manifest.forget_old(spark, table, lambda m: [d["name"] for d in m.get("deltas", [])])

    writer = aggregated.writeStream.outputMode("update").foreachBatch(change)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_snapshot(spark: SparkSession, table: str, by: list[str], schema: StructType) -> DataFrame:
    """The newest row of every group that `snapshot_stream` published; no rows before its first batch."""
    deltas = (manifest.current(spark, table) or {"deltas": []})["deltas"]
    return _fold(spark, table, deltas, by, schema)


def _fold(spark: SparkSession, table: str, deltas: list[dict], by: list[str], schema: StructType) -> DataFrame:
    if not deltas:
        return spark.createDataFrame([], schema)
    parts = [spark.read.schema(schema).parquet(f"{table}/{d['name']}").withColumn("_batch", F.lit(d["batch"])) for d in deltas]
    rest = [c for c in schema.names if c not in by]
    newest = reduce(DataFrame.unionByName, parts).groupBy(*by).agg(F.max_by(F.struct(*rest), "_batch").alias("_newest"))
    return newest.select(*by, "_newest.*").select(*schema.names)


def stream_to_latest(spark: SparkSession, table: str, schema: StructType, folder: str, order: str = "case_id",
                     stamp: str | None = None) -> str:
    """Consolidate the ingested table into a sorted, dated record set, which becomes the latest one."""
    ingested = spark.read.schema(schema).parquet(table)
    return write_results_json(ingested, folder, order, stamp)
