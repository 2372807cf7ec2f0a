"""Batch writers."""

from __future__ import annotations

import re
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.functions.classify import REGIMES
from runledger.functions.derive import COMMAND
from runledger.sources import manifest


def write_report_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_results_json(df: DataFrame, folder: str, order: str = "case_id", stamp: str | None = None) -> str:
    """Records in case order as JSON lines: a time-stamped set, which then becomes the latest one (`latest_results`).

    The set is range-partitioned by `order`, so that its files are in case order one after the other. It is complete before a
    manifest names it as the latest, so "latest" is never missing or half there; a set that was published under the same stamp
    before stays as it is, beside the new one.
    """
    spark = df.sparkSession
    stamp = stamp or datetime.now(timezone.utc).strftime("%Y%m%d_%H%M%S")
    known = manifest.current(spark, folder) or {"sets": []}
    name, again = f"results_{stamp}", 1
    while name in known["sets"]:
        again += 1
        name = f"results_{stamp}_{again}"
    # what a failed attempt left under a name that no manifest holds is overwritten
    df.orderBy(order).write.mode("overwrite").json(f"{folder}/{name}")
    manifest.commit(spark, folder, {"latest": name, "sets": [*known["sets"], name]})
    return f"{folder}/{name}"


def latest_results(spark: SparkSession, folder: str) -> str:
    """The folder of the latest set that `write_results_json` published."""
    found = manifest.current(spark, folder)
    if found is None:
        raise FileNotFoundError(f"no results in {folder}")
    return f"{folder}/{found['latest']}"


def append_results(df: DataFrame, path: str, batch: str | None = None) -> None:
    """Add rows to a run table; a failed task leaves nothing behind, a finished one is committed.

    With the name of a `batch`, appending it again adds nothing: its files carry the name, and a mark is set once all are in place.
    An attempt that failed before that mark is undone by the next one. Without a name, a retry adds the rows again.
    """
    writer = df.write.mode("append").option("header", True)
    if batch is None:
        writer.csv(path)
        return
    spark = df.sparkSession
    if not re.fullmatch(r"[A-Za-z0-9.]+", batch):
        raise ValueError("a batch is named by letters, digits and dots")
    marks = f"{path}/_batches"
    if batch in manifest.names(spark, marks):
        return
    staged = f"{path}/_staged-{batch}"
    manifest.delete(spark, staged)
    for name in manifest.names(spark, path):
        if name.startswith(f"{batch}-"):
            manifest.delete(spark, f"{path}/{name}")
    writer.csv(staged)
    move_files(spark, staged, path, batch)
    fs, _ = manifest.file_system(spark, marks)
    fs.mkdirs(spark._jvm.org.apache.hadoop.fs.Path(marks, batch))


def move_files(spark: SparkSession, staged: str, folder: str, name: str) -> None:
    """Move the data files of a staged folder into another, under `name`, and delete the rest of it."""
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    fs, here = manifest.file_system(spark, staged)
    for file in manifest.names(spark, staged):
        if file.startswith("part-") and not fs.rename(path_of(here, file), path_of(folder, f"{name}-{file}")):
            raise OSError(f"{file} of {name} cannot be moved to {folder}")
    manifest.delete(spark, staged)


def write_documents(df: DataFrame, key: str, text: str, path: str) -> None:
    """One text file per row (an input deck, a JSON document), in a folder named after `key`."""
    df.select(key, F.col(text).alias("value")).write.partitionBy(key).text(path)


def records_to_json(df: DataFrame, name: str = "json") -> DataFrame:
    """Every row as one JSON text."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias(name))


def flatten_params(df: DataFrame, params: str = "predicted_params") -> DataFrame:
    """Command fields as columns; a missing key (or command) counts as 0."""
    return df.withColumns({c: F.coalesce(F.col(f"{params}.{c}"), F.lit(0.0)) for c in COMMAND})


def calibration_map(fits: DataFrame, samples: DataFrame, regime: str = "regime", x: str = "power_delta",
                    y: str = "delta_step") -> DataFrame:
    """Calibration record: regime -> borders, fit and, where a fit was possible, the ranges of the samples behind it.

    `samples` carry their regime. The fits are restricted to the six regimes; the samples stay a table, and the record holds
    their number and range.
    """
    fields = [c for c in fits.columns if c != regime]
    known = [label for label, _, _ in REGIMES]
    border = lambda k: F.element_at(F.create_map(*[F.lit(v) for r in REGIMES for v in (r[0], float(r[k]))]), F.col(regime))
    spans = samples.groupBy(F.col(regime).alias("_of")).agg(
        F.array(F.min(y), F.max(y)).alias("ds_range"), F.array(F.min(x), F.max(x)).alias("pd_range"))
    fitted = fits.where(F.col(regime).isin(known)).join(spans, F.col(regime) == F.col("_of"), "left")
    enough = F.col("n_samples") >= 2
    entry = F.struct(border(1).alias("lo"), border(2).alias("hi"), *fields,
                     *[F.when(enough, F.col(c)).alias(c) for c in ("ds_range", "pd_range")])
    by_regime = fitted.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(regime), entry.alias("entry"))))).alias("regimes"))
    ranges = samples.agg(F.count("*").alias("n_total_samples"), F.min(x).alias("x_min"), F.max(x).alias("x_max"),
                         F.min(y).alias("y_min"), F.max(y).alias("y_max"))
    return by_regime.withColumn("_k", F.lit(0)).join(ranges.withColumn("_k", F.lit(0)), "_k").drop("_k")
