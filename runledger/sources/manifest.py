"""Numbered manifests beside data folders: what a reader sees changes in one step, or not at all.

A manifest is a small JSON file of its own under `_manifests`, written once under the next number and never changed. Data folders
are complete before a manifest names them, and are not touched while one of the newest manifests does. So a reader that starts
while a writer works gets the old state or the new one, and a writer that fails before its manifest has changed nothing. One
writer at a time; a second one that takes the same number is refused by the file system.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

#: Manifests whose data stays on disk for readers that began with them.
KEPT = 3
HIDDEN = "_manifests"


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system and path object of a folder, whatever store it is on."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of the entries of a folder, none where it doesn't exist."""
    fs, where = file_system(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, where = file_system(spark, path)
    fs.delete(where, True)


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    return sorted(int(n.removesuffix(".json")) for n in names(spark, f"{folder}/{HIDDEN}") if n.endswith(".json"))


def _read(spark: SparkSession, folder: str, number: int) -> dict | None:
    """A manifest; None if its writer was lost in the middle of it."""
    fs, where = file_system(spark, f"{folder}/{HIDDEN}/{number:012d}.json")
    size = fs.getFileStatus(where).getLen()
    stream = fs.open(where)
    try:
        text = bytes(stream.readNBytes(int(size))).decode()
    finally:
        stream.close()
    try:
        return json.loads(text)
    except ValueError:
        return None


def current(spark: SparkSession, folder: str) -> dict | None:
    """The newest complete manifest of a folder."""
    for number in reversed(_numbers(spark, folder)):
        found = _read(spark, folder, number)
        if found is not None:
            return found
    return None


def commit(spark: SparkSession, folder: str, content: dict) -> None:
    """Publish `content` as the newest manifest."""
    number = max(_numbers(spark, folder), default=0) + 1
    fs, where = file_system(spark, f"{folder}/{HIDDEN}/{number:012d}.json")
    stream = fs.create(where, False)  # refuses a number that exists
    try:
        stream.write(bytearray(json.dumps(content).encode()))
    finally:
        stream.close()


def forget_old(spark: SparkSession, folder: str, data_of) -> None:
    """Delete the manifests but the newest KEPT, and the data that only they name; `data_of(manifest)` lists entry names."""
    numbers = _numbers(spark, folder)
    old, kept = numbers[:-KEPT], numbers[-KEPT:]
    alive = {d for n in kept for d in data_of(_read(spark, folder, n) or {})}
    for n in old:
        for d in data_of(_read(spark, folder, n) or {}):
            if d not in alive:
                delete(spark, f"{folder}/{d}")
        delete(spark, f"{folder}/{HIDDEN}/{n:012d}.json")
