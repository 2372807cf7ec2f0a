"""Helpers of the operators: words, staging, and vectorised hashing of spans of text."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEPARATORS = "[\\x20\\x09-\\x0D]"
WORD = "[^\\x20\\x09-\\x0D]+"

#: Bytes of text that one vectorised step handles; a longer document is a step of its own.
CHUNK_BYTES = 1_000_000
#: The same for steps that make many arrays of their length, which a worker holds at once.
FEW_BYTES = 250_000


def shared_dir(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`, which all executors share.

    In a local session without that setting, as in tests, a temporary folder is set for the session.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        path = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/llm/{label}-{uuid.uuid4().hex}"


#: Rows of whole texts that go to a Python worker at once, and of narrow rows what Spark's default says.
TEXTS_AT_ONCE = 1_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def staged(df: DataFrame, label: str, of_texts: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it back: its rows are fixed and its lineage is cut.

    With `of_texts` (or sets of texts), Arrow batches on the way are TEXTS_AT_ONCE rows, which are held in the executor and in its
    worker.
    """
    spark = df.sparkSession
    path, before = new_folder(spark, label), spark.conf.get(_BATCH)
    if of_texts:
        spark.conf.set(_BATCH, str(TEXTS_AT_ONCE))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    return spark.read.schema(df.schema).parquet(path)


def fits(table: DataFrame, most_bytes: int, most_rows: int) -> bool:
    """Whether a staged table is small enough to copy to every executor: in bytes of its files, then in rows."""
    planned = int(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return planned <= most_bytes and table.count() <= most_rows


def n_words(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def word_array(text: Column) -> Column:
    """Words of a text in order; null and blank texts give an empty array."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{SEPARATORS}+|{SEPARATORS}+$", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{SEPARATORS}+"))


def texts_in_steps(values: list[bytes], most: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, texts) of consecutive runs of about `most` bytes."""
    first, total = 0, 0
    for i, v in enumerate(values):
        total += len(v)
        if total >= most:
            yield first, values[first:i + 1]
            first, total = i + 1, 0
    if first < len(values):
        yield first, values[first:]


def column_bytes(column) -> list[bytes]:
    """UTF-8 of an Arrow string column; null is the empty text."""
    return [b"" if v is None else v for v in column.cast("binary").to_pylist()]


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2^64."""
    if len(_powers[0]) < n:
        size = 1 << int(n - 1).bit_length()
        for k, b in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class SpanHash:
    """64-bit hashes of any spans of an integer array, by prefix sums of a polynomial modulo 2^64."""

    def __init__(self, values: np.ndarray):
        powers, self._back = _tables(len(values) + 1)
        self._sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers[:-1], out=self._sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self._sums[end] - self._sums[start]) * self._back[start]
        return mix(raw + (np.asarray(end) - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_P = (1 << 61) - 1
_PRIME = np.uint64(_P)
_LOW31, _LOW30 = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
_1, _30, _31, _61 = (np.uint64(k) for k in (1, 30, 31, 61))
#: Units that one vectorised step handles, which then stays in the cache.
_STEP = 1 << 14
_PRIME_BASE = 0x13198A2E03707344 % _P
_prime_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo the prime 2^61 - 1."""
    x = (x & _PRIME) + (x >> _61)
    return np.minimum(x, x - _PRIME)  # below the prime the difference wraps to a large number


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2^61 - 1, for a and b below it."""
    a1, a0, b1, b0 = a >> _31, a & _LOW31, b >> _31, b & _LOW31
    middle = a0 * b1 + a1 * b0
    return _reduced(((a1 * b1) << _1) + (middle >> _30) + ((middle & _LOW30) << _31) + a0 * b0)


def _prime_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2^61 - 1."""
    if len(_prime_powers[0]) < n:
        size = 1 << int(n - 1).bit_length()
        for k, b in enumerate((_PRIME_BASE, pow(_PRIME_BASE, -1, _P))):
            made, known = np.ones(size, np.uint64), 1
            while known < size:  # the powers up to twice as far are those known times one more
                for at in range(0, known, _STEP):
                    own = made[at:min(at + _STEP, known)]
                    made[known + at:known + at + len(own)] = _times(own, np.full(len(own), pow(b, known, _P), np.uint64))
                known *= 2
            _prime_powers[k] = made
    return _prime_powers[0][:n], _prime_powers[1][:n]


class PrimeSpans:
    """As `SpanHash`, by a polynomial modulo the prime 2^61 - 1.

    Modulo 2^64 every two complementary Thue-Morse strings of 1,024 symbols collide; modulo a prime a polynomial of degree n has
    at most n roots, so no structure of two texts makes them equal for more than n in 2^61 bases.
    """

    def __init__(self, values: np.ndarray):
        powers, self._back = _prime_tables(len(values) + 1)
        self._sums = np.zeros(len(values) + 1, np.uint64)
        last = np.uint64(0)
        for at in range(0, len(values), _STEP):
            own = _reduced(_reduced(values[at:at + _STEP].astype(np.uint64)) + _1)
            terms = _times(own, powers[at:at + len(own)])
            # the sums of the lower and upper halves of a step stay below 2^50
            low, high = np.cumsum(terms & _LOW31), np.cumsum(terms >> _31)
            sums = _reduced(((high & _LOW30) << _31) + (high >> _30) + low + last)
            self._sums[at + 1:at + 1 + len(own)] = sums
            last = sums[-1]

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        start, end = np.asarray(start), np.asarray(end)
        out = np.empty(len(start), np.uint64)
        for at in range(0, len(start), _STEP):
            a, b = start[at:at + _STEP], end[at:at + _STEP]
            raw = _times(_reduced(self._sums[b] + (_PRIME - self._sums[a])), self._back[a])
            out[at:at + _STEP] = mix(raw + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        return out


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


class Words:
    """Words of several UTF-8 texts: start and end in `data`, number of the text, hash; `first[i]` is text i's first word."""

    def __init__(self, texts: list[bytes], spans=SpanHash):
        self.spans = spans
        self.data = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
        self.offsets = np.cumsum([1, *[len(t) + 1 for t in texts]])
        space = _IS_SPACE[self.data]
        self.start = np.flatnonzero(space[:-1] & ~space[1:]) + 1
        self.end = np.flatnonzero(~space[:-1] & space[1:]) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.hash = spans(self.data)(self.start, self.end)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word and hash of all runs of k words of one text."""
        n = len(self.start) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.text[:n] == self.text[k - 1:])
        return at, self.spans(self.hash)(at, at + k)
