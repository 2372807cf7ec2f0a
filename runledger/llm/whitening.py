"""Whitening of embeddings by spectrum slicing: eigenvalues are isolated, refined and certified by inertia counts."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runledger.llm.common import staged
from runledger.llm.vectors import matrix, usable

#: x = floor(SCALE * c) + SHIFT of an entry c; LIMIT keeps it a long, whatever the entry.
SCALE, SHIFT, LIMIT = 1024, 100_000, 1 << 62
#: Numbers below this can be added and squared as longs where a bound says so; others are Python integers.
LONG = (1 << 63) - 1
#: Eigenvalues up to so many times the rounding error of the matrix are noise.
FLOOR = 100
#: Entries of vectors that one vectorised step handles.
STEP = 1 << 20


def inertia(a: np.ndarray, shift: float) -> int:
    """How many eigenvalues of the symmetric matrix `a` are above `shift`: the positive pivots of L D Lᵀ = a - shift I.

    Symmetric pivoting takes the largest diagonal entry, or a pair of rows (a 2 x 2 pivot, one eigenvalue of each sign) where
    an entry beside the diagonal is much larger, so that the factors stay small and the signs can be trusted.
    """
    m = a - shift * np.eye(len(a))
    above = 0
    while len(m):
        diagonal = np.abs(np.diagonal(m))
        p = int(diagonal.argmax())
        beside = np.abs(m)
        np.fill_diagonal(beside, 0)
        r, s = divmod(int(beside.argmax()), len(m))
        if diagonal[p] == 0 and beside[r, s] == 0:
            break
        if diagonal[p] >= 0.6404 * beside[r, s]:
            above += m[p, p] > 0
            rest = np.delete(np.arange(len(m)), p)
            column = m[rest, p]
            m = m[np.ix_(rest, rest)] - np.outer(column, column / m[p, p])
        else:
            above += 1
            rest = np.delete(np.arange(len(m)), [r, s])
            block, columns = m[np.ix_([r, s], [r, s])], m[np.ix_(rest, [r, s])]
            m = m[np.ix_(rest, rest)] - columns @ np.linalg.solve(block, columns.T)
        m = (m + m.T) / 2
    return int(above)


@dataclass
class Slice:
    """The eigenvalue of number k: an interval that holds it, and how many eigenvalues lie above each end."""

    low: float
    high: float
    above_low: int
    above_high: int


def isolate(a: np.ndarray, k: int, counts: dict[float, int], small: float) -> Slice:
    """Bisection by inertia counts until the interval holds the k-th eigenvalue alone, or is as narrow as rounding lets it be."""
    bound = float(np.abs(a).sum(1).max()) + small
    for end in (-bound, bound):
        counts.setdefault(end, len(a) if end < 0 else 0)

    def ends() -> Slice:
        low = max(s for s, n in counts.items() if n >= k)
        high = min(s for s, n in counts.items() if n < k)
        return Slice(low, high, counts[low], counts[high])

    at = ends()
    while at.high - at.low > small and not (at.above_low == k and at.above_high == k - 1 and at.high - at.low < 1e-3 * bound):
        middle = (at.low + at.high) / 2
        counts[middle] = inertia(a, middle)
        at = ends()
    return at


def refine(a: np.ndarray, k: int, at: Slice, known: np.ndarray, small: float) -> tuple[float, np.ndarray]:
    """Rayleigh quotient iteration inside a slice, orthogonal to the eigenvectors known so far.

    An eigenvalue lies within the residual of every quotient. Once that whole neighbourhood is inside the slice it is the one
    looked for, and the quotient is the next shift, which converges cubically. Until then the shift is the middle of the slice,
    which no other eigenvalue is nearer to, and every few steps one more count halves the slice.
    """
    vector = np.random.default_rng(len(known)).standard_normal(len(a))
    low, high = at.low, at.high
    best = (np.inf, 0.0, vector)
    for step in range(200):
        vector = vector - known.T @ (known @ vector)
        vector = vector - known.T @ (known @ vector)
        vector /= np.linalg.norm(vector)
        value = float(vector @ a @ vector)
        residual = float(np.linalg.norm(a @ vector - value * vector))
        narrow = high - low <= small
        sure = low - small <= value - residual and value + residual <= high + small
        settled = best[0] <= small and residual > 0.5 * best[0]
        if (sure or (narrow and low - small <= value <= high + small)) and residual < best[0]:
            best = (residual, value, vector)
        if settled:
            break
        if not sure and not narrow and step % 3 == 2:
            middle = (low + high) / 2
            low, high = (middle, high) if inertia(a, middle) >= k else (low, middle)
        shift = value if sure else (low + high) / 2
        try:
            vector = np.linalg.solve(a - shift * np.eye(len(a)), vector)
        except np.linalg.LinAlgError:  # the shift is an eigenvalue to the last bit
            vector = np.linalg.solve(a - (shift + small) * np.eye(len(a)), vector)
    return best[1], best[2]


def leading(a: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a symmetric matrix that stand out of rounding (FLOOR), falling, and their unit vectors as rows.

    Each is certified: fewer than k eigenvalues lie above e_k plus a margin of rounding, k or more above e_k less that margin.
    Equal eigenvalues get orthonormal vectors of their common space.
    """
    d = len(a)
    scale = float(np.abs(np.diagonal(a)).max()) if d else 0.0
    if scale == 0:
        return np.zeros(0), np.zeros((0, d))
    small = 4 * d * np.finfo(float).eps * float(np.linalg.norm(a))
    counts: dict[float, int] = {}
    values, vectors = [], np.zeros((0, d))
    for k in range(1, min(count, d) + 1):
        at = isolate(a, k, counts, small)
        if at.high <= FLOOR * small:
            break
        value, vector = refine(a, k, at, vectors, small)
        if value <= FLOOR * small:
            break
        if not (inertia(a, value + 4 * small) < k <= inertia(a, value - 4 * small)):
            raise ArithmeticError(f"eigenvalue {k} is not certified at {value}")
        values.append(value)
        vectors = np.vstack([vectors, vector])
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order], vectors[order]


def to_integers(c: np.ndarray) -> np.ndarray:
    """x = floor(SCALE * c) + SHIFT as longs. An entry whose x would not be a long counts as the nearest of -LIMIT, LIMIT."""
    with np.errstate(over="ignore"):
        scaled = np.floor(np.clip(c * float(SCALE), -float(LIMIT), float(LIMIT)))
    return np.clip(scaled, -float(LIMIT), float(LIMIT)).astype(np.int64) + SHIFT


def column_sums(x: np.ndarray) -> list[int]:
    """Exact sums of each column."""
    if len(x) * int(np.abs(x).max(initial=0)) < LONG:
        return [int(v) for v in x.sum(0)]
    return [int(v) for v in x.astype(object).sum(0)]


class Centre:
    """The fit list's size and sums: gives n x - S as exact integers, and x - S / n as doubles without losing digits."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums

    def exact(self, x: np.ndarray) -> np.ndarray:
        most = max(int(np.abs(x).max(initial=0)) * self.n, max(map(abs, self.sums)))
        if 2 * most < LONG:
            return x * self.n - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.exact(x).astype(float) / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over the dimensions of (n x - S)^2, exact; null where it's no long."""
        off = self.exact(x)
        if off.dtype == np.int64 and int(np.abs(off).max(initial=0)) ** 2 * off.shape[1] < LONG:
            return (off * off).sum(1).tolist()
        squares = (off.astype(object) ** 2).sum(1)
        return [int(v) if v <= LONG else None for v in squares]


def steps(batch: pa.RecordBatch, d: int):
    """(ids, x) of a few rows at a time."""
    rows = max(1, STEP // d)
    for at in range(0, batch.num_rows, rows):
        part = batch.slice(at, rows)
        yield part.column(0), to_integers(matrix(part.column(1), d))


def fit_sums(rows: DataFrame, d: int) -> Centre | None:
    """Size and exact sums of the fit list; one row of partial sums for each task, added by Spark in 38 digits."""

    def run(batches):
        n, total = 0, [0] * d
        for batch in batches:
            for _, x in steps(batch, d):
                n += len(x)
                total = [a + b for a, b in zip(total, column_sums(x), strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array([n] * d), pa.array(range(d), pa.int32()), pa.array([Decimal(v) for v in total], pa.decimal128(38, 0))], ["n", "i", "s"])

    partial = rows.mapInArrow(run, "n long, i int, s decimal(38,0)")
    sums = {r.i: r for r in partial.groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()}
    return Centre(int(sums[0].n), [int(sums[i].s) for i in range(d)]) if sums else None


def covariance(rows: DataFrame, d: int, centre: Centre) -> np.ndarray:
    """Covariance of x over the fit list, divisor n, of centred vectors.

    A task adds up one d x d matrix; its upper triangle goes out as rows, which Spark sums by place, so that the driver gets the
    d (d + 1) / 2 entries of the result, however many tasks there are.
    """
    upper = np.triu_indices(d)

    def run(batches):
        total = None
        for batch in batches:
            for _, x in steps(batch, d):
                off = centre(x)
                total = off.T @ off if total is None else total + off.T @ off
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(upper[0].astype(np.int32)), pa.array(upper[1].astype(np.int32)), pa.array(total[upper])], ["i", "j", "v"])

    partial = rows.mapInArrow(run, "i int, j int, v double")
    out = np.zeros((d, d))
    for r in partial.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r.i, r.j] = out[r.j, r.i] = r.v / centre.n
    return out


def whiten(vectors: DataFrame, components: int = 8, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Whitened coordinates of every usable vector: vec_id, component, n, deviation, whitened, explained, identity_error.

    All usable vectors (finite entries; of lengths that differ the commonest) are the fit list. Entries become longs x, sums are
    exact, and the covariance is of centred vectors. The eigenvalues of the d x d covariance are found on the driver by spectrum
    slicing; everything that grows with the rows stays in tasks. `whitened` is the centred x along the component over the root of
    its eigenvalue, `explained` the eigenvalue's share of the trace, `identity_error` the largest absolute entry of the whitened
    vectors' covariance minus the identity.

    Components whose eigenvalue is not above rounding have no whitening and no rows: a table of one vector, or of equal ones, gives
    none, like an empty table. Rows that repeat and rows without an id are rows of their own. `deviation` is null where the exact
    number is no long. Other columns are not read.
    """
    spark = vectors.sparkSession
    schema = T.StructType([
        T.StructField("vec_id", vectors.schema[id].dataType), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()),
        T.StructField("deviation", T.LongType()), T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType())])
    rows, d = usable(vectors, id, vector)
    centre = fit_sums(rows, d) if d else None
    v = covariance(rows, d, centre) if centre else np.zeros((0, 0))
    values, axes = leading(v, components)
    k = len(values)
    if not k:
        return spark.createDataFrame([], schema).withColumn("identity_error", F.lit(None).cast("double"))
    explained = values / np.trace(v)
    turn = axes.T / np.sqrt(values)

    def run(batches):
        for batch in batches:
            for ids, x in steps(batch, d):
                white = centre(x) @ turn
                repeat = pa.array(np.repeat(np.arange(len(x)), k))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(repeat), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                     pa.array(np.full(len(x) * k, centre.n)), pa.array(centre.deviations(x), pa.int64()).take(repeat),
                     pa.array(white.ravel()), pa.array(np.tile(explained, len(x)))], schema.names)

    done = staged(rows.mapInArrow(run, schema), "whitened")
    return done.withColumn("identity_error", F.lit(_identity_error(rows, d, centre, turn)))


def _identity_error(rows: DataFrame, d: int, centre: Centre, turn: np.ndarray) -> float:
    """Largest absolute entry of the covariance of the whitened vectors, centred on their own mean, minus the identity."""
    k = turn.shape[1]

    def run(batches):
        for batch in batches:
            for _, x in steps(batch, d):
                white = centre(x) @ turn
                yield pa.RecordBatch.from_arrays([pa.array(white[:, i]) for i in range(k)], [f"w{i}" for i in range(k)])

    white = rows.mapInArrow(run, ", ".join(f"w{i} double" for i in range(k)))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    found = white.agg(*[F.covar_pop(f"w{i}", f"w{j}") for i, j in pairs]).first()
    return max(abs(v - (i == j)) for v, (i, j) in zip(found, pairs, strict=True))
