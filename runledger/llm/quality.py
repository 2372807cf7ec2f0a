"""Quality classifier by positive-unlabelled learning: the non-negative unbiased risk, minimised over the whole corpus."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runledger.llm.common import FEW_BYTES, Words, column_bytes, staged, texts_in_steps

FEATURES = [
    "bytes", "words", "word_bytes", "word_spread", "upper", "digits", "signs", "beyond_ascii", "lines", "distinct_words", "top_word",
    "repeated_triples", "repeated_next", "sign_ends", "single_signs", "doubled_bytes", "stops",
]
#: Ridge on all weights but the constant.
RIDGE = 1e-4
STEPS = 12
#: Histogram bins of the class prior's estimate; a bin edge counts if so many positives lie above it.
BINS, LEAST_POSITIVES = 200, 100

_KIND = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58),
    "sign": [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)], "line": [10], "stop": [33, 46, 63],
}


def text_features(texts: list[bytes]) -> np.ndarray:
    """FEATURES of whole texts, one row each; a text without words has zeros for what words define."""
    words = Words(texts)
    data, n = words.data, len(texts)
    size = np.array([len(t) for t in texts], np.float64)
    owner = np.repeat(np.arange(n), size.astype(np.int64) + 1)  # the separator behind a text counts as its own
    inside = data[1:]

    def per_text(mask: np.ndarray) -> np.ndarray:
        return np.bincount(owner[mask], minlength=n).astype(np.float64)

    table = {k: np.isin(np.arange(256), list(v)) for k, v in _KIND.items()}
    share = {k: per_text(t[inside]) for k, t in table.items()}
    share["line"] -= 1
    beyond = per_text(inside >= 128)
    doubled = per_text(np.concatenate([inside[1:] == inside[:-1], [False]]) & (inside != 10))
    count = np.diff(words.first).astype(np.float64)
    length = (words.end - words.start).astype(np.float64)
    by_word = lambda w=None: np.bincount(words.text, weights=w, minlength=n)
    mean = by_word(length) / np.maximum(count, 1)
    spread = np.sqrt(np.maximum(by_word(length * length) / np.maximum(count, 1) - mean * mean, 0))

    def distinct(text: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct values of each text, and copies of its most frequent one."""
        if not len(hashes):
            return np.zeros(n), np.zeros(n)
        order = np.lexsort((hashes, text))
        t, h = text[order], hashes[order]
        begin = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (h[1:] != h[:-1])]))
        copies = np.diff(np.append(begin, len(t))).astype(np.float64)
        most = np.zeros(n)
        np.maximum.at(most, t[begin], copies)
        return np.bincount(t[begin], minlength=n).astype(np.float64), most

    kinds, most = distinct(words.text, words.hash)
    at, triples = words.grams(3)
    triple_count = np.bincount(words.text[at], minlength=n)
    triple_kinds, _ = distinct(words.text[at], triples)
    again = np.concatenate([[False], (words.hash[1:] == words.hash[:-1]) & (words.text[1:] == words.text[:-1])]) if len(length) else np.zeros(0, bool)
    last = data[words.end - 1]
    letters = np.maximum(share["upper"] + share["lower"] + beyond, 1)
    some, every = np.maximum(count, 1), np.maximum(size, 1)
    columns = [
        np.log1p(size), np.log1p(count), np.log1p(mean), np.log1p(spread), share["upper"] / letters, share["digit"] / every,
        share["sign"] / every, beyond / every, share["line"] / some, kinds / some, most / some,
        1 - (triple_kinds + (triple_count == 0)) / np.maximum(triple_count, 1), by_word(again.astype(np.float64)) / some,
        by_word(table["sign"][last].astype(np.float64)) / some,
        by_word((table["sign"][last] & (length == 1)).astype(np.float64)) / some, doubled / every, share["stop"] / some,
    ]
    return np.stack(columns, axis=1)


def _whole_features(column) -> np.ndarray:
    parts = [text_features(p) for _, p in texts_in_steps(column_bytes(column), FEW_BYTES)]
    return np.concatenate(parts).astype(np.float32) if parts else np.zeros((0, len(FEATURES)), np.float32)


def _rounded(score: np.ndarray) -> np.ndarray:
    return np.round(score, 9)


def held_out(id: Column) -> Column:
    """The fifth of the ids that no label is learned from; a null id is held out."""
    return F.pmod(F.crc32(F.coalesce(id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _design(x: np.ndarray, mean: np.ndarray, deviation: np.ndarray) -> np.ndarray:
    """A constant, the features in deviations from their mean (cut at five), and their squares."""
    z = np.clip((x - mean) / deviation, -5, 5)
    return np.concatenate([np.ones((len(x), 1)), z, z * z / 5], axis=1)


def _sums(rows: DataFrame, fn, width: int) -> np.ndarray:
    """Sum over all rows of the vectors that `fn(x, positive)` gives for each batch; `width` numbers reach the driver."""

    def partial(batches):
        total = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                total += fn(_matrix(batch.column(0)), np.array(batch.column(1).to_pylist(), bool))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(total)], ["i", "v"])

    summed = rows.select("x", "positive").mapInArrow(partial, "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))
    out = np.zeros(width)
    for r in summed.collect():
        out[r["i"]] = r["v"]
    return out


def _sigmoid(g: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * g))


def _softplus(g: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, g)


class Model:
    """Weights of a logistic score over the features."""

    def __init__(self, mean, deviation, weights, prior):
        self.mean, self.deviation, self.weights, self.prior = mean, deviation, weights, prior

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(_design(x, self.mean, self.deviation) @ self.weights)


def _fit(rows: DataFrame, mean, deviation, prior: float | None) -> np.ndarray:
    """Newton steps, each one pass over all rows.

    The positive-unlabelled risk is  prior E_p[l(g)] + max(0, E_u[l(-g)] - prior E_p[l(-g)])  of the logistic loss l.
    While the second term, the risk on negatives, is not below zero, the risk is convex in the weights; where a step takes it
    below zero (the sign of overfitting), the step is halved until it is back. Without a known prior a half serves:
    the score then ranks rows for the estimate of the prior.
    """
    d = 2 * len(mean) + 1
    upper = np.triu_indices(d)
    width = 2 * d + len(upper[0]) + 5

    def look(weights):
        def fn(x, positive):
            a = _design(x, mean, deviation)
            g = a @ weights
            p = _sigmoid(g)
            own = a[positive]
            curve = (a * (p * (1 - p))[:, None]).T @ a
            return np.concatenate([
                a.T @ p, own.sum(0), curve[upper],
                [len(x), len(own), _softplus(g).sum(), _softplus(g[positive]).sum(), _softplus(-g[positive]).sum()]])

        s = _sums(rows, fn, width)
        n_u, n_p, minus_u, minus_p, plus_p = s[-5:]
        n_u, n_p = max(n_u, 1.0), max(n_p, 1.0)
        share = 0.5 if prior is None else prior
        ridge = np.full(d, RIDGE)
        ridge[0] = 0
        curve = np.zeros((d, d))
        curve[upper] = s[2 * d:-5] / n_u
        curve = curve + np.triu(curve, 1).T + np.diag(ridge + 1e-9)
        gradient = s[:d] / n_u - share * s[d:2 * d] / n_p + ridge * weights
        negative = minus_u / n_u - share * minus_p / n_p
        risk = share * plus_p / n_p + max(0.0, negative) + 0.5 * (ridge * weights * weights).sum()
        return gradient, curve, negative, risk

    weights = np.zeros(d)
    gradient, curve, _, risk = look(weights)
    for _ in range(STEPS):
        step = np.linalg.solve(curve, gradient)
        for _ in range(6):
            tried = weights - step
            seen = look(tried)
            if seen[2] >= 0 and seen[3] <= risk + 1e-9:
                break
            step = step / 2
        else:
            break
        moved = np.abs(step).max()
        weights, gradient, curve, gain, risk = tried, seen[0], seen[1], risk - seen[3], seen[3]
        if moved < 1e-4 or gain < 1e-6:
            break
    return weights


def _class_prior(rows: DataFrame, mean, deviation, weights) -> float:
    """Share of positives among unlabelled rows: the least ratio of unlabelled to positive rows above a score.

    At the top of a score that separates the classes nearly all rows are positive, so the ratio is the prior there; a
    standard error on both shares keeps thin tails from winning.
    """

    def fn(x, positive):
        at = np.minimum((_sigmoid(_design(x, mean, deviation) @ weights) * BINS).astype(int), BINS - 1)
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at[positive], minlength=BINS)]).astype(np.float64)

    s = _sums(rows, fn, 2 * BINS)
    above = lambda h: np.cumsum(h[::-1])[::-1]
    u, p = above(s[:BINS]), above(s[BINS:])
    n_u, n_p = max(u[0], 1.0), max(p[0], 1.0)
    usable = p >= min(LEAST_POSITIVES, n_p)
    q_u, q_p = u[usable] / n_u, p[usable] / n_p
    error = np.sqrt(q_u * (1 - q_u) / n_u) + np.sqrt(q_p * (1 - q_p) / n_p)
    return float(np.clip(((q_u + error) / np.maximum(q_p, 1e-12)).min(), 0.02, 0.98)) if usable.any() else 0.5


def featured(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", quality: str = "quality") -> DataFrame:
    """Staged rows (id, positive, x): features of whole texts, and whether the row is a trusted positive.

    Trusted are ids whose labels are all 1 and that are not held out; labels serve for nothing else.
    """
    schema = T.StructType([T.StructField("id", docs.schema[id].dataType), T.StructField("x", T.ArrayType(T.FloatType()))])

    def features(batches):
        for batch in batches:
            x = _whole_features(batch.column(1))
            offsets = pa.array(np.arange(len(x) + 1) * len(FEATURES), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], ["id", "x"])

    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(features, schema)
    trusted = labels.where(F.col(id).isNotNull()).groupBy(F.col(id).alias("id")).agg(F.min(F.coalesce(F.col(quality), F.lit(0))).alias("least"))
    trusted = trusted.where((F.col("least") == 1) & ~held_out(F.col("id"))).select("id", F.lit(True).alias("trusted"))
    return staged(rows.join(trusted, "id", "left").select("id", F.coalesce("trusted", F.lit(False)).alias("positive"), "x"), "quality", of_texts=True)


def train(rows: DataFrame) -> Model:
    """Fit on all rows of `featured`: every one is unlabelled text, the positive ones are trusted positives as well."""
    k = len(FEATURES)
    s = _sums(rows, lambda x, positive: np.concatenate([x.sum(0), (x * x).sum(0), [len(x), positive.sum()]]), 2 * k + 2)
    n = max(s[-2], 1.0)
    mean = s[:k] / n
    deviation = np.sqrt(np.maximum(s[k:2 * k] / n - mean * mean, 1e-8))
    if not s[-1]:
        return Model(mean, deviation, np.zeros(2 * k + 1), 0.5)
    prior = _class_prior(rows, mean, deviation, _fit(rows, mean, deviation, None))
    return Model(mean, deviation, _fit(rows, mean, deviation, prior), prior)


def score_quality(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """Per row of `docs`: id, held_out, score (0 to 1, higher: label 1 likelier), predicted (1 if score >= threshold, else 0).

    Only the text enters a score. Null and empty texts are scored by their features, which are zeros. Without any trusted
    positive all scores are 0.5. Repeated rows and rows without an id are scored like others; an empty table gives no rows.
    """
    rows = featured(docs, labels, id, text)
    model = train(rows)
    schema = T.StructType([T.StructField("id", docs.schema[id].dataType), T.StructField("score", T.DoubleType())])

    def score(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_rounded(model.score(_matrix(batch.column(1)))))], ["id", "score"])

    scored = rows.select("id", "x").mapInArrow(score, schema)
    return scored.select(F.col("id").alias(id), held_out(F.col("id")).alias("held_out"), "score",
                         F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of `docs` with a score of `threshold` or more, found in one pass over the texts without a shuffle.

    They are staged, as whole texts go to the workers in small batches only while a table is written here.
    """
    model = train(featured(docs, labels, id, text))
    at = docs.columns.index(text)

    def keep(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(_rounded(model.score(_whole_features(batch.column(at)).astype(np.float64))) >= threshold))

    return staged(docs.mapInArrow(keep, docs.schema), "accepted", of_texts=True)
