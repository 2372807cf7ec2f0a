import numpy as np
import pytest

from runledger.llm import neighbours
from tests.llm.vectors import empty, finite, rows, table


def brute(own, k=5, every=50):
    """For each query (id, vector) its k best of (score, id), ids once."""
    own = [(i, v) for i, v in own if i is not None and np.any(v != 0)]
    units = np.array([v / np.abs(v).max() for _, v in own])
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    out = {}
    for at, (i, v) in enumerate(own):
        if i % every == 0:
            best = {}
            for (j, _), s in zip(own, units @ units[at], strict=True):
                if j != i:
                    best[j] = max(s, best.get(j, -2))
            out[i, v.tobytes()] = sorted(best.items(), key=lambda x: (-round(x[1], 12), x[0]))[:k]
    return out


def check(docs, own, least=0.9, **how):
    got = neighbours.nearest(docs, **how).collect()
    want = brute(own, **how)
    by_query = {}
    for r in got:
        by_query.setdefault(r.query_id, []).append(r)
    assert set(by_query) == {i for i, _ in want}
    hits = total = 0
    for (i, _), best in want.items():
        found = sorted(by_query[i], key=lambda r: r.rank)
        scores = {r.vec_id: r.score for r in found}
        hits += sum(j in scores and abs(scores[j] - s) < 1e-9 for j, s in best)
        total += len(best)
        if len([x for x in want if x[0] == i]) == 1:
            assert [r.rank for r in found] == list(range(1, len(best) + 1))
            assert all(a.score > b.score or (a.score == b.score and a.vec_id < b.vec_id) for a, b in zip(found, found[1:]))
        assert i not in scores
    assert hits >= least * total
    return hits / max(total, 1)


def test_small_tables_are_searched_whole(spark):
    for n, d in ((300, 8), (9, 3)):
        assert check(table(spark, n=n, d=d), finite(rows(n=n, d=d), d), every=3) > 0.99


def test_recall_on_clusters_and_noise(spark, monkeypatch):
    """Cells much smaller than the table, so that the graph has to find what the first lists miss."""
    monkeypatch.setattr(neighbours, "CELL", 128)
    rnd = np.random.default_rng(7)
    centres = rnd.standard_normal((40, 24)) * 2
    own = [(int(i), (centres[i % 40] * (i % 3 > 0) + rnd.standard_normal(24))) for i in range(6000)]
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in own], "vec_id long, embedding array<double>")
    check(docs, own, least=0.9)


def test_a_third_of_the_rows_are_one_vector(spark):
    rnd = np.random.default_rng(8)
    own = [(i, np.ones(6) if i % 3 == 0 else rnd.standard_normal(6)) for i in range(900)]
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in own], "vec_id long, embedding array<double>")
    assert check(docs, own) > 0.99


@pytest.mark.parametrize("vectors", [[[1.0, 2.0]], [[1.0, 2.0]] * 3, [[0.0, 0.0], [1.0, 1.0]], [[1e300, 1e300], [1e-300, 2e-300], [5e-324, 0.0]]])
def test_few_candidates(spark, vectors):
    docs = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    own = [(i, np.array(v)) for i, v in enumerate(vectors)]
    want = {i: [j for j, _ in best] for (i, _), best in brute(own).items() if best}
    got = neighbours.nearest(docs).orderBy("query_id", "rank").collect()
    assert {i: [r.vec_id for r in got if r.query_id == i] for i in want} == want and len(got) == sum(map(len, want.values()))


def test_no_rows(spark):
    assert neighbours.nearest(empty(spark)).collect() == []
