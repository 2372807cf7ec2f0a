import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from runledger.llm import decontamination, phrases, quality
from runledger.llm.queries import ORACLES, QUERIES
from tests.compare import compare, duck
from tests.llm.cases import empty, ragged, rows, table

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    w = WORD.findall((text or "").lower())
    return {" ".join(w[i:i + k]) for i in range(len(w) - k + 1)}


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_leaks_against_sql(spark, sf):
    assert compare(spark, duck(sf), "op6", QUERIES["op6_leaks"], ORACLES["op6_leaks"], sf) is None


@pytest.mark.parametrize("limit", [0, 500_000])
def test_leaks_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(decontamination, "BROADCAST_SKETCH", limit)
    docs = ragged(spark, n=80)
    texts = [r.text for r in docs.collect() if r.text and len(r.text) < 2000]
    some = [" ".join(t.split(" ")[3:40]) for t in texts[::5]] + [texts[4].upper(), "too short", "", None, texts[4]]
    some += [some[0] + " and four other words behind"]
    items = spark.createDataFrame([(i, t, "x") for i, t in enumerate(some)], "item_id long, text string, doc_id string")
    first = {}
    for i, t in enumerate(some):
        first.setdefault(" ".join(WORD.findall((t or "").lower())), i)
    want = set()
    for r in docs.collect():
        own = shingles(r.text, 5)
        for t, i in first.items():
            q = shingles(t, 5)
            if q and 100 * len(q & own) >= 80 * len(q):
                want.add((r.doc_id, r.text, i, len(q), len(q & own), len(q & own) / len(q)))
    got = decontamination.find_leaks(docs, items)
    assert not re.search("Python|Pandas|Arrow|Cartesian", got._jdf.queryExecution().toString())
    found = got.collect()
    assert Counter((r.doc_id, r.item_id, r.n_shingles, r.n_common, r.containment) for r in found) == Counter((w[0], *w[2:]) for w in want)
    assert any(w[5] < 1 for w in want) and any(w[0] is None for w in want)
    leaked = {(w[0], w[1]) for w in want}
    kept = decontamination.without_leaks(docs, items)
    assert kept.columns == docs.columns
    assert Counter(map(tuple, kept.collect())) == Counter(tuple(r) for r in docs.collect() if (r.doc_id, r.text) not in leaked)


def test_leaks_of_nothing(spark):
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontamination.find_leaks(empty(spark), items).count() == 0
    assert decontamination.find_leaks(table(spark), items.limit(0)).count() == 0
    assert decontamination.without_leaks(table(spark), items.limit(0)).count() == table(spark).count()


def lz_phrases(data):
    known, start = set(), 0
    for end in range(1, len(data) + 1):
        if data[start:end] not in known:
            known.add(data[start:end])
            start = end
    return known


def test_parse_finds_the_phrases():
    for r in rows(n=40):
        data = (r[1] or "").encode()[:5000]
        half = phrases.Parse().feed(data[:len(data) // 2])
        ends = half.copy().feed(data[len(data) // 2:]).ends
        assert {data[a:b] for a, b in zip([0, *ends], ends)} == lz_phrases(data)
        assert half.length == len(data) // 2


def test_likeness():
    a, b = np.arange(40, dtype=np.uint32), np.arange(20, 50, dtype=np.uint32)
    none = np.zeros(0, np.uint32)
    assert phrases.likeness(a, b) == 20 / 50 and phrases.likeness(a, a) == 1 and phrases.likeness(none, none) == 1 and phrases.likeness(a, none) == 0


def edited(text, following):
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


@pytest.mark.parametrize("part_bytes", [900, 1 << 24])
@pytest.mark.parametrize("make", [table, ragged])
def test_fingerprints(spark, monkeypatch, part_bytes, make):
    monkeypatch.setattr(phrases, "PART_BYTES", part_bytes)
    docs = make(spark)
    got = phrases.fingerprints(docs).collect()
    by_text, source = {}, docs.collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in source)
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    if make is table:  # ids are unique: every next document is known
        order = sorted(source, key=lambda r: -r.doc_id)
        text = {r.doc_id: r.text or "" for r in source}
        after = {a.doc_id: b.doc_id for a, b in zip(order, order[1:] + order[:1])}
        sketch = {i: phrases.sketches([(t.encode(), phrases.Parse().feed(t.encode()).ends)])[0] for i, t in text.items()}
        for r in got:
            e = edited(text[r.doc_id], text[after[r.doc_id]])
            own = phrases.sketches([(e.encode(), phrases.Parse().feed(e.encode()).ends)])[0]
            assert r.n_chars == len(text[r.doc_id]) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
            assert r.fingerprint == phrases.as_hex(sketch[r.doc_id]) and r.edited_fingerprint == phrases.as_hex(own)
            assert r.near_edited == phrases.likeness(sketch[r.doc_id], own)
            assert r.near_next == phrases.likeness(sketch[r.doc_id], sketch[after[r.doc_id]])
            assert by_text.setdefault(text[r.doc_id], r.fingerprint) == r.fingerprint


def test_fingerprints_of_nothing_and_of_one(spark):
    assert phrases.fingerprints(empty(spark)).count() == 0
    one = phrases.fingerprints(spark.createDataFrame([(5, "abab")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one.near_next == 1.0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = {r.doc_id: r for r in quality.score_quality(docs, labels).collect()}
    assert len(scored) == docs.count()
    held = [(scored[r.doc_id].score, r.quality, scored[r.doc_id].predicted) for r in labels.collect() if scored[r.doc_id].held_out]
    good, bad = [s for s, q, _ in held if q], np.sort([s for s, q, _ in held if not q])
    assert np.mean(np.searchsorted(bad, good)) / len(bad) > 0.97
    assert np.mean([p == q for _, q, p in held]) > 0.98
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in scored.values())


def test_quality_of_odd_tables(spark):
    docs = ragged(spark, n=60)
    labels = spark.createDataFrame([(i, i % 3 and 1, "t") for i in range(50)] + [(None, 1, "t"), (3, None, "t")], "doc_id long, quality int, text string")
    got = quality.score_quality(docs, labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in docs.collect())
    assert {r.score for r in quality.score_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.score_quality(empty(spark), labels).count() == 0
    positive = {r.id for r in quality.featured(docs, labels).where("positive").collect()}
    import zlib
    assert positive == {i for i in range(50) if i % 3 and i != 3 and zlib.crc32(str(i).encode()) % 5}


def test_features_do_not_depend_on_the_batch():
    texts = [(r[1] or "").encode() for r in rows(n=30)]
    whole = quality.text_features(texts)
    assert np.isfinite(whole).all()
    assert np.allclose(whole, np.concatenate([quality.text_features([t]) for t in texts]))


def test_quality_against_a_plain_minimiser(spark):
    """Gradient descent on the same risk over all rows in one matrix, and the prior from every threshold in turn.

    Like the Newton steps, it takes no step that puts the risk on negatives below zero, so both stop at that border.
    """
    sf = "/root/testdata/sf0.01"
    rows = quality.featured(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    x, positive = (np.array(c) for c in zip(*[(r.x, r.positive) for r in rows.collect()], strict=True))
    model = quality.train(rows)
    assert np.allclose(model.mean, x.mean(0), rtol=1e-6, atol=1e-6)
    z = np.clip((x - model.mean) / model.deviation, -5, 5)
    a = np.hstack([np.ones((len(z), 1)), z, z ** 2 / 5])
    ridge = np.r_[0.0, np.full(a.shape[1] - 1, quality.RIDGE)]
    loss = lambda g: np.log1p(np.exp(-np.abs(g))) + np.maximum(-g, 0)
    slope = lambda g: -1 / (1 + np.exp(g))

    def risk(w, prior):
        g = a @ w
        negative = loss(-g).mean() - prior * loss(-g[positive]).mean()
        return prior * loss(g[positive]).mean() + max(0.0, negative) + (ridge * w * w).sum() / 2, negative

    def descend(prior):
        w, step = np.zeros(a.shape[1]), 1.0
        for _ in range(6000):
            g = a @ w
            own = prior * (slope(g[positive]) + slope(-g[positive]))
            grad = a[positive].T @ own / positive.sum() - a.T @ slope(-g) / len(a) + ridge * w
            here = risk(w, prior)[0]
            while (tried := risk(w - step * grad, prior))[0] > here - step * (grad @ grad) / 2 or tried[1] < 0:
                step /= 2
                if step < 1e-12:
                    return w
            w, step = w - step * grad, step * 1.5
        return w

    first = descend(0.5)
    score = 1 / (1 + np.exp(-(a @ first)))
    best = 1.0
    for t in np.arange(quality.BINS) / quality.BINS:
        u, p = (score >= t).mean(), (score[positive] >= t).mean()
        if (score[positive] >= t).sum() >= min(quality.LEAST_POSITIVES, positive.sum()):
            best = min(best, (u + (u * (1 - u) / len(a)) ** 0.5 + (p * (1 - p) / positive.sum()) ** 0.5) / p)
    assert model.prior == pytest.approx(best, abs=0.03)
    reference = descend(model.prior)
    found, least = risk(model.weights, model.prior), risk(reference, model.prior)
    # the Newton steps stop earlier on the way to that border, and judge the rows alike
    assert found[1] >= 0 and least[1] >= 0 and least[0] - 1e-6 <= found[0] < risk(np.zeros(a.shape[1]), model.prior)[0] - 0.05
    threshold = np.log(0.3 / 0.7)
    assert np.mean((a @ model.weights >= threshold) == (a @ reference >= threshold)) > 0.95
