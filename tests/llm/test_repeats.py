import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from runledger.llm import de_bruijn, suffix_buckets
from runledger.llm.repeats import Unit, Units, find_pieces, sliding_least
from tests.llm.cases import SCHEMA, empty, rows


def sha(b):
    return hashlib.sha256(b).hexdigest()


def brute_words(docs, k):
    """docs: (id, text) rows; rows that share an id are one document."""
    first = {}
    for i, t in docs:
        w = (t or "").encode().split()
        for s in range(len(w) - k + 1):
            key = tuple(w[s:s + k])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in docs:
        w = (t or "").encode().split()
        gone = set()
        for s in range(len(w) - k + 1):
            if i is not None and first[tuple(w[s:s + k])] < i:
                gone |= set(range(s, s + k))
        out.append((i, len(w), len(gone), sha(b" ".join(x for p, x in enumerate(w) if p not in gone))))
    return Counter(out)


def brute_bytes(docs, k):
    starts = defaultdict(int)
    texts = [(i, (t or "").encode()) for i, t in docs]
    for _, b in texts:
        for s in range(len(b) - k + 1):
            starts[b[s:s + k]] += 1
    out = []
    for i, b in texts:
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - k + 1):
            if starts[b[s:s + k]] > 1:
                gone[s:s + k] = True
        out.append((i, len(b), int(gone.sum()), int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1)),
                    sha(bytes(np.frombuffer(b, np.uint8)[~gone[:-1]]))))
    return Counter(out)


def passages(seed, n=60):
    """Texts that share passages at any place, some of them twice in a text."""
    rnd = random.Random(seed)
    vocab = [f"{rnd.choice('abcdefgh')}{i}é"[: rnd.randint(2, 5)] for i in range(60)]
    own = lambda k: [rnd.choice(vocab) for _ in range(k)]
    shared = [own(rnd.randint(8, 40)) for _ in range(8)]
    out = []
    for i in range(n):
        words = []
        for _ in range(rnd.randint(1, 4)):
            p = rnd.choice(shared)
            a = rnd.randint(0, len(p) // 2)
            words += own(rnd.randint(0, 25)) + p[a:rnd.randint(a, len(p))]
        if rnd.random() < 0.1:
            words = own(3) * 12
        out.append((i * 3 % (3 * n - 1) if rnd.random() < 0.8 else i + 1000, " ".join(words)))
    ids = {}
    return [(ids.setdefault(i, len(ids)) * 7 % 1009, t) for i, t in out]


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string")


@pytest.mark.parametrize("seed,k", [(1, 13), (2, 13), (3, 6), (4, 3)])
def test_words_against_brute_force(spark, seed, k):
    docs = passages(seed)
    got = de_bruijn.without_repeats(frame(spark, docs), k).collect()
    want = brute_words(docs, k)
    assert Counter(map(tuple, got)) == want
    assert sum(w[2] > 0 for w in want) > 5


@pytest.mark.parametrize("together", [0, 50_000])
@pytest.mark.parametrize("seed,k", [(1, 60), (2, 100), (3, 40), (4, 20)])
def test_bytes_against_brute_force(spark, monkeypatch, seed, k, together):
    monkeypatch.setattr(suffix_buckets, "TOGETHER", together)
    docs = passages(seed)
    got = suffix_buckets.without_repeats(frame(spark, docs), k).collect()
    want = brute_bytes(docs, k)
    assert Counter(map(tuple, got)) == want
    assert sum(w[2] > 0 for w in want) > 5


def test_odd_tables(spark):
    own = rows(n=50)
    odd = [*own, *own[:7], *[(None, *r[1:]) for r in own[:5]], (3, own[9][1], *own[3][2:]), (None, None, *([None] * 7))]
    docs = spark.createDataFrame(odd, SCHEMA)
    pairs = [(r[0], r[1]) for r in odd]
    assert Counter(map(tuple, de_bruijn.without_repeats(docs).collect())) == brute_words(pairs, 13)
    assert Counter(map(tuple, suffix_buckets.without_repeats(docs, 90).collect())) == brute_bytes(pairs, 90)
    for op in (de_bruijn, suffix_buckets):
        assert op.without_repeats(empty(spark)).count() == 0


@pytest.mark.parametrize("span", [5, 16, 37, 64])
def test_refinement(span):
    rnd = random.Random(span)
    data = ["".join(rnd.choice("ab") for _ in range(rnd.randint(0, 200))).encode() for _ in range(12)]
    data += [data[0][5:] + b"x", data[1]]
    bucket, text, offset = suffix_buckets.refine(data, span)
    strings = [data[t][o:o + span] for t, o in zip(text, offset)]
    count = Counter(s for s in strings if len(s) == span)
    assert all((b >= 0) == (count[s] > 1) for b, s in zip(bucket, strings))
    by_bucket = {(b, s) for b, s in zip(bucket, strings) if b >= 0}
    assert len({b for b, _ in by_bucket}) == len(by_bucket) == len({s for _, s in by_bucket})


def test_pieces_cover_every_window_once():
    texts = [(r[1] or "").encode() for r in rows(n=30)]
    for unit in (Unit(True, 13, 5), Unit(False, 40, 8), Unit(True, 3, 3)):
        units = Units(texts, unit.of_words)
        owner, at, lo, hi, key = find_pieces(units, unit)
        assert int((hi - lo + 1).sum()) == int(np.maximum(units.count - unit.span + 1, 0).sum())
        assert (lo <= at).all() and (at <= lo + unit.grams - 1).all() and (hi <= at).all()
        place = unit.pack(at, at - lo, at - hi)
        assert all((x == y).all() for x, y in zip(unit.unpack(place), (at, at - lo, at - hi)))


def test_sliding_least():
    rnd = np.random.default_rng(2)
    for n, w in ((1, 1), (5, 3), (10, 10), (100, 7), (4, 9)):
        v = rnd.integers(0, 50, n, dtype=np.uint64)
        assert sliding_least(v, w).tolist() == [int(v[i:i + w].min()) for i in range(n - w + 1)]
