import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from runledger.llm import near_dups
from runledger.llm.components import components
from tests.llm.cases import empty, ragged, rows, table


def shingle_set(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset()


def brute(texts, k, percent=80):
    """Smallest reachable id of each (id, text)."""
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = {i: shingle_set(t, k) for i, t in texts.items()}
    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def check(docs, k):
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    want = brute(texts, k)
    got = near_dups.near_duplicates(docs, k=k).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in docs.collect())
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == want[r.doc_id]
    return want


@pytest.mark.parametrize("k", [2, 5])
@pytest.mark.parametrize("make", [table, ragged])
def test_components_against_brute_force(spark, make, k):
    want = check(make(spark, n=150), k)
    assert len({c for _, c, _ in want.values()}) < len(want)


def chain(rnd, n, words, step):
    """Texts of which each differs from the last by `step` words: only neighbours are linked."""
    vocab = [f"w{i}" for i in range(5000)]
    text = [rnd.choice(vocab) for _ in range(words)]
    out = []
    for i in range(n):
        out.append(" ".join(text))
        for _ in range(step):
            text[(i * step + _) * 7 % words] = rnd.choice(vocab)
    return out


@pytest.mark.parametrize("stars", [0, 1, 3])
def test_links_that_only_pairs_of_a_bucket_have(spark, monkeypatch, stars):
    """Chains and groups whose members are linked to few others; without stars all is left to the blocks."""
    monkeypatch.setattr(near_dups, "STARS", stars)
    monkeypatch.setattr(near_dups, "BLOCK", 16)
    rnd = random.Random(3)
    texts = chain(rnd, 40, 100, 4) + chain(rnd, 30, 60, 2)
    base = [f"b{i}" for i in range(120)]
    for _ in range(40):  # similar to the base, less so to each other
        own = list(base)
        for _ in range(rnd.randint(3, 7)):
            own[rnd.randrange(120)] = f"n{rnd.random()}"
        texts.append(" ".join(own))
    rnd.shuffle(texts)
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 2)


def test_empty_and_lonely(spark):
    assert near_dups.near_duplicates(empty(spark)).count() == 0
    got = near_dups.near_duplicates(spark.createDataFrame([(4, None), (5, " "), (6, "a")], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == {(4, 0, 4, True), (5, 0, 5, True), (6, 1, 6, True)}


def test_one_of_each(spark):
    docs = ragged(spark, n=60)
    kept = near_dups.one_of_each(docs, k=5)
    want = brute({r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}, 5)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [i for i, w in want.items() if w[2]]
    assert kept.where("doc_id is null").count() == docs.where("doc_id is null").count()


@pytest.mark.parametrize("repeat", [False, True])
def test_columns_named_like_the_operators_own(spark, repeat):
    names = ["_hash", "hash", "_row", "number", "kept", "label", "key", "node", "n", "set_a"]
    rows = [(i, f"text of its own {i} " * 3, *[f"{c}{i}" for c in names]) for i in range(8)]
    rows += [(3, "another text under this id", *names)] if repeat else []
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    got = near_dups.one_of_each(docs, k=5)
    assert got.schema == docs.schema and sorted(map(tuple, got.collect())) == sorted(rows)


def test_texts_that_share_an_id_are_judged_each_by_itself(spark):
    rnd = random.Random(5)
    texts = [" ".join(f"{t}w{j}" for j in range(60)) for t in range(12)]
    near = [t + " more" for t in texts]
    pairs = [(rnd.randrange(4), t) for t in texts + near] + [(9, texts[0]), (9, texts[0]), (7, None), (7, "alone")]
    docs = spark.createDataFrame([*pairs, (None, texts[1])], "doc_id long, text string")
    got = Counter((r.doc_id, r.text) for r in near_dups.one_of_each(docs, k=5).collect())
    assert got.pop((None, texts[1])) == 1 and got.pop((7, None)) == 1 and got.pop((7, "alone")) == 1
    for one, other in zip(texts, near, strict=True):
        group = {(i, t) for i, t in pairs if t in (one, other)}
        (i, _), = [x for x in got.elements() if x in group]
        assert i == min(i for i, _ in group)
    assert got.total() == len(texts)


def test_keys_meet_whenever_signatures_are_close():
    rnd = np.random.default_rng(1)
    for errors in range(2 * near_dups.CHUNKS):
        a = rnd.integers(0, 1 << 16, (50, near_dups.SYMBOLS)).astype(np.uint16)
        b = a.copy()
        for row in b:
            row[rnd.choice(near_dups.SYMBOLS, errors, replace=False)] ^= 1
        assert (near_dups.keys(a) == near_dups.keys(b)).any(1).all()


def test_sets_do_not_depend_on_the_batch():
    texts = [(r[1] or "").encode() for r in rows(n=40)]
    grams, offsets = near_dups.shingle_sets(texts, 3)
    for i, t in enumerate(texts):
        alone, _ = near_dups.shingle_sets([t], 3)
        assert (grams[offsets[i]:offsets[i + 1]] == alone).all() and len(alone) == len(shingle_set(t.decode(), 3))


@pytest.mark.parametrize("seed", [1, 2])
def test_connected_components(spark, seed):
    rnd = random.Random(seed)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(160)] + [(i, i + 1) for i in range(1000, 1100)] + [(7, 7)]
    root = {}
    near = defaultdict(set)
    for a, b in links:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    for n in sorted(near):
        todo = [n]
        while todo:
            x = todo.pop()
            if x not in root:
                root[x] = n
                todo += near[x]
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == root and len(got) == len(root)
