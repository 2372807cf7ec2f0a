"""Texts that a polynomial hash modulo 2^64 confuses, in the operators that look texts up by hash."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from runledger.llm import common, de_bruijn, near_dups, suffix_buckets, token_counts, token_files, tokens

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def confused(a, b):
    """The Thue-Morse string of 1,024 signs, and the one with the signs exchanged."""
    one = "".join((a, b)[bin(i).count("1") & 1] for i in range(1024))
    return one, one.translate(str.maketrans(a + b, b + a))


X, Y = confused("a", "b")


@pytest.mark.parametrize("signs", ["ab", "01", "éx", "xZ"])
def test_primes_tell_them_apart(signs):
    one, other = confused(*signs)
    points = np.frombuffer((one + other).encode("utf-32-le"), np.uint32)
    at, end = np.array([0, 1024]), np.array([1024, 2048])
    assert len(set(common.SpanHash(points)(at, end).tolist())) == 1
    assert len(set(common.PrimeSpans(points)(at, end).tolist())) == 2


def test_products_and_spans_modulo_the_prime():
    rnd = np.random.default_rng(0)
    p = (1 << 61) - 1
    a, b = (np.concatenate([rnd.integers(0, p, 500, dtype=np.uint64), np.array([0, 1, p - 1], np.uint64)]) for _ in range(2))
    assert common._times(a, b).tolist() == [int(x) * int(y) % p for x, y in zip(a, b, strict=True)]
    values = rnd.integers(0, 1 << 64, 40_000, dtype=np.uint64)
    values[30_000:30_500] = values[100:600]
    spans = common.PrimeSpans(values)
    assert spans(np.array([100]), np.array([600])) == spans(np.array([30_000]), np.array([30_500]))
    every = np.arange(29_000)
    assert len(np.unique(spans(every, every + 7))) == len(every)


def test_ids_and_counts(spark):
    library = Tokenizer.from_file(VOCABULARY)
    texts = [X, Y, f"{X} {Y} {X}", f"{Y} {Y}", "plain", None, (X + " ") * 1200]
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    for order in (slice(None), slice(None, None, -1)):
        encoder, merges = tokens.Encoder(VOCABULARY), tokens.Merges(VOCABULARY)
        for _ in range(2):
            part = [t or "" for t in texts[order]]
            assert [x.tolist() for x in encoder.encode(part)] == want[order]
            assert merges.counts(part).tolist() == [len(w) for w in want[order]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, VOCABULARY).collect()} == {i: len(w) for i, w in enumerate(want)}
    path = common.new_folder(spark, "tokens")
    token_files.write_tokens(docs, path, VOCABULARY)
    back = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in token_files.read_tokens(spark, path).collect()}
    assert back == {i: [*w, 0] for i, w in enumerate(want)}


def test_pretokens_whose_hashes_are_all_equal(monkeypatch):
    """Whatever the hash does, ids and counts are those of the library, also when the memory starts afresh."""
    class Constant:
        def __init__(self, values):
            pass

        def __call__(self, start, end):
            return np.zeros(len(start), np.uint64)

    monkeypatch.setattr(tokens, "SpanHash", Constant)
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    library = Tokenizer.from_file(VOCABULARY)
    texts = ["one two three two one", "four one", "", "three  three\n", "two " + "z" * 50 + " " + "z" * 49 + "y"]
    encoder, merges = tokens.Encoder(VOCABULARY), tokens.Merges(VOCABULARY)
    for part in (texts, texts[::-1], texts[:2]):
        want = [library.encode(t, add_special_tokens=False).ids for t in part]
        assert [x.tolist() for x in encoder.encode(part)] == want
        assert merges.counts(part).tolist() == [len(w) for w in want]


def test_links(spark):
    docs = spark.createDataFrame([(1, X), (2, Y), (3, f"{X} w")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dups.near_duplicates(docs, k=2).collect()} == {1: 1, 2: 2, 3: 3}


def test_removed_words(spark):
    before, after = (" ".join(f"{s}{i}" for i in range(20)) for s in "vw")
    docs = spark.createDataFrame([(1, f"{before} {X} {after}"), (2, f"{before} {Y} {after}"), (3, f"{before} {X} q")], "doc_id long, text string")
    got = {r.doc_id: r for r in de_bruijn.without_repeats(docs).collect()}
    assert [got[i].n_removed for i in (1, 2, 3)] == [0, 40, 21]
    assert got[2].kept_sha256 == hashlib.sha256(Y.encode()).hexdigest()


def test_removed_bytes(spark):
    docs = spark.createDataFrame([(1, X), (2, Y), (3, "p" + X)], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in suffix_buckets.without_repeats(docs, span=1024).collect()}
    assert got == {1: 1024, 2: 0, 3: 1024}
