import random
import re
from collections import defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from runledger.llm import filter_audit
from tests.llm.cases import empty, ragged, table

LABELS = "doc_id long, quality int, toxic int, text string, part string"


def failing(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {x for x, failed in zip("ABCD", [
        len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
        re.search(r"[#$%&*|]", text)], strict=True) if failed}


def brute(rows, labels):
    """Filters applied one after the other, for every order."""
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    good = {i for i, q, *_ in labels if i is not None and q == 1}
    toxic = {i for i, _, t, *_ in labels if i is not None and t == 1}
    parts = defaultdict(list)
    for i, text, source in rows:
        text = text or ""
        bad = failing(text) | ({"E"} if i is not None and i > first[text] else set())
        parts[source or ""].append((i, bad))
    out, shapley = {}, defaultdict(int)
    for part, docs in parts.items():
        for order in permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone, before = [d for d in left if f in d[1]], len(left)
                left = [d for d in left if f not in d[1]]
                fails = sum(f in bad for _, bad in docs)
                out[part, "".join(order), step] = [
                    len(left), before - len(left), fails - len(gone), sum(bad == {f} for _, bad in docs),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
                shapley[part, f] += len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def check(docs, labels):
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    got = filter_audit.filter_audit(docs, labels).collect()
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got} == brute(rows, [tuple(r) for r in labels.collect()])
    assert len(got) == 600 * len({r[2] or "" for r in rows})


def some_labels(spark, n=200):
    rnd = random.Random(2)
    rows = [(rnd.randrange(n), rnd.choice([0, 1, None]), rnd.choice([0, 1, None]), "t", "p") for _ in range(n)]
    return spark.createDataFrame([*rows, (None, 1, 1, None, None)], LABELS)


@pytest.mark.parametrize("make", [table, ragged, empty])
def test_against_brute_force(spark, make):
    check(make(spark), some_labels(spark))


def test_no_labels_and_every_failure(spark):
    rnd = random.Random(4)
    long_ones = [" ".join(f"w{rnd.randrange(10 ** rnd.randint(1, 4))}" for _ in range(rnd.randint(190, 260))) for _ in range(30)]
    dirty = [t + " # A" for t in long_ones[:10]] + [t.upper() for t in long_ones[5:15]] + ["A" * 5, "\x0b", "", None, "é" * 50 + "X"]
    texts = long_ones + dirty + rnd.choices(long_ones + dirty, k=40)
    rnd.shuffle(texts)
    docs = spark.createDataFrame([(i, t, rnd.choice(["a", "", None])) for i, t in enumerate(texts)], "doc_id long, text string, source string")
    check(docs, spark.createDataFrame([], LABELS))


def test_large_texts_and_hot_groups(spark):
    """Texts of more than a megabyte, one text in a third of the rows, one id in many rows."""
    big = "word " * 300_000
    rows = [(i, "the same text", "a") for i in range(60)] + [(i, big + str(i % 2), "a") for i in range(60, 66)]
    rows += [(7, f"text {i}", "b") for i in range(50)] + [(7, "the same text", "b")] * 3
    check(spark.createDataFrame(rows, "doc_id long, text string, source string"), some_labels(spark))


@pytest.mark.parametrize("blocks", [1, 3, 1000])
def test_sketch_keeps_every_repeat(spark, blocks, monkeypatch):
    """A sketch with too few blocks clears fewer texts, and never one that repeats; without a broadcast the result is the same."""
    docs = table(spark)
    monkeypatch.setattr(filter_audit, "TEXTS_A_BLOCK", max(1, 129 // blocks))
    monkeypatch.setattr(filter_audit, "SKETCH_ROWS", 0)
    check(docs, some_labels(spark))


def uncleared(texts, sketch, blocks):
    """Share of the texts that the sketch doesn't clear."""
    own = filter_audit._bits(filter_audit._cells(F.col("text")))
    probed = texts.withColumn("block", filter_audit._block(F.col("text"), blocks)).join(sketch, "block", "left")
    return probed.where(F.coalesce(F.col("bits").bitwiseAND(own) == own, F.lit(False))).count() / texts.count()


def test_sketch_clears_unique_texts(spark):
    texts = spark.range(20_000).selectExpr("concat('text ', id) as text")
    doubled = texts.union(texts)
    assert uncleared(texts, filter_audit.repeat_sketch(texts, 5_000), 5_000) < 0.02
    assert uncleared(texts, filter_audit.repeat_sketch(doubled, 10_000), 10_000) == 1
