"""The stages of the pipeline against brute force, each on what its predecessor kept."""

import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from runledger.llm import quality
from runledger.llm.common import new_folder
from tests.llm.cases import SCHEMA, ragged
from tests.llm.test_leaks_phrases_quality import shingles
from tests.llm.test_near_dups import brute
from tests.llm.test_tokens_and_mix import brute_targets

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def chain(spark):
    """Input and output of every stage over the smallest tables."""
    out, docs = {}, spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        path = new_folder(spark, "test")
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out[name] = docs, after
        docs = after
    return out


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near-dedup", "decontamination", "mix", "tokens"]


def test_all_but_the_last_keep_the_columns(chain):
    for name, (before, after) in chain.items():
        assert name == "tokens" or after.columns == before.columns
        assert 0 < after.count()


def test_quality_keeps_what_it_predicts(spark, chain):
    before, after = chain["quality"]
    scored = quality.score_quality(before, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1").collect()
    assert sorted(r.doc_id for r in scored) == sorted(r.doc_id for r in after.collect())
    assert after.count() < before.count()


def test_one_document_of_each_group(chain):
    before, after = chain["near-dedup"]
    want = brute({r.doc_id: r.text for r in before.collect()}, 5)
    assert sorted(r.doc_id for r in after.collect()) == sorted(i for i, w in want.items() if w[2])


def test_no_benchmark_item_is_left(spark, chain):
    before, after = chain["decontamination"]
    items = [shingles(r.text, 5) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    holds = lambda t: any(q and 100 * len(q & t) >= 80 * len(q) for q in items)
    assert sorted(r.doc_id for r in after.collect()) == sorted(r.doc_id for r in before.collect() if not holds(shingles(r.text, 5)))


def test_mix_meets_its_targets(chain):
    before, after = chain["mix"]
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, taken, longest = Counter(), Counter(), Counter()
    for r in before.collect():
        sizes[r.source] += words(r.text)
        longest[r.source] = max(longest[r.source], words(r.text))
    for r in after.collect():
        taken[r.source] += words(r.text)
    for s, t in brute_targets(sizes).items():
        assert abs(taken[s] - t) <= longest[s] / 2 + 60
    assert max(Counter(r.doc_id for r in after.collect()).values()) <= 3


def test_tokens_are_those_of_the_library(chain):
    before, after = chain["tokens"]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in before.collect():
        ids = [*library.encode(r.text, add_special_tokens=False).ids, 0]
        want[r.doc_id, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))] += 1
    rows = sorted(after.collect(), key=lambda r: r.start)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == want
    assert [r.doc_id for r in rows] == sorted(r.doc_id for r in rows)
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(len(rows))]


def test_odd_and_empty_tables_go_through(spark):
    for docs in (ragged(spark, n=40), spark.createDataFrame([], SCHEMA)):
        for name, stage in corpus_pipeline.STAGES:
            path = new_folder(spark, "test")
            stage(spark, docs, SF).write.parquet(path)
            docs = spark.read.parquet(path)
            assert name == "tokens" or docs.columns == ragged(spark, n=1).columns


def test_whole_texts_and_sets_go_to_workers_in_small_batches(spark, monkeypatch):
    """What is written while workers hold texts, or two sets of shingles a row, is written in batches of TEXTS_AT_ONCE."""
    from runledger.llm import common, near_dups, quality

    batches = {}

    def recorded(df, label, of_texts=False):
        batches[label] = of_texts
        return common.staged(df, label, of_texts)

    monkeypatch.setattr(near_dups, "staged", recorded)
    monkeypatch.setattr(quality, "staged", recorded)
    words = [f"w{i}" for i in range(200)]
    docs = spark.createDataFrame([(i, " ".join([*words, f"x{i}"])) for i in range(6)] + [(6, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, quality int")
    assert near_dups.near_duplicates(docs, k=2).where("component_id = 0").count() == 6
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns and kept.count() <= 7
    assert all(batches[label] for label in ("prints", "sets", "near-links", "quality", "accepted"))
