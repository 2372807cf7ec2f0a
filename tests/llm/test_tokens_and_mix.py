import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from runledger.llm import mixing, sharding, token_counts, token_files
from runledger.llm.common import new_folder
from runledger.llm.tokens import Encoder, Merges, split_special
from tests.llm.cases import empty, ragged, table

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def strings():
    rnd = random.Random(5)
    pool = "abcsdtrevlm '  \n\t'’éßñ0129²½.,!-—漢字かな🙂  ̀\x00​Å"
    out = ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 60))) for _ in range(4000)]
    out += ["".join(chr(rnd.choice([rnd.randint(1, 0xD7FF), rnd.randint(0xE000, 0x1FFFF)])) for _ in range(20)) for _ in range(2000)]
    return out + ["", "   ", "a<|endoftext|>b", "<|endoftext|>", "<|endoftext|> <|endoftext|>x'll", "'s't're'lla", "a" * 5000]


def test_counts_and_ids_equal_the_library(library):
    texts = strings()
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert Merges(PATH).counts(texts).tolist() == [len(w) for w in want]
    assert [x.tolist() for x in Encoder(PATH).encode(texts)] == want


def test_nothing_to_count():
    assert Merges(PATH).counts([]).tolist() == [] and Merges(PATH).counts(["", ""]).tolist() == [0, 0]
    assert [len(x) for x in Encoder(PATH).encode(["", ""])] == [0, 0]
    assert split_special("a<x>b", ["<x>"]) == ["a", "b"]


def test_token_counts_of_a_table(spark, library):
    docs = ragged(spark)
    got = Counter(map(tuple, token_counts.token_counts(docs, PATH, limit=20).collect()))
    texts = [(r.doc_id, r.text or "") for r in docs.collect()]
    sizes = [len(e.ids) for e in library.encode_batch([t for _, t in texts], add_special_tokens=False)]
    assert got == Counter((i, len(t.encode()), n, n > 20) for (i, t), n in zip(texts, sizes, strict=True))
    assert token_counts.token_counts(empty(spark), PATH).count() == 0


def test_token_files_round_trip(spark, library, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_BYTES", 600)
    docs, path = ragged(spark), new_folder(spark, "test")
    token_files.write_tokens(docs.repartition(5), path, PATH)
    rows = sorted(token_files.read_tokens(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((r.doc_id for r in docs.collect()), key=lambda i: (i is not None, i or 0))
    at = 0
    for r in rows:
        assert r.start == at
        at += len(r.ids) // 4
    want = Counter((r.doc_id, (*library.encode(r.text or "", add_special_tokens=False).ids, 0)) for r in docs.collect())
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in rows) == want
    one = token_files.lookup(spark, path, [3]).collect()
    assert {(r.start, bytes(r.ids)) for r in one} == {(r.start, bytes(r.ids)) for r in rows if r.doc_id == 3}
    digest = {(r.doc_id, r.start): (r.n_tokens, r.ids_crc32) for r in token_files.digests(spark, path).collect()}
    assert digest == {(r.doc_id, r.start): (len(r.ids) // 4, zlib.crc32(r.ids)) for r in rows}


def test_dictionary_is_of_distinct_texts_and_all_their_places(spark, library, monkeypatch):
    monkeypatch.setattr(token_files, "SAMPLE_DOCUMENTS", 30)
    one = [(i, f"text {i} " + " ".join(f"{i * j % 97}x" for j in range(40))) for i in range(30)]
    schema = "doc_id long, text string"
    made = [token_files.train_dictionary(spark.createDataFrame(x, schema), PATH, 0, 4).first() for x in (one, one * 40)]
    assert made[0] == made[1]
    monkeypatch.setattr(token_files, "SAMPLE_CHARACTERS", 800)
    long = spark.createDataFrame([(1, "begin " * 400 + "middle " * 400 + "last " * 400)], schema)
    row = token_files.train_dictionary(long, PATH, 0, 4).first()
    said = library.decode(np.frombuffer(row.bytes, "<u4").tolist())
    assert row.kind == "raw" and "begin" in said and "middle" in said and said.count("last") > 20


def test_token_files_of_nothing(spark):
    path = new_folder(spark, "test")
    token_files.write_tokens(empty(spark), path, PATH)
    assert token_files.read_tokens(spark, path).count() == 0


@pytest.mark.parametrize("bucket_bytes", [2_000, 1 << 20])
def test_shards(spark, bucket_bytes):
    docs = ragged(spark)
    rows = sharding.shuffle_into_shards(docs, 8, bucket_bytes=bucket_bytes).collect()
    assert Counter(map(tuple, (r.row for r in rows))) == Counter(map(tuple, docs.collect()))
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = sharding.shuffle_into_shards(docs.repartition(7), 8, bucket_bytes=bucket_bytes).collect()
    assert Counter((r.shard, r.slot, tuple(r.row)) for r in rows) == Counter((r.shard, r.slot, tuple(r.row)) for r in again)
    order = [r.row.doc_id for r in sorted(rows, key=lambda r: (r.slot, r.shard))]
    assert order != sorted(order, key=lambda i: i or 0)


def test_shards_are_native_and_written(spark):
    df = sharding.shuffle_into_shards(table(spark))
    plan = df._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    path = new_folder(spark, "test")
    sharding.write_shards(df, path)
    assert spark.read.parquet(path).count() == df.count()
    assert sharding.shuffle_into_shards(empty(spark)).count() == 0


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, open_, out = sum(sizes.values()), set(names), {}
    while open_:
        level = (total - sum(out.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 3 * sizes[s]}
        out |= {s: 3.0 * sizes[s] for s in over}
        open_ -= over
        if not over:
            out |= {s: level * weight[s] for s in open_}
            break
    return out


@pytest.mark.parametrize("make", [table, ragged])
def test_mix(spark, make):
    docs = make(spark, n=400)
    mixed = mixing.mix(docs, docs.columns)
    rows = mixed.collect()
    assert Counter(tuple(r.row) for r in rows) == Counter(map(tuple, docs.collect()))
    word, sizes, taken, most = re.compile(r"[^\x20\x09-\x0D]+"), Counter(), Counter(), Counter()
    for r in rows:
        assert r.mix.size == len(word.findall(r.row.text or "")) and 0 <= r.mix.copies <= 3
        sizes[r.row.source] += r.mix.size
        taken[r.row.source] += r.mix.copies * r.mix.size
    want = brute_targets(sizes)
    for r in rows:
        assert r.mix.source_size == sizes[r.row.source] and r.mix.target == pytest.approx(want[r.row.source])
        most[r.row.source] = max(most[r.row.source], r.mix.size)
    exact = Counter()
    for r in rows:
        exact[r.row.source] += r.mix.rate * r.mix.size
    for s, t in want.items():
        assert exact[s] == pytest.approx(t, rel=1e-6)
        # a source whose longest text is most of it can only be met up to half that text
        assert abs(taken[s] - t) <= (30 if most[s] < 100 else most[s] / 2)
    again = mixing.mix(docs.repartition(3), docs.columns).collect()
    assert Counter((tuple(r.row), r.mix.copies) for r in rows) == Counter((tuple(r.row), r.mix.copies) for r in again)
    assert mixing.repeated(mixed).count() == sum(r.mix.copies for r in rows)
    assert mixing.repeated(mixed).columns == docs.columns


def test_mix_of_one_short_source_and_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b c", "x"), (2, "d", "y"), (3, None, None)], "doc_id long, text string, source string")
    rows = {r.row.doc_id: r.mix for r in mixing.mix(docs, ["doc_id"]).collect()}
    assert {i: m.target for i, m in rows.items()} == pytest.approx({1: 4 / 3, 2: 8 / 3, 3: 0.0}) and rows[3].copies == 0
    assert mixing.mix(empty(spark), ["doc_id"]).count() == 0


def test_rates_against_bisection(spark):
    """The rate of every document from a multiplier found by bisection, one source at a time, without the dual's derivatives."""
    docs = table(spark, n=400, words=300)
    own = defaultdict(list)
    for r in mixing.mix(docs, ["doc_id"]).collect():
        own[r.mix.source_size, r.mix.target].append(r.mix)

    def rate(size, tilt):
        base = max(0.25, min(1.0, size / 200))
        odds = base / (3 - base) * math.exp(tilt)  # odds of a rate against the cap
        return 3 * odds / (1 + odds)

    solved = 0
    for (source_size, target), mixes in own.items():
        sizes = [m.size for m in mixes]
        if not 0 < target < 3 * source_size * (1 - 1e-9):
            continue
        low, high = -30.0, 30.0
        for _ in range(200):
            middle = (low + high) / 2
            low, high = (middle, high) if sum(s * rate(s, middle) for s in sizes) < target else (low, middle)
        assert [m.rate for m in mixes] == pytest.approx([rate(s, low) for s in sizes], rel=1e-5)
        solved += 1
    assert solved >= 3


def test_pieces_are_encoded_together(monkeypatch):
    """Fewer texts reach the library than there are pre-tokens; ids and sizes are those of each by itself."""
    from runledger.llm import tokens
    from runledger.llm.queries import vocabulary

    made = tokens.Encoder(vocabulary())
    words = ["a", " the", "<|endoftext", "<|endoftext|", "|>", "<", " <|", "é", "​", "漢字", "'s", "  ", "\n\n", "0" * 500, "\x00", "ﬀ"] * 20
    ids, sizes = made.library(words)
    asked, library = [], tokens.Encoder.library
    monkeypatch.setattr(tokens.Encoder, "library", lambda self, texts: asked.append(len(texts)) or library(self, texts))
    got, got_sizes = made.pieces(words)
    assert (got == ids).all() and (got_sizes == sizes).all() and asked == [-(-len(words) // tokens.TOGETHER)]
    assert [len(x) for x in made.pieces([])] == [0, 0]
