"""JSON documents read by many tasks give the records of the whole document, wherever its blocks begin."""

import json
import random

import pytest

from runledger.sources import json_arrays as J
from runledger.sources import readers as R

TRICKY = ['plain', 'with "quotes"', 'back\\slash', 'ends in \\', '\\"', '}{][', '"}],[{"', "é漢\U0001f642", "", "a\nb", '\\\\" }', '"results":[{']


@pytest.fixture
def small_blocks(spark):
    """Blocks of a few dozen bytes, so that borders fall inside strings, escapes, keys and numbers."""
    def of(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield of
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def record(rnd, i):
    out = {"case_id": i, "model": rnd.choice(TRICKY), "note": rnd.choice(TRICKY), "final_error": rnd.choice([0.5, None, float("nan"), 1e300])}
    if rnd.random() < 0.5:
        out["predicted_params"] = {"b1_pos": 7.0, rnd.choice(TRICKY): [1, {"deep": rnd.choice(TRICKY)}, []]}
    return out


def put(folder, documents):
    folder.mkdir(exist_ok=True)
    for name, text in documents.items():
        (folder / f"{name}.json").write_text(text, encoding="utf-8")
    return str(folder)


def same(texts, records):
    key = lambda r: json.dumps(r, sort_keys=True)
    return sorted(key(json.loads(t)) for t in texts) == sorted(map(key, records))


@pytest.mark.parametrize("size", [7, 50, 333, 1 << 20])
def test_arrays_cut_anywhere(spark, tmp_path, small_blocks, size):
    rnd = random.Random(size)
    want, documents = [], {}
    for n, (indent, ascii_) in enumerate([(None, True), (2, False), (0, True)]):
        own = [record(rnd, 100 * n + i) for i in range(12)]
        want += own
        documents[f"d{n}"] = json.dumps(own, indent=indent, ensure_ascii=ascii_) + "\n" * n
    documents |= {"empty": "[]", "nothing": "", "blank": " \n"}
    one = record(rnd, 999)
    documents["one"] = json.dumps(one, indent=1)
    path = put(tmp_path / "in", documents)
    small_blocks(size)
    got = [r.value for r in J.json_objects(spark, path).collect()]
    assert same(got, [*want, one])


@pytest.mark.parametrize("size", [11, 64, 1 << 20])
def test_envelopes_cut_anywhere(spark, tmp_path, small_blocks, size):
    rnd = random.Random(size)
    own = [record(rnd, i) for i in range(15)]
    other = [record(rnd, 100 + i) for i in range(4)]
    tricky = {"note": '"results":[{', "meta": {"results": [{"case_id": 1}], "x": {"y": {}}}, "errors": other}
    documents = {
        "head": json.dumps({**tricky, "results": own[:5]}), "tail": json.dumps({"results": own[5:9], **tricky}, indent=1),
        "list": json.dumps(own[9:12]), "none": json.dumps({"results": [], "n": 0}), "mixed": json.dumps({"results": [1, "}", [own[0]], None, own[12], [[]]]}),
        "alone": json.dumps(own[13]), "null": json.dumps({**own[14], "results": None})}
    path = put(tmp_path / "in", documents)
    small_blocks(size)
    got = [r.value for r in J.json_objects(spark, path, "results").collect()]
    assert same(got, [*own[:14], {**own[14], "results": None}])


def test_broken_documents_lose_what_is_broken(spark, tmp_path, small_blocks):
    documents = {"a": '[{"case_id": 1}, {"case_id": 2}, {"case_', "b": '[{"case_id": 3}] trailing', "c": '{"results": [{"case_id": 4}, {"cas'}
    path = put(tmp_path / "in", documents)
    small_blocks(9)
    assert sorted(r.case_id for r in R.read_results_enveloped(spark, path).collect()) == [1, 2, 3, 4]


def test_one_file_is_read_by_many_tasks(spark, tmp_path, small_blocks):
    rows = [{"case_id": i, "model": "m" * 50, "final_error": i / 7} for i in range(20_000)]
    path = put(tmp_path / "in", {"all": json.dumps({"results": rows})})
    small_blocks(100_000)
    segments = J._segments(spark, path)
    assert segments.rdd.getNumPartitions() >= 15
    got = R.read_results_enveloped(spark, path).select("case_id", "model", "final_error").collect()
    assert sorted((r.case_id, r.final_error) for r in got) == [(r["case_id"], r["final_error"]) for r in rows]


@pytest.mark.parametrize("text", ['a"b\\"c"{[', '\\\\"', '"\\\\\\""{}', '""""', '\\', '{"a\\\\":"\\\\\\\\"}'])
def test_structure_does_not_depend_on_the_cut(text):
    data = text.encode()
    whole = J.Structure(data)
    for at in range(len(data) + 1):
        one = J.Structure(data[:at])
        two = J.Structure(data[at:], one.escaped)
        assert one.quotes + two.quotes == whole.quotes and (two.escaped or not two.data and one.escaped) == whole.escaped
        odd = one.quotes % 2 == 1
        assert [*one.steps(False), *two.steps(odd)] == whole.steps(False).tolist()
