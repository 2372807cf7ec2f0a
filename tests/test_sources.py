"""Readers, writers and streams on small files."""

import json
import os
import time
import uuid
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from runledger import schemas
from runledger.operators.scale import new_path, stage, work_dir
from runledger.sources import manifest
from runledger.sources import readers as R
from runledger.sources import writers as W
from runledger.streaming import keyindex
from runledger.streaming import results as Q


def rec(i, **more):
    return {"case_id": i, "target_final": 1.0 + i / 10, "parsing_success": True, **more}


def put(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text)


def test_broken_lines_are_skipped_and_counted(spark, tmp_path):
    lines = [json.dumps(rec(1)), "", "{\"case_id\": 2, \"mod", json.dumps(rec(3)), "   ", "null garbage"]
    put(tmp_path / "in", "a.jsonl", "\n".join(lines))
    df = R.read_results_jsonl(spark, str(tmp_path / "in"))
    assert [r.case_id for r in df.orderBy("case_id").collect()] == [1, 3]
    assert df.count() == 2
    health = R.jsonl_health(spark, str(tmp_path / "in")).first()
    assert (health.good, health.broken) == (2, 2)


def test_envelopes(spark, tmp_path):
    put(tmp_path / "in", "list.json", json.dumps([rec(1), rec(2)]))
    put(tmp_path / "in", "dict.json", json.dumps({"n": 2, "results": [rec(3), rec(4, predicted_params={"b1_pos": 7.0})]}, indent=1))
    put(tmp_path / "in", "one.json", json.dumps(rec(5), indent=2))
    df = R.read_results_enveloped(spark, str(tmp_path / "in"))
    assert [r.case_id for r in df.orderBy("case_id").collect()] == [1, 2, 3, 4, 5]
    assert df.where("case_id = 4").first().predicted_params.b1_pos == 7.0


def test_nan_from_csv_is_null(spark, tmp_path):
    put(tmp_path / "in", "a.csv", "run_id,b1_pos,b1_time,b1_speed,b2_pos,b2_time,b2_speed,initial_power,final_power,peak_power\n"
                                  "run_1,180,0.0,0.0,100,2.5,1.0,1.0,NaN,\n")
    row = R.read_runs_csv(spark, str(tmp_path / "in")).first()
    assert row.final_power is None and row.peak_power is None and row.b2_time == 2.5


def test_union_needs_a_source(spark):
    with pytest.raises(ValueError):
        R.union_labeled({"a": None})
    both = R.union_labeled({"a": spark.createDataFrame([(1,)], "x int"), "b": spark.createDataFrame([(2,)], "y int"), "c": None})
    assert sorted((r.model, r.x, r.y) for r in both.collect()) == [("a", 1, None), ("b", None, 2)]


def test_required_columns(spark):
    with pytest.raises(ValueError, match="missing columns: z"):
        R.require_columns(spark.range(1), ["id", "z"])


def test_completeness_bounds(spark):
    assert [R.completeness(spark.range(5), n).first().complete for n in (4, 5, 6)] == [True, True, False]


def test_latest_copy_is_replaced(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "case_id long, v string")
    folder = str(tmp_path / "r")
    with pytest.raises(FileNotFoundError):
        W.latest_results(spark, folder)
    dated = W.write_results_json(df, folder, stamp="1")
    W.write_results_json(df.where("case_id = 1"), folder, stamp="2")
    assert spark.read.json(dated).count() == 2 and spark.read.json(W.latest_results(spark, folder)).count() == 1


def test_latest_stays_while_the_next_set_is_written(spark, tmp_path, monkeypatch):
    """A writer that is lost before its manifest, one that is lost inside it, and a retry under the same stamp."""
    df, folder = spark.createDataFrame([(2, "b"), (1, "a")], "case_id long, v string"), str(tmp_path / "r")
    first = W.write_results_json(df, folder, stamp="1")
    with monkeypatch.context() as m:
        m.setattr(manifest, "commit", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            W.write_results_json(df.where("case_id = 1"), folder, stamp="2")
    assert W.latest_results(spark, folder) == first and spark.read.json(first).count() == 2
    (tmp_path / "r" / "_manifests" / "000000000002.json").write_text('{"latest": "resul')
    assert W.latest_results(spark, folder) == first
    reader = spark.read.json(W.latest_results(spark, folder))
    second = W.write_results_json(df.where("case_id = 1"), folder, stamp="1")
    assert second != first and W.latest_results(spark, folder) == second
    assert reader.count() == 2 and spark.read.json(second).count() == 1


def test_a_batch_is_appended_once(spark, tmp_path, monkeypatch):
    path, df = str(tmp_path / "t"), spark.range(5)
    count = lambda: spark.read.option("header", True).csv(path).count()
    W.append_results(df, path, batch="a")
    W.append_results(df, path, batch="a")
    assert count() == 5
    W.append_results(df.repartition(3), path, batch="b")
    # the driver went away after the files were in place, before the mark
    manifest.delete(spark, f"{path}/_batches/b")
    assert count() == 10
    W.append_results(df.repartition(2), path, batch="b")
    assert count() == 10
    W.append_results(df, path)
    assert count() == 15
    with pytest.raises(ValueError):
        W.append_results(df, path, batch="a/b")


def test_snapshots_change_in_one_step(spark, tmp_path, monkeypatch):
    """Readers see the state before a batch or after it; batches that are done again and folded ones change nothing."""
    monkeypatch.setattr(Q, "DELTAS", 2)
    table, mark, by = str(tmp_path / "live"), str(tmp_path / "mark"), ["model"]
    states = []
    for n in range(5):
        put(tmp_path / "in", f"{n}.jsonl", "\n".join(json.dumps({"model": f"m{n % 2}", "validation_success_5": n > 2}) for _ in range(n + 1)))
        live = Q.stream_running_success(Q.stream_results(spark, str(tmp_path / "in")), by)
        before = Q.read_snapshot(spark, table, by, live.schema)
        if n == 3:
            with monkeypatch.context() as m:
                m.setattr(manifest, "commit", lambda *a: 1 / 0)
                with pytest.raises(Exception):  # noqa: B017
                    Q.snapshot_stream(live, by, table, mark).awaitTermination()
            assert sorted(map(tuple, Q.read_snapshot(spark, table, by, live.schema).collect())) == states[-1]
        Q.snapshot_stream(live, by, table, mark).awaitTermination()
        assert sorted(map(tuple, before.collect())) == (states[-1] if states else [])
        states.append(sorted(map(tuple, Q.read_snapshot(spark, table, by, live.schema).collect())))
    assert states[-1] == [("m0", 9, 5, 5 / 9), ("m1", 6, 4, 4 / 6)] and states[0] == [("m0", 1, 0, 0.0)]
    assert len([p for p in (tmp_path / "live").iterdir() if not p.name.startswith("_")]) <= 6


def test_appending_keeps_earlier_rows(spark, tmp_path):
    for i in range(3):
        W.append_results(spark.range(i, i + 1), str(tmp_path / "t"))
    assert spark.read.option("header", True).csv(str(tmp_path / "t")).count() == 3


def test_json_keeps_nulls(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    assert json.loads(W.records_to_json(df).first().json) == {"a": 1, "b": None}


def test_stream_resumes_and_restarts(spark, tmp_path):
    folder, sink, mark = tmp_path / "in", str(tmp_path / "sink"), str(tmp_path / "mark")

    def pump(sink, mark):
        source = Q.stream_dedup(Q.stream_results(spark, str(folder)), ["case_id"])
        Q.append_stream(source, sink, mark).awaitTermination()
        return sorted(r.case_id for r in spark.read.schema(schemas.RESULTS).parquet(sink).collect())

    put(folder, "1.jsonl", "\n".join(json.dumps(rec(i)) for i in (1, 2, 2)) + "\n{bad")
    assert pump(sink, mark) == [1, 2]
    assert pump(sink, mark) == [1, 2]
    put(folder, "2.jsonl", "\n".join(json.dumps(rec(i)) for i in (2, 3)))
    assert pump(sink, mark) == [1, 2, 3]
    assert pump(str(tmp_path / "sink2"), str(tmp_path / "mark2")) == [1, 2, 3]


def test_decks_and_logs_are_files(spark, tmp_path):
    from runledger.functions.text import render_deck
    from runledger.sources.runlog import read_run_logs, run_log_points

    cases = spark.createDataFrame([(1, 120, 2.5), (2, 90, 0.0)], "case_id long, pos int, at double")
    decks = cases.withColumn("deck", render_deck("bank 1\n{pos} {at}\n", {"pos": F.col("pos"), "at": F.col("at")}))
    W.write_documents(decks, "case_id", "deck", str(tmp_path / "decks"))
    back = spark.read.text(str(tmp_path / "decks"), wholetext=True)
    assert {r.case_id: r.value.strip() for r in back.collect()} == {1: "bank 1\n120 2.5", 2: "bank 1\n90 0.0"}

    for name in ("a", "b"):
        put(tmp_path / "logs", f"{name}.out", f"TRANSIENT RESULTS\n-\n-\n1 0.0 0 1.{ord(name)}\n")
    points = run_log_points(read_run_logs(spark, str(tmp_path / "logs")), ["run_id"])
    assert {r.run_id: r.power for r in points.collect()} == {"a.out": 1.97, "b.out": 1.98}


def test_bounded_dedup(spark, tmp_path):
    put(tmp_path / "in", "1.jsonl", "\n".join(
        json.dumps({"case_id": i, "at": f"2024-01-01T00:00:0{i}Z"}) for i in (1, 2, 2, 1, 3)))
    raw = spark.readStream.schema("case_id long, at timestamp").json(str(tmp_path / "in"))
    query = Q.append_stream(Q.stream_dedup(raw, ["case_id"], "at", "1 hour"), str(tmp_path / "s"), str(tmp_path / "c"))
    query.awaitTermination()
    assert sorted(r.case_id for r in spark.read.parquet(str(tmp_path / "s")).collect()) == [1, 2, 3]


def test_stage_reads_back_what_it_wrote(spark):
    df = spark.range(10).withColumn("s", F.struct(F.lit(None).cast("string").alias("a"), F.col("id").alias("b")))
    assert sorted(stage(df).collect()) == sorted(df.collect())
    assert new_path(spark, "x").startswith(work_dir(spark)) and uuid


def test_latest_is_in_case_order(spark, tmp_path):
    df = spark.range(0, 120_000, 1, 12).select(F.col("id").alias("case_id"), F.lit("x" * 20).alias("model"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        latest = W.write_results_json(df.repartition(12), str(tmp_path), stamp="s")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    from pathlib import Path

    spans = [(json.loads(lines[0])["case_id"], json.loads(lines[-1])["case_id"])
             for f in sorted(Path(latest).glob("part-*")) if (lines := f.read_text().splitlines())]
    assert len(spans) > 3 and all(a <= b for a, b in spans) and all(x[1] < y[0] for x, y in zip(spans, spans[1:]))
    assert spans[0][0] == 0 and spans[-1][1] == 119_999


NOT_FINITE = [json.dumps(rec(i, final_error=x)) for i, x in enumerate((0.5, float("nan"), float("inf"), float("-inf")))]


def test_records_of_diverged_runs_are_kept(spark, tmp_path):
    put(tmp_path / "in", "a.jsonl", "\n".join([*NOT_FINITE, '{"case_id": 9, "final_error": NaN, "mod']))
    df = R.read_results_jsonl(spark, str(tmp_path / "in"))
    assert {r.case_id: r.final_error for r in df.collect()} == {0: 0.5, 1: None, 2: float("inf"), 3: float("-inf")}
    health = R.jsonl_health(spark, str(tmp_path / "in")).first()
    assert (health.good, health.damaged, health.broken) == (4, 0, 1)


def test_stream_keeps_diverged_runs(spark, tmp_path):
    put(tmp_path / "in", "a.jsonl", "\n".join([*NOT_FINITE, "[NaN]"]))
    sink = str(tmp_path / "sink")
    Q.append_stream(Q.stream_results(spark, str(tmp_path / "in")), sink, str(tmp_path / "mark")).awaitTermination()
    rows = spark.read.schema(schemas.RESULTS).parquet(sink).collect()
    assert {r.case_id: r.final_error for r in rows} == {0: 0.5, 1: None, 2: float("inf"), 3: float("-inf")}


@pytest.mark.parametrize("how", ["state", "table"])
def test_cases_count_once_however_late(spark, tmp_path, how):
    """Files of a month ago, of today, and a late one of a month ago; repeats in the same file, across files, without a key."""
    sink, mark, days = str(tmp_path / "sink"), str(tmp_path / "mark"), 86_400
    cases = [(30, [1, 2, 2, None]), (0, [3, None]), (0, [1, 2, 3]), (30, [4, 1])]
    for n, (age, ids) in enumerate(cases):
        put(tmp_path / "in", f"{n}.jsonl", "\n".join(json.dumps({"case_id": i}) for i in ids))
        os.utime(tmp_path / "in" / f"{n}.jsonl", (time.time() - age * days,) * 2)
        source = Q.stream_results(spark, str(tmp_path / "in"))
        if how == "state":
            Q.append_stream(Q.stream_dedup(source, ["case_id"]), sink, mark).awaitTermination()
        else:
            Q.append_new(source, ["case_id"], sink, mark).awaitTermination()
    found = [r.case_id for r in spark.read.schema(schemas.RESULTS).parquet(sink).collect()]
    assert sorted(i or 0 for i in found) == [0, 1, 2, 3, 4]


def test_a_batch_that_is_done_again_adds_nothing(spark, tmp_path):
    put(tmp_path / "in", "a.jsonl", "\n".join(json.dumps(rec(i)) for i in (1, 2)))
    for mark in ("m1", "m2"):
        Q.append_new(Q.stream_results(spark, str(tmp_path / "in")), ["case_id"], str(tmp_path / "s"), str(tmp_path / mark)).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2


def cases(spark, *ids):
    return spark.createDataFrame([(i, f"m{i}" if i is None or i % 2 else None) for i in ids], "case_id long, model string")


def test_a_batch_reads_the_key_folders_that_may_hold_its_keys(spark, tmp_path, monkeypatch):
    table, key = str(tmp_path / "t"), ["model", "case_id"]
    runs = [keyindex.write_run(cases(spark, *range(n * 1000, n * 1000 + 1000)), key, table, f"run-{n}") for n in range(3)]
    runs.append(keyindex.write_run(cases(spark, None), key, table, "run-null"))
    assert keyindex.write_run(cases(spark), key, table, "run-none") is None
    assert len(keyindex.folders_with(cases(spark, 5, 1005), key, table, runs)) in (2, 3)
    one = keyindex.folders_with(cases(spark, 1234), key, table, runs)
    assert len(one) == 1 and "run-1" in one[0]
    new = cases(spark, *range(10_000, 10_040))
    assert len(keyindex.folders_with(new, key, table, runs)) <= 4
    left = keyindex.without_known(cases(spark, None, 7, 2999, 3000, 3001), key, table, runs)
    assert sorted(r.case_id for r in left.collect()) == [3000, 3001]
    monkeypatch.setattr(keyindex, "MOST_RUNS", 2)
    monkeypatch.setattr(keyindex, "BUCKET_ROWS", 100)
    whole = keyindex.merged(spark, key, table, runs, new, "merged")
    assert len(whole) == 1 and (whole[0]["rows"], whole[0]["buckets"]) == (3001, 31)
    left = keyindex.without_known(cases(spark, None, 7, 2999, 3000, 3001), key, table, whole)
    assert sorted(r.case_id for r in left.collect()) == [3000, 3001]


def test_cases_count_once_when_batches_fail_between_steps(spark, tmp_path, monkeypatch):
    """Failures after the files are in place, a table with rows from before, runs that are merged, and a second checkpoint."""
    monkeypatch.setattr(keyindex, "MOST_RUNS", 1)
    table, mark = str(tmp_path / "t"), str(tmp_path / "mark")
    schema = Q.stream_results(spark, str(put(tmp_path / "in", "0.jsonl", json.dumps(rec(1))) or tmp_path / "in")).schema
    spark.createDataFrame([(0, "old")], "case_id long, model string").write.parquet(table)
    found = lambda: sorted(r.case_id for r in spark.read.schema(schema).parquet(table).collect())

    def pump(mark):
        Q.append_new(Q.stream_results(spark, str(tmp_path / "in")), ["case_id"], table, mark).awaitTermination()

    want = {0, 1}
    for n in range(1, 5):
        put(tmp_path / "in", f"{n}.jsonl", "\n".join(json.dumps(rec(i)) for i in (0, n, n + 1, n + 1)))
        want |= {n, n + 1}
        if n == 2:
            with monkeypatch.context() as m:
                m.setattr(keyindex, "merged", lambda *a: 1 / 0)
                with pytest.raises(Exception):  # noqa: B017
                    pump(mark)
        pump(mark)
        assert found() == sorted(want)
    pump(str(tmp_path / "other"))
    assert found() == sorted(want)


def test_new_cases_do_not_go_where_readers_miss_them(spark, tmp_path):
    put(tmp_path / "in", "a.jsonl", json.dumps(rec(1)))
    source = Q.stream_results(spark, str(tmp_path / "in"))
    Q.append_stream(source, str(tmp_path / "s"), str(tmp_path / "m")).awaitTermination()
    with pytest.raises(ValueError, match="append_stream"):
        Q.append_new(source, ["case_id"], str(tmp_path / "s"), str(tmp_path / "m2"))


def test_a_batch_of_new_cases_is_written_once(spark, tmp_path):
    """Its rows are staged in the table only; one that may hold known cases is staged there again without them."""
    table, mark = str(tmp_path / "t"), str(tmp_path / "mark")
    shared = Path(work_dir(spark)) / "runledger"
    before = set(shared.glob("batch-*"))
    for n, ids in enumerate([(1, 2, 2, None), (2, 3, None)]):
        put(tmp_path / "in", f"{n}.jsonl", "\n".join(json.dumps({"case_id": i}) for i in ids))
        Q.append_new(Q.stream_results(spark, str(tmp_path / "in")), ["case_id"], table, mark).awaitTermination()
    found = [r.case_id for r in spark.read.schema(schemas.RESULTS).parquet(table).collect()]
    assert sorted(i or 0 for i in found) == [0, 1, 2, 3]
    assert set(shared.glob("batch-*")) == before and not [n for n in os.listdir(table) if n.startswith("_staged")]
