"""The distributed forms must equal brute force on skewed data, with and without broadcast joins, for any layout."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from runledger.functions.hashing import order_hash
from runledger.operators import joins as J
from runledger.operators import report as R
from runledger.operators import scale as S
from runledger.operators import split as P
from runledger.operators import stats as T
from runledger.operators import windows as W
from runledger.operators.joins import assign_range


def skewed(n=3000, seed=1):
    """A third of the rows in one group with one value; zeros, negatives, outliers, nulls; a null group."""
    rng = np.random.default_rng(seed)
    x = np.round(rng.lognormal(-3, 2, n), 3) * rng.choice([-1.0, 1.0], n)
    x[: n // 3] = 0.25
    x[n // 3: n // 3 + 50] = 0.0
    x[-5:] = [1e9, -1e9, 1e-12, 5e5, -3.0]
    g = rng.choice(["a", "b", "c"], n).astype(object)
    g[: n // 3] = "hot"
    g[n // 3: n // 3 + 30] = None
    frame = pd.DataFrame({"id": np.arange(n), "g": g, "x": x})
    frame.loc[100:120, "x"] = np.nan
    return frame


@pytest.fixture(scope="module")
def frame():
    return skewed()


@pytest.fixture(scope="module")
def table(spark, frame):
    rows = [(int(r.id), r.g, None if pd.isna(r.x) else float(r.x)) for r in frame.itertuples()]
    return spark.createDataFrame(rows, "id long, g string, x double").repartition(5).cache()


@pytest.fixture(params=["broadcast", "shuffle"])
def joins(request, spark, monkeypatch):
    """Run a test with small sides broadcast and with every broadcast forbidden."""
    if request.param == "shuffle":
        monkeypatch.setattr(S, "BROADCAST_ROWS", 0)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    monkeypatch.setattr(S, "SMALL", 50)
    monkeypatch.setattr(S, "LEVEL", 8)
    monkeypatch.setattr(S, "SCAN_ROWS", 100)
    yield request.param
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def groups(frame):
    for key, part in frame.groupby("g", dropna=False):
        yield (None if pd.isna(key) else key), part


def test_quantiles(joins, table, frame):
    qs = {"q0": 0.0, "q1": 0.25, "q2": 0.5, "q9": 0.95, "q10": 1.0}
    got = {r.g: r for r in S.quantiles(table, ["g"], F.col("x"), qs).collect()}
    for key, part in groups(frame):
        x = part.x.dropna()
        assert got[key].n == len(x)
        for name, q in qs.items():
            assert got[key][name] == pytest.approx(np.quantile(x, q), rel=1e-12, abs=1e-15)


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([("a", v) for v in (1.0, float("nan"), 3.0, None)], "g string, x double")
    row = S.quantiles(df, ["g"], F.col("x"), {"m": 0.5}).first()
    assert (row.n, row.m) == (2, 2.0)


def test_quantiles_of_the_whole_table(joins, table, frame):
    got = S.quantiles(table, [], F.col("x"), {"m": 0.5}).first()
    assert got.m == pytest.approx(frame.x.median()) and got.n == frame.x.notna().sum()


def test_rank_percentile(joins, table, frame):
    got = {r.g: r for r in R.rank_percentile(table, ["g"], "x").collect()}
    for key, part in groups(frame):
        x = np.sort(part.x.dropna())
        assert (got[key].p95, got[key].p99) == (x[int(0.95 * len(x))], x[int(0.99 * len(x))])


def test_running_success(joins, table, frame):
    df = table.withColumn("hit", F.coalesce(F.col("x") > 0, F.lit(False)))
    got = {r.id: r for r in W.running_success(df, ["g"], "id", F.col("hit")).collect()}
    assert len(got) == len(frame)
    for _, part in groups(frame):
        hits = (part.x > 0).cumsum()
        for n, (i, s) in enumerate(zip(part.id, hits), 1):
            assert (got[i].n_so_far, got[i].successes_so_far) == (n, s)


@pytest.mark.parametrize("descending", [False, True])
def test_running_min_and_max(joins, table, frame, descending):
    scan = {"low": ("min", F.col("x")), "high": ("max", F.col("x"))}
    got = {r.id: r for r in S.ordered_scan(table.where("x is not null"), ["g"], F.floor(F.col("id") / 100), ["id"], scan,
                                           descending).collect()}
    for _, part in groups(frame[frame.x.notna()]):
        x = part.x[::-1] if descending else part.x
        for i, lo, hi in zip(part.id[::-1] if descending else part.id, x.cummin(), x.cummax()):
            assert (got[i].low, got[i].high) == (lo, hi)


def test_split_shares_and_layout(joins, spark, table, frame):
    parts = P.stratified_split3(table, ["g"], ["id"]).toPandas()
    assert sorted(parts.id) == sorted(frame.id)
    for key, part in groups(frame):
        mine = parts[parts.g.isna() if key is None else parts.g == key].part.value_counts()
        n = len(part)
        assert mine.get("train", 0) == int(0.8 * n)
        assert mine.get("train", 0) + mine.get("val", 0) == int(0.9 * n)
    again = P.stratified_split3(table.repartition(11, "x"), ["g"], ["id"]).toPandas()
    assert dict(zip(parts.id, parts.part)) == dict(zip(again.id, again.part))


def test_split_equals_plain_ranking(table):
    from pyspark.sql import Window

    coarse = S.label_by_hash_rank(table, ["g"], ["id"], 42, [("first", lambda n: F.floor(n * F.lit(0.37)))], "rest",
                                  digits=1)
    w = Window.partitionBy("g").orderBy(order_hash(42, F.col("id")), "id")
    whole = Window.partitionBy("g")
    plain = table.withColumn("p", F.row_number().over(w)).withColumn("n", F.count("*").over(whole))
    plain = plain.select("id", F.when(F.col("p") <= F.floor(F.col("n") * 0.37), "first").otherwise("rest"))
    assert dict(map(tuple, coarse.select("id", "part").collect())) == dict(map(tuple, plain.collect()))


def test_quota_and_sample(joins, table, frame):
    sample = P.quota_sample(table, "g", 100, ["id"], {"hot": 0.5, "a": 0.3, "b": 50.0})
    sizes = {r.g: r["count"] for r in sample.groupBy("g").count().collect()}
    assert sizes == {"hot": 50, "a": 30, "b": int((frame.g == "b").sum())}
    assert P.sample_n(table, 17, ["id"]).count() == 17
    assert P.sample_n(table, 10**6, ["id"]).count() == len(frame)


def test_positions(joins, table, frame):
    at = P.shuffle_position(table, ["id"]).select("id", "position").collect()
    assert sorted(r.position for r in at) == list(range(1, len(frame) + 1))
    order = [r.id for r in P.shuffle(table, ["id"]).collect()]
    assert [r.id for r in sorted(at, key=lambda r: r.position)] == order
    names = [r.run_id for r in P.rekey(table, "m_", "id").orderBy("id").collect()]
    assert names == [f"m_{i:05d}" for i in range(len(frame))]


def test_histogram(joins, table, frame):
    got = T.histogram(table, ["g"], "x", 10).toPandas()
    for key, part in groups(frame):
        x = part.x.dropna()
        mine = got[got.g.isna() if key is None else got.g == key]
        assert mine.n.sum() == len(x)
        counts, edges = np.histogram(x, 10)
        assert np.allclose(mine.left, edges[mine.bin])
        assert {int(b): int(n) for b, n in zip(mine.bin, mine.n)} == dict(enumerate(counts))


def test_ecdf(joins, table, frame):
    got = T.ecdf(table, ["g"], "x").toPandas()
    for key, part in groups(frame):
        x = np.sort(part.x.dropna())
        mine = got[got.g.isna() if key is None else got.g == key].sort_values("value")
        assert np.repeat(mine.value, mine.copies).tolist() == x.tolist()
        assert mine.last_rank.tolist() == [int(np.searchsorted(x, v, "right")) for v in mine.value]
        assert mine.y_last.iloc[-1] == 100.0


def test_box(joins, table, frame):
    got = {r.g: r for r in T.box_stats(table, ["g"], "x").collect()}
    for key, part in groups(frame):
        x = part.x.dropna()
        q1, q3 = np.quantile(x, [0.25, 0.75])
        inside = x[(x >= q1 - 1.5 * (q3 - q1)) & (x <= q3 + 1.5 * (q3 - q1))]
        r = got[key]
        assert (r.whisker_low, r.whisker_high) == (min(inside.min(), r.q1), max(inside.max(), r.q3))
        assert r.outliers == len(x) - len(inside)


def test_kde(joins, table, frame):
    got = T.kde_grid(table.where("abs(x) < 5"), ["g"], "x", 7).toPandas()
    for key, part in groups(frame[frame.x.abs() < 5]):
        x = part.x.to_numpy()
        if x.std() == 0:
            continue
        h = x.std(ddof=1) * len(x) ** -0.2
        mine = got[got.g.isna() if key is None else got.g == key].sort_values("grid")
        at = np.linspace(x.min(), x.max(), 7)
        want = np.exp(-0.5 * ((x[:, None] - at) / h) ** 2).sum(0) / (len(x) * h * np.sqrt(2 * np.pi))
        assert np.allclose(mine.density, want)


def test_range_join(joins, spark, table, frame):
    ranges = [(i, lo, lo + w) for i, (lo, w) in enumerate([(0.2, 0.1), (0.25, 0.01), (-1.0, 2.0), (0.0, 0.0001), (3.0, 0.5)])]
    df = table.where("abs(x) < 10")
    got = assign_range(df, "x", spark.createDataFrame(ranges, "r int, lo double, hi double"), 0.07, ["id"])
    want = {(int(i), r) for i, x in zip(frame.id, frame.x) if abs(x) < 10 for r, lo, hi in ranges if lo <= x < hi}
    assert {(r.id, r.r) for r in got.select("id", "r").collect()} == want


def test_one_range_over_everything_among_short_ones(joins, spark):
    """Each range is listed twice at most, also one of a million cells, infinite ones and empty ones."""
    short = [(i, i / 10, i / 10 + 0.05) for i in range(-200, 200)]
    wide = [(1000, -1e5, 1e5), (1001, float("-inf"), 0.0), (1002, 3.0, float("inf")), (1003, 2.0, 2.0), (1004, 5.0, 4.0), (1005, None, 4.0),
            (1006, -1e300, 1e300), (1007, 0.0, 1e-9)]
    ranges = spark.createDataFrame(short + wide, "r int, lo double, hi double")
    values = [(i, v) for i, v in enumerate([*np.random.default_rng(3).uniform(-25, 25, 400).tolist(), 0.0, 3.0, 1e5, -1e5, 1e299, -2e300, None])]
    got = assign_range(spark.createDataFrame(values, "id int, x double"), "x", ranges, 0.1, ["id"])
    want = {(i, r) for i, x in values for r, lo, hi in short + wide if x is not None and lo is not None and lo <= x < hi}
    assert {(r.id, r.r) for r in got.select("id", "r").collect()} == want and got.count() == len(want)
    assert J.listed_ranges(ranges, 0.1).groupBy("r").count().agg(F.max("count")).first()[0] <= 2


def test_nearest_time(joins, spark):
    rows = [("hot", s, float(s), float((s * 7) % 101)) for s in range(500)] + [("short", s, float(s), 5.0 - s) for s in range(3)]
    trace = spark.createDataFrame(rows, "run_id string, step long, t double, power double")
    got = {r.run_id: r for r in W.at_nearest_time(trace, 100.5, "t", "power").collect()}
    tail = [(s * 7) % 101 for s in range(100, 500)]
    assert (got["hot"].initial_value, got["hot"].min_value, got["hot"].max_value) == (tail[0], min(tail), max(tail))
    assert (got["short"].initial_value, got["short"].final_value) == (3.0, 3.0)


@pytest.mark.parametrize("small,level", [(1, 2), (10, 1024), (10**6, 8)])
def test_span_sizes_do_not_matter(table, frame, monkeypatch, small, level):
    monkeypatch.setattr(S, "SMALL", small)
    monkeypatch.setattr(S, "LEVEL", level)
    got = S.quantiles(table, [], F.col("x"), {"a": 0.1, "b": 0.77}).first()
    assert (got.a, got.b) == (pytest.approx(frame.x.quantile(0.1)), pytest.approx(frame.x.quantile(0.77)))


def test_near_values_and_far_outliers_are_spread(spark, monkeypatch):
    """Values within 1.0..1.001, one far away, infinities: no sorted span holds more than SMALL rows."""
    monkeypatch.setattr(S, "SMALL", 500)
    rng = np.random.default_rng(4)
    x = [*rng.uniform(1.0, 1.001, 20_000).tolist(), 1e12, float("inf"), float("-inf")]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    sizes, inner = [], S._in_spans

    def seen(values, spans):
        sizes.append(spans.agg(F.max("_c")).first()[0])
        return inner(values, spans)

    monkeypatch.setattr(S, "_in_spans", seen)
    got = S.quantiles(df, [], F.col("x"), {"m": 0.5, "p": 0.9}).first()
    assert (got.m, got.p) == (pytest.approx(np.median(x), rel=1e-15), pytest.approx(np.sort(x)[int(0.9 * (len(x) - 1))], rel=1e-6))
    assert sizes[-1] <= 500 and len(sizes) <= 5


def buckets(df, order):
    return df.select(*order, "_b").collect() if "_b" in df.columns else S.with_order_bucket(df, order).select(*order, "_b").collect()


@pytest.mark.parametrize("clustered", ["even", "sparse", "one value", "close", "text"])
def test_no_bucket_is_large_wherever_the_keys_lie(spark, monkeypatch, clustered):
    """About one bucket for every SCAN_ROWS rows, none with more than twice as many, in the order of the whole key."""
    monkeypatch.setattr(S, "SCAN_ROWS", 2_000)
    rows = spark.range(0, 60_000, 1, 7)
    value = {"even": F.col("id"), "sparse": F.pow(F.lit(1.0003), F.col("id")), "one value": F.when(F.col("id") % 3 > 0, 5).otherwise(F.col("id")),
             "close": F.lit(1.0) + F.col("id") * 1e-14, "text": F.when(F.col("id") % 2 == 0, F.concat(F.lit("x"), F.col("id")))}[clustered]
    got = buckets(rows.select(value.alias("v"), "id"), ["v", "id"])
    sizes = {}
    for r in got:
        sizes[r._b] = sizes.get(r._b, 0) + 1
    assert max(sizes.values()) <= 4_000 and 20 <= len(sizes) <= 45
    ranked = sorted(got, key=lambda r: (r.v is not None, r.v, r.id) if r.v is not None else (False, 0, r.id))
    assert [r._b for r in ranked] == sorted(r._b for r in ranked)


def test_bucket_numbers_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(S, "SCAN_ROWS", 500)
    few, many = (len({r._b for r in buckets(spark.range(n), ["id"])}) for n in (5_000, 50_000))
    assert len({r._b for r in buckets(spark.range(500), ["id"])}) == 1 and 7 * few < many < 14 * few


def test_a_large_bucket_is_cut_again(spark, monkeypatch):
    """A first sample that misses nearly all keys."""
    monkeypatch.setattr(S, "SCAN_ROWS", 1_000)
    true, calls = S._every_nth, []

    def poor(keys, n, share):
        calls.append(share)
        return true(keys, n, share) if len(calls) > 1 else keys.where("k.id < 10")

    monkeypatch.setattr(S, "_every_nth", poor)
    got = buckets(spark.range(30_000), ["id"])
    sizes = np.bincount([r._b for r in got])
    assert len(calls) == 2 and sizes.max() <= 2_000


def test_equal_keys_share_a_bucket(spark, monkeypatch):
    monkeypatch.setattr(S, "SCAN_ROWS", 100)
    got = buckets(spark.range(3_000).selectExpr("if(id < 1000, 1, id) as v"), ["v"])
    assert len({r._b for r in got if r.v == 1}) == 1


def test_ordered_queries_compile(spark, monkeypatch, table):
    """Whole-stage code of the scans is not given up, whatever the number of bounds."""
    monkeypatch.setattr(S, "SCAN_ROWS", 50)
    spark.conf.set("spark.sql.codegen.fallback", "false")
    spark.conf.set("spark.sql.codegen.factoryMode", "CODEGEN_ONLY")
    try:
        assert W.running_success(table, ["g"], "id", F.col("x") > 0).count() == table.count()
        assert T.ecdf(table, ["g"], "x").agg(F.max("last_rank")).first()[0] > 900
        assert P.rekey(table, "m_", "id").select("run_id").distinct().count() == table.count()
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
        spark.conf.unset("spark.sql.codegen.factoryMode")


def test_many_equal_p_values(spark):
    tests = spark.createDataFrame([(i, 0.0 if i % 2 else i / 4000) for i in range(2000)], "i int, p double")
    got = T.fdr_bh(tests, "p", ["i"]).collect()
    assert sorted(r.bh_rank for r in got) == list(range(1, 2001)) and all(r.p_adjusted == 0 for r in got if r.i % 2)


def test_failed_cases_of_quiet_suites(joins, spark):
    rows = [(i, "loud", False, 0.5) for i in range(300)] + [(300, "quiet", False, 0.2), (301, "quiet", False, None),
                                                            (302, "quiet", True, 0.01), (303, "fine", True, 0.0)]
    df = spark.createDataFrame(rows, "case_id long, suite string, validation_success_5 boolean, final_error double")
    got = W.failed_cases(df, ["suite"], 20).collect()
    assert [(r.case_id, r.suite, r.failures) for r in got] == [(300, "quiet", 2)]
    assert W.failed_cases(df, ["suite"], None).count() == 301


def test_fdr_matches_the_definition(joins, spark):
    p = [0.001, 0.2, 0.04, 0.04, 0.9, 0.0, 1e-30, None, 0.03]
    df = spark.createDataFrame(list(enumerate(p)), "i int, p double")
    got = {r.i: r for r in T.fdr_bh(df, "p", ["i"]).collect()}
    known = sorted((v, i) for i, v in enumerate(p) if v is not None)
    best, want = 1.0, {}
    for rank in range(len(known), 0, -1):
        best = min(best, known[rank - 1][0] * len(known) / rank)
        want[known[rank - 1][1]] = best
    assert {i: r.p_adjusted for i, r in got.items()} == pytest.approx(want)
    assert {i for i, r in got.items() if r.significant} == {i for i, v in want.items() if v <= 0.05}


def scored(spark, n=4000):
    rows = [(i, "hot" if i % 3 else "b", i % 10 < 4, i % 10 < 5, i % 10 < 6, i % 10 < 8, i % 10 < 9, True) for i in range(n)]
    cols = ["case_id", "model", *[f"validation_success_{t}" for t in (1, 2, 3, 5, 10)], "simulation_success"]
    return spark.createDataFrame(rows, cols)


@pytest.mark.parametrize("method", ["binomial", "poisson"])
def test_bootstrap_interval(spark, method):
    df = scored(spark)
    out = T.bootstrap_ci(df, ["model"], 4000) if method == "binomial" else T.poisson_bootstrap_ci(df, ["model"], ["case_id"], 400)
    for r in out.collect():
        half = 1.96 * np.sqrt(r.success_rate * (1 - r.success_rate) / r.total)
        assert r.ci_lower <= r.success_rate <= r.ci_upper
        assert r.ci_upper - r.ci_lower == pytest.approx(2 * half, rel=0.15)


def test_bootstrap_is_reproducible(spark):
    df = scored(spark, 500)
    first = T.bootstrap_ci(df, ["model"], 500).orderBy("model", "tolerance").collect()
    assert first == T.bootstrap_ci(df.repartition(7), ["model"], 500).orderBy("model", "tolerance").collect()


def test_chi_square_against_the_table(spark):
    out = T.chi2_pairwise(scored(spark, 3001)).where("tolerance = 5").first()
    a = np.array([[out.successes_a, out.total_a - out.successes_a], [out.successes_b, out.total_b - out.successes_b]], float)
    want = a.sum(1)[:, None] * a.sum(0) / a.sum()
    assert out.chi2 == pytest.approx(((a - want) ** 2 / want).sum())
    import math
    assert out.p_value == pytest.approx(math.erfc(math.sqrt(out.chi2 / 2)), rel=2e-7)


def test_only_short_tables_are_spread(spark):
    cores = spark.sparkContext.defaultParallelism
    assert S.spread(spark.range(100).coalesce(1)).rdd.getNumPartitions() == cores
    large = spark.range(0, 10**9, 1, 3)
    assert S.spread(large).rdd.getNumPartitions() == 3
    assert S.planned_bytes(large) == 8 * 10**9


def test_staged_folders_are_deleted(spark):
    import os

    with S.staging(spark):
        paths = [S.stage(spark.range(5)).inputFiles()[0] for _ in range(2)]
        folders = [os.path.dirname(p.removeprefix("file://")) for p in paths]
        assert all(map(os.path.isdir, folders))
    assert not any(map(os.path.isdir, folders))


def test_buckets_are_monotone(spark, monkeypatch):
    monkeypatch.setattr(S, "SCAN_ROWS", 20)
    values = sorted([0.0, 1e-300, -1e-300, 1e300, -1e300, 1.0, 1.0000001, -1.0, -2.5, 0.1, float("inf"), float("-inf"),
                     *np.random.default_rng(0).normal(0, 100, 500).tolist()])
    df = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "v double")
    found = {repr(r.v): r._b for r in buckets(df, ["v"])}
    assert [found[repr(v)] for v in [None, *values, float("nan")]] == sorted(found.values())


def test_a_repeated_table_is_not_broadcast(spark, monkeypatch):
    """Its planned size leaves out that every row is there once for each salt."""
    monkeypatch.setattr(S, "BROADCAST_ROWS", 2)
    few = S.stage(spark.range(50).select("id", (F.col("id") % 7).alias("n")), "few")
    joined = S.salted_join(spark.range(1000).select((F.col("id") % 60).alias("id"), F.col("id").alias("row")), few, ["id"], ["row"])
    got = joined.toPandas()
    assert "Broadcast" not in joined._jdf.queryExecution().toString()
    assert sorted(got["row"]) == [r for r in range(1000) if r % 60 < 50] and (got["n"] == got["id"] % 7).all()
