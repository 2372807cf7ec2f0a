"""Edges of the row functions, on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from runledger.functions import classify as K
from runledger.functions import derive as D
from runledger.functions import text as X
from runledger.operators import generate as G
from runledger.operators import stats as T
from runledger.operators.joins import assign_regime
from runledger.sources.runlog import read_log_points, run_log_points, run_log_points_unskipped


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def each(spark, values, kind, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[1] for r in df.select("i", fn(F.col("x"))).orderBy("i").collect()]


def test_time_gap_of_the_pattern(spark):
    df = spark.createDataFrame([(0, 2.0, 2.0), (1, 2.0, 2.0099), (2, 2.0, 2.02), (3, 0.0, 0.0), (4, None, None),
                                (5, 2.0, None)], "i int, a double, b double")
    got = df.select("i", K.pattern_by_time(F.col("a"), F.col("b"))).orderBy("i").collect()
    assert [r[1] for r in got] == ["simultaneous", "simultaneous", "sequential", "none_active", "parsing_failure",
                                   "single_b1"]


def test_motion_needs_speed_and_distance(spark):
    rows = [(0, 180.5, 1.0, 5.0, 100.0, 0.0, 5.0), (1, 181.0, 1.0, 5.0, 100.0, 1.0, 5.0), (2, 170.0, 1.0, 5.0, 90.0, 1.0, 5.05),
            (3, 170.0, 1.0, 5.0, 90.0, 1.0, 5.06), (4, 170.0, 0.0, 5.0, 90.0, 1.0, 5.0)]
    df = spark.createDataFrame(rows, "i int, b1_pos double, b1_speed double, b1_time double, b2_pos double, "
                                     "b2_speed double, b2_time double")
    cmd = {c: F.col(c) for c in D.COMMAND}
    got = df.select("i", K.pattern_by_motion(cmd, F.lit(180.0), F.lit(100.0))).orderBy("i").collect()
    assert [r[1] for r in got] == ["no_motion", "single_b1", "simultaneous", "sequential", "single_b2"]


def test_bin_edges(spark):
    targets = [1.1, 0.9, 1.10001, 1.3, 1.30005, None]
    assert each(spark, targets, "double", lambda x: K.power_bin(x)) == [
        "Medium" if abs(t - 1.0) > 0.1 and abs(t - 1.0) <= 0.3 else "Small" if abs(t - 1.0) <= 0.1 else "Large"
        for t in targets[:-1]] + ["Unknown"]
    assert each(spark, [-1.0, -0.3, -0.1, 0.0, 0.1, 0.3, 1.0, -1.5], "double", K.regime_of_delta) == [
        "large_dec", "medium_dec", "small_dec", "small_inc", "medium_inc", "large_inc", "large_inc", "large_dec"]
    assert each(spark, [59.89, 59.9, 70.0, 70.1, 100.1, 100.2], "double", K.window_bin) == [
        "nan", "60_70", "60_70", "70_80", "90_100", "nan"]
    assert each(spark, ["60", "69.9", "70", "100", "100.1", "x"], "string", K.window_band) == [
        "60-70", "60-70", "70-80", "90-100", "Outlier", "Error"]
    assert each(spark, [-0.009, -0.0089, -0.015, -0.0151], "double", K.severity3) == [
        "risky", "normal", "risky", "shutdown"]


def test_nan_is_missing(spark):
    row = one(spark, D.nan_to_null(F.lit(float("nan"))), D.flag(D.nan_to_null(F.lit(float("nan"))) > 1.0))
    assert row.c0 is None and row.c1 is False


def test_round_half_to_even_then_clip(spark):
    assert each(spark, [0.5, 1.5, 2.5, -3.0, 179.5, 180.5, 999.0, None], "double", D.round_clip) == [
        0, 2, 2, 0, 180, 180, 180, None]


def test_command_saturates_and_spills(spark):
    cmd = D.gain_command(F.lit(1.0), F.lit(2.0), F.lit(100.0))
    assert list(one(spark, *cmd.values())) == [180.0, 0.0, 0.0, 180.0, 40.0, 2.0]
    cmd = D.gain_command(F.lit(1.0), F.lit(0.5), F.lit(260.0))
    assert list(one(spark, *cmd.values())) == [150.0, 15.0, 2.0, 0.0, 50.0, 2.0]
    cmd = D.gain_command(F.lit(1.0), F.lit(1.0), F.lit(260.0))
    assert list(one(spark, *cmd.values())) == [180.0, 0.0, 0.0, 100.0, 0.0, 0.0]
    cmd = D.gain_command(F.lit(1.0), F.lit(1.001), F.lit(20.0))
    assert one(spark, *cmd.values()).c4 == 0.1


def test_zero_target_modes(spark):
    a, t = F.lit(0.5), F.lit(0.0)
    got = one(spark, *[D.pct_error(a, t, m) for m in ("absolute", "relative", "inf", "positive", "floored")])
    assert list(got) == [50.0, None, float("inf"), 0.0, 50.0]


@pytest.mark.parametrize("text, expected", [
    ("[1.0, 1.5, 180, 0.0, 0.0, 100, 0.0, 0.0]", [180, 0, 0, 100, 0, 0]),
    ("[1.0, 1.5, 180, 0.0, 0.0, 100, -4.5, 0.0]", [180, 0, 0, 100, 4.5, 0]),
    ("[1.0, 1.5, 180, 0.0, 0.0, 100, 1.2.3, 0.0]", None),
    ("[1.0, 1.5, 180, 0.0, 0.0, 100, 0.0, 0.0].", None),
    ("[1.0, 1.5, 180, 0.0, 0.0, 100, 0.0]", None),
    ("[1.0, 1.5, 180., .5, 0.0, 100, 0.0, 0.0]", [180, 0.5, 0, 100, 0, 0]),
    ("", None),
])
def test_parse_last6(spark, text, expected):
    assert one(spark, X.parse_last6(F.lit(text))).c0 == expected


def test_parse_variants(spark):
    assert one(spark, X.parse_signed_last6(F.lit("1 2 -3 -4.5 5 6 7. 8"))).c0 == [-3, -4.5, 5, 6, 7, 8]
    assert one(spark, X.parse_bracket6(F.lit("[9] x [1, 2,3 ,4,5,6.5] 7]"))).c0 == [1, 2, 3, 4, 5, 6.5]
    assert one(spark, X.parse_bracket6(F.lit("[1,2,3,4,5]"))).c0 is None
    assert one(spark, X.parse_bracket6(F.lit("[1,2,3,4,5,1d]"))).c0 is None
    assert one(spark, X.parse_bracket6(F.lit("1,2,3,4,5,6"))).c0 == [1, 2, 3, 4, 5, 6]
    assert tuple(one(spark, X.parse_pair_signed(F.lit("[245.4, 180, -2.1e-3, 22.4]"))).c0) == (-0.0021, 22.4)
    assert tuple(one(spark, X.parse_pair_signed(F.lit("[245.4, 180, 0.1, 22.4, -0.2, 3]"))).c0) == (-0.2, 3.0)
    assert one(spark, X.parse_pair_signed(F.lit("[245.4, 180]"))).c0 is None


def test_format_reasons(spark):
    texts = ["[1,2,3,4,5,6]", "1,2,3,4,5,6", "[1,2]", "[1,2,3,4,5,6] Speed"]
    assert each(spark, texts, "string", X.format_problem) == [None, "no bracket", "too few numbers", "field name: speed"]


def test_number_text(spark):
    values = [0.125, 1.005, 2.5, 1234567.891, -0.5, 1e-7]
    assert each(spark, values, "double", lambda x: X.fixed(x, 2)) == [f"{v:.2f}" for v in values]
    values = [1.0, 0.5, 180.0, 0.00012, 12345678.9, 123456789.0]
    assert each(spark, values, "double", X.plain_number) == [repr(v) for v in values]


def test_deck_slots(spark):
    assert one(spark, X.render_deck("a {x} {{b}} {y}", {"x": F.lit(1), "y": F.lit(2.5)})).c0 == "a 1 {b} 2.5"
    with pytest.raises(KeyError):
        X.render_deck("a {x}", {})


def test_names_keep_all_digits(spark):
    assert each(spark, [7, 123456], "long", lambda x: X.run_name("def_", x, 5)) == ["def_00007", "def_123456"]


LOG = """CPU time before
1 1.0 2 3
 TRANSIENT RESULTS
 TRANSIENT RESULTS
 5 5.0 5 5.0
 1 0.5 0 1.25 tail
 Time 1 x 9

 TRANSIENT RESULTS
 8 8.0 8 8.0
 CPU time inside the skipped lines
 2 x 0 1.5
 3 1.5 0 1.75
 CPU time breakdown
 4 2.0 0 9.0
"""


def test_log_states(spark):
    df = spark.createDataFrame([("a", LOG), ("b", "no results here"), ("c", LOG.replace("\n", "\r\n"))], "run_id string, text string")
    full = run_log_points(df, ["run_id"]).orderBy("run_id", "line").collect()
    assert [(r.run_id, r.t, r.power) for r in full] == [(k, *p) for k in "ac" for p in ((0.5, 1.25), (1.0, 9.0), (1.5, 1.75))]
    powers = run_log_points(df.where("run_id = 'a'"), ["run_id"], power_only=True).orderBy("line").collect()
    assert [r.power for r in powers] == [1.25, 9.0, 1.5, 1.75]
    loose = run_log_points_unskipped(df.where("run_id = 'a'"), ["run_id"]).orderBy("line").collect()
    assert [r.power for r in loose] == [5.0, 1.25, 8.0, 1.5, 1.75, 9.0]


@pytest.mark.parametrize("size", [13, 40, 1 << 20])
def test_logs_cut_anywhere(spark, tmp_path, size):
    """Blocks of a few bytes: the section's state is carried from one to the next."""
    late = "x\n" * 30 + LOG + " TRANSIENT RESULTS\n7 7.0 7 7.0\n"
    logs = {"a.out": LOG, "b.out": "no results here\n", "c.out": LOG.replace("\n", "\r\n"), "d.out": late, "e.out": "", "f.out": LOG * 3,
            "g.out": " TRANSIENT RESULTS\n"}
    for name, text in logs.items():
        (tmp_path / name).write_bytes(text.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        for how in ({}, {"power_only": True}, {"end": "time breakdown", "end_anywhere": True}, {"end": "CPU time"}):
            whole = run_log_points(spark.createDataFrame(list(logs.items()), "run_id string, text string"), ["run_id"], **how)
            got = sorted(map(repr, read_log_points(spark, str(tmp_path), **how).collect()))
            assert got == sorted(map(repr, whole.withColumn("line", F.col("line").cast("long")).collect())) and got
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_gain_fallbacks(spark):
    rows = [("one", 0.5, 10.0), ("zero", 0.00001, 1.0), ("zero", 0.00002, 2.0), ("good", 0.1, 1.0), ("good", 0.2, 2.0),
            ("good", 0.3, 3.0), ("poor", 0.1, 1.0), ("poor", 0.2, -2.0), ("poor", 0.3, 3.0), ("poor", 0.4, -4.0)]
    df = spark.createDataFrame(rows, "regime string, x double, y double")
    got = {r.regime: (round(r.Kp, 6), r.method) for r in T.fit_gain_by_regime(df, "x", "y", labels=["one", "zero", "good", "poor", "none"]).collect()}
    assert got.pop("none") == (35.5, "fallback")
    assert got == {"one": (35.5, "fallback"), "zero": (35.5, "fallback (samples too close to zero)"),
                   "good": (10.0, "linear_regression"), "poor": (10.0, "median_ratio (low R^2)")}
    flat = spark.createDataFrame([("f", 0.1, 2.0), ("f", 0.2, 2.0), ("f", 0.4, 2.0)], "regime string, x double, y double")
    row = T.fit_gain_by_regime(flat, "x", "y", labels=["f"]).first()
    assert (row.Kp, row.r2, row.method) == (10.0, 0.0, "median_ratio (low R^2)")
    assert {r.regime: r.gain for r in T.single_gain(df, "x", "y", ["regime"]).collect()}["one"] == 200.0


def test_values_outside_every_regime_are_dropped(spark):
    df = spark.createDataFrame([(-1.5,), (-1.0,), (0.0,), (1.0,)], "x double")
    assert {r.x: r.regime for r in assign_regime(df, "x").collect()} == {-1.0: "large_dec", 0.0: "small_inc"}


def test_mixture_families(spark):
    df = G.gen_mixture(G.id_table(spark, 20000)).cache()
    shares = {r.family: r["count"] / 20000 for r in df.groupBy("family").count().collect()}
    assert shares["single"] == pytest.approx(0.6, abs=0.02) and shares["sequential"] == pytest.approx(0.1, abs=0.01)
    labels = df.withColumn("p", K.pattern_by_time(F.col("b1_time"), F.col("b2_time")))
    assert {r.p for r in labels.where("family = 'single'").select("p").distinct().collect()} == {"single_b1", "single_b2"}
    assert labels.where("family = 'sequential' and (p <> 'sequential' or b1_time < b2_time + 3)").count() == 0
    assert labels.where("b1_pos not between 60 and 180 or b2_pos not between 70 and 160").count() == 0
    mirror = G.gen_mixture(G.id_table(spark, 2000), mirror=True)
    assert mirror.where("family = 'sequential' and b2_time < b1_time + 3").count() == 0
    assert mirror.where("b1_time = 0 and b1_pos <> 100 or b2_time = 0 and b2_pos <> 180").count() == 0


def test_binned_cells_hold_their_ranges(spark):
    df = G.gen_binned(G.bin_plan(spark, 5)).cache()
    assert df.count() == 1000 and df.select("win_range", "boron_range", "init_case", "move_type").distinct().count() == 200
    low, high = (F.split_part("win_range", F.lit("-"), F.lit(i)).cast("int") for i in (1, 2))
    assert df.where(~F.col("monitor_window").between(low, high)).count() == 0
    assert df.where("move_type = 'A_only' and (b2_time > 0 or b1_time = 0)").count() == 0
    first = df.orderBy("id").first()
    assert (first.run_name, first.win_range, first.boron_range, first.init_case, first.move_type) == (
        "data_000001", "60-80", "0-200", "case1", "A_only")


def test_first_cases_are_the_fixed_ones(spark):
    rows = G.gen_test_cases(G.id_table(spark, 50)).orderBy("case_id").collect()
    assert [r.target_final for r in rows[:12]] == G.FIXED_TARGETS
    assert all(0.5 <= r.target_final <= 1.5 for r in rows) and {r.kind for r in rows[12:]} == {"random"}


def test_case_of_a_regime_without_samples_has_a_command(spark):
    from runledger.plans.flows import schedule_pending

    samples = spark.createDataFrame([(0.15 + k / 100, 5.0 + k) for k in range(6)], "power_delta double, delta_step double")
    cases = spark.createDataFrame([(1, 1.0, 0.6), (2, 1.0, 1.2)], "case_id long, target_initial double, target_final double")
    got = {r.case_id: r for r in schedule_pending(samples, cases, cases.limit(0)).collect()}
    assert got[1].Kp_used == 35.5 and got[1].b2_pos is not None and got[2].Kp_used == pytest.approx(100.0)


def test_diverged_run_is_no_success(spark):
    from runledger.plans.flows import score_closed_loop

    cases = spark.createDataFrame([(k, 1.0, 1.2) for k in range(4)], "case_id long, target_initial double, target_final double")
    texts = cases.selectExpr("case_id", "'[1.0, 1.2, 90, 5.0, 1.0, 80, 5.0, 1.0]' AS text")
    body = {0: "nan\n4 3.0 0 NaN", 1: "1.21", 2: "Infinity", 3: "1.2\n CPU time so far\n4 3.0 0 1.9"}
    logs = spark.createDataFrame([(k, f"TRANSIENT RESULTS\n-\n-\n1 0.0 0 1.0\n2 1.0 0 1.2\n3 2.0 0 {b}\n CPU time breakdown\n5 9.0 0 1.2")
                                  for k, b in body.items()], "case_id long, text string")
    got = {r.case_id: r for r in score_closed_loop(cases, texts, logs).collect()}
    assert [got[k].validation_success_5 for k in range(4)] == [False, True, False, False]
    assert got[0].actual_final is None and got[0].stage == "result_parse_failure" and got[3].actual_final == 1.9


def test_unlisted_models_stay(spark):
    df = spark.createDataFrame([("1K", 4.0, 4.0), ("10K", 2.0, 2.0), ("PID", 1.0, 1.0)], "model string, mean double, median double")
    got = [(r.from_model, r.to_model, r.mean_improvement) for r in T.improvement(df).collect()]
    assert got == [("1K", "10K", 50.0), ("10K", "PID", 50.0)]


def test_exact_bounds():
    from math import comb

    for n, k in ((1, 1), (10, 3), (50, 49), (400, 4)):
        p, upto, want = k / n, 0.0, []
        for j in range(n + 1):
            upto += comb(n, j) * p**j * (1 - p) ** (n - j)
            if len(want) < 1 and upto >= 0.025:
                want.append(j / n)
            if len(want) == 1 and upto >= 0.975:
                want.append(j / n)
        assert T.binomial_bounds(n, k) == want
    lo, hi = T.binomial_bounds(10**9, 5 * 10**8)
    assert (hi - lo) / 2 == pytest.approx(1.96 * 0.5 / 10**4.5, rel=1e-2)
