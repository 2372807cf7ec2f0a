"""Published numbers: they must come out of the operators."""

import math

import pytest
from pyspark.sql import functions as F

from runledger.functions import classify as K
from runledger.operators import joins as J
from runledger.operators import stats as T
from runledger.operators.report import success_by_direction, success_by_range, success_by_regime

# scale -> counts of single_b1, single_b2, simultaneous, sequential, other; entropy; divergence
HISTOGRAMS = {
    "1K": ((332, 1561, 85, 22, 0), 0.6753554703518707, 0.5407020691494145),
    "10K": ((452, 1425, 113, 10, 0), 0.7664768961270707, 0.442988969642206),
    "100K": ((400, 1522, 75, 2, 1), 0.6595990822756583, 0.5454728839198807),
}
# The published sweep: regime -> (gain, samples)
SWEEP = {"large_dec": 13, "medium_dec": 9, "small_dec": 3, "small_inc": 2, "medium_inc": 5, "large_inc": 8}


@pytest.fixture(scope="module")
def histogram(spark):
    rows = [(m, c) for m, (counts, _, _) in HISTOGRAMS.items()
            for c, n in zip([*K.MAIN_PATTERNS, "none_active"], counts) for _ in range(n)]
    return spark.createDataFrame(rows, "model string, scenario_type string")


def test_entropy(histogram):
    for row in T.entropy(histogram, ["model"], "scenario_type").collect():
        counts, h, _ = HISTOGRAMS[row.model]
        assert row.h_nats == pytest.approx(h, abs=1e-12)
        assert row.h_max_nats == pytest.approx(math.log(4), abs=1e-12)
        assert (row.n_records, row.n_in_taxonomy, row.n_other) == (2000, 2000 - counts[4], counts[4])


def test_kl_divergence_is_not_monotonic(histogram):
    kl = T.kl_divergence(histogram, ["model"], "scenario_type")
    assert {r.model: pytest.approx(r.kl_nats, abs=1e-12) for r in kl.collect()} == {
        m: v[2] for m, v in HISTOGRAMS.items()}
    assert T.is_monotonic(kl, "kl_nats").first().monotonic is False


@pytest.fixture(scope="module")
def cases(spark):
    from runledger.operators.generate import published_cases

    return published_cases(spark).withColumn("validation_success_5", F.lit(True))


@pytest.mark.parametrize("mode, expected", [
    ("closed", {"Small": 379, "Medium": 789, "Large": 832}),
    ("closed_eps", {"Small": 380, "Medium": 790, "Large": 830}),
    ("half_open", {"Small": 381, "Medium": 790, "Large": 829}),
])
def test_size_bins(cases, mode, expected):
    assert {r.range: r.n for r in success_by_range(cases, [], mode).collect()} == expected


def test_direction(cases):
    assert {r.direction: r.n for r in success_by_direction(cases, []).collect()} == {"increase": 1013, "decrease": 987}


def test_regimes(cases):
    rows = success_by_regime(cases, J.SCHEDULED_GAINS).collect()
    assert [(r.regime, r.n) for r in rows] == [
        ("large_dec", 427), ("medium_dec", 378), ("small_dec", 182), ("small_inc", 197), ("medium_inc", 411),
        ("large_inc", 405)]
    assert [r.Kp for r in rows] == list(J.SCHEDULED_GAINS.values())


def test_scaling_exponent(spark):
    rates = spark.createDataFrame([("1K", 6.0), ("10K", 26.2), ("100K", 92.0)], "model string, success_rate double")
    out = {r.to_model: r.exponent for r in T.scaling_exponent(rates).collect()}
    assert out["100K"] == pytest.approx(0.5455, abs=5e-5)


def test_rate_margins(spark):
    df = spark.createDataFrame([(1000,), (2000,), (3000,)], "n long")
    margins = [r[0] for r in df.select(T.rate_margin(F.lit(0.9), F.col("n")) * 100).collect()]
    assert [round(m, 1) for m in margins] == [1.9, 1.3, 1.1]


def test_sweep_sizes(spark):
    from runledger.operators.generate import gen_sweep, gen_symmetric_sweep

    start = spark.createDataFrame([(100,)], "start int")
    assert gen_sweep(start, "start", -25, 15).count() == sum(SWEEP.values()) == 40
    assert gen_symmetric_sweep(start, "start").count() == 6
    assert gen_symmetric_sweep(spark.createDataFrame([(170,)], "start int"), "start").count() == 4
