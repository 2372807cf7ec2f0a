"""Run tables derived from the given tables."""

import math

from runledger.operators import joins as J
from runledger.plans import fixtures


def test_few_regimes_are_computed_once(spark, tmp_path):
    """Conditions on the moved value don't compute it again; nulls, repeated rows and repeated ids are kept."""
    rows = [(9, 1, 1, 1, 30.0, 0.02, "A"), (10, 2, 1, 1, 26.0, 0.04, "N"), (10, 2, 1, 1, 26.0, 0.04, "N"), (5, None, 3, 1, 1.0, 0.0, "R"),
            (5, 2, 1, 1, None, 0.0, None), (None, 10, 1, 1, 50.0, 0.08, "R")]
    schema = ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_tax double, "
              "l_returnflag string")
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/lineitem.parquet")
    samples = J.assign_regime(fixtures.few_regimes(spark, str(tmp_path)), "power_delta")
    assert "sin(" not in samples._jdf.queryExecution().optimizedPlan().toString().lower()
    # the least id as a string is "1-10-1": (null, 10, 1, 1) without its null
    want = [(r[6], r[4] - 25.5, -0.5 if r[0] is None else 0.2 + 0.0999 * math.sin((r[4] - 25.5) * 0.02 + r[5] - 0.04))
            for r in rows if r[4] is not None]
    got = sorted((r.grp, r.delta_step, r.power_delta) for r in samples.select("grp", "delta_step", "power_delta").collect())
    assert [g[:2] for g in got] == [w[:2] for w in sorted(want)]
    assert all(abs(g[2] - w[2]) < 1e-12 for g, w in zip(got, sorted(want), strict=True))
