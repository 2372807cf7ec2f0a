"""Small tables of embeddings with nulls, zeros, copies, scaled copies, ties and columns whose names clash."""

import numpy as np

SCHEMA = "vec_id long, embedding array<float>, label int, node long, vector string, n int, component string, score double"


def rows(n=300, d=8, seed=1):
    rnd = np.random.default_rng(seed)
    own = rnd.standard_normal((n, d)).astype(np.float32)
    own[: n // 3] += 3 * rnd.standard_normal(d).astype(np.float32)
    own[n // 4: n // 4 + n // 10] = own[0]          # copies of one vector
    own[n // 2: n // 2 + 5] = 2 * own[1]             # the same direction
    out = [[i, [float(x) for x in v]] for i, v in enumerate(own)]
    out += [[n, None], [n + 1, []], [n + 2, [None] * d], [n + 3, [float("nan")] + [1.0] * (d - 1)], [n + 4, [float("inf")] + [1.0] * (d - 1)],
            [n + 5, [0.0] * d], [n + 6, [1.0] * (d + 1)], [None, [1.0] * d], [n + 7, [1e-30] * d], [n + 8, [1.0] * (d - 1) + [None]]]
    out += [list(out[3]), [5, out[9][1]], [None, out[4][1]]]
    return [(*r, 1, None, "v", 3, "c", 0.5) for r in out]


def table(spark, **how):
    return spark.createDataFrame(rows(**how), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def finite(all_rows, d):
    """(id, vector) of the rows whose vector has d finite entries."""
    return [(r[0], np.array(r[1], float)) for r in all_rows
            if r[1] is not None and len(r[1]) == d and all(x is not None and np.isfinite(x) for x in r[1])]
