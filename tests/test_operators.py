"""Operators that SQL cannot express, against plain numpy."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from verdant.operators import statespace

def series(spark, n=3, days=40, seed=4):
    r = np.random.default_rng(seed)
    rows = [(p, str(np.datetime64("2000-01-01") + k), None if r.random() < 0.3 else float(np.sin(k / 9) + r.normal() / 5), None if r.random() < 0.5 else float(r.normal())) for p in range(n) for k in range(days) if r.random() < 0.9]
    return rows, spark.createDataFrame(rows, "pixel_id long, d string, y1 double, y2 double").selectExpr("pixel_id", "CAST(d AS DATE) obs_date", "y1", "y2").repartition(3)


def plain(ys, m):
    """One pixel's smoother with full matrices, all observations of a step at once."""
    x, c, out, pre = m.m0, m.C0, [], []
    for y in ys:
        x, c = m.G @ x, m.G @ c @ m.G.T + m.W
        pre.append((x, c))
        k = np.array([v is not None and not np.isnan(v) for v in y])
        if k.any():
            f = m.FF[k]
            gain = c @ f.T @ np.linalg.inv(f @ c @ f.T + np.diag(m.V[k]))
            x, c = x + gain @ (np.array(y, float)[k] - f @ x), c - gain @ f @ c
        out.append((x, c))
    for i in range(len(out) - 2, -1, -1):
        g = out[i][1] @ m.G.T @ np.linalg.inv(pre[i + 1][1])
        out[i] = out[i][0] + g @ (out[i + 1][0] - pre[i + 1][0]), out[i][1] + g @ (out[i + 1][1] - pre[i + 1][1]) @ g.T
    return out


def test_multi_state_smoother_as_plain_matrices(spark):
    rows, df = series(spark)
    for m in (statespace.model(2, [[0], [0, 1]][:1] + [[1]], w=0.05, v=0.2), statespace.seasonal(5, 2, 0.1, 0.3)):
        got = statespace.kf_multi(df, ["y1", "y2"], m, smooth=True, buckets=2).toPandas().sort_values(["pixel_id", "obs_date"])
        for p in range(3):
            mine = sorted(x for x in rows if x[0] == p)
            want = plain([x[2:] for x in mine], m)
            own = got[got.pixel_id == p]
            assert np.allclose(own[[f"mean_{i + 1}" for i in range(len(m.m0))]].to_numpy(), [x for x, _ in want])
            assert np.allclose(own[[f"variance_{i + 1}" for i in range(len(m.m0))]].to_numpy(), [np.diag(c) for _, c in want])


def test_leave_one_out_as_refits(spark):
    rows, df = series(spark, n=1, days=15)
    got = {str(r["obs_date"]): r["error"] for r in statespace.leave_one_out_error(df, F.col("y1"), 0.05, 0.2).collect()}
    m = statespace.Model(np.ones((1, 1)), np.eye(1), np.eye(1) * 0.05, np.array([0.2]), np.zeros(1), np.eye(1))
    for i, x in enumerate(rows):
        if x[2] is not None:
            without = plain([(None if j == i else y[2],) for j, y in enumerate(rows)], m)
            assert np.isclose(got[x[1]], x[2] - without[i][0][0])
