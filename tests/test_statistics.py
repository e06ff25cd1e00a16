"""Robust fits, intervals, components and noise against numpy and plain Python."""

import itertools
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdant.operators import multivariate, robust, stats


def brute_p(x):
    """All signs of the ranks."""
    rank = np.argsort(np.argsort(np.abs(x))) + 1
    v = rank[np.array(x) > 0].sum()
    sums = [sum(r for r, s in zip(rank, signs) if s) for signs in itertools.product((0, 1), repeat=len(x))]
    n = len(x)
    tail = sum(s >= v for s in sums) if v > n * (n + 1) / 4 else sum(s <= v for s in sums)
    return min(1, 2 * tail / len(sums))


def test_signed_rank_p():
    r = np.random.default_rng(1)
    for n in range(1, 11):
        x = r.normal(0.3, 1, n)
        assert np.isclose(robust.signed_rank_p(x), brute_p(x))
    assert np.isnan(robust.signed_rank_p(np.array([0.0, np.nan])))
    # ties and zeros: normal, both corrections. ranks of 1 1 2 3 -2: 1.5 1.5 3.5 5 3.5; V = 11.5, mean 7.5, variance 13.75 - 2 * 6 / 48
    assert np.isclose(robust.signed_rank_p(np.array([0, 1.0, 1.0, 2.0, 3.0, -2.0])), 2 * (1 - 0.5 * (1 + __import__("math").erf((4 - 0.5) / np.sqrt(13.5) / np.sqrt(2)))))
    x = r.normal(0.1, 1, 400)
    assert 0 < robust.signed_rank_p(x) < 1


def test_t_quantiles():
    for df, t in ((1, 12.706204736432095), (2, 4.302652729696142), (5, 2.5705818366147395), (30, 2.0422724563012373), (1000, 1.9623390808264078)):
        assert np.isclose(robust.t_quantile(0.95, df), t, rtol=1e-10)


def test_normals_as_plain_python(spark):
    r = np.random.default_rng(2)
    rows = [(p, y, None if r.random() < 0.2 else float(r.integers(90, 130)) + 0.5 * p % 1) for p in range(12) for y in range(2001, 2001 + (1 if p == 11 else 14))] + [(10, 2030, 3.0), (10, 2030, 9.0)]
    got = {x["pixel_id"]: x for x in robust.climate_normals(spark.createDataFrame(rows, "pixel_id long, yr int, x double").repartition(4), "pixel_id", "yr", "x", rounded=False).collect()}
    for p in range(12):
        pts = [(y, v) for q, y, v in rows if q == p and v is not None]
        if not pts:
            assert p not in got
            continue
        xs = [v for _, v in pts]
        slopes = [median(s) for i in pts if (s := [(j[1] - i[1]) / (j[0] - i[0]) for j in pts if j[0] != i[0]])]
        g = got[p]
        assert np.allclose([g["med"], g["mad"], g["mean"], g["n"]], [median(xs), 1.4826 * median(abs(v - median(xs)) for v in xs), np.mean(xs), len(xs)])
        if len(xs) > 1:
            assert np.isclose(g["sd"], np.std(xs, ddof=1)) and np.isclose(g["slope"], median(slopes)) and np.isclose(g["p"], robust.signed_rank_p(np.array(slopes)))
        else:
            assert g["sd"] is None and g["slope"] is None


def test_line_and_limits(spark):
    r = np.random.default_rng(3)
    rows = [(p, float(x), float(2 * x + p + r.normal()), float(w)) for p in range(3) for x, w in zip(r.normal(50, 5, 20), r.integers(0, 4, 20))] + [(7, 1.0, 1.0, 1.0), (7, 2.0, 3.0, 1.0), (8, None, 1.0, 1.0)]
    got = {x["k"]: x for x in robust.ols_interval(spark.createDataFrame(rows, "k int, x double, y double, w double"), "k", "y", "x", "w").collect()}
    for p in range(3):
        x, y, w = np.array([q[1:] for q in rows if q[0] == p and q[3] > 0]).T
        a = np.column_stack([np.ones(len(x)), x])
        inv = np.linalg.inv(a.T @ (w[:, None] * a))
        b = inv @ a.T @ (w * y)
        s2 = (w * (y - a @ b) ** 2).sum() / (len(x) - 2)
        e = robust.t_quantile(0.95, len(x) - 2) * np.sqrt(s2 * np.diag(inv))
        g = got[p]
        assert g["n"] == len(x) and np.allclose([g["intercept"], g["slope"], g["intercept_low"], g["intercept_high"], g["slope_low"], g["slope_high"]], [*b, b[0] - e[0], b[0] + e[0], b[1] - e[1], b[1] + e[1]])
        my = (w * y).sum() / w.sum()
        assert np.isclose(g["r2"], 1 - (w * (y - a @ b) ** 2).sum() / (w * (y - my) ** 2).sum())
    assert got[7]["slope"] == 2 and got[7]["slope_low"] is None and 8 not in got


def test_components_as_numpy(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(300, 5)) @ r.normal(size=(5, 5)) * [1, 10, 0.1, 5, 1] + [0, 5, -3, 100, 2]
    rows = [(i, *map(float, v), 7.0) for i, v in enumerate(x)] + [(999, None, *[1.0] * 5)]
    d = spark.createDataFrame(rows, "i int, a double, b double, c double, d double, e double, f double").repartition(6)
    m = multivariate.pca_fit(d, list("abcdef"), 3)
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    values, vectors = np.linalg.eigh(np.corrcoef(x.T))
    want = vectors[:, np.argsort(-values)[:3]]
    want = want * np.sign(want[np.abs(want).argmax(0), range(3)])
    assert np.allclose(m.loadings[:5], want, atol=1e-8) and np.allclose(m.loadings[5], 0) and np.allclose(m.variance, np.sort(values)[::-1][:3])
    got = {q["i"]: [q["pc_1"], q["pc_2"], q["pc_3"]] for q in multivariate.pca_transform(d, m).collect()}
    assert got.pop(999) == [None] * 3 and np.allclose([got[i] for i in range(300)], z @ want, atol=1e-8)
    with pytest.raises(ValueError):
        multivariate.pca_fit(d.limit(0), ["a"], 1)


def dense(y, w, strength, n):
    d = np.diff(np.eye(n), 2, axis=0)
    return np.linalg.solve(np.diag(w) + strength * d.T @ d, w * y)


def test_noise_of_three_classes(spark):
    """One of them has a single pixel and takes the pooled values."""
    r = np.random.default_rng(5)
    rows = [(p, "abc"[min(p // 3, 2)], yr, int(doy), *[float(np.sin(doy / 60) * (b + 1) + r.normal() / 5) for b in range(2)]) for p in range(7) for yr in (2001, 2002) for doy in np.sort(r.choice(np.arange(1, 366), 30, False))]
    d = spark.createDataFrame(rows, "pixel_id long, cls string, yr int, doy int, u double, v double").withColumn("obs_date", F.expr("date_add(make_date(yr, 1, 1), doy - 1)")).select("pixel_id", "cls", "obs_date", "u", "v")
    got = {(x["cls"], x["doy"]): x for x in multivariate.process_noise_by_class(d, ["u", "v"], "cls", strength=30.0).collect()}
    curves = {}
    for p in range(7):
        for b in (0, 1):
            own = np.array([q[4 + b] for q in rows if q[0] == p])
            lo, hi = np.quantile(own, [0.25, 0.75])
            keep = lambda v: lo - 1.5 * (hi - lo) <= v <= hi + 1.5 * (hi - lo)
            for yr in (2001, 2002):
                y, w = np.zeros(365), np.zeros(365)
                for q in rows:
                    if q[0] == p and q[2] == yr and keep(q[4 + b]):
                        y[q[3] - 1], w[q[3] - 1] = q[4 + b], 1
                seen = np.flatnonzero(w)
                curves[p, yr, b] = np.diff(dense(y, w, 30.0, 365)) if len(seen) >= 4 else np.full(364, np.nan)
    for cls, pixels in (("a", range(3)), ("b", range(3, 6)), ("c", range(7))):
        for doy in (2, 50, 200, 365):
            x = np.array([[curves[p, yr, b][doy - 2] for b in (0, 1)] for p in pixels for yr in (2001, 2002)])
            q = np.quantile(x, [0.25, 0.75], axis=0)
            good = ((x >= q[0] - 1.5 * (q[1] - q[0])) & (x <= q[1] + 1.5 * (q[1] - q[0]))).all(1)
            c = np.cov(x[good].T)
            g = got[cls, doy]
            assert np.allclose([g["cov_u_u"], g["cov_u_v"], g["cov_v_v"]], [c[0, 0], c[0, 1], c[1, 1]]) and g["pixels"] == (1 if cls == "c" else 3)
    assert len(got) == 3 * 364


def test_samples_by_hash(spark):
    d = spark.range(20_000).selectExpr("id", "CASE WHEN id % 10 = 0 THEN 'a' WHEN id % 10 < 3 THEN 'b' ELSE 'c' END cls")
    s = stats.stratified_sample(d, "cls", "id", 1000)
    assert {r["cls"]: r["count"] for r in s.groupBy("cls").count().collect()} == {"a": 100, "b": 200, "c": 700}
    assert {r["id"] for r in s.collect()} == {r["id"] for r in stats.stratified_sample(d.repartition(7), "cls", "id", 1000).collect()} and set(s.columns) == {"id", "cls"}
    b = multivariate.bounded_sample(d, "cls", "id", 3000).groupBy("cls").count().collect()
    assert all(abs(r["count"] - min({"a": 2000, "b": 4000, "c": 14000}[r["cls"]], 3000)) < 300 for r in b)
    assert abs(stats.random_sample(d, "id", share=0.25).count() - 5000) < 300 and stats.random_sample(d, "id", n=7).count() == 7


def test_curves_of_two_sensors(spark):
    r = np.random.default_rng(6)
    rows = [(s, 1, int(t), float(np.sin(t / 9) + s * 0.3 + r.normal() / 20)) for s in (0, 1) for t in np.sort(r.choice(np.arange(5 * s, 60 + 10 * s), 25, False))]
    d = spark.createDataFrame(rows, "s int, pixel_id long, t int, x double").withColumn("obs_date", F.expr("date_add(DATE'2001-01-01', t)"))
    got = multivariate.spline_rmse(d.where("s = 0"), d.where("s = 1"), "x", 10.0).first()["rmse"]
    curves = []
    for s in (0, 1):
        t = np.array([q[2] for q in rows if q[0] == s])
        y, w = np.zeros(t.max() - t.min() + 1), np.zeros(t.max() - t.min() + 1)
        y[t - t.min()], w[t - t.min()] = [q[3] for q in rows if q[0] == s], 1
        curves.append(dict(zip(range(t.min(), t.max() + 1), dense(y, w, 10.0, len(y)))))
    both = curves[0].keys() & curves[1].keys()
    assert np.isclose(got, np.sqrt(np.mean([(curves[0][t] - curves[1][t]) ** 2 for t in both])))


def test_covariance_terms_over_days(spark):
    rows = [(0, -1.0, 4.0), (0, -3.0, None), (6, 1.0, 8.0), (9, 2.0, -1.0)]
    d = spark.createDataFrame(rows, "t int, p double, q double").withColumn("obs_date", F.expr("date_add(DATE'2001-01-01', t)"))
    got = [(x["p"], x["q"]) for x in multivariate.smooth_covariance(d, ["p", "q"], 2.0).orderBy("obs_date").collect()]
    y, w = np.zeros((2, 10)), np.zeros((2, 10))
    y[:, [0, 6, 9]], w[:, [0, 6, 9]] = [[-2, 1, 2], [4, 8, -1]], [[2, 1, 1], [1, 1, 1]]
    want = np.array([dense(y[k], w[k], 2.0, 10) for k in (0, 1)]).T
    assert np.allclose(got, want)
    root = [x["p"] for x in multivariate.smooth_covariance(d, ["p", "q"], 2.0, True).orderBy("obs_date").collect()]
    assert np.allclose(root, np.sign(want[:, 0]) * np.sqrt(np.abs(want[:, 0])))


@pytest.mark.parametrize("least", [5, 50])
def test_exact_quantiles_without_a_whole_buffer(spark, least):
    r = np.random.default_rng(11)
    for x in (r.normal(size=700), r.integers(0, 4, 700).astype(float), np.r_[np.full(600, 2.0), r.normal(size=100)], np.exp(r.normal(0, 40, 300)), np.array([3.0]), np.full(60, -1.0)):
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "v double").repartition(3)
        for p in (0.0, 0.02, 0.5, 0.98, 1.0):
            assert np.isclose(stats.exact_quantile(df, "v", p, least), np.quantile(x, p), rtol=1e-12), p
    assert stats.exact_quantile(spark.createDataFrame([(None,)], "v double"), "v", 0.5) is None


def test_bins_from_the_pixels_first_year(spark):
    rows = [(1, "S1", "2003-12-30", 10), (1, "S1", "2004-01-01", 30), (1, "S2", "2004-01-07", 5), (1, "S1", "2002-05-01", None), (2, "S3", "2004-12-31", 8)]
    df = spark.createDataFrame(rows, "pixel_id long, sensor string, d string, v int").selectExpr("pixel_id", "sensor", "CAST(d AS DATE) obs_date", "v")
    got = {(r["pixel_id"], r["sensor"], str(r["bin"]), r["value"], r["error"], r["n"]) for r in stats.bin_observations(df, "v", share={"S1": 0.1}).collect()}
    assert got == {(1, "S1", "2003-12-31", 30.0, 3.0, 1), (1, "S1", "2003-12-24", 10.0, 1.0, 1), (1, "S2", "2004-01-07", 5.0, None, 1), (2, "S3", "2004-12-30", 8.0, None, 1)}
    days = {(r["pixel_id"], str(r["bin"])) for r in stats.bin_observations(df, "v", "daily").collect()}
    assert days == {(1, "2003-12-30"), (1, "2004-01-01"), (1, "2004-01-07"), (2, "2004-12-31")}


def test_edges_of_weeks(spark):
    df = spark.createDataFrame([(1, f"2015-01-{d:02d}", d) for d in (1, 2, 8, 9)], "pixel_id long, d string, v int").selectExpr("pixel_id", "CAST(d AS DATE) obs_date", "v")
    left = {(r["week"], r["n"]) for r in stats.weekly_composite(df, "pixel_id", "obs_date", "v").collect()}
    right = {(r["week"], r["n"], str(r["centre"])) for r in stats.weekly_composite(df, "pixel_id", "obs_date", "v", closed="right", centre=True).collect()}
    assert left == {(0, 2), (1, 2)} and right == {(0, 2, "2015-01-05"), (1, 1, "2015-01-11")}
