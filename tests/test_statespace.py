"""Varying models, quality filters, hold-outs and forecasts against plain matrices and refits."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from verdant.operators import statespace as S

DAY0 = np.datetime64("2000-01-01")


def plain(ys, gs, ws, vs, ff, m, c, smooth=True):
    """One pixel with full matrices, all observations of a step at once; a pair for each step."""
    out, pre = [], []
    for y, g, w, v in zip(ys, gs, ws, vs):
        m, c = g @ m, g @ c @ g.T + w
        pre.append((m, c))
        k = ~np.isnan(y) & ~np.isnan(v)
        if k.any():
            f = ff[k]
            gain = c @ f.T @ np.linalg.inv(f @ c @ f.T + np.diag(v[k]))
            m, c = m + gain @ (y[k] - f @ m), c - gain @ f @ c
        out.append((m, c))
    for i in range(len(out) - 2, -1, -1) if smooth else ():
        g = out[i][1] @ gs[i + 1].T @ np.linalg.inv(pre[i + 1][1])
        out[i] = out[i][0] + g @ (out[i + 1][0] - pre[i + 1][0]), out[i][1] + g @ (out[i + 1][1] - pre[i + 1][1]) @ g.T
    return np.array([m for m, _ in out]), np.array([np.diag(c) for _, c in out])


def series(n=4, days=30, bands=2, seed=3, missing=0.4):
    r = np.random.default_rng(seed)
    rows = [[p, DAY0 + k, *[np.nan if r.random() < missing else float(np.sin(k / 5 + b) + r.normal() / 9) for b in range(bands)]] for p in range(n) for k in range(days) if r.random() < 0.9]
    return pd.DataFrame(rows, columns=["pixel_id", "obs_date", *[f"y{b}" for b in range(bands)]])


def frame(spark, d):
    types = {"pixel_id": "long", "obs_date": "string"}
    d = d.astype({c: float for c in d.columns if c not in types and c != "mode"}).astype(object).where(d.notna(), None)
    d["obs_date"] = d["obs_date"].astype(str).str[:10]
    return spark.createDataFrame([tuple(x) for x in d.itertuples(index=False)], ", ".join(f"{c} {types.get(c, 'double')}" for c in d.columns)).withColumn("obs_date", F.col("obs_date").cast("date")).repartition(3)


def ordered(df):
    return df.toPandas().sort_values(["pixel_id", "obs_date"]).reset_index(drop=True)


@pytest.mark.parametrize("smooth", [True, False])
def test_models_that_vary_by_row(spark, smooth, monkeypatch):
    monkeypatch.setattr(S, "BYTES", 60_000)  # several blocks in a bucket
    d = series()
    d["e0"], d["e1"] = 0.1 + d.pixel_id * 0.05, np.where(d.index % 5, 0.3, np.nan)
    d["w1"], d["w2"], d["w3"], d["g"] = 0.02 * (1 + d.index % 3), 0.005, 0.03, 1 + 0.1 * (d.index % 4 - 1)
    d["a"], d["b"] = 0.5 + d.pixel_id, 0.2 + d.pixel_id
    m = S.Model(np.eye(2), np.array([[1.0, 0.1], [0.0, 1.0]]), np.eye(2), np.ones(2), np.zeros(2), np.eye(2))
    c = F.col
    got = ordered(S.kf_multi(frame(spark, d), ["y0", "y1"], m, smooth, buckets=1, errors=[c("e0"), c("e1")], noise=[c("w1"), c("w2"), c("w3")], growth=c("g"), first_mean=[c("a"), c("b")], first_variance=[c("b"), c("a")]))
    for p, x in d.groupby("pixel_id"):
        ws = [np.array([[a, b], [b, e]]) for a, b, e in x[["w1", "w2", "w3"]].to_numpy()]
        ms, vs = plain(x[["y0", "y1"]].to_numpy(), [m.G * g for g in x.g], ws, x[["e0", "e1"]].to_numpy(), m.FF, x[["a", "b"]].to_numpy()[0], np.diag(x[["b", "a"]].to_numpy()[0]), smooth)
        own = got[got.pixel_id == p]
        assert np.allclose(own[["mean_1", "mean_2"]], ms) and np.allclose(own[["variance_1", "variance_2"]], vs)


def test_bands_of_two_sensors_by_class_and_day(spark):
    d = series(bands=8).rename(columns={f"y{k}": f"{'fc'[k // 4]}{k % 4}" for k in range(8)})
    d["cls"] = d.pixel_id % 2
    names = [f"w_{r}{c}" for c in range(1, 5) for r in range(c, 5)]
    r = np.random.default_rng(1)
    cov = {}
    for cls in (0, 1):
        for doy in range(2, 40):  # the first day has none: the second one's is taken
            a = r.normal(size=(4, 6)) / 10
            cov[cls, doy] = a @ a.T
    table = spark.createDataFrame([(float(k), t, *[float(w[i, j]) for j in range(4) for i in range(j, 4)]) for (k, t), w in cov.items()], "cls double, doy int, " + ", ".join(f"{n} double" for n in names))
    fine, coarse = [f"f{k}" for k in range(4)], [f"c{k}" for k in range(4)]
    for squared in (True, False):
        got = ordered(S.fuse_multiband(frame(spark, d), fine, coarse, [F.abs(f) * 0.07 + 0.01 for f in fine], [F.lit(0.2)] * 4, table, squared=squared, buckets=2))
        for p, x in d.groupby("pixel_id"):
            doys = [int((t - np.datetime64("2000-01-01")).astype("timedelta64[D]").astype(int)) + 1 for t in x.obs_date.to_numpy()]
            v = np.hstack([np.abs(x[fine].to_numpy()) * 0.07 + 0.01, np.full((len(x), 4), 0.2)])
            ms, vs = plain(x[[*fine, *coarse]].to_numpy(), [np.eye(4)] * len(x), [cov[p % 2, max(t, 2)] for t in doys], v**2 if squared else v, np.vstack([np.eye(4)] * 2), np.zeros(4), np.eye(4) * 0.1)
            own = got[got.pixel_id == p]
            assert np.allclose(own[[f"mean_{k}" for k in range(1, 5)]], ms) and np.allclose(own[[f"variance_{k}" for k in range(1, 5)]], vs)


def test_yearly_carry_is_one_filter(spark):
    d = series(n=2, days=800, bands=1)
    got = ordered(S.annual_carry(frame(spark, d), F.col("y0"), 0.01, 0.05))
    for p, x in d.groupby("pixel_id"):
        m, c, want = 0.0, 1.0, []
        for _, year in x.groupby(pd.to_datetime(x.obs_date).dt.year):  # each year a filter of its own, from the last state of the one before
            ms, vs = plain(year[["y0"]].to_numpy(), [np.eye(1)] * len(year), [np.eye(1) * 0.01] * len(year), [np.array([0.05])] * len(year), np.eye(1), np.array([m]), np.array([[c]]), False)
            m, c = ms[-1, 0], vs[-1, 0]
            want += [*zip(ms[:, 0], vs[:, 0])]
        assert np.allclose(got[got.pixel_id == p][["mean", "variance"]], want)


def test_quality_filter(spark):
    d = series(n=3, bands=2)
    d["k"] = [(1.0, 2.0, 3.0, np.nan)[i % 4] for i in range(len(d))]
    got = ordered(S.kf_quality(frame(spark, d), "y0", "k", "y1"))
    weight, gain, push = {1: 3, 2: 0.5, 3: 0}, {1: 1.1, 2: 1, 3: 1}, {1: 0.8, 2: 1, 3: 1}
    for p, x in d.groupby("pixel_id"):
        est, var, want = 0.0, 5.0, [0.0]
        for y, u, k in x[["y0", "y1", "k"]].to_numpy()[1:]:
            c, b = (gain[k], push[k]) if k == k else (1.1, 0.8)
            g = var * c / (c * var * c + weight[k] * 8) if k == k and y == y else 0
            est, var = est + g * ((y if y == y else 0) - c * est), var - g * c * var
            want.append(est)
            est, var = est + b * (u if u == u else 0), var + 0.5
        assert np.allclose(got[got.pixel_id == p]["mean"], want)


def refit(x, hidden, m, values):
    y = x[values].to_numpy().copy()
    y[hidden, 0] = np.nan
    return plain(y, [m.G] * len(x), [m.W] * len(x), [m.V] * len(x), m.FF, m.m0, m.C0)[0] @ m.FF[0]


def test_held_out_runs_as_refits(spark, monkeypatch):
    monkeypatch.setattr(S, "BYTES", 3_000)
    d, m = series(n=3, days=20), S.two_sensor_model(0.05, 0.1, 0.2, 0.9)
    got = {(r.pixel_id, r.replicate, str(r.obs_date)[:10]): r.error for r in S.holdout_runs(frame(spark, d), ["y0", "y1"], m, 3).toPandas().itertuples()}
    n = 0
    for p, x in d.groupby("pixel_id"):
        valid = np.flatnonzero(x.y0.notna())
        for s in range(len(valid) - 2):
            est = refit(x, valid[s : s + 3], m, ["y0", "y1"])
            for i in valid[s : s + 3]:
                assert np.isclose(got[p, s, str(x.obs_date.iloc[i])[:10]], x.y0.iloc[i] - est[i])
                n += 1
    assert n == len(got)


def test_held_out_shares(spark):
    d, m = series(n=3, days=25), S.two_sensor_model(0.05, 0.1, 0.2)
    got = S.holdout_sweep(frame(spark, d), ["y0", "y1"], m, (0.2, 0.6), 4).toPandas()
    again = S.holdout_sweep(frame(spark, d.iloc[::-1]), ["y0", "y1"], m, (0.2, 0.6), 4, buckets=2).toPandas()
    keys = ["pixel_id", "part", "replicate", "mode", "obs_date"]
    pd.testing.assert_frame_equal(*(x.sort_values(keys).reset_index(drop=True) for x in (got, again)))  # drawn by hash: the same anywhere
    for (p, part, replicate, mode), g in got.groupby(keys[:4]):
        x = d[d.pixel_id == p].copy()
        hidden = np.flatnonzero(np.isin(x.obs_date.astype(str).str[:10], g.obs_date.astype(str).str[:10]))
        assert len(hidden) == round(x.y0.notna().sum() * part)
        if mode == "fine":
            x["y1"] = np.nan
        assert np.allclose(g.sort_values("obs_date").error, x.y0.to_numpy()[hidden] - refit(x, hidden, m, ["y0", "y1"])[hidden])
    assert got.groupby(["part", "replicate"]).obs_date.nunique().nunique() > 0 and got[got.part == 0.2].groupby("replicate").obs_date.apply(tuple).nunique() > 1
    rmse = S.holdout_rmse(frame(spark, got.drop(columns="mode")), "part").toPandas().set_index("part").rmse
    assert np.isclose(rmse[0.6], np.sqrt((got[got.part == 0.6].error ** 2).mean()))


def test_forecast_of_each_truncation(spark):
    d = series(n=3, days=40, bands=1)
    got = ordered(S.forecast_phenology(frame(spark, d), F.col("y0"), 0.3, 0.02, 0.05))
    for p, x in d.groupby("pixel_id"):
        day = ((x.obs_date.to_numpy() - np.datetime64("2000-01-01")) / np.timedelta64(1, "D")).astype(int)
        for n in range(1, len(x) + 1):
            k = x.iloc[:n]
            ms, _ = plain(k[["y0"]].to_numpy(), [np.eye(1)] * n, [np.eye(1) * 0.02] * n, [np.array([0.05])] * n, np.eye(1), np.zeros(1), np.eye(1), False)
            grid = np.arange(day[0], day[n - 1] + 1)
            z = np.interp(grid, day[:n], ms[:, 0])
            up = z[: z.argmax() + 1]
            want = grid[np.flatnonzero(up >= up.min() + 0.3 * (up.max() - up.min()))[0]]
            row = got[got.pixel_id == p].iloc[n - 1]
            assert (pd.Timestamp(row.estimate) - pd.Timestamp("2000-01-01")).days == want
        assert row.error == 0


def test_buckets_follow_the_rows(spark, monkeypatch):
    d = frame(spark, series(n=9))
    want = ordered(S.kf_filter(d, F.col("y0")))
    monkeypatch.setattr(S, "ROWS", 10)
    out = S.kf_filter(d, F.col("y0"))
    pd.testing.assert_frame_equal(ordered(out), want)
    n = -(-d.count() // 10)
    assert f"{n}" in out._jdf.queryExecution().analyzed().toString().split("pmod(")[1][:60]
