"""Fusion operators against plain matrices."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from verdant.operators import fusion, phenology

from .test_statespace import frame, ordered, plain, series


def doys(x):
    return ((x.obs_date.to_numpy() - np.datetime64("2000-01-01")) / np.timedelta64(1, "D")).astype(int) + 1


def test_noise_by_class_and_day(spark):
    d = series(n=4, days=25)
    d["cls"] = (d.pixel_id % 2).astype(float)
    sd = spark.createDataFrame([(float(c), t, 0.1 + c / 10 + t / 100) for c in (0, 1) for t in range(3, 40)], "cls double, doy int, sd double")
    for squared in (True, False):
        for smooth in (True, False):
            got = ordered(fusion.fuse_by_class(frame(spark, d), "y0", "y1", F.abs("y0") * 0.1 + 0.05, F.lit(0.3), sd, slope=0.9, bias=0.2, squared=squared, smooth=smooth, buckets=2))
            for p, x in d.groupby("pixel_id"):
                up = (lambda v: v * v) if squared else (lambda v: v)
                w = [np.array([[up(0.1 + (p % 2) / 10 + max(t, 3) / 100)]]) for t in doys(x)]
                v = np.column_stack([up(np.abs(x.y0) * 0.1 + 0.05), np.full(len(x), up(0.3))])
                ms, vs = plain(np.column_stack([x.y0, x.y1 - 0.2]), [np.eye(1)] * len(x), w, v, np.array([[1.0], [0.9]]), np.zeros(1), np.eye(1), smooth)
                own = got[got.pixel_id == p]
                assert np.allclose(own["mean"], ms[:, 0]) and np.allclose(own["se"], np.sqrt(vs[:, 0]))


def test_simple_fusion_of_filled_series(spark):
    d = series(n=3, days=25)
    d["r"] = np.where(d.pixel_id == 1, np.nan, 0.2)
    got = ordered(fusion.fuse_rmse_simple(frame(spark, d), "y0", "y1", F.col("r"), 0.05, 0.01, c0=100.0))
    for p, x in d.groupby("pixel_id"):
        t = doys(x)
        y = np.column_stack([np.interp(t, t[x[c].notna()], x[c].dropna()) for c in ("y0", "y1")])
        ms, vs = plain(y, [np.eye(1)] * len(x), [np.eye(1) * 0.01] * len(x), np.tile([0.05, 1e6 if p == 1 else 0.2], (len(x), 1)), np.ones((2, 1)), np.array([y[:, 0].min()]), np.eye(1) * 100)
        own = got[got.pixel_id == p]
        assert np.allclose(own["mean"], ms[:, 0]) and np.allclose(own["se"], np.sqrt(vs[:, 0]))


def test_weekly_fusion(spark):
    d = series(n=3, days=40, bands=4).rename(columns={"y0": "f_u", "y1": "f_v", "y2": "c_u", "y3": "c_v"})
    d.loc[d.pixel_id == 2, "f_v"] = np.nan
    d["rmse_u"], d["rmse_v"] = 0.3, np.where(d.pixel_id == 0, np.nan, 0.4)
    got = ordered(fusion.fuse_weekly(frame(spark, d), ["u", "v"], 0.1, 0.5, 7.0, c0=100.0))
    for p, x in d.groupby("pixel_id"):
        k = x.assign(week=(doys(x) - 1) // 7).groupby("week")[["f_u", "f_v", "c_u", "c_v"]].mean()
        first = [k[c].dropna().iloc[0] if k[c].notna().any() else 7.0 for c in ("f_u", "f_v")]
        v = np.column_stack([(k.f_u.abs() * 0.1) ** 2, (k.f_v.abs() * 0.1) ** 2, np.full(len(k), 0.09), np.full(len(k), 1e12 if p == 0 else 0.16)])
        ms, vs = plain(k.to_numpy(), [np.eye(2)] * len(k), [np.eye(2) * 0.5] * len(k), v, np.vstack([np.eye(2)] * 2), np.array(first), np.eye(2) * 100)
        own = got[got.pixel_id == p]
        assert np.allclose(own[["mean_1", "mean_2"]], ms, atol=1e-6) and np.allclose(own[["variance_1", "variance_2"]], vs, rtol=1e-5)


def test_many_sensors(spark):
    d = series(n=3, days=20, bands=4)
    d.loc[d.pixel_id == 1, "y3"] = np.nan
    w = np.array([[0.1, 0.02], [0.02, 0.2]])
    rmse = [F.lit(0.3), F.lit(None).cast("double"), F.lit(0.5), F.lit(0.6)]
    got = ordered(fusion.fuse_many_sensors(frame(spark, d), [["y0", "y1"], ["y2"], ["y3"]], [[0, 1], [0], [1]], rmse, w, 2.0, c0=100.0))
    ff = np.eye(2)[[0, 1, 0, 1]]
    for p, x in d.groupby("pixel_id"):
        y = x[["y0", "y1", "y2", "y3"]].to_numpy()
        first = [next((v for v in c if v == v), np.nan) for c in y.T]
        m0 = np.array([np.nanmean([first[0], first[2]]), np.nanmean([first[1], first[3]])])
        ms, vs = plain(y, [np.eye(2)] * len(x), [w] * len(x), np.tile([0.09, 4.0, 0.25, 0.36], (len(x), 1)), ff, m0, np.eye(2) * 100)
        own = got[got.pixel_id == p]
        assert np.allclose(own[["mean_1", "mean_2"]], ms, atol=1e-6) and np.allclose(own[["se_1", "se_2"]] ** 2, vs, rtol=1e-5)


def test_flux_years(spark):
    day0, rows = np.datetime64("1999-01-01"), []
    for p in range(4):
        for t in range(365 if p == 1 else 0, 365 * 3 + 1):
            hole = p == 2 and 500 < t < 560 or p == 3 and 365 <= t < 731
            rows.append((p, str(day0 + t), None if hole else float(10 + 8 * np.sin((t - 100) / 365 * 2 * np.pi)), 0.1 + (t % 5) / 10))
    d = spark.createDataFrame([r for r in rows if not (r[0] == 3 and r[2] is None)], "pixel_id long, d string, value double, se double").withColumn("obs_date", F.to_date("d"))
    got = {r["pixel_id"]: r for r in fusion.flux_phenology(d, 2000).collect()}
    assert set(got) == {0, 1}  # a long gap, and no row of the year, are left out
    for r in got.values():
        peak = (np.datetime64("1970-01-01") + r["peak_1"] - day0).astype(int)
        assert r["num_cycles"] == 1 and abs(peak - (365 + 191)) <= 3 and r["evi_amp_1"] == 16 and r["ogi_1"] < r["midgup_1"] < r["peak_1"] < r["midgdown_1"] < r["dor_1"]
    assert fusion.flux_phenology(d, 1999, fake=False, max_span=400).count() == 3
    half = [x.peak_1 for x in fusion.flux_phenology(d, 2000, weight=lambda se: F.lit(1.0)).collect()]
    assert len(half) == 2 and phenology.Params().min_amplitude == 0.1 and isinstance(half[0], (int, np.integer, pd.Int64Dtype.type))
