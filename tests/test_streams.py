"""Streams against the batches that they equal: files in any order, a restart between them, late rows, timers."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from verdant.operators import statespace
from verdant.streaming import composite, stateful

T0 = pd.Timestamp("2000-12-01")
SCHEMA = "pixel_id long, ts timestamp, value double, qa double, signal double"


def write(spark, folder, rows, name):
    """One file; files are taken by their time of change."""
    d = spark.createDataFrame([(p, (T0 + pd.Timedelta(days=t)).to_pydatetime(), *v) for p, t, *v in rows], SCHEMA).coalesce(1)
    d.write.mode("append").parquet(f"{folder}/{name}")


def stream(spark, folder, files=1):
    return composite.observations(spark, f"{folder}/*", SCHEMA, files)


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(2)
    return [(p, t, None if r.random() < 0.2 else float(np.sin(t / 20) + r.normal() / 9), float(r.integers(1, 4)), float(r.normal() / 50)) for p in range(3) for t in range(80) if r.random() < 0.8]


def played(spark, tmp_path, rows, make, parts=6):
    """Rows within 10 days of their order over six files; the query ends after three and starts again from its checkpoint."""
    s = stateful.session(spark)
    r = np.random.default_rng(3)
    ordered = sorted(rows, key=lambda x: x[1] + r.uniform(0, 10))
    split = np.array_split(np.arange(len(ordered)), parts)
    files = [[ordered[i] for i in x] for x in split] + [[(99, 400, 0.0, 1.0, 0.0)]]  # the last one lets the watermark pass all others
    out = f"{tmp_path}/out"
    for half in (range(0, 3), range(3, parts + 1)):
        for k in half:
            write(spark, f"{tmp_path}/in", files[k], f"f{k}")
        stateful.run_available(make(stream(s, f"{tmp_path}/in")), f"{tmp_path}/checkpoint", out)
    d = spark.read.parquet(out)
    assert d.select("batch").distinct().count() >= (2 if len(rows) > 50 else 1)
    return d.where("pixel_id <> 99").drop("batch").withColumn("obs_date", F.to_date("ts")).drop("ts")


def batch(spark, rows):
    d = spark.createDataFrame([(p, (T0 + pd.Timedelta(days=t)).to_pydatetime(), *v) for p, t, *v in rows], SCHEMA)
    return d.withColumn("obs_date", F.to_date("ts")).drop("ts")


def same(a, b):
    a, b = (x.select(sorted(x.columns)).toPandas().sort_values(["pixel_id", "obs_date"]).reset_index(drop=True) for x in (a, b))
    pd.testing.assert_frame_equal(a, b, check_dtype=False)


def test_online_quality_filter(spark, tmp_path, rows):
    got = played(spark, tmp_path, rows, lambda d: stateful.online_quality(d, "20 days"))
    same(got, statespace.kf_quality(batch(spark, rows), "value", "qa", "signal"))


def test_online_filter_with_yearly_carry(spark, tmp_path, rows):
    got = played(spark, tmp_path, rows, lambda d: stateful.online_scalar(d, "20 days", 0.02, 0.1))
    same(got, statespace.annual_carry(batch(spark, rows), F.col("value"), 0.02, 0.1))


def test_online_forecast(spark, tmp_path, rows):
    rows = [x for x in rows if x[1] >= 31]  # one season; the filter begins with it, too
    got = played(spark, tmp_path, rows, lambda d: stateful.online_forecast(d, "20 days", 0.3, 0.02, 0.1))
    want = statespace.forecast_phenology(batch(spark, rows), F.col("value"), 0.3, 0.02, 0.1)
    same(got.withColumn("estimate", F.to_date("estimate")), want.drop("error"))


def test_equal_times_count_once(spark, tmp_path):
    rows = [(1, 0, 1.0, 1.0, 0.0), (1, 5, 2.0, 1.0, 0.0), (1, 5, 7.0, 1.0, 0.0), (1, 9, 3.0, 1.0, 0.0)]
    got = played(spark, tmp_path, rows, lambda d: stateful.online_scalar(d, "20 days"), parts=4)
    same(got, statespace.kf_filter(batch(spark, rows).where("NOT (obs_date = '2000-12-06' AND value = 2.0)"), F.col("value")))


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    s = stateful.session(spark)
    day = lambda t: (1, t, 1.0, 1.0, 0.0)
    late = [(1, 0, 9.0, 1.0, 0.0), (1, 1, 9.0, 1.0, 0.0)]
    for k, rows in enumerate([[day(0), day(1)], [day(60)], late, [day(120)]]):
        write(spark, f"{tmp_path}/in", rows, f"f{k}")
        q = stateful.run_available(stateful.online_scalar(stream(s, f"{tmp_path}/in"), "20 days"), f"{tmp_path}/c", f"{tmp_path}/out")
        assert stateful.late_rows(q) == (2 if k == 2 else 0)
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.groupBy("ts").count().where("count > 1").count() == 0 and got.where("mean > 1").count() == 0 and got.count() == 3


def test_alarm_without_a_new_row(spark, tmp_path):
    s = stateful.session(spark)
    make = lambda: stateful.gap_alarm(stream(s, f"{tmp_path}/in"), "1 day", 45)
    for k, rows in enumerate([[(1, 0, 1.0, 1.0, 0.0), (2, 0, 1.0, 1.0, 0.0)], [(2, 30, 1.0, 1.0, 0.0)], [(3, 50, 1.0, 1.0, 0.0)], [(3, 90, 1.0, 1.0, 0.0)]]):
        write(spark, f"{tmp_path}/in", rows, f"f{k}")
        stateful.run_available(make(), f"{tmp_path}/c", f"{tmp_path}/out")
        got = {(r["pixel_id"], (r["alarm_at"] - T0.to_pydatetime()).days) for r in spark.read.schema("pixel_id long, ts timestamp, alarm_at timestamp").parquet(f"{tmp_path}/out").collect()}
        assert got == (set() if k < 2 else {(1, 45)} if k == 2 else {(1, 45), (2, 75)})


def test_versions_supersede(spark, tmp_path):
    s = stateful.session(spark)
    for k, rows in enumerate([[(1, 0, 3.0, 1.0, 0.0)], [(1, 0, 5.0, 1.0, 0.0), (1, 0, 4.0, 1.0, 0.0), (2, 0, 1.0, 1.0, 0.0)], [(1, 0, 2.0, 1.0, 0.0)], [(9, 99, 1.0, 1.0, 0.0)], [(1, 0, 6.0, 1.0, 0.0)]]):
        write(spark, f"{tmp_path}/in", rows, f"f{k}")
        q = stateful.run_available(stateful.latest_versions(stream(s, f"{tmp_path}/in"), "10 days", version="value"), f"{tmp_path}/c", f"{tmp_path}/out")
    assert stateful.late_rows(q) == 1  # version 6 came after the day was closed
    got = [(r["pixel_id"], r["version"], r["action"], r["superseded"]) for r in spark.read.parquet(f"{tmp_path}/out").where("pixel_id < 9").orderBy("batch", "pixel_id", "version").collect()]
    assert got == [(1, 3, "new", None), (1, 4, "superseding", 3), (1, 5, "superseding", 4), (2, 1, "new", None), (1, 2, "stale", None)]


def test_weekly_stream_in_update_mode(spark, tmp_path):
    s = stateful.session(spark)
    r = np.random.default_rng(5)
    rows = [(u, t, float(r.integers(0, 4)), 0.0, 0.0) for u in (1, 2) for t in range(60)]
    make = lambda: composite.weekly(stream(s, f"{tmp_path}/in").withColumnRenamed("pixel_id", "user_id"))
    for k, part in enumerate([rows[:30] + rows[60:90], rows[30:60] + rows[90:], [(1, 200, 1.0, 0.0, 0.0)], [(1, 3, 3.0, 0.0, 0.0)]]):
        write(spark, f"{tmp_path}/in", part, f"f{k}")
        q = stateful.run_available(make(), f"{tmp_path}/c", f"{tmp_path}/out")
    assert stateful.late_rows(q) == 1
    last = spark.read.parquet(f"{tmp_path}/out").groupBy("week", "user_id").agg(F.max_by(F.struct("mean_value", "n"), "batch").alias("x")).select("week", "user_id", "x.*")
    want = composite.weekly(spark.createDataFrame([(p, (T0 + pd.Timedelta(days=t)).to_pydatetime(), v) for p, t, v, *_ in [*rows, (1, 200, 1.0)]], "user_id long, ts timestamp, value double"))
    a, b = (x.toPandas().sort_values(["user_id", "week"]).reset_index(drop=True) for x in (last, want))
    pd.testing.assert_frame_equal(a, b[a.columns])
    assert {"2000-12-30", "2001-01-01"} <= set(a.week.astype(str).str[:10])  # the last week of a year is short
