"""Plans that hold when tables grow."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from verdant.operators import joins, multivariate, statespace
from verdant.plans import QUERIES
from verdant.sources import views as V

SF = "/root/testdata/sf0.01"


def planned(spark, name, d=SF):
    """The plan before any stage has run, where tables over 256 KB are not broadcast."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")
    try:
        return QUERIES[name](spark, d)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_season_is_not_taken_for_small(spark):
    """Spark's estimate of the daily table covers its rows, a number of eight bytes each at least."""
    d = V.season(spark, SF)
    assert int(str(d._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) >= 8 * d.count()


@pytest.mark.parametrize("name", ["a7_assemble_three_years", "e34_flux_phenology"])
def test_daily_tables_are_not_broadcast(spark, name):
    assert "BroadcastHashJoin" not in planned(spark, name)


def test_sizes_of_classes_are_sent_and_not_their_rows(spark, monkeypatch):
    """Without a class of one pixel the changes are computed once, in one shuffle, and the sample sends only a row for each class."""
    s = V.season(spark, SF).withColumns({"a": F.col("evi") / 1e4, "cls": F.col("pixel_id") % 3})
    plan = multivariate.bounded_sample(s, "cls", "pixel_id", 10)._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in plan.split("\n")[1] + plan.split("\n")[0] + plan.split("\n")[2]
    calls = []
    monkeypatch.setattr(multivariate, "daily_differences", lambda *a, f=multivariate.daily_differences: calls.append(out := f(*a)) or out)
    assert multivariate.process_noise_by_class(s, ["a"], "cls").count() == 3 * 364
    assert len(calls) == 1 and "Join" not in calls[0]._jdf.queryExecution().optimizedPlan().toString().split("FlatMapGroups")[0]


def test_pairs_of_boxes_are_not_shuffled(spark):
    """A pair over many bins comes once, a repeated scene twice."""
    s = spark.createDataFrame([(1, -3.0, 9.0, 0.5, 7.0), (2, 4.0, 4.0, 2.0, 2.0), (2, 4.0, 4.0, 2.0, 2.0), (3, 11.0, 12.0, 0.0, 1.0)], "scene int, x0 double, x1 double, y0 double, y1 double")
    t = spark.createDataFrame([(k, 2.0 * (k % 5), 2.0 * (k % 5) + 2, 2.0 * (k // 5), 2.0 * (k // 5) + 2) for k in range(20)], "tile int, tx0 double, tx1 double, ty0 double, ty1 double")
    got = joins.tiles_intersecting(s, t, 2.0)
    over = lambda a, b: a.x0 <= b.tx1 and a.x1 >= b.tx0 and a.y0 <= b.ty1 and a.y1 >= b.ty0
    want = sorted((a.scene, b.tile) for a in s.collect() for b in t.collect() if over(a, b))
    assert sorted((r.scene, r.tile) for r in got.collect()) == want and len(want) > 20
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_no_frame_is_read_anew_for_each_row(spark):
    assert "currentrow$(), unboundedfollowing$()" not in planned(spark, "f8_fuse_rmse_simple", "/root/testdata/sf0.001").lower()


@pytest.mark.parametrize("name", ["f18_leave_one_out", "e26_segment_dates", "e33_segment_amplitude"])
def test_days_are_shuffled_once(spark, name):
    plan = planned(spark, name, "/root/testdata/sf0.001")
    assert plan.count("Exchange hashpartitioning") == 1 and "HashJoin" not in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("name", ["e16_snow_fill_max", "e25_segment_fit_stats"])
def test_joins_of_series_are_merged(spark, name):
    """A hint, as sizes measured on the way may be those of pruned tables."""
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("rightHint=(strategy=merge)") == 2


def test_errors_of_replicates_come_in_few_frames(spark, monkeypatch):
    got = {}
    monkeypatch.setattr(statespace, "by_buckets", lambda df, fn, *a, rows=0, **b: got.update(fn=fn, rows=rows) or df.withColumn("mode", F.lit(0)))
    d = spark.createDataFrame([(1, 1.0, 1.0)], "pixel_id long, a double, b double").withColumn("obs_date", F.lit("2001-01-01").cast("date"))
    statespace.holdout_sweep(d, ["a", "b"], statespace.two_sensor_model(1e-4, 4e-4, 1e-3))
    frames, concat = [], pd.concat
    monkeypatch.setattr(pd, "concat", lambda x, **k: frames.append(len(x)) or concat(x, **k))
    b = pd.DataFrame({"pixel_id": 1, "obs_date": pd.date_range("2001-01-01", periods=60), "a": range(60), "b": 1.0}).astype({"a": float})
    out = got["fn"](b)
    assert len(out) == 2 * 10 * sum(round(60 * q / 10) for q in range(1, 10)) and out["mode"].dtype == "int8"
    assert frames[-1] <= 2 and 0 < got["rows"] < statespace.ROWS
