"""Each query against its SQL, and the grouped operators against plain Python."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from verdant.operators import phenology, series
from verdant.plans import queries as Q

SF = "/root/testdata/sf0.001"


def rows(df):
    df = df[sorted(df.columns)]
    for c in df:
        if "datetime" in str(df[c].dtype) or df[c].map(lambda v: hasattr(v, "isoformat")).any():
            df[c] = pd.to_datetime(df[c]).dt.strftime("%F %T")
    out = [tuple(None if v is None or v is pd.NA or v != v else round(float(v), 4) if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else str(v) for v in r) for r in df.itertuples(index=False)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want, got = con.execute(Q.ORACLES[name]).df(), Q.QUERIES[name](spark, SF).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    a, b = rows(want), rows(got)
    assert len(a) == len(b) > 0
    assert a == b


def test_peaks_and_segments():
    assert phenology.peaks(np.array([0, 1, 0.0])) == [1]
    assert phenology.peaks(np.array([0, 1, 1, 1, 0.0])) == [2] and phenology.peaks(np.array([1, 1, 0.0, 1])) == []
    x = np.r_[np.linspace(0, 1, 50), np.linspace(0.98, 0, 49)]
    assert phenology.segments(x, phenology.Params()) == [(0, 49, 98)]
    # rises enough but falls too little: it goes, and the higher peak reaches past it
    y = np.array([0, 0.5, 0.45, 1.0, 0.0])
    assert phenology.segments(y, phenology.Params()) == [(0, 3, 4)]


def test_record_order(spark):
    got = Q.QUERIES["e22_annual_phenology"](spark, SF).where("num_cycles > 0 AND pixel_id % 3 <> 0").toPandas()
    d = got[[f"{x}_1" for x in phenology.DATES]].to_numpy(int)
    assert len(got) and (np.diff(d, axis=1) >= 0).all()


def test_smoother_is_surer_than_filter(spark):
    f = Q.QUERIES["f1_f2_kf_filter"](spark, SF).withColumnsRenamed({"mean": "m", "variance": "v"})
    s = Q.QUERIES["f3_f17_kf_smooth_band"](spark, SF)
    assert f.join(s, ["pixel_id", "obs_date"]).where("variance > v + 1e-12").count() == 0


def test_despike_over_nulls(spark):
    """A spike's neighbours are the values next to it, not the NULLs."""
    rows = [(1, d, v) for d, v in enumerate([None, 10.0, None, 1.0, None, None, 10.0, None])]
    got = series.despike(spark.createDataFrame(rows, "pixel_id long, obs_date int, v double"), "v")
    assert [r["obs_date"] for r in got.where("spike").collect()] == [3]


def test_union_of_dates(spark):
    got = Q.QUERIES["h2_union_dates"](spark, SF)
    shared = Q.QUERIES["h2_h3_shared_dates"](spark, SF).select("pixel_id", "obs_date")
    assert got.count() == got.distinct().count() > shared.count() and shared.subtract(got).count() == 0
