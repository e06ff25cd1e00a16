"""Sources read back what the test wrote; sinks replace only what they are given."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdant.operators import phenology
from verdant.sources import bip, sinks, text


def test_bytes_of_bip_files_come_back(spark, tmp_path):
    r = np.random.default_rng(1)
    want = {}
    for name, lines in (("a", 5), ("b", 3)):
        x = r.integers(-32768, 32768, (lines, 4, 7)).astype("<i2")
        (tmp_path / name).write_bytes(x.tobytes())
        want |= {(name, i, j): x[i, j].tolist() for i in range(lines) for j in range(4)}
    (tmp_path / "a.hdr").write_text("lines = 5")
    d = bip.read_bip(spark, str(tmp_path), nbands=7, samples=4, lines=2)
    assert d.rdd.getNumPartitions() == 3 + 2
    got = {(os.path.basename(x["file"]), x["line"], x["sample"]): x["values"] for x in d.collect()}
    assert got == want
    one = bip.read_bip(spark, f"file://{tmp_path}/b", nbands=7, samples=4)
    s = bip.bip_series(one, "2001-01-01", 1.0, int(want["b", 1, 2][3]), samples=4).where("pixel_id = 7").orderBy("obs_date").collect()
    assert [x["value"] for x in s] == [None if v == want["b", 1, 2][3] else float(v) for v in want["b", 1, 2]] and str(s[6]["obs_date"]) == "2001-01-07"


@pytest.mark.parametrize("dtype", ["<i4", ">i2", "u1"])
def test_other_types_and_batches(spark, tmp_path, monkeypatch, dtype):
    x = np.arange(6 * 5 * 3).reshape(6, 5, 3).astype(dtype)
    (tmp_path / "t").write_bytes(x.tobytes())
    reader = bip.BipReader(str(tmp_path / "t"), 3, dtype, 5, 4)
    monkeypatch.setattr(bip, "BATCH", 16)
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    assert len(batches) == 6 and [v for b in batches for v in b.column(3).to_pylist()] == x.reshape(-1, 3).tolist()


def test_a_torn_file_is_refused_and_an_empty_folder_has_no_rows(spark, tmp_path):
    (tmp_path / "x").mkdir()
    assert bip.read_bip(spark, str(tmp_path / "x"), nbands=2, samples=2).count() == 0
    (tmp_path / "x" / "t").write_bytes(b"123")
    with pytest.raises(Exception, match="no whole lines"):
        bip.read_bip(spark, str(tmp_path / "x"), nbands=2, samples=2).count()


def test_flux_table(spark, tmp_path):
    (tmp_path / "f.csv").write_text("TIMESTAMP,GPP,SE,X\n20010102,1.5,0.1,a\n20010103,-9999,9999,b\n20010104,,0.3,c\nbad,2,0.4,d\n")
    got = [tuple(r) for r in text.read_flux_csv(spark, str(tmp_path / "f.csv"), weight="SE").collect()]
    assert [(str(a), b, c) for a, b, c in got] == [("2001-01-02", 1.5, 0.1), ("2001-01-03", None, None), ("2001-01-04", None, 0.3), ("None", 2.0, 0.4)]
    assert [r["weight"] for r in text.read_flux_csv(spark, str(tmp_path / "f.csv")).collect()] == [1.0] * 4
    assert text.read_flux_csv(spark, str(tmp_path / "f.csv"), value="NEE") is None


def test_site_lists(spark, tmp_path):
    (tmp_path / "s").write_text("Site|Lat|Long|name\n US-1 | 42.5 | -72.2 |x\nUS-2|n/a|1|y\n")
    assert [tuple(r) for r in text.read_sites(spark, str(tmp_path / "s")).collect()] == [("US-1", 42.5, -72.2)]


def test_parameter_files(spark, tmp_path):
    (tmp_path / "p").write_text("# all of it\nmin_amplitude = 0.2 # of a cycle\nmax_rise=250\r\nrel_peak = NA\nscale =\nunknown=7\nmin_amplitude=0.15\nup = 3\n")
    p = text.read_params(spark, str(tmp_path / "p"), phenology.Params(rel_peak=0.3))
    assert p == phenology.Params(min_amplitude=0.15, max_rise=250, rel_peak=None)


def records(spark, rows):
    return spark.createDataFrame(rows, "tile string, year int, pixel_id long, v double").select("tile", "year", "pixel_id", *[F.col("v").alias(f) for f in phenology.FIELDS])


def files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_a_second_write_changes_one_partition(spark, tmp_path):
    path = str(tmp_path / "out")
    sinks.write_metrics(records(spark, [("h1v1", 2000, p, 1.5 + p) for p in range(50)] + [("h1v1", 2001, p, None) for p in range(5)] + [("h2v2", 2000, 1, -3.5)]), path)
    before = files(path)
    sinks.write_metrics(records(spark, [("h1v1", 2001, 9, 7.0)]), path)
    after = files(path)
    changed = {f for f in before.keys() ^ after.keys()}
    assert changed and all("tile=h1v1/year=2001" in f for f in changed) and all(after[f] == t for f, t in before.items() if f in after)
    got = {(r["tile"], r["year"], r["pixel_id"]): r["peak_1"] for r in spark.read.parquet(path).collect()}
    assert got[("h1v1", 2001, 9)] == 7 and len(got) == 52 and ("h1v1", 2001, 0) not in got
    assert got[("h1v1", 2000, 0)] == 2 and got[("h1v1", 2000, 1)] == 2 and got[("h2v2", 2000, 1)] == -4  # half to even
    sinks.write_metrics(records(spark, []), path)
    assert files(path) == after


def test_layers_off_land_hold_the_fill(spark, tmp_path):
    land = spark.createDataFrame([(0, 2), (1, 1)], "pixel_id long, mask int")
    sinks.write_metric_layers(records(spark, [("h1v1", 2000, p, 3.0 if p else None) for p in range(3)]), str(tmp_path / "out"), land)
    d = spark.read.parquet(str(tmp_path / "out"))
    assert d.count() == 3 * 25 and d.where("value <> 32767").count() == 0  # 0: NULL, 1: water, 2: unknown
    sinks.write_metric_layers(records(spark, [("h1v1", 2000, 0, 3.0)]), str(tmp_path / "out"), land)
    d = spark.read.parquet(str(tmp_path / "out"))
    assert {(r["metric"], r["layer"]) for r in d.where("value = 3").collect()} == {("num_cycles", 1)} | {(f[:-2], int(f[-1])) for f in phenology.FIELDS[1:]}


def test_layers_are_scaled(spark, tmp_path):
    d = spark.createDataFrame([("a", 1, 0.25), ("a", 2, None)], "k string, pixel_id long, x double")
    sinks.write_layers(d, str(tmp_path / "out"), ["x"], ["k"], ["pixel_id"], 10, fill=-1)
    assert {(r["pixel_id"], r["x"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(1, 2), (2, -1)}
