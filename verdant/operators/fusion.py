"""Several sensors fused into one series: measurements put together, errors and starts as each operator has them, and flux years.

Errors are standard deviations and are squared, unless `squared` is off, which takes them as they are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import date, timedelta

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.views import days
from . import phenology
from .joins import complete_calendar
from .series import interpolate, longest_gap, order, pad_year
from .smoothing import smooth
from .statespace import Model, as_variance, kf_multi, model, two_sensor_model


def fuse_by_class(df: DataFrame, fine: str, coarse: str, fine_error: Column, rmse: Column, class_sd: DataFrame, cls: str = "cls", slope: float = 1.0, bias: float = 0.0, squared: bool = True, smooth: bool = True, key: str = "pixel_id", day: str = "obs_date", buckets: int | None = None) -> DataFrame:
    """(key, day, mean, se) on a daily grid: the noise is that of the class on the day (cls, doy, sd; the first day's for one that is missing), the errors those of the rows; the coarse sensor reads slope x state + bias."""
    sd = class_sd.select(cls, F.col("doy").alias("_doy"), "sd")
    d = df.withColumn("_doy", F.dayofyear(day)).join(sd, [cls, "_doy"], "left").join(sd.groupBy(cls).agg(F.min_by("sd", "_doy").alias("_sd")), cls, "left")
    d = d.withColumns({"_y1": F.col(fine), "_y2": F.col(coarse) - bias})
    noise = as_variance(F.coalesce("sd", "_sd"), squared)
    out = kf_multi(d, ["_y1", "_y2"], two_sensor_model(1.0, 1.0, 1.0, slope), smooth, key, day, buckets, errors=[as_variance(fine_error, squared), as_variance(rmse, squared)], noise=[noise])
    return out.select(key, day, F.col("mean_1").alias("mean"), F.sqrt("variance_1").alias("se"))


def extended(value: str, key: str, day: str) -> Column:
    """Linear over gaps; the ends take the nearest value."""
    w = order(key, day)
    first, last = (f(value, True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) for f in (F.first, F.last))
    before = F.last(value, True).over(w.rowsBetween(Window.unboundedPreceding, 0)).isNull()
    return F.coalesce(interpolate(value, key, day), F.when(before, first).otherwise(last))


def fuse_rmse_simple(df: DataFrame, a: str, b: str, rmse: Column, a_error: float = 0.05, w: float = 1e-3, squared: bool = False, c0: float = 1e6, key: str = "pixel_id", day: str = "obs_date", buckets: int | None = None) -> DataFrame:
    """(key, day, mean, se) of two sensors on a daily grid, both filled linearly first; the second one's error is the pixel's RMSE, 1e6 where there is none, and the state begins at the first sensor's least value."""
    d = df.withColumns({"_a": extended(a, key, day), "_b": extended(b, key, day), "_r": F.coalesce(rmse, F.lit(1e6))})
    d = d.withColumn("_m0", F.min("_a").over(Window.partitionBy(key)))
    m = Model(np.ones((2, 1)), np.eye(1), np.array([[w]]), np.ones(2), np.zeros(1), np.array([[c0]]))
    out = kf_multi(d, ["_a", "_b"], m, True, key, day, buckets, errors=[as_variance(F.lit(a_error), squared), as_variance(F.col("_r"), squared)], first_mean=[F.col("_m0")])
    return out.select(key, day, F.col("mean_1").alias("mean"), F.sqrt("variance_1").alias("se"))


def assemble_measurements(fine: DataFrame, coarse: DataFrame, cells: DataFrame, bands: list[str], land: DataFrame | None = None, default_rmse: float | None = None, key: str = "pixel_id", cell: str = "cell", day: str = "obs_date") -> DataFrame:
    """(key, day, f_.., c_.., rmse_..): each fine pixel's own bands, those of the coarse cell over it, and for each band the RMSE of its days that have both.

    cells: (key, cell). land: (key) of land pixels; others keep their days, with NULLs. A pixel without pairs has the default.
    """
    f = fine.select(key, day, *[F.col(b).alias(f"f_{b}") for b in bands])
    c = coarse.join(cells, cell).select(key, day, *[F.col(b).alias(f"c_{b}") for b in bands])
    d = f.join(c, [key, day], "full")
    off = lambda b: F.col(f"f_{b}") - F.col(f"c_{b}")
    e = d.groupBy(key).agg(*[F.coalesce(F.sqrt(F.avg(off(b) * off(b))), F.lit(default_rmse).cast("double")).alias(f"rmse_{b}") for b in bands])
    d = d.join(e, key)
    if land is not None:
        d = d.join(land.select(key).distinct().withColumn("_land", F.lit(True)), key, "left")
        d = d.select(key, day, *[F.when(F.col("_land"), F.col(x)).alias(x) for x in d.columns if x not in (key, day, "_land")])
    return d


def fuse_weekly(measured: DataFrame, bands: list[str], share: float = 0.05, w: float = 10.0, start: float = 2000.0, squared: bool = True, c0: float = 1e6, key: str = "pixel_id", day: str = "obs_date", buckets: int | None = None) -> DataFrame:
    """(key, day, mean_.., variance_..) by weeks from the first of January, day the first one of each: weekly means of assemble_measurements, fine errors a share of the value, coarse ones the RMSE; each band begins at its first fine value, or at `start`."""
    week = F.date_add(F.trunc(day, "year"), (F.floor((F.dayofyear(day) - 1) / 7) * 7).cast("int"))
    cols = [f"{s}_{b}" for s in "fc" for b in bands]
    d = measured.withColumn(day, week).groupBy(key, day).agg(*[F.avg(c).alias(c) for c in cols], *[F.first(f"rmse_{b}", True).alias(f"rmse_{b}") for b in bands])
    every = order(key, day).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = d.withColumns({f"_m_{b}": F.coalesce(F.first(f"f_{b}", True).over(every), F.lit(start)) for b in bands})
    n = len(bands)
    m = Model(np.vstack([np.eye(n)] * 2), np.eye(n), np.eye(n) * w, np.ones(2 * n), np.zeros(n), np.eye(n) * c0)
    errors = [as_variance(F.abs(f"f_{b}") * share, squared) for b in bands] + [as_variance(F.coalesce(f"rmse_{b}", F.lit(1e6)), squared) for b in bands]
    return kf_multi(d, cols, m, True, key, day, buckets, errors=errors, first_mean=[F.col(f"_m_{b}") for b in bands])


def fuse_many_sensors(df: DataFrame, sensors: list[list[str]], states: list[list[int]], rmse: list[Column], w: float | np.ndarray, default_rmse: float = 100.0, smooth: bool = True, c0: float = 1e6, key: str = "pixel_id", day: str = "obs_date", buckets: int | None = None) -> DataFrame:
    """(key, day, mean_.., se_..): any sensors, each seeing some of the states through its columns; errors are squared RMSEs, a default where one is missing; each state begins at the mean of its sensors' first values, or at 0."""
    cols, seen = [c for s in sensors for c in s], [k for s in states for k in s]
    n = max(seen) + 1
    every = order(key, day).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = df.withColumns({f"_first_{i}": F.first(c, True).over(every).cast("double") for i, c in enumerate(cols)})
    firsts = [F.array_compact(F.array(*[F.col(f"_first_{i}") for i, k in enumerate(seen) if k == state])) for state in range(n)]
    start = [F.coalesce(F.aggregate(a, F.lit(0.0), lambda x, v: x + v) / F.nullif(F.size(a), F.lit(0)), F.lit(0.0)) for a in firsts]
    m = replace(model(n, states), W=np.eye(n) * w if np.isscalar(w) else np.asarray(w, float), C0=np.eye(n) * c0)
    errors = [as_variance(F.coalesce(r, F.lit(float(default_rmse))), True) for r in rmse]
    out = kf_multi(d, cols, m, smooth, key, day, buckets, errors=errors, first_mean=start)
    return out.select(key, day, *[F.col(f"mean_{k}") for k in range(1, n + 1)], *[F.sqrt(f"variance_{k}").alias(f"se_{k}") for k in range(1, n + 1)])


def flux_phenology(df: DataFrame, year: int, weight: Callable[[Column], Column] = lambda se: 1 / (se + 0.1), pad_days: int = 185, fake: bool = True, max_span: int = 45, strength: float = 500.0, p: phenology.Params = phenology.Params(min_amplitude=4.0, scale=1.0), key: str = "pixel_id", day: str = "obs_date") -> DataFrame:
    """The yearly record of daily fluxes (key, day, value, se): a year padded from its neighbours, or at the ends of the record from itself, without gaps over max_span days, smoothed with weights of the standard errors. Missing days have quality 2, padded ones 1. Series with a longer gap or without the year have no row."""
    d = df.select(key, day, F.col("value").cast("double").alias("value"), weight(F.col("se")).cast("double").alias("w")).withColumn("qc", F.lit(0))
    d = pad_year(d.join(d.where(F.year(day) == year).select(key).distinct(), key, "left_semi"), year, pad_days, fake, key, day)
    pad = timedelta(pad_days)
    every = days(d.sparkSession, date(year, 1, 1) - pad, date(year, 12, 31) + pad, day)
    d = complete_calendar(d, every, key, day).withColumns({"w": F.coalesce("w", F.lit(0.0)), "flag": F.when(F.col("value").isNull(), 2).otherwise(F.col("qc"))})
    usable = longest_gap(d, "value", key, day, max_span).where("usable").select(key)
    d = d.join(usable, key, "left_semi")
    s = d.join(smooth(d, "value", strength, weight="w", floored=False, key=key, day=day), [key, day])
    s = s.select(key, day, F.col("smooth").alias("evi"), (F.col("smooth") - F.col("value")).alias("resid"), "flag")
    return phenology.annual(s, f"{year}-01-01", f"{year}-12-31", p, 1.0, key=key, day=day)
