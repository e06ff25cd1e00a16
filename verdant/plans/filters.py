"""Queries of the state-space filters and smooth curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import cycles, fusion, smoothing, statespace, stats
from ..sources import views as V
from .more import DAILY, GAPPY, gappy
from .queries import OBS, SEASON, query, r6

STEPS = "s AS (SELECT pixel_id, obs_date, row_number() OVER (PARTITION BY pixel_id ORDER BY obs_date) i, CASE WHEN flag=0 THEN evi/1e4 END y FROM season)"
FILTER = """f AS (SELECT pixel_id, obs_date, i, CASE WHEN y IS NULL THEN 0.0 ELSE 1.01/(1.01+0.05)*y END m, CASE WHEN y IS NULL THEN 1.01 ELSE (1-1.01/(1.01+0.05))*1.01 END c, 0.0::DOUBLE mp, 1.01::DOUBLE cp FROM s WHERE i=1
 UNION ALL SELECT s.pixel_id, s.obs_date, s.i, CASE WHEN s.y IS NULL THEN f.m ELSE f.m + (f.c+0.01)/(f.c+0.01+0.05)*(s.y-f.m) END, CASE WHEN s.y IS NULL THEN f.c+0.01 ELSE (1-(f.c+0.01)/(f.c+0.01+0.05))*(f.c+0.01) END, f.m, f.c+0.01 FROM f JOIN s ON s.pixel_id=f.pixel_id AND s.i=f.i+1)"""


def seen() -> Column:
    return F.when(F.col("flag") == 0, F.col("evi") / 1e4)


@query(f"""WITH RECURSIVE {SEASON}, {STEPS}, {FILTER} SELECT pixel_id, obs_date, round(m,6) mean, round(c,6) variance FROM f""")
def f1_f2_kf_filter(spark: SparkSession, d: str) -> DataFrame:
    return statespace.kf_filter(V.season(spark, d), seen()).withColumns({k: r6(F.col(k)) for k in ("mean", "variance")})


@query(f"""WITH RECURSIVE {SEASON}, {STEPS}, {FILTER}, g AS (SELECT pixel_id, obs_date, i, m, c FROM f WHERE i=1095
 UNION ALL SELECT f.pixel_id, f.obs_date, f.i, f.m + f.c/(f.c+0.01)*(g.m-f.m), f.c + pow(f.c/(f.c+0.01),2)*(g.c-(f.c+0.01)) FROM g JOIN f ON f.pixel_id=g.pixel_id AND f.i=g.i-1)
 SELECT pixel_id, obs_date, round(m,6) mean, round(c,6) variance, round(m-1.6448536269514722*sqrt(c),6) low, round(m+1.6448536269514722*sqrt(c),6) high FROM g""")
def f3_f17_kf_smooth_band(spark: SparkSession, d: str) -> DataFrame:
    s = statespace.kf_smooth(V.season(spark, d), seen())
    low, high = X.kf_band(F.col("mean"), F.sqrt("variance"), 0.9)
    return s.withColumns({"low": low, "high": high}).withColumns({k: r6(F.col(k)) for k in ("mean", "variance", "low", "high")})


@query(f"""WITH RECURSIVE {SEASON}, {STEPS}, {FILTER} SELECT pixel_id, obs_date, round(m,6) mean, round(c,6) variance FROM f""")
def f12_annual_carry(spark: SparkSession, d: str) -> DataFrame:
    return statespace.annual_carry(V.season(spark, d), seen(), 0.01, 0.05).withColumns({k: r6(F.col(k)) for k in ("mean", "variance")})


@query()
def f4_f5_f11_multi_state(spark: SparkSession, d: str) -> DataFrame:
    s = V.season(spark, d).withColumns({"y1": seen(), "y2": F.when(F.col("flag") != 1, F.col("evi") / 1e4 + 0.02), "y3": F.when(F.col("flag") == 0, F.col("resid") / 1e3)})
    return statespace.kf_multi(s, ["y1", "y3", "y2"], statespace.model(2, [[0, 1], [0]], w=1e-3, v=0.01), smooth=True)


#: Class and week of each step, and the rate of growth of the class from the week before.
GROWTH = f"""{STEPS}, cw AS (SELECT pixel_id, obs_date, pixel_id % 4 cls, (dayofyear(obs_date) - 1 + 7 - dayofweek(obs_date)) // 7 AS week, evi/1e4 v FROM season),
 wk AS (SELECT cls, week, avg(v) x FROM cw GROUP BY 1, 2), flat AS (SELECT cls, week, CASE WHEN week < 10 THEN max(CASE WHEN week = 10 THEN x END) OVER (PARTITION BY cls) WHEN week > 50 THEN max(CASE WHEN week = 50 THEN x END) OVER (PARTITION BY cls) ELSE x END x FROM wk),
 rates AS (SELECT cls, week, x AS mean, coalesce(lead(x) OVER (PARTITION BY cls ORDER BY week) / x, 1.0) rate FROM flat)"""


def by_class(spark: SparkSession, d: str) -> DataFrame:
    s = V.season(spark, d)
    return s.select("pixel_id", "obs_date", (F.col("pixel_id") % 4).alias("cls"), X.week_of_year("obs_date").alias("week"), (F.col("evi") / 1e4).alias("v"), seen().alias("y"))


@query(f"""WITH {SEASON}, {GROWTH} SELECT cls, CAST(week AS INT) AS week, round(mean, 6) AS mean, round(rate, 6) AS rate FROM rates""")
def d25_class_week_profile(spark: SparkSession, d: str) -> DataFrame:
    out = stats.class_week_profile(by_class(spark, d), "cls", "week", "v")
    return out.select("cls", "week", r6(F.col("mean")).alias("mean"), r6(F.col("rate")).alias("rate"))


@query(f"""WITH RECURSIVE {SEASON}, {GROWTH}, g AS (SELECT s.*, coalesce(r.rate, 1.0) rate FROM s JOIN cw USING (pixel_id, obs_date) LEFT JOIN rates r ON r.cls = cw.cls AND r.week + 1 = cw.week),
 f AS (SELECT pixel_id, i, obs_date, CASE WHEN y IS NULL THEN rate*0.3 ELSE rate*0.3 + (rate*rate+0.05)/(rate*rate+0.05+0.05)*(y - rate*0.3) END m, CASE WHEN y IS NULL THEN rate*rate+0.05 ELSE (1-(rate*rate+0.05)/(rate*rate+0.05+0.05))*(rate*rate+0.05) END c FROM g WHERE i = 1
  UNION ALL SELECT g.pixel_id, g.i, g.obs_date, CASE WHEN g.y IS NULL THEN g.rate*f.m ELSE g.rate*f.m + (g.rate*g.rate*f.c+0.05)/(g.rate*g.rate*f.c+0.05+0.05)*(g.y - g.rate*f.m) END, CASE WHEN g.y IS NULL THEN g.rate*g.rate*f.c+0.05 ELSE (1-(g.rate*g.rate*f.c+0.05)/(g.rate*g.rate*f.c+0.05+0.05))*(g.rate*g.rate*f.c+0.05) END FROM f JOIN g ON g.pixel_id = f.pixel_id AND g.i = f.i + 1)
 SELECT pixel_id, obs_date, round(m, 6) mean, round(c, 6) variance FROM f""")
def f15_kf_class_growth(spark: SparkSession, d: str) -> DataFrame:
    s = by_class(spark, d)
    growth = stats.class_week_profile(s, "cls", "week", "v")
    out = statespace.kf_class_growth(s, F.col("y"), growth, m0=0.3, smooth=False)
    return out.withColumns({k: r6(F.col(k)) for k in ("mean", "variance")})


@query(f"""WITH RECURSIVE {SEASON}, {STEPS}, pr AS (SELECT unnest(range(0, 4)) cluster, unnest([0.001, 0.002, 0.003, 0.004]) q), g AS (SELECT s.*, pixel_id % 4 cluster, 1 + 0.001*(month(obs_date) - 6)*(pixel_id % 4) rate, 0.001*(pixel_id % 4 + 1)*month(obs_date) var, 0.2 + 0.1*(pixel_id % 4) m0, 0.001*(pixel_id % 4 + 1) c0 FROM s),
 f AS (SELECT pixel_id, i, obs_date, CASE WHEN y IS NULL THEN rate*m0 ELSE rate*m0 + (rate*rate*c0+var)/(rate*rate*c0+var+0.01)*(y - rate*m0) END m, CASE WHEN y IS NULL THEN rate*rate*c0+var ELSE (1-(rate*rate*c0+var)/(rate*rate*c0+var+0.01))*(rate*rate*c0+var) END c FROM g WHERE i = 1
  UNION ALL SELECT g.pixel_id, g.i, g.obs_date, CASE WHEN g.y IS NULL THEN g.rate*f.m ELSE g.rate*f.m + (g.rate*g.rate*f.c+var)/(g.rate*g.rate*f.c+var+0.01)*(g.y - g.rate*f.m) END, CASE WHEN g.y IS NULL THEN g.rate*g.rate*f.c+var ELSE (1-(g.rate*g.rate*f.c+var)/(g.rate*g.rate*f.c+var+0.01))*(g.rate*g.rate*f.c+var) END FROM f JOIN g ON g.pixel_id = f.pixel_id AND g.i = f.i + 1)
 SELECT pixel_id, obs_date, round(m, 6) mean, round(c, 6) variance FROM f""")
def f13_kf_by_cluster(spark: SparkSession, d: str) -> DataFrame:
    cluster, month = F.col("pixel_id") % 4, F.month("obs_date")
    s = V.season(spark, d).select("pixel_id", "obs_date", cluster.alias("cluster"), month.alias("step"), seen().alias("y"))
    priors = s.select("cluster", "step").distinct()
    c, t = F.col("cluster"), F.col("step")
    priors = priors.select("cluster", "step", (1 + 0.001 * (t - 6) * c).alias("rate"), (0.001 * (c + 1) * t).alias("var"), (0.2 + 0.1 * c).alias("mean"))
    out = statespace.kf_by_cluster(s, F.col("y"), priors, 0.01, smooth=False)
    return out.withColumns({k: r6(F.col(k)) for k in ("mean", "variance")})


@query(f"""WITH RECURSIVE {SEASON}, q AS (SELECT pixel_id, obs_date, row_number() OVER (PARTITION BY pixel_id ORDER BY obs_date) i, CASE WHEN flag <> 1 THEN evi/1e4 END y, resid/1e4 u, 1 + (pixel_id + evi) % 3 k FROM season),
 v AS (SELECT *, [3.0, 0.5, 0.0][k] * 8 rw, [1.1, 1, 1][k]::DOUBLE c, [0.8, 1, 1][k]::DOUBLE b FROM q),
 f AS (SELECT pixel_id, i, obs_date, 0.0::DOUBLE est, 0.0::DOUBLE x, 5.0::DOUBLE p FROM v WHERE i = 1
  UNION ALL SELECT pixel_id, i, obs_date, est, est + b*u, p - gain*c*p + 0.5 FROM (SELECT v.*, f.p, CASE WHEN y IS NULL THEN 0 ELSE f.p*c/(c*f.p*c+rw) END gain, f.x + CASE WHEN y IS NULL THEN 0 ELSE f.p*c/(c*f.p*c+rw)*(y - c*f.x) END est FROM f JOIN v ON v.pixel_id = f.pixel_id AND v.i = f.i + 1))
 SELECT pixel_id, obs_date, round(est, 6) mean FROM f""")
def f14_kf_quality(spark: SparkSession, d: str) -> DataFrame:
    s = V.season(spark, d).select("pixel_id", "obs_date", F.when(F.col("flag") != 1, F.col("evi") / 1e4).alias("y"), (F.col("resid") / 1e4).alias("u"), (1 + (F.col("pixel_id") + F.col("evi")) % 3).alias("k"))
    return statespace.kf_quality(s, "y", "k", "u").withColumn("mean", r6(F.col("mean")))


def two_sensors(spark: SparkSession, d: str) -> DataFrame:
    """Every ninth day and every fourth day of the season: a sharp sensor and a coarse one."""
    i = F.datediff("obs_date", F.lit("1999-01-01"))
    return V.season(spark, d).select("pixel_id", "obs_date", (F.col("pixel_id") % 4).alias("cls"), F.when(i % 9 == 0, F.col("evi") / 1e4).alias("y1"), F.when(i % 4 == 0, (F.col("evi") + F.col("resid")) / 1e4).alias("y2"), "resid")


@query()
def f7_fuse_multiband(spark: SparkSession, d: str) -> DataFrame:
    s = two_sensors(spark, d)
    fine, coarse = [f"f{k}" for k in range(4)], [f"c{k}" for k in range(4)]
    s = s.select("*", *[(F.col("y1") * (1 + k / 4) + F.col("resid") * k / 1e5).alias(f) for k, f in enumerate(fine)], *[(F.col("y2") * (1 + k / 4)).alias(c) for k, c in enumerate(coarse)])
    diffs = s.select("cls", F.dayofyear("obs_date").alias("doy")).distinct()
    lower = {f"w_{r}{c}": (1e-4 if r == c else 2e-5) * (1 + F.col("cls")) * (1 + F.col("doy") / 365) for c in range(1, 5) for r in range(c, 5)}
    cov = diffs.select("cls", "doy", *[x.alias(k) for k, x in lower.items()])
    return statespace.fuse_multiband(s, fine, coarse, [F.abs(f) * 0.07 for f in fine], [F.lit(0.02)] * 4, cov)


@query()
def f6_fuse_by_class(spark: SparkSession, d: str) -> DataFrame:
    s = two_sensors(spark, d)
    sd = s.select("cls", F.dayofyear("obs_date").alias("doy")).distinct().withColumn("sd", 0.005 * (1 + F.col("cls")) * (1 + F.col("doy") / 365))
    return fusion.fuse_by_class(s, "y1", "y2", F.abs("y1") * 0.07, F.lit(0.03), sd, bias=0.01)


@query()
def f8_fuse_rmse_simple(spark: SparkSession, d: str) -> DataFrame:
    return fusion.fuse_rmse_simple(two_sensors(spark, d), "y1", "y2", F.when(F.col("cls") != 0, F.lit(0.02)))


def fine_and_coarse(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    o = V.obs(spark, d)
    fine = o.where("sensor = 'S1'").groupBy("pixel_id", "obs_date").agg(F.avg("red").alias("red"), F.avg("nir").alias("nir"))
    coarse = o.where("sensor = 'S3'").groupBy((F.col("pixel_id") % 10).alias("cell"), "obs_date").agg(F.avg("red").alias("red"), F.avg("nir").alias("nir"))
    pixels = fine.select("pixel_id").distinct()
    return fine, coarse, pixels.withColumn("cell", F.col("pixel_id") % 10), pixels.where("pixel_id % 4 <> 1")


@query(f"""WITH {OBS}, f AS (SELECT pixel_id, obs_date, avg(red) f_red, avg(nir) f_nir FROM obs WHERE sensor='S1' GROUP BY 1, 2), c AS (SELECT pixel_id % 10 cell, obs_date, avg(red) c_red, avg(nir) c_nir FROM obs WHERE sensor='S3' GROUP BY 1, 2),
 k AS (SELECT DISTINCT pixel_id, pixel_id % 10 cell FROM f), m AS (SELECT k.pixel_id, obs_date, c_red, c_nir FROM c JOIN k USING (cell)), j AS (SELECT * FROM f FULL JOIN m USING (pixel_id, obs_date)), e AS (SELECT pixel_id, coalesce(sqrt(avg((f_red-c_red)*(f_red-c_red))), 100) rmse_red, coalesce(sqrt(avg((f_nir-c_nir)*(f_nir-c_nir))), 100) rmse_nir FROM j GROUP BY 1)
 SELECT pixel_id, obs_date, {', '.join(f"CASE WHEN pixel_id % 4 <> 1 THEN round({c}, 6) END {c}" for c in ('f_red', 'f_nir', 'c_red', 'c_nir', 'rmse_red', 'rmse_nir'))} FROM j JOIN e USING (pixel_id)""")
def f9_assemble_measurements(spark: SparkSession, d: str) -> DataFrame:
    fine, coarse, cells, land = fine_and_coarse(spark, d)
    out = fusion.assemble_measurements(fine, coarse, cells, ["red", "nir"], land, 100.0)
    return out.select("pixel_id", "obs_date", *[r6(F.col(c)).alias(c) for c in out.columns[2:]])


@query()
def f10_fuse_weekly(spark: SparkSession, d: str) -> DataFrame:
    fine, coarse, cells, _ = fine_and_coarse(spark, d)
    return fusion.fuse_weekly(fusion.assemble_measurements(fine, coarse, cells, ["red", "nir"]), ["red", "nir"])


@query()
def f11_fuse_many_sensors(spark: SparkSession, d: str) -> DataFrame:
    s = two_sensors(spark, d).withColumns({"y3": F.col("resid") / 1e3, "y4": F.col("y2") * 0.98})
    return fusion.fuse_many_sensors(s, [["y1", "y3"], ["y2"], ["y4"]], [[0, 1], [0], [0]], [F.lit(0.02), F.lit(None).cast("double"), F.lit(0.03), F.lit(0.05)], 1e-4, 0.1)


@query()
def e34_flux_phenology(spark: SparkSession, d: str) -> DataFrame:
    s = V.season(spark, d).select("pixel_id", "obs_date", F.when(F.col("flag") != 1, (F.col("evi") + F.col("resid")) / 100).alias("value"), (1 + F.col("flag") / 4).alias("se"))
    return fusion.flux_phenology(s, 2000)


FUSED = dict(w=1e-4, v1=4e-4, v2=1e-3)


def fused_model() -> statespace.Model:
    return statespace.two_sensor_model(**FUSED)


def third_year(spark: SparkSession, d: str) -> DataFrame:
    return two_sensors(spark, d).where("year(obs_date) = 2001")


@query()
def f19_holdout_runs(spark: SparkSession, d: str) -> DataFrame:
    return statespace.holdout_runs(third_year(spark, d), ["y1", "y2"], fused_model(), 3)


@query()
def f20_holdout_fraction(spark: SparkSession, d: str) -> DataFrame:
    return statespace.holdout_fraction(third_year(spark, d), ["y1", "y2"], fused_model(), 0.3)


@query()
def f21_holdout_sweep(spark: SparkSession, d: str) -> DataFrame:
    errors = statespace.holdout_sweep(third_year(spark, d), ["y1", "y2"], fused_model())
    return statespace.holdout_rmse(errors, "part", "mode")


@query()
def f22_forecast_phenology(spark: SparkSession, d: str) -> DataFrame:
    return statespace.forecast_phenology(V.season(spark, d).where("year(obs_date) = 2000"), seen(), 0.2, 1e-3, 1e-2, m0=0.2)


@query()
def f16_kf_seasonal(spark: SparkSession, d: str) -> DataFrame:
    weeks = stats.weekly_composite(V.season(spark, d).withColumn("v", seen()), "pixel_id", "obs_date", "v")
    weeks = weeks.select("pixel_id", F.expr("date_add(make_date(yr, 1, 1), 7 * week)").alias("obs_date"), "value")
    return statespace.kf_multi(weeks, ["value"], statespace.seasonal(26, 1, 1e-3, 1e-2), smooth=True).select("pixel_id", "obs_date", "mean_1", "variance_1")


@query()
def f6_f8_fuse_two_sensors(spark: SparkSession, d: str) -> DataFrame:
    s = V.season(spark, d).withColumns({"y1": seen(), "y2": F.when(F.col("flag") != 1, F.col("evi") / 1e4 + 0.02)})
    return statespace.fuse_two_sensors(s, "y1", "y2", 1e-4, 1e-4, 4e-4, bias=0.02)


@query()
def f18_leave_one_out(spark: SparkSession, d: str) -> DataFrame:
    return statespace.leave_one_out_error(V.season(spark, d), seen(), 1e-3, 1e-2)


@query()
def e10_e11_smooth_reject(spark: SparkSession, d: str) -> DataFrame:
    return smoothing.smooth(V.season(spark, d).withColumn("v", seen()), "v", 200.0, q=0.99, iterations=2)


@query()
def e16_snow_fill_max(spark: SparkSession, d: str) -> DataFrame:
    s = V.season(spark, d).withColumn("v", F.when(F.col("flag") != 1, F.col("evi") / 1e4))
    return smoothing.snow_fill_max(s, "v", F.col("flag") == 4)


_ORDER = "list_sort({v})[CAST(greatest(1, round_even(len({v})*0.1, 0)) AS INT)]"


@query(f"""WITH RECURSIVE {OBS}, {DAILY}, {GAPPY}, x AS (SELECT pixel_id, obs_date, year(obs_date) yr, v/1e4 v, (w % 97)/97.0 - 0.505 ndsi FROM gap),
 ys AS (SELECT pixel_id, yr, coalesce(list(v) FILTER (WHERE ndsi < 0 AND v IS NOT NULL), []) vs, row_number() OVER (PARTITION BY pixel_id ORDER BY yr) k FROM x GROUP BY 1, 2),
 near AS (SELECT a.*, coalesce(b.vs, []) ahead FROM ys a LEFT JOIN ys b ON b.pixel_id = a.pixel_id AND b.yr = a.yr + 1),
 f AS (SELECT pixel_id, yr, k, fill, list_transform(vs, lambda v: greatest(v, fill)) raised FROM (SELECT *, CASE WHEN greatest(w, o)/least(w, o) <= 1.25 THEN w ELSE o END fill FROM (SELECT *, {_ORDER.format(v='list_concat(vs, ahead)')} w, {_ORDER.format(v='vs')} o FROM near WHERE k = 1))
  UNION ALL SELECT pixel_id, yr, k, fill, list_transform(vs, lambda v: greatest(v, fill)) FROM (SELECT *, CASE WHEN greatest(w, o)/least(w, o) <= 1.25 THEN w ELSE o END fill FROM (SELECT n.*, {_ORDER.format(v='list_concat(CASE WHEN f.yr = n.yr - 1 THEN f.raised ELSE [] END, n.vs, n.ahead)')} w, {_ORDER.format(v='n.vs')} o FROM f JOIN near n ON n.pixel_id = f.pixel_id AND n.k = f.k + 1)))
 SELECT x.pixel_id, obs_date, round(CASE WHEN ndsi > 0 OR v < fill THEN fill ELSE v END, 6) filled, CAST(CASE WHEN ndsi > 0 THEN 1 WHEN v < fill THEN 2 ELSE 0 END AS INT) flag FROM x JOIN f USING (pixel_id, yr)""")
def e15_snow_filter_multiyear(spark: SparkSession, d: str) -> DataFrame:
    x = gappy(spark, d).select("pixel_id", "obs_date", (F.col("v") / 1e4).alias("v"), (F.col("w") % 97 / 97 - 0.505).alias("ndsi"))
    return smoothing.snow_filter_multiyear(x, "v", "ndsi", 0.1).select("pixel_id", "obs_date", r6(F.col("filled")).alias("filled"), "flag")


@query()
def e17_sharp_smooth(spark: SparkSession, d: str) -> DataFrame:
    return smoothing.sharp_smooth(two_sensors(spark, d), "y1")


@query()
def e18_doy_curve(spark: SparkSession, d: str) -> DataFrame:
    return smoothing.doy_curve(two_sensors(spark, d), "y1")


@query()
def e27_phenology_raw(spark: SparkSession, d: str) -> DataFrame:
    """Bands that give the season's index, every fourth day, under snow where the season has it."""
    s = V.season(spark, d).where(F.datediff("obs_date", F.lit("1999-01-01")) % 4 == 0)
    red, v = F.lit(0.05), (F.col("evi") + F.col("resid")) / 1e4
    nir = (v * (2.4 * red + 1) + 2.5 * red) / (2.5 - v)
    s = s.select("pixel_id", "obs_date", red.alias("red"), F.when(F.col("flag") != 1, nir).alias("nir"), F.when(F.col("flag") == 4, 0.6).otherwise(0.1).alias("green"), F.lit(0.3).alias("swir"))
    return cycles.phenology_raw(s)
