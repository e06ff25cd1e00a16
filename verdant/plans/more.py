"""Further queries of the operators, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import joins, multivariate, phenology, robust, series, stats
from ..sources import views as V
from .queries import ANNUAL, OBS, SEASON, SIEGEL, query, r6

GAPPY = "gap AS (SELECT pixel_id, obs_date, CASE WHEN w % 7 <> 0 THEN v END v, w FROM day)"
DAILY = "day AS (SELECT pixel_id, obs_date, max(nir) v, max(swir) w, max(red) r FROM obs GROUP BY 1,2)"


def daily(spark: SparkSession, d: str) -> DataFrame:
    return V.obs(spark, d).groupBy("pixel_id", "obs_date").agg(F.max("nir").alias("v"), F.max("swir").alias("w"), F.max("red").alias("r"))


@query(f"""WITH {SEASON}, y AS (SELECT pixel_id, obs_date, evi FROM season WHERE pixel_id % 10 <> 3 OR year(obs_date) <> 2001), whole AS (SELECT pixel_id FROM y GROUP BY 1 HAVING count(DISTINCT year(obs_date)) = 3)
 SELECT y.pixel_id, y.obs_date, y.evi, s.resid, s.flag FROM y JOIN whole USING (pixel_id) JOIN season s ON s.pixel_id=y.pixel_id AND s.obs_date=y.obs_date""")
def a7_assemble_three_years(spark: SparkSession, d: str) -> DataFrame:
    s = V.season(spark, d)
    return joins.assemble_three_years(s.where("pixel_id % 10 <> 3 OR year(obs_date) <> 2001").select("pixel_id", "obs_date", "evi"), s.select("pixel_id", "obs_date", "resid"), s.select("pixel_id", "obs_date", "flag"), 2000)


@query(f"""WITH {SEASON} SELECT pixel_id, obs_date, evi, flag FROM season""")
def a8_packed_and_long(spark: SparkSession, d: str) -> DataFrame:
    return joins.packed_to_long(joins.long_to_packed(V.season(spark, d), ["evi", "flag"]))


@query(f"""WITH {OBS}, have AS (SELECT DISTINCT pixel_id, sensor FROM obs WHERE obs_date < DATE '1992-06-01'), p AS (SELECT s_suppkey pixel_id, sensor FROM supplier CROSS JOIN (SELECT unnest(['S1','S2','S3']) sensor))
 SELECT p.pixel_id, p.sensor, h.pixel_id IS NOT NULL present FROM p LEFT JOIN have h USING (pixel_id, sensor)""")
def a15_coverage_check(spark: SparkSession, d: str) -> DataFrame:
    sensors = spark.range(1).select(F.explode(F.array(*map(F.lit, ("S1", "S2", "S3")))).alias("sensor"))
    pairs = joins.expand_tasks(V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("pixel_id")), sensors)
    return joins.coverage_check(pairs, V.obs(spark, d).where("obs_date < DATE'1992-06-01'"), ["pixel_id", "sensor"])


@query(f"""WITH {OBS}, {DAILY}, cal AS (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '1995-12-31', INTERVAL 1 DAY)) AS DATE) obs_date), k AS (SELECT DISTINCT pixel_id FROM day)
 SELECT k.pixel_id, c.obs_date, d.v, coalesce(d.w, 0) w FROM k CROSS JOIN cal c LEFT JOIN day d ON d.pixel_id=k.pixel_id AND d.obs_date=c.obs_date""")
def a16_c5_complete_calendar(spark: SparkSession, d: str) -> DataFrame:
    return joins.complete_calendar(daily(spark, d).select("pixel_id", "obs_date", "v", "w"), V.calendar(spark, "1995-01-01", "1995-12-31"), fills={"w": 0})


@query(f"""WITH {OBS} SELECT pixel_id, obs_date, sensor, swir, (qa & 14) = 0 unsaturated, (qa & 189) = 0 AND (qa & 14) = 0 both_clear, (qa & 189) = 0 OR (qa & 14) = 0 either_clear, CASE WHEN qa % 4 IN (1,2) THEN 1 END weight,
 CASE WHEN qa IN (0, 64, 128) THEN nir END good, coalesce(CASE WHEN red NOT IN (0,32767) THEN red END, 32767) filled FROM obs""")
def b5_b9_b10_b12_b14_masks(spark: SparkSession, d: str) -> DataFrame:
    qa = F.col("qa")
    clear, sat = X.pixel_qa_clear(qa), X.radsat_clear(qa, [1, 2, 3])
    return V.obs(spark, d).select("pixel_id", "obs_date", "sensor", "swir", sat.alias("unsaturated"), X.image_mask(clear, sat).alias("both_clear"), X.image_mask(clear, sat, "or").alias("either_clear"), X.qa_weight(qa % 4, {0: 0, 1: 1, 2: 0.5, 3: 0}).alias("weight"), X.apply_mask(F.col("nir"), qa, [0, 64, 128]).alias("good"), X.null_to_fill(X.fill_to_null(F.col("red"), 0, 32767)).alias("filled"))


@query(f"""WITH {OBS}, {DAILY} SELECT pixel_id, obs_date, v FROM day JOIN part ON p_partkey = pixel_id WHERE p_size % 3 = 1""")
def b15_land_only(spark: SparkSession, d: str) -> DataFrame:
    land = V.table(spark, d, "part").where("p_size % 3 = 1").select(F.col("p_partkey").alias("pixel_id"))
    return joins.extract_at_sites(daily(spark, d).select("pixel_id", "obs_date", "v"), land)


@query("""SELECT o_orderkey, CASE WHEN (o_orderkey % 100)/1000.0 <= 0.05 THEN o_custkey * 0.5 END slope, CAST(datediff('day', DATE '2000-01-01', o_orderdate) + 10957 - 1 AS INT) AS days,
 make_date(CAST(year(o_orderdate) AS INT), CASE WHEN o_custkey % 18 < 9 THEN 1 ELSE 7 END, 1) first_day, CASE WHEN o_custkey % 18 < 9 THEN make_date(CAST(year(o_orderdate) AS INT),12,31) ELSE make_date(CAST(year(o_orderdate)+1 AS INT),6,30) END last_day,
 (dayofyear(o_orderdate) + (o_orderkey % 60) * 1.0) / 2 mid FROM orders""")
def b16_b17_b19_b31_dates(spark: SparkSession, d: str) -> DataFrame:
    tile = F.concat(F.lit("h10v"), F.lpad((F.col("o_custkey") % 18).cast("string"), 2, "0"))
    day = F.col("o_orderdate").cast("date")
    first, last = X.phenology_year(tile, F.year(day))
    return V.table(spark, d, "orders").select("o_orderkey", X.significant_slope(F.col("o_custkey") * 0.5, F.col("o_orderkey") % 100 / 1000).alias("slope"), X.epoch2000_to_1970(F.datediff(day, F.lit("2000-01-01").cast("date"))).alias("days"), first.alias("first_day"), last.alias("last_day"), X.mid_phase(F.dayofyear(day), F.col("o_orderkey") % 60).alias("mid"))


@query("""SELECT l_orderkey, l_linenumber, 'h' || lpad(CAST(CAST(least(greatest(floor((x + 20015109.354)/1111950.5197),0),35) AS INT) AS VARCHAR),2,'0') || 'v' || lpad(CAST(CAST(least(greatest(floor((10007554.677 - y)/1111950.5197),0),17) AS INT) AS VARCHAR),2,'0') tile,
 (l_linenumber - 1)*2400 + l_partkey cell, round((l_orderkey % 36)*1111950.5197 - 20015109.354, 2) ox, round(10007554.677 - (l_linenumber % 18)*1111950.5197, 2) oy
 FROM (SELECT *, (l_orderkey % 4000)*10000.0 - 20000000 x, (l_partkey % 2100)*10000.0 - 10500000 y FROM lineitem)""")
def b21_b22_tiles_and_cells(spark: SparkSession, d: str) -> DataFrame:
    x, y = F.col("l_orderkey") % 4000 * 10000.0 - 20000000, F.col("l_partkey") % 2100 * 10000.0 - 10500000
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    ox, oy = X.tile_origin(F.concat(F.lit("h"), two(F.col("l_orderkey") % 36), F.lit("v"), two(F.col("l_linenumber") % 18)))
    return V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.tile_of(x, y).alias("tile"), X.cell_number(F.col("l_linenumber"), F.col("l_partkey"), 2400).alias("cell"), F.round(ox, 2).alias("ox"), F.round(oy, 2).alias("oy"))


@query("""SELECT l_orderkey, l_linenumber, name, coalesce(CAST(round_even(v * CASE WHEN name IN ('evi_min','evi_amp') THEN 10000.0 WHEN name='evi_area' THEN 10.0 ELSE 1.0 END, 0) AS INT), 32767) AS value,
 round(CASE name WHEN 'evi_min' THEN v*0.07 WHEN 'evi_amp' THEN v*0.05 END, 6) AS err
 FROM (SELECT *, CASE WHEN l_quantity > 10 THEN CAST(l_quantity AS DOUBLE)/7 END v, CASE l_linenumber % 4 WHEN 0 THEN 'evi_min' WHEN 1 THEN 'evi_amp' WHEN 2 THEN 'evi_area' ELSE 'peak' END AS name FROM lineitem)""")
def b26_b28_scaling_and_errors(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_linenumber") % 4
    t = V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(k == 0, "evi_min").when(k == 1, "evi_amp").when(k == 2, "evi_area").otherwise("peak").alias("name"), F.when(F.col("l_quantity") > 10, F.col("l_quantity").cast("double") / 7).alias("v"))
    return t.select("l_orderkey", "l_linenumber", "name", X.scale_metrics(F.col("v"), F.col("name")).alias("value"), r6(X.sensor_error(F.col("v"), F.col("name"), {"evi_min": 0.07, "evi_amp": 0.05})).alias("err"))


@query(f"""WITH {OBS}, x AS (SELECT pixel_id, obs_date, sensor, swir, nir, nir - 2500 v FROM obs), q AS (SELECT pixel_id, quantile_cont(v, 0.05) q FROM x WHERE v >= 0 GROUP BY 1)
 SELECT x.pixel_id, obs_date, sensor, swir, nir, round(CASE WHEN v < 0 THEN q ELSE v END, 6) low FROM x LEFT JOIN q USING (pixel_id)""")
def b32_low_value_replace(spark: SparkSession, d: str) -> DataFrame:
    x = V.obs(spark, d).select("pixel_id", "obs_date", "sensor", "swir", "nir", (F.col("nir") - 2500).alias("v"))
    return stats.low_value_replace(x, ["pixel_id"], "v").select("pixel_id", "obs_date", "sensor", "swir", "nir", r6(F.col("v")).alias("low"))


@query("""SELECT p_partkey, CAST(p_size*2 + i AS INT) AS row, CAST((p_partkey % 100)*2 + j AS BIGINT) col FROM part, (SELECT unnest([0,1]) i), (SELECT unnest([0,1]) j)""")
def c4_disaggregate(spark: SparkSession, d: str) -> DataFrame:
    p = V.table(spark, d, "part").select("p_partkey", F.col("p_size").cast("int").alias("row"), (F.col("p_partkey") % 100).cast("long").alias("col"))
    return joins.disaggregate(p)


@query(f"""WITH {OBS}, a AS (SELECT pixel_id, obs_date, max(nir) x FROM obs WHERE sensor='S1' GROUP BY 1,2), b AS (SELECT pixel_id, obs_date, max(nir) y FROM obs WHERE sensor='S3' GROUP BY 1,2)
 SELECT pixel_id, obs_date, x, y, x-y difference FROM a JOIN b USING (pixel_id, obs_date)""")
def c7_c8_compare_products(spark: SparkSession, d: str) -> DataFrame:
    o = V.obs(spark, d)
    a, b = (o.where(F.col("sensor") == s).groupBy("pixel_id", "obs_date").agg(F.max("nir").alias("v")) for s in ("S1", "S3"))
    return joins.compare_products(a, b, ["pixel_id", "obs_date"], "v")


@query("""SELECT s_suppkey pixel_id, s_nationkey AS class, r_name prior FROM supplier LEFT JOIN (SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 5 <> 2) ON n_nationkey = s_nationkey""")
def c9_class_params(spark: SparkSession, d: str) -> DataFrame:
    n = V.table(spark, d, "nation").where("n_nationkey % 5 <> 2").join(V.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("class"), F.col("r_name").alias("prior"))
    return joins.class_params_join(V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("pixel_id"), F.col("s_nationkey").alias("class")), n).select("pixel_id", "class", "prior")


@query(f"""WITH {OBS} SELECT pixel_id, obs_date, sensor, nir FROM obs WHERE pixel_id IN (SELECT o_custkey FROM orders WHERE o_orderkey % 50 = 0)""")
def c10_extract_at_sites(spark: SparkSession, d: str) -> DataFrame:
    sites = V.table(spark, d, "orders").where("o_orderkey % 50 = 0").select(F.col("o_custkey").alias("pixel_id"))
    return joins.extract_at_sites(V.obs(spark, d).select("pixel_id", "obs_date", "sensor", "nir"), sites)


@query("""WITH s AS (SELECT c_custkey scene, (c_custkey % 97)*1.0 x0, (c_custkey % 97)+1.5 x1, (c_custkey % 53)*1.0 y0, (c_custkey % 53)+1.5 y1 FROM customer), t AS (SELECT s_suppkey tile, (s_suppkey % 40)*2.0 tx0, (s_suppkey % 40)*2.0+2 tx1, (s_suppkey % 25)*2.0 ty0, (s_suppkey % 25)*2.0+2 ty1 FROM supplier)
 SELECT scene, tile FROM s JOIN t ON x0 <= tx1 AND x1 >= tx0 AND y0 <= ty1 AND y1 >= ty0""")
def c11_tiles_intersecting(spark: SparkSession, d: str) -> DataFrame:
    c = V.table(spark, d, "customer").selectExpr("c_custkey scene", "c_custkey % 97 * 1D x0", "c_custkey % 97 + 1.5D x1", "c_custkey % 53 * 1D y0", "c_custkey % 53 + 1.5D y1")
    t = V.table(spark, d, "supplier").selectExpr("s_suppkey tile", "s_suppkey % 40 * 2D tx0", "s_suppkey % 40 * 2D + 2 tx1", "s_suppkey % 25 * 2D ty0", "s_suppkey % 25 * 2D + 2 ty1")
    return joins.tiles_intersecting(c, t, 2.0).select("scene", "tile")


MAD = "m AS (SELECT pixel_id, median(doy0) med FROM h GROUP BY 1), a AS (SELECT pixel_id, med, 1.4826*median(abs(doy0-med)) mad FROM h JOIN m USING (pixel_id) GROUP BY 1,2)"


@query(f"""WITH {ANNUAL}, h AS (SELECT * FROM annual WHERE yr BETWEEN 1992 AND 1996), {MAD} SELECT pixel_id, round(doy0-med,6) anomaly, round((doy0-med)/nullif(mad,0),6) z FROM annual JOIN a USING (pixel_id) WHERE yr = 1997""")
def d4_target_year_anomaly(spark: SparkSession, d: str) -> DataFrame:
    return stats.target_year_anomaly(V.annual(spark, d), "pixel_id", "yr", "doy0", 1997, 1992, 1996).select("pixel_id", r6(F.col("anomaly")).alias("anomaly"), r6(F.col("z")).alias("z"))


@query("""WITH x AS (SELECT floor(CAST(o_totalprice AS DOUBLE)/10000)*10000+5000 centre, CAST(dayofyear(o_orderdate) AS DOUBLE) v FROM orders), m AS (SELECT centre, median(v) med, count(v) n FROM x GROUP BY 1)
 SELECT centre, round(med,6) med, round(1.4826*median(abs(v-med)),6) mad, n FROM x JOIN m USING (centre) GROUP BY centre, med, n""")
def d5_d6_band_profile(spark: SparkSession, d: str) -> DataFrame:
    o = V.table(spark, d, "orders").select(F.col("o_totalprice").cast("double").alias("lat"), F.dayofyear("o_orderdate").cast("double").alias("v"))
    return stats.band_profile(o, "lat", "v", 10000.0).select("centre", r6(F.col("med")).alias("med"), r6(F.col("mad")).alias("mad"), "n")


@query(f"""WITH {OBS}, s AS (SELECT pixel_id, list_sort(list(nir)) s, count(nir) n FROM obs GROUP BY 1) SELECT pixel_id, s[CAST(greatest(1, round_even(n*0.05, 0)) AS INT)] q05, s[CAST(greatest(1, round_even(n*0.5, 0)) AS INT)] q50 FROM s""")
def d8_quantile_type3(spark: SparkSession, d: str) -> DataFrame:
    return V.obs(spark, d).groupBy("pixel_id").agg(stats.quantile_type3("nir", 0.05).alias("q05"), stats.quantile_type3("nir", 0.5).alias("q50"))


#: Ground observations with the days around the phase, some of them missing, and a metric.
AROUND = "around AS (SELECT o_custkey % 200 site_id, year(o_orderdate) obs_year, o_orderpriority phase, CAST(dayofyear(o_orderdate) AS INT) first_yes, CAST(dayofyear(o_orderdate) + o_orderkey % 60 AS INT) last_yes, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(dayofyear(o_orderdate) - o_custkey % 9 - 1 AS INT) END last_no, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(dayofyear(o_orderdate) + o_orderkey % 60 + o_custkey % 7 + 1 AS INT) END first_no, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_totalprice AS DOUBLE) END metric FROM orders)"
SITE_FILTERS = ["phase <> '1-URGENT'", "first_yes > 20"]


def around(spark: SparkSession, d: str) -> DataFrame:
    o, doy, k, c = V.table(spark, d, "orders"), F.dayofyear("o_orderdate"), F.col("o_orderkey"), F.col("o_custkey")
    return o.select(
        (c % 200).alias("site_id"), F.year("o_orderdate").alias("obs_year"), F.col("o_orderpriority").alias("phase"), doy.alias("first_yes"), (doy + k % 60).cast("int").alias("last_yes"),
        F.when(k % 5 != 0, (doy - c % 9 - 1).cast("int")).alias("last_no"), F.when(k % 3 != 0, (doy + k % 60 + c % 7 + 1).cast("int")).alias("first_no"), F.when(k % 7 != 0, F.col("o_totalprice").cast("double")).alias("metric"))


def site_sql(seen: str, other: str) -> str:
    return f"""WITH {AROUND} SELECT site_id, obs_year, min(phase) phase, CAST(median({seen}) AS DOUBLE) AS day, CAST(median({other}) AS DOUBLE) AS other, median(first_yes + (last_yes - first_yes)/2.0) midpoint, round(var_samp({seen}),6) variance, CAST(median({seen} - {other}) AS DOUBLE) lag, round(median(metric),6) AS value
 FROM around WHERE phase <> '1-URGENT' AND first_yes > 20 AND last_yes - first_yes >= 10 GROUP BY 1,2"""


@query(site_sql("first_yes", "last_no"))
def d9_ground_site_year(spark: SparkSession, d: str) -> DataFrame:
    return stats.ground_site_year(around(spark, d), SITE_FILTERS, 10, "metric", first_cols=("phase",)).withColumns({c: r6(F.col(c)) for c in ("variance", "value")})


@query(site_sql("last_yes", "first_no"))
def d9_ground_site_year_last(spark: SparkSession, d: str) -> DataFrame:
    return stats.ground_site_year(around(spark, d), SITE_FILTERS, 10, "metric", last=True, first_cols=("phase",)).withColumns({c: r6(F.col(c)) for c in ("variance", "value")})


@query(f"""WITH {AROUND} SELECT * FROM (SELECT 0 step, count(*) n FROM around UNION ALL SELECT 1, count(*) FILTER (WHERE phase <> '1-URGENT') FROM around UNION ALL SELECT 2, count(*) FILTER (WHERE phase <> '1-URGENT' AND first_yes > 20) FROM around)""")
def d9_j2_dropped_rows(spark: SparkSession, d: str) -> DataFrame:
    return stats.filter_steps(around(spark, d), SITE_FILTERS)


@query("""SELECT floor(CAST(o_totalprice AS DOUBLE)/10000)*10000+5000 centre, round(median(z),6) z, count(*) n FROM (SELECT *, (dayofyear(o_orderdate) - 180)/(1.0 + o_custkey % 9) z FROM orders) WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1""")
def d5_anomaly_by_latitude(spark: SparkSession, d: str) -> DataFrame:
    o = V.table(spark, d, "orders").select(F.col("o_totalprice").cast("double").alias("lat"), "o_orderpriority", ((F.dayofyear("o_orderdate") - 180) / (1 + F.col("o_custkey") % 9)).alias("z"))
    return stats.anomaly_by_latitude(o, "lat", "z", "o_orderpriority", ["1-URGENT", "2-HIGH"], 10000.0).withColumn("z", r6(F.col("z")))


@query(f"""WITH {OBS}, {DAILY}, x AS (SELECT v - w AS dd FROM day), h AS (SELECT len(list_filter([-500.0, 0, 500, 1000, 2000, 4000], lambda b: b <= dd)) bin, count(*) n FROM x GROUP BY 1)
 SELECT CAST(bin AS INT) bin, n, round(n/sum(n) OVER (), 6) AS share, round((SELECT avg(dd) FROM x), 6) mean FROM h""")
def d36_difference_stats(spark: SparkSession, d: str) -> DataFrame:
    out = stats.difference_stats(daily(spark, d), "v", "w", [-500.0, 0.0, 500.0, 1000.0, 2000.0, 4000.0])
    return out.withColumns({"share": r6(F.col("share")), "mean": r6(F.col("mean"))})


@query(f"""WITH {AROUND}, y AS (SELECT site_id, obs_year, median(last_yes - first_yes) gsl FROM around GROUP BY 1, 2), m AS (SELECT site_id, median(gsl) med FROM y GROUP BY 1)
 SELECT site_id, round_even(med, 0) med, round(1.4826*median(abs(gsl-med)),6) mad, round_even(avg(gsl), 0) mean, round(stddev_samp(gsl),6) sd, count(*) n FROM y JOIN m USING (site_id) GROUP BY 1, med""")
def d38_growing_season_length(spark: SparkSession, d: str) -> DataFrame:
    g = stats.growing_season_length(around(spark, d), "first_yes", "last_yes").groupBy("site_id", "obs_year").agg(F.median("gsl").alias("gsl"))
    return robust.climate_normals(g, "site_id", "obs_year", "gsl").drop("p", "slope").withColumns({c: r6(F.col(c)) for c in ("mad", "sd")})


@query(f"""WITH {OBS}, s AS (SELECT pixel_id, count(*)::DOUBLE c, sum(w) sw, sum(w*red) sx, sum(w*nir) sy, sum(w*red*red) sxx, sum(w*red*nir) sxy, sum(w*nir*nir) syy FROM (SELECT pixel_id, red::DOUBLE red, nir::DOUBLE nir, swir::DOUBLE w FROM obs) GROUP BY 1)
 SELECT pixel_id, round((sw*sxy-sx*sy)/nullif(sw*sxx-sx*sx,0),6) slope, round((sy-(sw*sxy-sx*sy)/nullif(sw*sxx-sx*sx,0)*sx)/sw,4) intercept, round(pow(sw*sxy-sx*sy,2)/nullif((sw*sxx-sx*sx)*(sw*syy-sy*sy),0),6) r2 FROM s""")
def d11_weighted_ols(spark: SparkSession, d: str) -> DataFrame:
    o = V.obs(spark, d).select("pixel_id", *[F.col(c).cast("double").alias(c) for c in ("red", "nir", "swir")])
    return stats.weighted_ols(o, "pixel_id", "nir", "red", "swir").select("pixel_id", r6(F.col("slope")).alias("slope"), F.round("intercept", 4).alias("intercept"), r6(F.col("r2")).alias("r2"))


_RANKS = "round({a}[CAST(round_even(n/2.0 - 1.96*sqrt(n)/2, 0) AS INT)], 6) {k}_low, round({a}[CAST(round_even(1 + n/2.0 + 1.96*sqrt(n)/2, 0) AS INT)], 6) {k}_high"


@query(f"""WITH {ANNUAL}, {SIEGEL}, l AS (SELECT pixel_id, list_sort(list(s)) ss, list_sort(list(t)) ts, count(*) n, median(s) slope, median(t) intercept FROM p GROUP BY 1)
 SELECT pixel_id, round(slope, 6) slope, round(intercept, 5) intercept, {_RANKS.format(a='ss', k='slope')}, {_RANKS.format(a='ts', k='intercept').replace(', 6)', ', 5)')} FROM l""")
def d14_slope_rank_interval(spark: SparkSession, d: str) -> DataFrame:
    out = robust.slope_rank_interval(V.annual(spark, d), "pixel_id", "yr", "doy0")
    return out.select("pixel_id", *[F.round(c, 5 if "inter" in c else 6).alias(c) for c in out.columns[1:]])


@query()
def d11_ols_interval(spark: SparkSession, d: str) -> DataFrame:
    return robust.ols_interval(V.obs(spark, d), "pixel_id", "nir", "red", "swir")


@query("""WITH x AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size END a, CASE WHEN p_size % 5 = 0 THEN p_retailprice END b, CASE WHEN p_size % 3 = 0 THEN p_size END c FROM part)
 SELECT count(*) records, count(*) FILTER (WHERE a IS NOT NULL OR b IS NOT NULL) with_first, count(*) FILTER (WHERE c IS NOT NULL) with_second, count(*) FILTER (WHERE a IS NOT NULL OR b IS NOT NULL) + count(*) FILTER (WHERE c IS NOT NULL) cycles FROM x""")
def d31_cycle_counts(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_size")
    x = V.table(spark, d, "part").select(F.when(n % 2 == 0, n).alias("a"), F.when(n % 5 == 0, F.col("p_retailprice")).alias("b"), F.when(n % 3 == 0, n).alias("c"))
    return stats.cycle_counts(x, ["a", "b"], ["c"])


@query()
def d37_pca(spark: SparkSession, d: str) -> DataFrame:
    """Components of four yearly metrics of all pixels, applied year by year, and the trend of each."""
    o, c = V.table(spark, d, "orders"), V.table(spark, d, "customer")
    y = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_custkey").alias("pixel_id"), F.year("o_orderdate").alias("yr"))
    y = y.agg(F.median(F.dayofyear("o_orderdate")).alias("a"), F.avg("o_totalprice").cast("double").alias("b"), F.count("*").alias("n"), F.max(F.dayofyear("o_orderdate")).alias("z"))
    m = multivariate.pca_fit(y, ["a", "b", "n", "z"], 3)
    p = multivariate.pca_transform(y, m)
    out = None
    for k in (1, 2, 3):
        s = robust.theil_sen(p, "pixel_id", "yr", f"pc_{k}").select("pixel_id", F.col("slope").alias(f"slope_{k}"))
        out = s if out is None else out.join(s, "pixel_id", "full")
    return out


@query()
def d22_process_noise(spark: SparkSession, d: str) -> DataFrame:
    s = V.season(spark, d).withColumns({"a": F.when(F.col("flag") == 0, F.col("evi") / 1e4), "b": F.when(F.col("flag") == 0, (F.col("evi") + 3 * F.col("resid")) / 1e4), "cls": F.col("pixel_id") % 3})
    return multivariate.process_noise_by_class(s, ["a", "b"], "cls", strength=500.0)


@query()
def d17_spline_rmse(spark: SparkSession, d: str) -> DataFrame:
    o = V.obs(spark, d).where("snow = 0")
    return multivariate.spline_rmse(o.where("sensor = 'S1'"), o.where("sensor = 'S3'"), "nir", 1e4)


@query()
def d21_f23_smooth_covariance(spark: SparkSession, d: str) -> DataFrame:
    o = V.obs(spark, d).where("sensor <> 'S2'")
    cov = stats.band_covariance(o, ["obs_date", "sensor"], ["red", "nir"])
    return multivariate.smooth_covariance(cov, ["cov_red_red", "cov_red_nir", "cov_nir_nir"], 1e4, True)


@query(f"""WITH {OBS}, a AS (SELECT pixel_id, obs_date, avg(nir) x FROM obs WHERE sensor='S1' AND (qa & 1)=0 GROUP BY 1,2), b AS (SELECT pixel_id, obs_date other, avg(nir) y FROM obs WHERE sensor='S3' AND (qa & 1)=0 GROUP BY 1,2),
 j AS (SELECT a.pixel_id, a.obs_date, x, y, row_number() OVER (PARTITION BY a.pixel_id, a.obs_date ORDER BY abs(other-a.obs_date), other) k FROM a JOIN b ON a.pixel_id=b.pixel_id AND abs(other-a.obs_date)<=4)
 SELECT s_suppkey pixel_id, round(coalesce(sqrt(avg(pow(x-y,2))), 100),6) rmse FROM supplier LEFT JOIN j ON j.pixel_id=s_suppkey AND k=1 GROUP BY 1""")
def d16_sensor_rmse(spark: SparkSession, d: str) -> DataFrame:
    o = V.obs(spark, d).where(X.bits(F.col("qa"), 0) == 0)
    a, b = (o.where(F.col("sensor") == s).groupBy("pixel_id", "obs_date").agg(F.avg("nir").alias("v")) for s in ("S1", "S3"))
    pixels = V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("pixel_id"))
    return stats.sensor_rmse(pixels, a, b, "v", 4, 100.0).select("pixel_id", r6(F.col("rmse")).alias("rmse"))


TUKEY = "q AS (SELECT pixel_id, quantile_cont(red,0.25) ra, quantile_cont(red,0.75) rb, quantile_cont(nir,0.25) na, quantile_cont(nir,0.75) nb FROM obs GROUP BY 1)"


@query(f"""WITH {OBS}, {TUKEY} SELECT pixel_id, round(covar_samp(red,nir),4) cov, round(corr(red,nir),6) cor, round(covar_samp(red,red),4) var FROM obs JOIN q USING (pixel_id) WHERE red BETWEEN ra-0.25*(rb-ra) AND rb+0.25*(rb-ra) AND nir BETWEEN na-0.25*(nb-na) AND nb+0.25*(nb-na) GROUP BY 1""")
def d20_tukey_cov(spark: SparkSession, d: str) -> DataFrame:
    return stats.tukey_cov(V.obs(spark, d), ["pixel_id"], ["red", "nir"], 0.25).select("pixel_id", F.round("cov_red_nir", 4).alias("cov"), r6(F.col("cor_red_nir")).alias("cor"), F.round("cov_red_red", 4).alias("var"))


@query(f"""WITH {OBS} SELECT obs_date, round(covar_samp(red,nir),4) cov, round(corr(red,nir),6) cor FROM obs GROUP BY 1 HAVING count(*) > 5""")
def d21_band_covariance_by_date(spark: SparkSession, d: str) -> DataFrame:
    o = V.obs(spark, d)
    many = o.groupBy("obs_date").count().where("count > 5").select("obs_date")
    return stats.band_covariance(o.join(many, "obs_date", "left_semi"), ["obs_date"], ["red", "nir"]).select("obs_date", F.round("cov_red_nir", 4).alias("cov"), r6(F.col("cor_red_nir")).alias("cor"))


@query(f"""WITH {OBS} SELECT pixel_id, year(obs_date) yr, CAST(floor((dayofyear(obs_date)-1)/7.0) AS INT) AS week, round(avg(red),6) value, count(*) n FROM obs WHERE red <> 0 GROUP BY 1,2,3""")
def d23_weekly_composite(spark: SparkSession, d: str) -> DataFrame:
    return stats.weekly_composite(V.obs(spark, d), "pixel_id", "obs_date", "red").withColumn("value", r6(F.col("value")))


@query(f"""WITH {OBS} SELECT pixel_id, sensor, year(obs_date) yr, CAST(floor((dayofyear(obs_date)-1)/7.0) AS INT) AS week, round(median(nir),6) value, count(*) n FROM obs WHERE nir <> 0 GROUP BY 1,2,3,4""")
def d24_j3_bin_observations(spark: SparkSession, d: str) -> DataFrame:
    o = V.obs(spark, d).withColumn("k", F.struct("pixel_id", "sensor"))
    return stats.weekly_composite(o, "k", "obs_date", "nir", "median").select("k.*", "yr", "week", r6(F.col("value")).alias("value"), "n")


@query(f"""WITH {OBS}, w AS (SELECT CAST(floor((dayofyear(obs_date)-1)/7.0) AS INT) AS week, avg(nir) m, var_samp(nir) v FROM obs GROUP BY 1) SELECT week, round(m,6) mean, round(v,4) variance, round(coalesce(lead(m) OVER (ORDER BY week)/m, 1),6) rate FROM w""")
def d26_population_prior(spark: SparkSession, d: str) -> DataFrame:
    o = V.obs(spark, d).withColumn("week", F.floor((F.dayofyear("obs_date") - 1) / 7).cast("int"))
    return stats.population_prior(o, "week", "nir").select("week", r6(F.col("mean")).alias("mean"), F.round("variance", 4).alias("variance"), r6(F.col("rate")).alias("rate"))


@query("""SELECT p_type, count(*) n, round(count(*)/sum(count(*)) OVER (), 6) share FROM part GROUP BY 1 QUALIFY count(*)/sum(count(*)) OVER () >= 0.007""")
def d27_class_shares(spark: SparkSession, d: str) -> DataFrame:
    return stats.class_shares(V.table(spark, d, "part"), "p_type", 0.007).withColumn("share", r6(F.col("share")))


@query("""SELECT c_mktsegment, least(CAST(round_even(200.0*count(*)/sum(count(*)) OVER (), 0) AS BIGINT), count(*)) n, (SELECT least(count(*), 50) FROM customer) total FROM customer GROUP BY 1""")
def d28_d29_samples(spark: SparkSession, d: str) -> DataFrame:
    c = V.table(spark, d, "customer")
    total = stats.random_sample(c, "c_custkey", 50).agg(F.count("*").alias("total"))
    return stats.stratified_sample(c, "c_mktsegment", "c_custkey", 200).groupBy("c_mktsegment").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total))  # one row


@query(f"""WITH {OBS} SELECT round(avg(CASE WHEN red IN (0) THEN 1.0 ELSE 0 END),6) red, round(avg(CASE WHEN nir > 4000 THEN 1.0 ELSE 0 END),6) nir FROM obs""")
def d30_missing_fraction(spark: SparkSession, d: str) -> DataFrame:
    o = V.obs(spark, d).select(X.fill_to_null(F.col("red"), 0).alias("red"), F.when(F.col("nir") <= 4000, F.col("nir")).alias("nir"))
    return stats.missing_fraction(o, ["red", "nir"]).select(r6(F.col("red")).alias("red"), r6(F.col("nir")).alias("nir"))


@query(f"""WITH {ANNUAL}, k AS (SELECT DISTINCT pixel_id FROM annual), a AS (SELECT * FROM annual WHERE yr=1996 AND pixel_id % 3 <> 0), b AS (SELECT * FROM annual WHERE yr=1997)
 SELECT b.pixel_id, coalesce(a.doy0, b.doy0) AS first, round(CASE WHEN a.doy0 IS NULL THEN b.doy0 ELSE (a.doy0+b.doy0)/2 END,6) mean FROM b LEFT JOIN a ON a.pixel_id=b.pixel_id""")
def d32_h1_mosaic(spark: SparkSession, d: str) -> DataFrame:
    a = V.annual(spark, d)
    return stats.mosaic([a.where("yr = 1996 AND pixel_id % 3 <> 0"), a.where("yr = 1997")], ["pixel_id"], "doy0").withColumn("mean", r6(F.col("mean")))


@query("""SELECT CAST(floor(p_size/5.0) AS BIGINT) AS row, CAST(floor((p_partkey % 100)/5.0) AS BIGINT) col, median(CAST(p_retailprice AS DOUBLE)) v FROM part GROUP BY 1,2""")
def d33_coarsen_median(spark: SparkSession, d: str) -> DataFrame:
    p = V.table(spark, d, "part").select(F.col("p_size").alias("row"), (F.col("p_partkey") % 100).alias("col"), F.col("p_retailprice").cast("double").alias("v"))
    return stats.coarsen_median(p, "row", "col", "v", 5)


@query(f"""WITH {OBS}, s AS (SELECT min(nir)::DOUBLE a, quantile_cont(nir,0.02) p, quantile_cont(nir,0.98) q, max(nir)::DOUBLE b FROM obs)
 SELECT CAST(i AS INT) i, round(CASE i WHEN 0 THEN a WHEN 11 THEN b ELSE p+(q-p)*(i-1)/9 END, 6) AS at FROM s, range(12) t(i)""")
def d34_stretch_breaks(spark: SparkSession, d: str) -> DataFrame:
    return stats.stretch_breaks(V.obs(spark, d), "nir", n=10).withColumn("at", r6(F.col("at")))


@query(f"""WITH {OBS} SELECT CAST(floor(red/100.0) AS BIGINT) bin_x, CAST(floor(nir/100.0) AS BIGINT) bin_y, count(*) n FROM obs GROUP BY 1,2""")
def d35_d36_density(spark: SparkSession, d: str) -> DataFrame:
    return stats.density2d(V.obs(spark, d), "red", "nir", 100)


@query("""SELECT n_name, count(DISTINCT o_custkey) sites, count(*) pixels FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey GROUP BY 1 ORDER BY sites DESC, n_name""")
def d39_sites_per_tile(spark: SparkSession, d: str) -> DataFrame:
    o = V.table(spark, d, "orders").join(V.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(V.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return o.groupBy("n_name").agg(F.count_distinct("o_custkey").alias("sites"), F.count("*").alias("pixels")).orderBy(F.desc("sites"), "n_name")


W = "WINDOW w AS (PARTITION BY pixel_id ORDER BY obs_date)"


@query(f"""WITH {OBS}, {DAILY}, n AS (SELECT *, lag(v) OVER w a, lead(v) OVER w b FROM day {W}) SELECT pixel_id, obs_date, v, coalesce(v >= a AND v > b, false) top, (a IS NULL OR v <= a) AND (b IS NULL OR b > v) bottom FROM n""")
def e2_local_extrema(spark: SparkSession, d: str) -> DataFrame:
    return daily(spark, d).select("pixel_id", "obs_date", "v", series.local_extrema("v").alias("top"), series.local_extrema("v", minima=True, partial=True).alias("bottom"))


@query(f"""WITH {SEASON} SELECT pixel_id, min(obs_date) FILTER (WHERE evi >= 3500) rise_first, max(obs_date) FILTER (WHERE evi <= 3500) rise_last, min(obs_date) FILTER (WHERE evi <= 3500) fall_first, max(obs_date) FILTER (WHERE evi >= 3500) fall_last FROM season GROUP BY 1""")
def e7_cross_threshold(spark: SparkSession, d: str) -> DataFrame:
    return series.cross_threshold(V.season(spark, d), "evi", F.lit(3500))


@query(f"""WITH {SEASON}, x AS (SELECT pixel_id, obs_date, CASE WHEN pixel_id % 2 = 0 AND flag <> 0 THEN NULL ELSE evi END evi FROM season), g AS (SELECT *, count(evi) OVER (PARTITION BY pixel_id ORDER BY obs_date) g FROM x), n AS (SELECT pixel_id, max(n) n FROM (SELECT pixel_id, g, count(*) n FROM g WHERE evi IS NULL GROUP BY 1, 2) GROUP BY 1)
 SELECT s.s_suppkey pixel_id, coalesce(n, 0) longest_gap, coalesce(n, 0) <= 30 usable FROM supplier s LEFT JOIN n ON n.pixel_id = s.s_suppkey""")
def e20_usable_series(spark: SparkSession, d: str) -> DataFrame:
    s = V.season(spark, d).withColumn("evi", F.when((F.col("pixel_id") % 2 != 0) | (F.col("flag") == 0), F.col("evi")))
    return series.longest_gap(s, "evi", max_span=30)


@query(f"""WITH {SEASON}, x AS (SELECT * FROM season WHERE pixel_id % 2 = 0 OR year(obs_date) <> 2001), p AS (SELECT pixel_id, obs_date, evi, 0 qc FROM x WHERE obs_date BETWEEN DATE '1999-12-22' AND DATE '2001-01-10')
 SELECT pixel_id, CAST(obs_date AS DATE) obs_date, evi, qc FROM p UNION ALL SELECT pixel_id, CAST(obs_date + INTERVAL 366 DAY AS DATE), evi, 1 FROM x WHERE pixel_id % 2 <> 0 AND obs_date BETWEEN DATE '2000-01-01' AND DATE '2000-01-10'""")
def e21_pad_year_fake(spark: SparkSession, d: str) -> DataFrame:
    s = V.season(spark, d).where("pixel_id % 2 = 0 OR year(obs_date) <> 2001").withColumn("qc", F.lit(0))
    return series.pad_year(s, 2000, 10, fake=True).select("pixel_id", "obs_date", "evi", "qc")


@query(f"""WITH {OBS}, a AS (SELECT DISTINCT pixel_id, obs_date FROM obs WHERE sensor='S1'), b AS (SELECT DISTINCT pixel_id, obs_date other FROM obs WHERE sensor='S3'),
 j AS (SELECT a.pixel_id, a.obs_date, other, row_number() OVER (PARTITION BY a.pixel_id, a.obs_date ORDER BY abs(other-a.obs_date), other DESC) k FROM a LEFT JOIN b ON a.pixel_id=b.pixel_id) SELECT pixel_id, obs_date, other AS match FROM j WHERE k=1""")
def c2_nearest_date_open(spark: SparkSession, d: str) -> DataFrame:
    o = V.obs(spark, d)
    return joins.nearest_date(o.where("sensor = 'S1'"), o.where("sensor = 'S3'"), None, tie="max")


@query(f"""WITH {OBS}, a AS (SELECT pixel_id, obs_date, max(nir) x FROM obs WHERE sensor='S1' GROUP BY 1,2), b AS (SELECT pixel_id, obs_date, max(nir) y FROM obs WHERE sensor='S3' GROUP BY 1,2), e AS (SELECT DISTINCT pixel_id, obs_date FROM obs), j AS (SELECT * FROM e LEFT JOIN a USING (pixel_id, obs_date) LEFT JOIN b USING (pixel_id, obs_date))
 SELECT pixel_id, obs_date, x, y, CASE WHEN year(obs_date) = 1995 THEN 4 WHEN x IS NOT NULL AND y IS NOT NULL THEN 0 WHEN x IS NOT NULL THEN 1 WHEN y IS NOT NULL THEN 2 ELSE 3 END status FROM j""")
def c6_merge_status(spark: SparkSession, d: str) -> DataFrame:
    o = V.obs(spark, d)
    a, b = (o.where(F.col("sensor") == s).groupBy("pixel_id", "obs_date").agg(F.max("nir").alias(n)) for s, n in (("S1", "x"), ("S3", "y")))
    return joins.merge_products(a, b, "x", "y", expected=o, done=o.where("year(obs_date) = 1995"))


@query("""SELECT l_orderkey, l_linenumber, len(list_filter([10.0, 20, 30, 50], lambda b: b <= l_quantity)) raw, greatest(1, least(3, len(list_filter([10.0, 20, 30, 50], lambda b: b <= l_quantity)))) inside, len(list_filter([10.0, 20, 30, 50], lambda b: b <= l_quantity)) - CAST(l_quantity = 50 AS INT) closed,
 l_partkey - 2*2400 AS shifted, CAST(l_shipdate AS DATE) - DATE '2000-01-01' + 10957 AS days FROM lineitem""")
def b22_b23_intervals_and_offsets(spark: SparkSession, d: str) -> DataFrame:
    q, b = F.col("l_quantity").cast("double"), [10.0, 20.0, 30.0, 50.0]
    n = F.datediff(F.col("l_shipdate").cast("date"), F.lit("2000-01-01").cast("date")) + 1
    return V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.find_interval(q, b, all_inside=False).alias("raw"), X.find_interval(q, b).alias("inside"), X.find_interval(q, b, False, True).alias("closed"), X.cell_offset(F.col("l_partkey"), 3, 2400).alias("shifted"), X.epoch2000_to_1970(n).alias("days"))


@query(f"""WITH {SEASON}, t AS (SELECT pixel_id, arg_max(obs_date, (evi, -epoch(obs_date))) peak, max(evi) high FROM season GROUP BY 1), l AS (SELECT s.pixel_id, peak, high, min(CASE WHEN obs_date<=peak THEN evi END) a, min(CASE WHEN obs_date>peak THEN evi END) b FROM season s JOIN t USING (pixel_id) GROUP BY 1,2,3)
 SELECT s.pixel_id, peak, min(CASE WHEN obs_date<=peak AND evi >= a+0.5*(high-a) THEN obs_date END) rise, min(CASE WHEN obs_date>peak AND evi <= b+0.5*(high-b) THEN obs_date END) fall FROM season s JOIN l USING (pixel_id) GROUP BY 1,2""")
def e8_crossing_dates(spark: SparkSession, d: str) -> DataFrame:
    return series.crossing_dates(V.season(spark, d), "evi", 0.5, 0.5)


def gappy(spark: SparkSession, d: str) -> DataFrame:
    """A daily value with NULLs in it."""
    return daily(spark, d).withColumn("v", F.when(F.col("w") % 7 != 0, F.col("v")))


@query(f"""WITH {OBS}, {DAILY}, {GAPPY}, n AS (SELECT *, list(v) OVER (PARTITION BY pixel_id, v IS NULL ORDER BY obs_date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) s FROM gap), m AS (SELECT *, list_aggregate(s, 'median') med, list_aggregate(list_transform(s, lambda x: abs(x - list_aggregate(s, 'median'))), 'median') off FROM n)
 SELECT pixel_id, obs_date, v, CASE WHEN len(s)=7 AND abs(v-med) > 2*1.4826*off THEN 3 ELSE 0 END flag, CAST(CASE WHEN len(s)=7 AND abs(v-med) > 2*1.4826*off THEN med ELSE v END AS INT) clean FROM m""")
def e13_hampel(spark: SparkSession, d: str) -> DataFrame:
    return series.hampel(gappy(spark, d).select("pixel_id", "obs_date", "v"), "v", 3, 2.0)


@query(f"""WITH {OBS}, {DAILY}, {GAPPY}, x AS (SELECT pixel_id, obs_date, v, (w % 100)/100.0 ndsi FROM gap), q AS (SELECT pixel_id, quantile_cont(v, 0.05) low FROM x WHERE ndsi <= 0.2 GROUP BY 1)
 SELECT pixel_id, obs_date, v, CAST(ndsi > 0.2 AS INT) flag, round(CASE WHEN ndsi > 0.2 OR v < low THEN low ELSE v END, 6) filled FROM x LEFT JOIN q USING (pixel_id)""")
def e14_snow_filter(spark: SparkSession, d: str) -> DataFrame:
    x = gappy(spark, d).select("pixel_id", "obs_date", "v", (F.col("w") % 100 / 100).alias("ndsi"))
    return series.snow_filter(x, "v", "ndsi").select("pixel_id", "obs_date", "v", "flag", r6(F.col("filled")).alias("filled"))


@query(f"""WITH {SEASON} SELECT pixel_id, CAST(year(obs_date) AS INT) AS yr, round(pow(corr(CASE WHEN flag < 4 THEN evi END, CASE WHEN flag < 4 THEN evi + resid END), 2), 6) r2 FROM season GROUP BY 1, 2""")
def e28_r_squared(spark: SparkSession, d: str) -> DataFrame:
    s = V.season(spark, d).withColumn("yr", F.year("obs_date")).withColumn("evi", F.when(F.col("flag") < 4, F.col("evi")))
    return phenology.r_squared_of(s, ["pixel_id", "yr"]).withColumn("r2", r6(F.col("r2")))


@query()
def e35_parameter_sweep(spark: SparkSession, d: str) -> DataFrame:
    sets = {"main": phenology.VERSIONS["main"], "hank": phenology.VERSIONS["hank"], "dsm": phenology.VERSIONS["dsm"]}
    return phenology.parameter_sweep(V.season(spark, d), sets, "2000-01-01", "2000-12-31")


@query(f"""WITH {SEASON} SELECT pixel_id, obs_date, evi - lag(evi) OVER (PARTITION BY pixel_id, year(obs_date) ORDER BY obs_date) change FROM season""")
def e19_daily_change(spark: SparkSession, d: str) -> DataFrame:
    return V.season(spark, d).select("pixel_id", "obs_date", series.daily_change("evi").alias("change"))


@query(f"""WITH {SEASON} SELECT pixel_id, obs_date, evi FROM season WHERE obs_date BETWEEN DATE '1999-12-02' AND DATE '2001-01-30'""")
def e21_pad_year(spark: SparkSession, d: str) -> DataFrame:
    return series.pad_year(V.season(spark, d), 2000, 30).select("pixel_id", "obs_date", "evi")


@query(f"""WITH {SEASON} SELECT pixel_id, obs_date, round(sum(CASE WHEN flag NOT IN (0,1,2) THEN 1 ELSE 0 END) OVER p / (count(*) OVER p + CASE WHEN row_number() OVER w <= 14 THEN 1 ELSE 0 END), 6) bad FROM season
 WINDOW w AS (PARTITION BY pixel_id ORDER BY obs_date), p AS (PARTITION BY pixel_id ORDER BY obs_date ROWS BETWEEN 14 PRECEDING AND 14 FOLLOWING)""")
def e29_fill_fraction_by_position(spark: SparkSession, d: str) -> DataFrame:
    return V.season(spark, d).select("pixel_id", "obs_date", r6(series.fill_share("flag")).alias("bad"))


EVENTS = "ev AS (SELECT o_custkey pixel_id, CAST(o_orderdate AS DATE) up, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 60 AS INT) down, o_orderkey id FROM orders)"


@query(f"""WITH {EVENTS}, e AS (SELECT pixel_id, up, min(id) id FROM ev GROUP BY 1,2), r AS (SELECT *, row_number() OVER (PARTITION BY pixel_id ORDER BY up) k FROM e WHERE up BETWEEN DATE '1993-01-01' AND DATE '1995-12-31') SELECT pixel_id, up, id FROM r WHERE k = 2""")
def e30_g3_nth_event(spark: SparkSession, d: str) -> DataFrame:
    e = V.table(spark, d, "orders").select(F.col("o_custkey").alias("pixel_id"), F.col("o_orderdate").cast("date").alias("up"), F.col("o_orderkey").alias("id"))
    return series.nth_event(e.groupBy("pixel_id", "up").agg(F.min("id").alias("id")), "pixel_id", "up", "1993-01-01", "1995-12-31", 2)


@query(f"""WITH {EVENTS}, win AS (SELECT make_date(CAST(y AS INT),1,1) start, make_date(CAST(y+3 AS INT),1,1) stop FROM range(1992,1997) t(y)) SELECT pixel_id, start, count(*) n FROM ev JOIN win ON up >= start AND up < stop GROUP BY 1,2""")
def e31_events_in_window(spark: SparkSession, d: str) -> DataFrame:
    win = spark.range(1992, 1997).selectExpr("make_date(int(id), 1, 1) start", "make_date(int(id) + 3, 1, 1) stop")
    e = V.table(spark, d, "orders").select(F.col("o_custkey").alias("pixel_id"), F.col("o_orderdate").cast("date").alias("up"))
    return series.events_in_window(e, win, "pixel_id", "up")


@query(f"""WITH {EVENTS}, a AS (SELECT pixel_id, up, row_number() OVER (PARTITION BY pixel_id ORDER BY up) k FROM ev WHERE up BETWEEN DATE '1993-01-01' AND DATE '1995-12-31'), b AS (SELECT pixel_id, down, row_number() OVER (PARTITION BY pixel_id ORDER BY down) k FROM ev WHERE down BETWEEN DATE '1993-01-01' AND DATE '1995-12-31')
 SELECT a.pixel_id, down-up AS length FROM a JOIN b ON a.pixel_id=b.pixel_id WHERE a.k=1 AND b.k=1""")
def e32_season_length(spark: SparkSession, d: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    e = V.table(spark, d, "orders").select(F.col("o_custkey").alias("pixel_id"), day.alias("up"), F.date_add(day, (F.col("o_orderkey") % 60).cast("int")).alias("down"))
    return series.season_length_window(e, "pixel_id", "up", "down", "1993-01-01", "1995-12-31", 1)


@query(f"""WITH {OBS}, {DAILY} SELECT pixel_id, arg_min(v, obs_date) AS first, arg_max(v, obs_date) AS last, array_to_string(list(v ORDER BY obs_date)[1:3], ',') AS early, array_to_string(list(v ORDER BY v DESC)[1:3], ',') AS highest FROM day WHERE v > 2000 GROUP BY 1""")
def g1_g2_g5_order(spark: SparkSession, d: str) -> DataFrame:
    s = daily(spark, d).where("v > 2000").groupBy("pixel_id").agg(F.min_by("v", "obs_date").alias("first"), F.max_by("v", "obs_date").alias("last"), F.sort_array(F.collect_list(F.struct("obs_date", "v"))).alias("s"), F.sort_array(F.collect_list("v"), False).alias("h"))
    return s.select("pixel_id", "first", "last", F.array_join(F.slice("s.v", 1, 3), ",").alias("early"), F.array_join(F.slice("h", 1, 3), ",").alias("highest"))


@query(f"""WITH {OBS} SELECT pixel_id, obs_date FROM obs WHERE sensor='S1' EXCEPT SELECT pixel_id, obs_date FROM obs WHERE sensor='S3'""")
def h4_except(spark: SparkSession, d: str) -> DataFrame:
    o = V.obs(spark, d)
    a, b = (o.where(F.col("sensor") == s).select("pixel_id", "obs_date") for s in ("S1", "S3"))
    return a.subtract(b)


@query("""SELECT o_orderkey, o_custkey, 1 AS cycle, CAST(dayofyear(o_orderdate) AS INT) AS value FROM orders UNION ALL SELECT o_orderkey, o_custkey, 2, CAST(dayofyear(o_orderdate) AS INT) + CAST(o_orderkey % 60 AS INT) FROM orders""")
def i3_cycles_to_rows(spark: SparkSession, d: str) -> DataFrame:
    o = V.table(spark, d, "orders").select("o_orderkey", "o_custkey", F.dayofyear("o_orderdate").alias("m1"), (F.dayofyear("o_orderdate") + (F.col("o_orderkey") % 60).cast("int")).alias("m2"))
    return o.select("o_orderkey", "o_custkey", F.stack(F.lit(2), F.lit(1), F.col("m1"), F.lit(2), F.col("m2")).alias("cycle", "value"))


@query(f"""WITH {OBS}, days AS (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '1995-01-31', INTERVAL 1 DAY)) AS DATE) obs_date), k AS (SELECT DISTINCT pixel_id FROM obs), p AS (SELECT pixel_id, obs_date, max(red) FILTER (WHERE sensor='S1') s1_red, max(nir) FILTER (WHERE sensor='S1') s1_nir, max(red) FILTER (WHERE sensor='S3') s3_red FROM obs GROUP BY 1,2)
 SELECT k.pixel_id, d.obs_date, s1_red, s1_nir, s3_red FROM k CROSS JOIN days d LEFT JOIN p ON p.pixel_id=k.pixel_id AND p.obs_date=d.obs_date""")
def i4_i5_sensor_band_grid(spark: SparkSession, d: str) -> DataFrame:
    o = V.obs(spark, d)
    p = o.groupBy("pixel_id", "obs_date").pivot("sensor", ["S1", "S3"]).agg(F.max("red").alias("red"), F.max("nir").alias("nir"))
    p = p.select("pixel_id", "obs_date", F.col("S1_red").alias("s1_red"), F.col("S1_nir").alias("s1_nir"), F.col("S3_red").alias("s3_red"))
    grid = joins.expand_tasks(o.select("pixel_id").distinct(), V.calendar(spark, "1995-01-01", "1995-01-31").select("obs_date"))
    return grid.join(p, ["pixel_id", "obs_date"], "left")


@query(f"""WITH {OBS} SELECT CAST(s AS INT) step, CAST(CASE s WHEN 0 THEN count(*) WHEN 1 THEN count(*) FILTER (WHERE snow=0) ELSE count(*) FILTER (WHERE snow=0 AND nir>2000) END AS BIGINT) n FROM obs, range(3) t(s) GROUP BY s""")
def j2_filter_step_counts(spark: SparkSession, d: str) -> DataFrame:
    return stats.filter_steps(V.obs(spark, d), ["snow = 0", "nir > 2000"])


@query(f"""WITH {OBS}, w AS (SELECT pixel_id, year(obs_date) yr, CAST(ceil((dayofyear(obs_date)-1)/7.0) AS INT) - 1 AS week, red FROM obs WHERE red <> 0)
 SELECT pixel_id, yr, week, round(avg(red),6) value, count(*) n, DATE '1970-01-01' + CAST(round_even((make_date(yr, 1, 1) - DATE '1970-01-01') + 7*week + 3.5, 0) AS INT) AS centre FROM w WHERE week >= 0 GROUP BY 1,2,3""")
def d23_weekly_composite_right(spark: SparkSession, d: str) -> DataFrame:
    return stats.weekly_composite(V.obs(spark, d), "pixel_id", "obs_date", "red", closed="right", centre=True).withColumn("value", r6(F.col("value")))


def _binned(spark: SparkSession, d: str, res: str) -> DataFrame:
    o = V.obs(spark, d).withColumn("nir", F.when(F.col("qa") % 5 != 0, F.col("nir")))
    return stats.bin_observations(o, "nir", res, share={"S1": 0.07, "S2": 0.05}).withColumns({"value": r6(F.col("value")), "error": r6(F.col("error"))})


_BINS = """WITH {obs}, o AS (SELECT *, date_trunc('year', min(obs_date) OVER (PARTITION BY pixel_id)) AS f FROM obs WHERE qa % 5 <> 0)
 SELECT pixel_id, sensor, {bin} AS bin, round(median(nir), 6) AS value, round(median(nir)*CASE sensor WHEN 'S1' THEN 0.07 WHEN 'S2' THEN 0.05 END, 6) AS error, count(*) n FROM o GROUP BY 1, 2, 3"""


@query(_BINS.format(obs=OBS, bin="CAST(f AS DATE) + 7*CAST((obs_date - CAST(f AS DATE)) // 7 AS INT)"))
def d24_bin_weekly(spark: SparkSession, d: str) -> DataFrame:
    return _binned(spark, d, "weekly")


@query(_BINS.format(obs=OBS, bin="obs_date"))
def d24_bin_daily(spark: SparkSession, d: str) -> DataFrame:
    return _binned(spark, d, "daily")


@query("""SELECT o_custkey pixel_id, make_date(CAST(year(o_orderdate) AS INT), 1, 1) obs_date, max(o_orderkey) b1, CASE WHEN count(*) > 1 THEN count(*) END b2 FROM orders GROUP BY 1, 2""")
def a8_wide_and_long(spark: SparkSession, d: str) -> DataFrame:
    o = V.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("pixel_id"), F.trunc("o_orderdate", "year").alias("obs_date"))
    o = o.agg(F.max("o_orderkey").alias("b1"), F.when(F.count("*") > 1, F.count("*")).alias("b2"))
    days = [r[0] for r in o.select("obs_date").distinct().collect()]  # one for each year
    return joins.wide_to_long(joins.long_to_wide(o, ["b1", "b2"], days), ["b1", "b2"])


@query(f"""WITH {OBS} SELECT pixel_id, sensor, round(1.4826*mad(CAST(nir AS DOUBLE)), 6) AS mad, round(quantile_cont(nir, 0.25) - 1.5*(quantile_cont(nir, 0.75) - quantile_cont(nir, 0.25)), 6) AS low, round(quantile_cont(nir, 0.75) + 1.5*(quantile_cont(nir, 0.75) - quantile_cont(nir, 0.25)), 6) AS high FROM obs GROUP BY 1, 2""")
def j6_mad_and_bounds_in_sql(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(f"SELECT pixel_id, sensor, round(mad, 6) AS mad, round(b.low, 6) AS low, round(b.high, 6) AS high FROM (SELECT pixel_id, sensor, {X.mad_sql('nir')} AS mad, {X.tukey_bounds_sql('nir')} AS b FROM {{obs}} GROUP BY pixel_id, sensor)", obs=V.obs(spark, d))


@query(f"""WITH {OBS}, v AS (SELECT nir - 2500.0 AS v FROM obs), s AS (SELECT greatest(abs(min(v)), abs(max(v))) b, greatest(abs(quantile_cont(v,0.02)), abs(quantile_cont(v,0.98))) q FROM v),
 pts AS (SELECT i, round(CASE i WHEN 0 THEN -b WHEN 11 THEN b ELSE -q + 2*q*(i-1)/9 END, -2) AS e FROM s, range(12) t(i)) SELECT CAST(row_number() OVER (ORDER BY e) - 1 AS INT) AS i, CAST(e AS DOUBLE) AS at FROM pts GROUP BY e""")
def d34_stretch_breaks_symmetric(spark: SparkSession, d: str) -> DataFrame:
    return stats.stretch_breaks(V.obs(spark, d).select((F.col("nir") - 2500.0).alias("v")), "v", n=10, symmetric=True, digits=-2)
