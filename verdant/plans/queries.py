"""One query for each operator, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import joins, phenology, robust, series, stats
from ..sources import views as V

OBS = """obs AS (SELECT l_suppkey pixel_id, CAST(l_shipdate AS DATE) obs_date,
 CASE l_returnflag WHEN 'A' THEN 'S1' WHEN 'N' THEN 'S2' ELSE 'S3' END sensor,
 CAST(round(l_discount*10000) AS INT) red, CAST(round(1000+l_quantity*80) AS INT) nir,
 CAST(round(l_tax*10000) AS INT) blue, CAST(round(500+l_tax*10000) AS INT) green,
 CAST(200+(l_orderkey % 1500) AS INT) swir, CAST(l_partkey % 2048 AS INT) qa,
 CASE WHEN l_linestatus='O' THEN 1 ELSE 0 END snow FROM lineitem)"""
SEASON = """cal AS (SELECT CAST(dt AS DATE) obs_date, dayofyear(dt) doy
 FROM (SELECT unnest(generate_series(DATE '1999-01-01', DATE '2001-12-31', INTERVAL 1 DAY)) dt) WHERE dayofyear(dt) <= 365),
season AS (SELECT s_suppkey pixel_id, obs_date,
 CAST(round(3000 + (1200+100*(s_suppkey % 7))*sin((doy - 80 - (s_suppkey % 40)) * 0.017214206)
  + CASE WHEN s_suppkey % 3 = 0 THEN 900*sin((doy - 30)*0.034428413) ELSE 0 END) AS INT) evi,
 CAST(((s_suppkey*31 + doy*17) % 41) - 20 AS INT) resid,
 CASE WHEN doy <= 40 THEN 4 WHEN doy % 9 = 0 THEN 1 ELSE 0 END flag FROM supplier CROSS JOIN cal)"""
ANNUAL = """annual AS (SELECT c_nationkey pixel_id, year(o_orderdate) yr, median(CAST(dayofyear(o_orderdate)-1 AS DOUBLE)) doy0, count(*) n
 FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""
GROUND = """ground AS (SELECT o_custkey % 200 site_id, year(o_orderdate) obs_year, o_orderpriority phase,
 CAST(dayofyear(o_orderdate) AS INT) first_yes, CAST(dayofyear(o_orderdate)+(o_orderkey % 60) AS INT) last_yes FROM orders)"""

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


r6 = lambda c: F.round(c, 6)


@query(f"""WITH {OBS} SELECT pixel_id, obs_date, sensor, red, nir, qa FROM obs WHERE obs_date BETWEEN DATE '1995-01-01' AND DATE '1995-12-31' AND sensor IN ('S1','S2')""")
def a1_b33_read_observations(spark: SparkSession, d: str) -> DataFrame:
    o = V.obs(spark, d)
    return o.where(F.col("obs_date").between("1995-01-01", "1995-12-31") & F.col("sensor").isin("S1", "S2")).select("pixel_id", "obs_date", "sensor", "red", "nir", "qa")


@query(f"""WITH {OBS} SELECT sensor, pixel_id, obs_date, count(*) n FROM obs GROUP BY 1,2,3""")
def a3_parse_scene_name(spark: SparkSession, d: str) -> DataFrame:
    o = V.obs(spark, d)
    name = F.concat("sensor", F.lit("."), F.col("pixel_id").cast("string"), F.lit(".A"), F.year("obs_date").cast("string"), F.lpad(F.dayofyear("obs_date").cast("string"), 3, "0"))
    sensor, pixel, day = X.parse_scene_name(F.col("scene"))
    o = o.select(name.alias("scene")).select(sensor.alias("sensor"), pixel.alias("pixel_id"), day.alias("obs_date"))
    return o.groupBy("sensor", "pixel_id", "obs_date").agg(F.count("*").alias("n"))


@query("""SELECT user_id, CAST(ts AS DATE) d, event_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id DESC) AS rank FROM events""")
def a14_g6_latest_version(spark: SparkSession, d: str) -> DataFrame:
    e = V.table(spark, d, "events").select("user_id", F.col("ts").cast("date").alias("d"), "event_id")
    return joins.latest(e, ["user_id", "d"], "event_id")


@query(f"""WITH {OBS}, years AS (SELECT unnest(range(1992, 1999)) yr) SELECT p.s_suppkey pixel_id, CAST(y.yr AS INT) yr FROM supplier p CROSS JOIN years y
 WHERE NOT EXISTS (SELECT 1 FROM obs WHERE pixel_id = p.s_suppkey AND year(obs_date) = y.yr AND sensor = 'S1')""")
def a12_a13_c13_missing_tasks(spark: SparkSession, d: str) -> DataFrame:
    years = spark.range(1992, 1999).select(F.col("id").cast("int").alias("yr"))
    tasks = joins.expand_tasks(V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("pixel_id")), years)
    have = V.obs(spark, d).where("sensor = 'S1'").select("pixel_id", F.year("obs_date").alias("yr")).distinct()
    return joins.missing(tasks, have, ["pixel_id", "yr"])


@query(f"""WITH {OBS} SELECT pixel_id, obs_date, sensor, red, nir, blue, round(2.5*(nir*1e-4-red*1e-4)/(nir*1e-4+2.4*(red*1e-4)+1),6) evi2,
 round(2.5*(nir*1e-4-red*1e-4)/(nir*1e-4+6*(red*1e-4)-7.5*(blue*1e-4)+1),6) evi FROM obs""")
def b1_b2_vegetation_indices(spark: SparkSession, d: str) -> DataFrame:
    o = V.obs(spark, d)
    c = [F.col(x) for x in ("nir", "red", "blue")]
    return o.select("pixel_id", "obs_date", "sensor", "red", "nir", "blue", r6(X.evi2(c[0], c[1])).alias("evi2"), r6(X.evi(*c)).alias("evi"))


@query(f"""WITH {OBS} SELECT pixel_id, obs_date, green, swir, nir, CAST(round_even(CAST(10000*(green-swir) AS DOUBLE)/nullif(green+swir,0),0) AS INT) ndsi,
 CAST(round_even(CAST(10000*(nir-swir) AS DOUBLE)/nullif(nir+swir,0),0) AS INT) ndmi FROM obs""")
def b3_normalized_differences(spark: SparkSession, d: str) -> DataFrame:
    return V.obs(spark, d).select("pixel_id", "obs_date", "green", "swir", "nir", X.normalized(F.col("green"), F.col("swir")).alias("ndsi"), X.normalized(F.col("nir"), F.col("swir")).alias("ndmi"))


@query(f"""WITH {OBS} SELECT pixel_id, obs_date, qa, CASE WHEN qa&1=1 THEN 5 WHEN (qa>>2)&1=1 THEN 3 WHEN (qa>>3)&1=1 THEN 2 WHEN (qa>>4)&1=1 THEN 4 WHEN (qa>>5)&1=1 THEN 1 WHEN ((qa>>8)&3)>=2 THEN 1 ELSE 0 END oli,
 CASE WHEN qa&1=1 THEN 5 WHEN (qa>>2)&1=1 THEN 3 WHEN (qa>>3)&1=1 THEN 2 WHEN (qa>>4)&1=1 THEN 4 WHEN (qa>>5)&1=1 THEN 1 WHEN ((qa>>6)&3)>=2 THEN 1 ELSE 0 END etm,
 CASE WHEN qa&3=0 THEN 0 WHEN qa&3=1 THEN (qa>>6)&3 END lst, qa&15 band1, (qa>>4)&15 band2 FROM obs""")
def b6_b7_b11_quality_bits(spark: SparkSession, d: str) -> DataFrame:
    qa = F.col("qa")
    return V.obs(spark, d).select("pixel_id", "obs_date", "qa", X.pixel_class(qa, True).alias("oli"), X.pixel_class(qa, False).alias("etm"), X.lst_class(qa).alias("lst"), X.band_quality(qa, 1).alias("band1"), X.band_quality(qa, 2).alias("band2"))


@query(f"""WITH {OBS} SELECT pixel_id, obs_date, CASE WHEN nir BETWEEN 2000 AND 4000 THEN nir*0.0001 END clamped, CASE WHEN red NOT IN (0,32767) THEN red END kept,
 CASE WHEN (qa & 189)=0 THEN nir END masked, CASE WHEN snow<>0 OR qa=4 THEN NULL ELSE nir END no_snow FROM obs""")
def b4_b5_b8_b12_b13_masks(spark: SparkSession, d: str) -> DataFrame:
    nir, qa = F.col("nir"), F.col("qa")
    return V.obs(spark, d).select("pixel_id", "obs_date", X.clamp_valid(nir, 2000, 4000, 1e-4).alias("clamped"), X.fill_to_null(F.col("red"), 0, 32767).alias("kept"), F.when(X.pixel_qa_clear(qa), nir).alias("masked"), X.modis_mask(nir, F.col("snow"), qa).alias("no_snow"))


@query("""SELECT o_orderkey, datediff('day', date_trunc('year', o_orderdate), o_orderdate) doy0, dayofyear(o_orderdate) doy1, dayofyear(o_orderdate) + CASE WHEN o_custkey % 2 = 0 THEN 182.5 ELSE 0 END shifted FROM orders""")
def b17_b20_day_of_year(spark: SparkSession, d: str) -> DataFrame:
    day = F.col("o_orderdate")
    south = F.when(F.col("o_custkey") % 2 == 0, -1.0).otherwise(1.0)
    return V.table(spark, d, "orders").select("o_orderkey", X.epoch_to_doy0(day).cast("long").alias("doy0"), X.epoch_to_doy1(day).cast("long").alias("doy1"), X.hemisphere_shift(F.dayofyear(day), south).alias("shifted"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_discount*10 < 0.25 THEN 3 WHEN l_discount*10 < 0.5 THEN 2 WHEN l_discount*10 < 0.75 THEN 1 ELSE 0 END score,
 CASE WHEN l_discount*10 < 0.25 THEN 3 WHEN l_discount*10 < 0.5 THEN 2 WHEN l_discount*10 < 0.75 THEN 1 ELSE 0 END + 4*(l_linenumber % 4) packed, l_linenumber % 4 AS second FROM lineitem""")
def b23_b24_b25_quality_scores(spark: SparkSession, d: str) -> DataFrame:
    o = V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.quality_score(F.col("l_discount") * 10).alias("score"))
    o = o.withColumn("packed", X.pack([F.col("score"), F.col("l_linenumber") % 4]))
    return o.withColumn("second", X.unpack(F.col("packed"), 1))


@query(f"""WITH {OBS} SELECT pixel_id, obs_date, round(sqrt(pow(2.5*(3.4*(red*1e-4)+1)/pow(nir*1e-4+2.4*(red*1e-4)+1,2)*0.02,2)+pow(2.5*(3.4*(nir*1e-4)+1)/pow(nir*1e-4+2.4*(red*1e-4)+1,2)*0.01,2)),6) err,
 CASE WHEN snow=1 AND ndsi>0.2 THEN 'both' WHEN snow=1 THEN 'product' WHEN ndsi>0.2 THEN 'index' ELSE 'none' END snow_class, round((red+nir)/2.0-273.3,6) gdd
 FROM (SELECT *, CAST(green-swir AS DOUBLE)/nullif(green+swir,0) ndsi FROM obs)""")
def b27_b29_b30_errors_and_snow(spark: SparkSession, d: str) -> DataFrame:
    red, nir = F.col("red") * 1e-4, F.col("nir") * 1e-4
    ndsi = (F.col("green") - F.col("swir")) / F.nullif(F.col("green") + F.col("swir"), F.lit(0))
    return V.obs(spark, d).select("pixel_id", "obs_date", r6(X.evi2_error(red, nir, F.lit(0.01), F.lit(0.02))).alias("err"), X.snow_class(F.col("snow"), ndsi).alias("snow_class"), r6(X.growing_degrees(F.col("red"), F.col("nir"))).alias("gdd"))


@query(f"""WITH {OBS}, p AS (SELECT pixel_id, obs_date, sensor, avg(nir) nir FROM obs GROUP BY 1,2,3) SELECT a.pixel_id, a.obs_date, round(a.nir,6) nir1, round(b.nir,6) nir2 FROM p a JOIN p b USING (pixel_id, obs_date) WHERE a.sensor='S1' AND b.sensor='S3'""")
def c1_pair_same_date(spark: SparkSession, d: str) -> DataFrame:
    p = V.obs(spark, d).groupBy("pixel_id", "obs_date", "sensor").agg(F.avg("nir").alias("nir"))
    a, b = (p.where(F.col("sensor") == s).select("pixel_id", "obs_date", r6(F.col("nir")).alias(n)) for s, n in (("S1", "nir1"), ("S3", "nir2")))
    return joins.pair_same_date(a, b)


@query(f"""WITH {OBS}, a AS (SELECT DISTINCT pixel_id, obs_date FROM obs WHERE sensor='S1'), b AS (SELECT DISTINCT pixel_id, obs_date other FROM obs WHERE sensor='S3'),
 j AS (SELECT a.pixel_id, a.obs_date, other, row_number() OVER (PARTITION BY a.pixel_id, a.obs_date ORDER BY abs(other-a.obs_date), other) k FROM a LEFT JOIN b ON a.pixel_id=b.pixel_id AND abs(b.other-a.obs_date)<=8)
 SELECT pixel_id, obs_date, other AS match FROM j WHERE k=1""")
def c2_nearest_date(spark: SparkSession, d: str) -> DataFrame:
    o = V.obs(spark, d)
    return joins.nearest_date(o.where("sensor = 'S1'"), o.where("sensor = 'S3'"), 8)


@query(f"""WITH {OBS}, f AS (SELECT DISTINCT pixel_id, obs_date FROM obs WHERE sensor='S1'), c AS (SELECT pixel_id % 10 cell, obs_date, avg(nir) coarse FROM obs WHERE sensor='S2' GROUP BY 1,2)
 SELECT f.pixel_id, f.obs_date, round(coarse,6) coarse FROM f JOIN c ON f.pixel_id % 10 = c.cell AND f.obs_date=c.obs_date""")
def c3_cell_map_join(spark: SparkSession, d: str) -> DataFrame:
    o, cell = V.obs(spark, d), (F.col("pixel_id") % 10).alias("cell")
    c = o.where("sensor = 'S2'").groupBy(cell, "obs_date").agg(r6(F.avg("nir")).alias("coarse"))
    return o.where("sensor = 'S1'").select("pixel_id", "obs_date", cell).distinct().join(c, ["cell", "obs_date"]).select("pixel_id", "obs_date", "coarse")


@query(f"""WITH {OBS}, a AS (SELECT pixel_id, obs_date, max(nir) x FROM obs WHERE sensor='S1' GROUP BY 1,2), b AS (SELECT pixel_id, obs_date, max(nir) y FROM obs WHERE sensor='S3' GROUP BY 1,2)
 SELECT pixel_id, obs_date, x, y, CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN 0 WHEN x IS NOT NULL THEN 1 ELSE 2 END status FROM a FULL JOIN b USING (pixel_id, obs_date)""")
def c6_merge_products(spark: SparkSession, d: str) -> DataFrame:
    o = V.obs(spark, d)
    a, b = (o.where(F.col("sensor") == s).groupBy("pixel_id", "obs_date").agg(F.max("nir").alias(n)) for s, n in (("S1", "x"), ("S3", "y")))
    return joins.merge_products(a, b, "x", "y")


SIEGEL = """p AS (SELECT a.pixel_id, a.yr, median((b.doy0-a.doy0)/(b.yr-a.yr)) s, median((b.yr*a.doy0-a.yr*b.doy0)/(b.yr-a.yr)) t FROM annual a JOIN annual b ON a.pixel_id=b.pixel_id AND b.yr<>a.yr GROUP BY 1,2)"""


@query(f"""WITH {ANNUAL}, {SIEGEL}, m AS (SELECT pixel_id, median(doy0) med FROM annual GROUP BY 1), a AS (SELECT pixel_id, med, 1.4826*median(abs(doy0-med)) mad FROM annual JOIN m USING (pixel_id) GROUP BY 1,2), g AS (SELECT pixel_id, median(s) slope FROM p GROUP BY 1)
 SELECT pixel_id, round_even(med, 0) med, round(mad,6) mad, round_even(avg(doy0), 0) mean, round(stddev_samp(doy0),6) sd, round(slope,6) slope, count(doy0) n FROM annual JOIN a USING (pixel_id) LEFT JOIN g USING (pixel_id) GROUP BY 1, med, mad, slope""")
def d1_d3_climate_normals(spark: SparkSession, d: str) -> DataFrame:
    return robust.climate_normals(V.annual(spark, d), "pixel_id", "yr", "doy0").drop("p").withColumns({c: r6(F.col(c)) for c in ("mad", "sd", "slope")})


@query()
def d1_slope_p(spark: SparkSession, d: str) -> DataFrame:
    return robust.climate_normals(V.annual(spark, d), "pixel_id", "yr", "doy0").select("pixel_id", "slope", "p")


@query(f"""WITH {ANNUAL}, m AS (SELECT pixel_id, median(doy0) med FROM annual GROUP BY 1), a AS (SELECT pixel_id, med, 1.4826*median(abs(doy0-med)) mad FROM annual JOIN m USING (pixel_id) GROUP BY 1,2)
 SELECT pixel_id, yr, round_even(doy0-med, 0) anomaly, round((doy0-med)/nullif(mad,0),6) z FROM annual JOIN a USING (pixel_id)""")
def d2_c12_anomalies(spark: SparkSession, d: str) -> DataFrame:
    return robust.climate_anomalies(V.annual(spark, d), "pixel_id", "yr", "doy0").withColumn("z", r6(F.col("z")))


@query(f"""WITH {OBS} SELECT pixel_id, round(quantile_cont(nir,0.05),6) q05, round(quantile_cont(nir,0.5),6) q50, round(quantile_cont(nir,0.95),6) q95, count(nir) n FROM obs WHERE snow=0 GROUP BY 1""")
def d7_pixel_quantiles(spark: SparkSession, d: str) -> DataFrame:
    q = lambda p: r6(F.percentile("nir", F.lit(p))).alias(f"q{int(p * 100):02d}")
    return V.obs(spark, d).where("snow = 0").groupBy("pixel_id").agg(q(0.05), q(0.5), q(0.95), F.count("nir").alias("n"))


@query(f"""WITH {GROUND} SELECT phase, count(*) n, round(avg(m),6) mean FROM (SELECT site_id, obs_year, phase, avg(first_yes) m FROM ground GROUP BY 1,2,3) GROUP BY 1 HAVING count(*) > 100""")
def d10_g4_phase_counts(spark: SparkSession, d: str) -> DataFrame:
    g = V.ground(spark, d).groupBy("site_id", "obs_year", "phase").agg(F.avg("first_yes").alias("m"))
    return g.groupBy("phase").agg(F.count("*").alias("n"), r6(F.avg("m")).alias("mean")).where("n > 100")


@query(f"""WITH {OBS} SELECT pixel_id, round(regr_slope(nir, red),6) slope, round(regr_intercept(nir, red),4) intercept, round(sqrt(avg(pow(nir-red,2))),6) rmse, round(avg(nir-red),6) bias, round(avg(abs(nir-red)),6) mae FROM obs GROUP BY 1""")
def d11_d15_fit_and_errors(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("nir") - F.col("red")
    return V.obs(spark, d).groupBy("pixel_id").agg(r6(F.regr_slope("nir", "red")).alias("slope"), F.round(F.regr_intercept("nir", "red"), 4).alias("intercept"), r6(F.sqrt(F.avg(e * e))).alias("rmse"), r6(F.avg(e)).alias("bias"), r6(F.avg(F.abs(e))).alias("mae"))


@query(f"""WITH {ANNUAL}, p AS (SELECT a.pixel_id, (b.doy0-a.doy0)/(b.yr-a.yr) s FROM annual a JOIN annual b ON a.pixel_id=b.pixel_id AND b.yr>a.yr), t AS (SELECT pixel_id, median(s) slope FROM p GROUP BY 1)
 SELECT pixel_id, round(slope,6) slope, round(median(doy0-slope*yr),6) intercept FROM annual JOIN t USING (pixel_id) GROUP BY 1, slope""")
def d12_theil_sen(spark: SparkSession, d: str) -> DataFrame:
    return robust.theil_sen(V.annual(spark, d), "pixel_id", "yr", "doy0").select("pixel_id", r6(F.col("slope")).alias("slope"), r6(F.col("intercept")).alias("intercept"))


@query(f"""WITH {ANNUAL}, p AS (SELECT a.pixel_id, a.yr, median((b.doy0-a.doy0)/(b.yr-a.yr)) s FROM annual a JOIN annual b ON a.pixel_id=b.pixel_id AND b.yr<>a.yr GROUP BY 1,2)
 SELECT pixel_id, round(median(s),6) slope FROM p GROUP BY 1""")
def d13_siegel(spark: SparkSession, d: str) -> DataFrame:
    return robust.siegel(V.annual(spark, d), "pixel_id", "yr", "doy0").select("pixel_id", r6(F.col("slope")).alias("slope"))


@query(f"""WITH {OBS}, q AS (SELECT pixel_id, quantile_cont(nir,0.25) a, quantile_cont(nir,0.75) b FROM obs GROUP BY 1)
 SELECT pixel_id, count(*) n, count(CASE WHEN nir BETWEEN a-0.5*(b-a) AND b+0.5*(b-a) THEN 1 END) kept, round(stddev_samp(CASE WHEN nir BETWEEN a-0.5*(b-a) AND b+0.5*(b-a) THEN nir END),6) sd FROM obs JOIN q USING (pixel_id) GROUP BY 1""")
def d18_d19_tukey(spark: SparkSession, d: str) -> DataFrame:
    o = stats.tukey(V.obs(spark, d), ["pixel_id"], "nir", 0.5)
    return o.groupBy("pixel_id").agg(F.count("*").alias("n"), F.count("nir").alias("kept"), r6(F.stddev_samp("nir")).alias("sd"))


#: Changes of value, each with the place of the next one; dates by place.
RUNS = """c AS (SELECT pixel_id, evi, row_number() OVER w i, lag(evi) OVER w a FROM season WINDOW w AS (PARTITION BY pixel_id ORDER BY obs_date)),
 r AS (SELECT pixel_id, evi, i, a, lead(i) OVER w j, lead(evi) OVER w b FROM c WHERE a IS NULL OR a <> evi WINDOW w AS (PARTITION BY pixel_id ORDER BY i)),
 days AS (SELECT pixel_id, list(obs_date ORDER BY obs_date) ds FROM season GROUP BY 1)"""


@query(f"""WITH {SEASON}, {RUNS} SELECT r.pixel_id, ds[CAST(i + round_even((j - i - 1)/2.0, 0) AS BIGINT)] obs_date, evi FROM r JOIN days USING (pixel_id) WHERE evi > a AND evi > b""")
def e1_find_peaks(spark: SparkSession, d: str) -> DataFrame:
    return series.peaks(V.season(spark, d)).select("pixel_id", "obs_date", "evi")


@query(f"""WITH {SEASON}, x AS (SELECT pixel_id, obs_date, CASE WHEN flag=0 THEN evi END evi FROM season), g AS (SELECT *, count(evi) OVER (PARTITION BY pixel_id ORDER BY obs_date) g FROM x)
 SELECT pixel_id, max(n) longest_gap FROM (SELECT pixel_id, g, count(*) n FROM g WHERE evi IS NULL GROUP BY 1,2) GROUP BY 1""")
def e20_max_gap(spark: SparkSession, d: str) -> DataFrame:
    return series.longest_gap(V.season(spark, d).withColumn("evi", F.when(F.col("flag") == 0, F.col("evi"))), "evi")


@query(f"""WITH {SEASON}, x AS (SELECT pixel_id, obs_date, CASE WHEN flag=0 THEN CAST(evi AS DOUBLE) END v FROM season),
 y AS (SELECT *, last_value(v IGNORE NULLS) OVER b x0, first_value(v IGNORE NULLS) OVER a x1, last_value(CASE WHEN v IS NOT NULL THEN obs_date END IGNORE NULLS) OVER b t0, first_value(CASE WHEN v IS NOT NULL THEN obs_date END IGNORE NULLS) OVER a t1
  FROM x WINDOW b AS (PARTITION BY pixel_id ORDER BY obs_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY pixel_id ORDER BY obs_date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
 SELECT pixel_id, obs_date, round(coalesce(v, x0+(x1-x0)*(obs_date-t0)/nullif(t1-t0,0)),4) filled FROM y""")
def e9_interpolate(spark: SparkSession, d: str) -> DataFrame:
    s = V.season(spark, d).withColumn("v", F.when(F.col("flag") == 0, F.col("evi").cast("double")))
    return s.select("pixel_id", "obs_date", F.round(series.interpolate("v", "pixel_id", "obs_date"), 4).alias("filled"))


@query(f"""WITH {OBS}, s AS (SELECT pixel_id, obs_date, max(nir) v FROM obs GROUP BY 1,2), w AS (SELECT *, lag(v) OVER o a, lead(v) OVER o b FROM s WINDOW o AS (PARTITION BY pixel_id ORDER BY obs_date))
 SELECT pixel_id, obs_date, v, coalesce(v-(b-a)/2.0-a < 0 AND abs(v-(b-a)/2.0-a) > 0 AND abs(v-(b-a)/2.0-a) > 2*abs(b-a), false) spike FROM w""")
def e12_despike(spark: SparkSession, d: str) -> DataFrame:
    return series.despike(V.obs(spark, d).groupBy("pixel_id", "obs_date").agg(F.max("nir").alias("v")), "v")


@query()
def e22_annual_phenology(spark: SparkSession, d: str) -> DataFrame:
    return phenology.annual(V.season(spark, d), "2000-01-01", "2000-12-31")


@query(f"""WITH {OBS} SELECT pixel_id, obs_date, 'S1' sensor FROM obs WHERE sensor='S1' INTERSECT SELECT pixel_id, obs_date, 'S1' FROM obs WHERE sensor='S3'""")
def h2_h3_shared_dates(spark: SparkSession, d: str) -> DataFrame:
    o = V.obs(spark, d)
    a, b = (o.where(F.col("sensor") == s).select("pixel_id", "obs_date") for s in ("S1", "S3"))
    return a.intersect(b).withColumn("sensor", F.lit("S1"))


@query(f"""WITH {OBS} SELECT pixel_id, obs_date FROM obs WHERE sensor='S1' UNION SELECT pixel_id, obs_date FROM obs WHERE sensor='S3'""")
def h2_union_dates(spark: SparkSession, d: str) -> DataFrame:
    o = V.obs(spark, d)
    a, b = (o.where(F.col("sensor") == s).select("pixel_id", "obs_date") for s in ("S1", "S3"))
    return a.union(b).distinct()


@query(f"""WITH {GROUND} SELECT site_id, count(*) FILTER (WHERE phase='1-URGENT') urgent, count(*) FILTER (WHERE phase='2-HIGH') high FROM ground GROUP BY 1""")
def i2_pivot(spark: SparkSession, d: str) -> DataFrame:
    p = V.ground(spark, d).groupBy("site_id").pivot("phase", ["1-URGENT", "2-HIGH"]).count().na.fill(0)
    return p.select("site_id", F.col("1-URGENT").alias("urgent"), F.col("2-HIGH").alias("high"))


@query(f"""WITH {OBS} SELECT pixel_id, obs_date, band, value FROM (SELECT pixel_id, obs_date, red, nir, blue FROM obs) UNPIVOT (value FOR band IN (red, nir, blue))""")
def i1_melt(spark: SparkSession, d: str) -> DataFrame:
    return V.obs(spark, d).unpivot(["pixel_id", "obs_date"], ["red", "nir", "blue"], "band", "value")


@query(f"""WITH {OBS} SELECT count(*) n, count(*) FILTER (WHERE snow=0) after_snow, count(*) FILTER (WHERE snow=0 AND nir>2000) after_nir FROM obs""")
def j2_filter_steps(spark: SparkSession, d: str) -> DataFrame:
    return V.obs(spark, d).agg(F.count("*").alias("n"), F.count_if(F.expr("snow = 0")).alias("after_snow"), F.count_if(F.expr("snow = 0 AND nir > 2000")).alias("after_nir"))
