"""Queries of the trough cycles, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cycles
from ..sources import views as V
from .queries import SEASON, query, r6

#: A rough daily series: the season with its residuals, ten times.
ROUGH = f"""{SEASON}, x AS (SELECT pixel_id, obs_date, flag, (evi + 10*resid)/1e4 y, evi/1e4 smooth, row_number() OVER (PARTITION BY pixel_id ORDER BY obs_date) i FROM season),
 n AS (SELECT *, lag(y) OVER w a, lead(y) OVER w b FROM x WINDOW w AS (PARTITION BY pixel_id ORDER BY obs_date)),
 top AS (SELECT pixel_id, obs_date - DATE '1970-01-01' t, i, y FROM n WHERE (a IS NULL OR y >= a) AND (b IS NULL OR b < y))"""
FILTERED = f"""{ROUGH}, low AS (SELECT pixel_id, quantile_cont(y, 0.2) low FROM x GROUP BY 1 HAVING max(y) > min(y)),
 kept AS (SELECT pixel_id, list_reduce(list([{{'t': t, 'i': i, 'y': y}}] ORDER BY t), lambda a, p: CASE WHEN p[1].t - a[-1].t >= 60 THEN list_concat(a, p) WHEN p[1].y >= a[-1].y THEN list_concat(a[:-2], p) ELSE a END) ps FROM top JOIN low USING (pixel_id) WHERE y >= low GROUP BY 1)"""


def rough(spark: SparkSession, d: str) -> DataFrame:
    return V.season(spark, d).select("pixel_id", "obs_date", "flag", ((F.col("evi") + 10 * F.col("resid")) / 1e4).alias("y"), (F.col("evi") / 1e4).alias("smooth"))


@query(f"""WITH {FILTERED} SELECT pixel_id, DATE '1970-01-01' + CAST(p.t AS INT) obs_date, p.y AS y FROM (SELECT pixel_id, unnest(ps) p FROM kept)""")
def e3_filter_peaks(spark: SparkSession, d: str) -> DataFrame:
    return cycles.filter_peaks(rough(spark, d), 60, value="y")


@query(f"""WITH {ROUGH}, kept AS (SELECT pixel_id, list_reduce(list([{{'t': t, 'y': y}}] ORDER BY y DESC, t DESC), lambda a, p: CASE WHEN len(list_filter(a, lambda k: abs(k.t - p[1].t) < 90)) > 0 THEN a ELSE list_concat(a, p) END) ps FROM top GROUP BY 1)
 SELECT pixel_id, DATE '1970-01-01' + CAST(p.t AS INT) obs_date, p.y AS y FROM (SELECT pixel_id, unnest(ps) p FROM kept)""")
def e4_filter_peaks_by_magnitude(spark: SparkSession, d: str) -> DataFrame:
    return cycles.filter_peaks_by_magnitude(rough(spark, d), 90, value="y")


_FOLD = "list_reduce(list_concat([{'i': 0, 'amp': 0.0}], list({'i': i, 'amp': amp} ORDER BY %s) FILTER (WHERE amp IS NOT NULL)), lambda best, t: CASE WHEN t.amp >= 0.1 AND t.amp >= 1.15*best.amp THEN t ELSE best END).i"
SEGS = f"""{FILTERED}, pk AS (SELECT pixel_id, k, ps[k].i pi, ps[k].y py, coalesce(ps[k-1].i, 1) before, ps[k+1].i after FROM (SELECT pixel_id, ps, unnest(range(1, len(ps)+1)) k FROM kept)),
 size AS (SELECT pixel_id, max(i) m FROM x GROUP BY 1), pw AS (SELECT pk.*, greatest(1, CASE WHEN k > 1 THEN before ELSE 1 END, pi - 185) lo, least(m, coalesce(after, m), pi + 185) hi FROM pk JOIN size USING (pixel_id)),
 up AS (SELECT pw.pixel_id, k, pi, {_FOLD % 'i DESC'} s FROM pw JOIN (SELECT n.pixel_id, n.i ti, n.i + 1 i, a, n.y, b FROM n) n ON n.pixel_id = pw.pixel_id AND ti BETWEEN lo AND pi AND (ti = lo OR n.y <= a) AND (ti = pi OR b > n.y) LEFT JOIN LATERAL (SELECT py - n.b amp) ON true GROUP BY 1, 2, 3),
 dn AS (SELECT pw.pixel_id, k, {_FOLD % 'i'} e FROM pw JOIN n ON n.pixel_id = pw.pixel_id AND n.i BETWEEN pi AND hi AND (n.i = pi OR n.y <= a) AND (n.i = hi OR b > n.y) LEFT JOIN LATERAL (SELECT py - n.y amp) ON true GROUP BY 1, 2),
 segs AS (SELECT up.pixel_id, row_number() OVER (PARTITION BY up.pixel_id ORDER BY k) seg, s, pi p, e, xs.obs_date AS start, xp.obs_date AS peak, xe.obs_date AS stop, xs.y vs, xp.y vp, xe.y ve
  FROM up JOIN dn USING (pixel_id, k) JOIN x xs ON xs.pixel_id = up.pixel_id AND xs.i = s JOIN x xp ON xp.pixel_id = up.pixel_id AND xp.i = pi JOIN x xe ON xe.pixel_id = up.pixel_id AND xe.i = e WHERE s > 0 AND e > 0)"""


def trough_cycles(spark: SparkSession, d: str, curves: bool = False) -> DataFrame:
    return cycles.segments_trough(rough(spark, d), value="y", curves=curves)


@query(f"""WITH {SEGS} SELECT pixel_id, CAST(seg AS INT) seg, start, peak, stop FROM segs""")
def e6_j5_segments_trough(spark: SparkSession, d: str) -> DataFrame:
    return trough_cycles(spark, d)


@query(f"""WITH {SEGS}, th AS (SELECT 'up' side, unnest([0.0, 0.2, 0.5, 1.0]) threshold UNION ALL SELECT 'down', unnest([0.9, 0.5, 0.0]))
 SELECT pixel_id, seg, side, threshold, min(obs_date) FILTER (WHERE CASE WHEN side = 'up' THEN i <= p AND round(y, 6) >= round(vs + (vp - vs)*threshold, 6) ELSE i >= p AND round(y, 6) <= round(ve + (vp - ve)*threshold, 6) END) AS at
 FROM segs JOIN x USING (pixel_id) CROSS JOIN th WHERE i BETWEEN s AND e GROUP BY 1, 2, 3, 4""")
def e26_segment_dates(spark: SparkSession, d: str) -> DataFrame:
    return cycles.segment_dates(trough_cycles(spark, d, True), None, (0, 0.2, 0.5, 1), (0.9, 0.5, 0), value="y")


_SIDE = "round(1 - sum((raw - smooth)*(raw - smooth)) FILTER (WHERE {w}) / nullif(var_pop(raw) FILTER (WHERE {w}) * count(raw) FILTER (WHERE {w}), 0), 6) {s}_r2, round(count(*) FILTER (WHERE {w} AND seen AND raw IS NULL) / nullif(count(*) FILTER (WHERE {w} AND seen), 0), 6) {s}_missing, count(*) FILTER (WHERE {w} AND seen AND flag = 4) {s}_snow"


@query(f"""WITH {SEGS}, r AS (SELECT *, i % 3 = 0 seen, CASE WHEN i % 3 = 0 AND flag <> 1 THEN y END raw FROM x)
 SELECT pixel_id, seg, round(min(smooth), 6) seg_min, round(max(smooth), 6) seg_max, round(sum(smooth) - count(*)*min(smooth), 6) seg_int, {_SIDE.format(w='i <= p', s='up')}, {_SIDE.format(w='i >= p', s='down')} FROM segs JOIN r USING (pixel_id) WHERE i BETWEEN s AND e GROUP BY 1, 2""")
def e25_segment_fit_stats(spark: SparkSession, d: str) -> DataFrame:
    s = rough(spark, d).withColumn("i", F.datediff("obs_date", F.lit("1998-12-31")) - (F.col("obs_date") > "2000-12-30").cast("int"))  # the last day of 2000 is left out
    raw = s.where("i % 3 = 0").select("pixel_id", "obs_date", F.when(F.col("flag") != 1, F.col("y")).alias("y"), (F.col("flag") == 4).alias("snow"))
    out = cycles.segment_fit_stats(trough_cycles(spark, d), raw, s, value="y")
    return out.select("pixel_id", "seg", *[r6(F.col(c)).alias(c) for c in ("seg_min", "seg_max", "seg_int", "up_r2", "up_missing", "down_r2", "down_missing")], "up_snow", "down_snow")


@query(f"""WITH {SEGS} SELECT pixel_id, seg, round(vp - vs, 6) amplitude FROM segs""")
def e33_segment_amplitude(spark: SparkSession, d: str) -> DataFrame:
    return cycles.segment_amplitude(trough_cycles(spark, d, True), None, value="y").withColumn("amplitude", r6(F.col("amplitude")))


@query()
def e5_j5_segments_cycle(spark: SparkSession, d: str) -> DataFrame:
    return cycles.segments_cycle(rough(spark, d), value="smooth")


_UP, _DOWN = (("ogi", 0.15), ("midgup", 0.5), ("mat", 0.9)), (("sen", 0.9), ("midgdown", 0.5), ("dor", 0.15))
_NAMES = ("ogi", "midgup", "mat", "peak", "sen", "midgdown", "dor")


def _metrics_sql(falls: str, filled: str, sides: str) -> str:
    """mt: places of the dates; q: fill and r2 of each window of days."""
    up = ", ".join(f"min(i) FILTER (WHERE i <= p AND round(y, 6) >= round(vs + {f}*(vp - vs), 6)) {n}" for n, f in _UP)
    down = ", ".join(falls.format(f=f) + f" {n}" for n, f in _DOWN)
    near = " UNION ALL ".join(f"SELECT pixel_id, seg, '{n}' AS name, greatest({n} - 14, 0) a, least({n} + 14, m) b, b - a + 1 AS n FROM mt JOIN size USING (pixel_id)" for n in _NAMES)
    return f"""{SEGS}, mt AS (SELECT pixel_id, seg, s, p, p AS peak, e, start, segs.peak AS top, stop, vs, vp, {up}, {down}, sum(greatest(y - vs, 0)) FILTER (WHERE i <= p) area FROM segs JOIN x USING (pixel_id) WHERE i BETWEEN s AND e GROUP BY ALL),
 win AS ({near} UNION ALL {sides}), q AS (SELECT pixel_id, seg, name, count(*) FILTER (WHERE {filled}) / nullif(CAST(n AS DOUBLE), 0) fill, CASE WHEN min(y) < max(y) AND min(smooth) < max(smooth) THEN pow(corr(y, smooth), 2) END r2 FROM win JOIN x USING (pixel_id) WHERE i BETWEEN a AND b GROUP BY pixel_id, seg, name, n),
 dated AS (SELECT mt.pixel_id, seg, round(vs, 6) evi_min, round(vp - vs, 6) evi_amp, round(area, 6) evi_area, {', '.join(f'(SELECT obs_date FROM x WHERE x.pixel_id = mt.pixel_id AND x.i = mt.{n}) AS {n}' for n in _NAMES)}, mt.top - mt.start AS length_gup, mt.stop - mt.top AS length_gdown FROM mt)"""


def _measured(spark: SparkSession, d: str, detailed: bool) -> DataFrame:
    s = rough(spark, d).withColumn("resid", F.col("smooth") - F.col("y"))
    out = cycles.segment_metrics(trough_cycles(spark, d), s, detailed=detailed, value="y")
    return out.withColumns({k: r6(F.col(k)) for k, t in out.dtypes if t == "double"})


_SCORE = "coalesce(3 - least(3, greatest(0, CAST(floor(4 * round((4*(1 - fill) + r2)/5, 12)) AS INT))), 3)"


@query(f"""WITH {_metrics_sql("max(i) FILTER (WHERE i >= p AND round(y, 6) >= round(ve + {f}*(vp - ve), 6))", "flag NOT IN (0, 1, 2)", "SELECT pixel_id, seg, 'all', s, e, e - s FROM mt")}
 SELECT dated.* EXCLUDE (length_gup, length_gdown), overall_qa, detailed_qa FROM dated JOIN (SELECT pixel_id, seg, CAST(max({_SCORE}) FILTER (WHERE name = 'all') AS INT) overall_qa, CAST(sum({_SCORE} * CASE name {' '.join(f"WHEN '{n}' THEN {4**j}" for j, n in enumerate(_NAMES))} ELSE 0 END) AS INT) detailed_qa FROM q GROUP BY 1, 2) USING (pixel_id, seg)""")
def e23_segment_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _measured(spark, d, False)


@query(f"""WITH {_metrics_sql("min(i) FILTER (WHERE i >= p AND round(y, 6) <= round(ve + {f}*(vp - ve), 6))", "flag NOT IN (0, 2)", "SELECT pixel_id, seg, 'gup', s, p, top - start FROM mt UNION ALL SELECT pixel_id, seg, 'gdown', p, e, stop - top FROM mt")}
 SELECT dated.*, {', '.join(f"(SELECT round({x}, 6) FROM q WHERE q.pixel_id = dated.pixel_id AND q.seg = dated.seg AND name = '{side}') AS {y}_{side}" for side in ('gup', 'gdown') for x, y in (('fill', 'frac_filled'), ('r2', 'spline_r2')))}, {', '.join(f"(SELECT round((4*(1 - fill) + r2)/5, 6) FROM q WHERE q.pixel_id = dated.pixel_id AND q.seg = dated.seg AND name = '{n}') AS {n}_qual" for n in _NAMES)} FROM dated""")
def e24_segment_metrics_detailed(spark: SparkSession, d: str) -> DataFrame:
    return _measured(spark, d, True)
