"""Queries that run streams over the events, and the SQL of the batches that they equal. Rows newer than the last watermark wait."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import views as V
from ..streaming import composite, stateful
from .queries import query, r6

LATE = "5 days"
DUE = "e.ts <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 5 DAY"
#: Steps of each user: of equal times the largest value counts.
STEPS = f"s AS (SELECT user_id pixel_id, date_trunc('millisecond', ts) ts, max(value) y, row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('millisecond', ts)) i FROM events e WHERE {DUE} GROUP BY 1, 2)"


def events(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream of files."""
    schema = V.table(spark, d, "events").schema
    return composite.observations(spark, d, schema, name="events.parquet").withColumnRenamed("user_id", "pixel_id").withColumn("ts", F.date_trunc("millisecond", "ts"))


def plain(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c, t in df.dtypes if t == "timestamp"})


@query(f"""WITH RECURSIVE {STEPS}, v AS (SELECT *, 1 + CAST(floor(y) AS INT) % 3 k, y/100 u FROM s), w AS (SELECT *, [3.0, 0.5, 0.0][k]*8 rw, [1.1, 1, 1][k]::DOUBLE c, [0.8, 1, 1][k]::DOUBLE b FROM v),
 f AS (SELECT pixel_id, i, ts, 0.0::DOUBLE est, 0.0::DOUBLE x, 5.0::DOUBLE p FROM w WHERE i = 1
  UNION ALL SELECT pixel_id, i, ts, est, est + b*u, p - g*c*p + 0.5 FROM (SELECT w.*, f.p, f.p*c/(c*f.p*c + rw) g, f.x + f.p*c/(c*f.p*c + rw)*(y - c*f.x) est FROM f JOIN w ON w.pixel_id = f.pixel_id AND w.i = f.i + 1))
 SELECT pixel_id, ts, round(est, 6) mean FROM f""")
def k1_k2_online_quality(spark: SparkSession, d: str) -> DataFrame:
    stream = lambda s: stateful.online_quality(events(s, d).withColumns({"qa": 1 + F.floor("value") % 3, "signal": F.col("value") / 100}), LATE)
    return plain(stateful.collected(spark, stream)).withColumn("mean", r6(F.col("mean")))


@query(f"""WITH RECURSIVE {STEPS}, f AS (SELECT pixel_id, i, ts, 1.01/(1.01+0.05)*y m, (1 - 1.01/(1.01+0.05))*1.01 c FROM s WHERE i = 1
  UNION ALL SELECT s.pixel_id, s.i, s.ts, f.m + (f.c+0.01)/(f.c+0.01+0.05)*(y - f.m), (1 - (f.c+0.01)/(f.c+0.01+0.05))*(f.c+0.01) FROM f JOIN s ON s.pixel_id = f.pixel_id AND s.i = f.i + 1)
 SELECT pixel_id, ts, round(m, 6) mean, round(c, 6) variance FROM f""")
def k3_online_scalar(spark: SparkSession, d: str) -> DataFrame:
    return plain(stateful.collected(spark, lambda s: stateful.online_scalar(events(s, d), LATE))).withColumns({c: r6(F.col(c)) for c in ("mean", "variance")})


@query("""WITH v AS (SELECT user_id pixel_id, CAST(ts AS DATE) AS day, event_id AS version, max(event_id) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) before FROM events)
 SELECT pixel_id, day, version, CASE WHEN before IS NULL THEN 'new' WHEN version > before THEN 'superseding' ELSE 'stale' END AS action, CASE WHEN version > before THEN before END superseded FROM v""")
def k5_superseding_versions(spark: SparkSession, d: str) -> DataFrame:
    return stateful.collected(spark, lambda s: stateful.latest_versions(events(s, d).withColumnRenamed("event_id", "version"), LATE))


@query("""WITH t AS (SELECT user_id pixel_id, date_trunc('millisecond', max(ts)) ts FROM events GROUP BY 1), m AS (SELECT max(ts) top FROM t)
 SELECT pixel_id, ts, ts + INTERVAL 12 HOUR alarm_at FROM t, m WHERE ts + INTERVAL 12 HOUR <= top - INTERVAL 5 HOUR""")
def k7_gap_alarm(spark: SparkSession, d: str) -> DataFrame:
    return plain(stateful.collected(spark, lambda s: stateful.gap_alarm(events(s, d), "5 hours", 0.5)))


@query("""SELECT CAST(date_trunc('year', ts) + INTERVAL 1 DAY * (7 * ((dayofyear(ts) - 1) // 7)) AS TIMESTAMP) AS week, user_id, round(avg(value), 6) mean_value, count(*) n FROM events WHERE value <> 0 GROUP BY 1, 2""")
def k4_weekly_composite(spark: SparkSession, d: str) -> DataFrame:
    """The weeks of a stream that ends before their state goes are those of the table."""
    stream = lambda s: composite.weekly(composite.observations(s, d, V.table(spark, d, "events").schema, name="events.parquet"))
    return plain(stateful.collected(spark, stream)).withColumn("mean_value", r6(F.col("mean_value")))


@query()
def k6_online_forecast(spark: SparkSession, d: str) -> DataFrame:
    return plain(stateful.collected(spark, lambda s: stateful.online_forecast(events(s, d), LATE, 0.5)))
