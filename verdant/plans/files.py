"""Queries that write and read back, and the SQL of the rows that come back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import phenology
from ..sources import sinks
from ..sources import views as V
from ..sources.folders import shared_folder
from .queries import OBS, query

TILE = "'h' || lpad(CAST(s_nationkey AS VARCHAR(9)), 2, '0') || 'v' || lpad(CAST(s_suppkey % 18 AS VARCHAR(9)), 2, '0')"
#: A record for each supplier: its balance and name stand for the metrics, NULL in every fifth.
NAMES = [f.removesuffix("_1") for f in phenology.FIELDS if f.endswith("_1")]


def records(spark: SparkSession, d: str) -> DataFrame:
    s = V.table(spark, d, "supplier")
    val = lambda k, c: F.when(F.col("s_suppkey") % (4 + k % 3) != c, F.col("s_acctbal") / (k + 1) + c)
    return s.select(
        V.tile_of(F.col("s_suppkey"), F.col("s_nationkey")).alias("tile"), (2000 + F.col("s_suppkey") % 2).cast("int").alias("year"), F.col("s_suppkey").alias("pixel_id"), (F.col("s_suppkey") % 3).alias("num_cycles"),
        *[val(k, c).alias(f"{n}_{c}") for c in (1, 2) for k, n in enumerate(NAMES)])


VAL = "CASE WHEN s_suppkey % {m} <> {c} THEN CAST(round_even(CAST(s_acctbal AS DOUBLE) / {k} + {c}, 0) AS INT) END"


def value(k: int, c: int) -> str:
    return VAL.format(m=4 + k % 3, c=c, k=k + 1)


@query(f"""SELECT {TILE} AS tile, CAST(2000 + s_suppkey % 2 AS INT) AS year, s_suppkey pixel_id, CAST(s_suppkey % 3 AS INT) num_cycles, {', '.join(f'coalesce({value(k, c)}, 32767) {n}_{c}' for c in (1, 2) for k, n in enumerate(NAMES))} FROM supplier""")
def a9_write_metrics(spark: SparkSession, d: str) -> DataFrame:
    folder, r = shared_folder(spark), records(spark, d)
    sinks.write_metrics(r.withColumns({f: F.lit(-1) for f in phenology.FIELDS}), folder)
    sinks.write_metrics(r, folder)  # again: the rows of before are replaced
    out = spark.read.parquet(folder)
    return out.select("tile", "year", "pixel_id", *phenology.FIELDS)


_LAYERS = " UNION ALL ".join(f"SELECT s_suppkey, s_nationkey, '{n}' metric, {c} layer, {value(k, c)} v FROM supplier" for k, n in enumerate(NAMES) for c in (1, 2))


@query(f"""WITH l AS (SELECT s_suppkey, s_nationkey, 'num_cycles' metric, 1 layer, CAST(s_suppkey % 3 AS INT) v FROM supplier UNION ALL {_LAYERS})
 SELECT metric, {TILE} AS tile, CAST(2000 + s_suppkey % 2 AS INT) AS year, layer, s_suppkey pixel_id, CASE WHEN p_size % 3 = 2 THEN coalesce(v, 32767) ELSE 32767 END AS value FROM l LEFT JOIN part ON p_partkey = s_suppkey""")
def a10_write_metric_layers(spark: SparkSession, d: str) -> DataFrame:
    folder = shared_folder(spark)
    land = V.table(spark, d, "part").select(F.col("p_partkey").alias("pixel_id"), (F.col("p_size") % 3).alias("mask"))
    sinks.write_metric_layers(records(spark, d), folder, land)
    return spark.read.parquet(folder)


@query(f"""WITH {OBS}, b AS (SELECT sensor, CAST(year(obs_date) AS INT) AS year, pixel_id, avg(red) red, avg(CASE WHEN snow = 0 THEN nir END) nir FROM obs GROUP BY 1, 2, 3)
 SELECT sensor, year, pixel_id, coalesce(CAST(round_even(red*0.1, 0) AS INT), 32767) red, coalesce(CAST(round_even(nir*0.1, 0) AS INT), 32767) nir FROM b""")
def a11_write_layers(spark: SparkSession, d: str) -> DataFrame:
    folder = shared_folder(spark)
    b = V.obs(spark, d).groupBy("sensor", F.year("obs_date").alias("year"), "pixel_id").agg(F.avg("red").alias("red"), F.avg(F.when(F.col("snow") == 0, F.col("nir"))).alias("nir"))
    sinks.write_layers(b, folder, ["red", "nir"], ["sensor", "year"], ["pixel_id"], 0.1)
    return spark.read.parquet(folder)
