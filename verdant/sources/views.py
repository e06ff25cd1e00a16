"""Observation views over the star-schema tables: each stands for an input of the engine."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-sensor observations with quality bits; a pixel, date and sensor can repeat."""
    t = table(spark, sf_dir, "lineitem")
    whole = lambda c: F.round(c).cast("int")
    return t.select(
        F.col("l_suppkey").alias("pixel_id"), F.col("l_shipdate").cast("date").alias("obs_date"),
        F.when(F.col("l_returnflag") == "A", "S1").when(F.col("l_returnflag") == "N", "S2").otherwise("S3").alias("sensor"),
        whole(F.col("l_discount") * 10000).alias("red"), whole(1000 + F.col("l_quantity") * 80).alias("nir"),
        whole(F.col("l_tax") * 10000).alias("blue"), whole(500 + F.col("l_tax") * 10000).alias("green"),
        (200 + F.col("l_orderkey") % 1500).cast("int").alias("swir"), (F.col("l_partkey") % 2048).cast("int").alias("qa"),
        (F.col("l_linestatus") == "O").cast("int").alias("snow"))


def days(spark: SparkSession, first: date, last: date, day: str = "obs_date") -> DataFrame:
    """Each day from first to last, as a range: Spark knows how many there are, so what is crossed with them is not taken for small and broadcast."""
    return spark.range((last - first).days + 1).select(F.date_add(F.lit(first), F.col("id").cast("int")).alias(day))


def calendar(spark: SparkSession, first: str = "1999-01-01", last: str = "2001-12-31") -> DataFrame:
    """Days of 365-day years: the last day of leap years is left out."""
    return days(spark, date.fromisoformat(first), date.fromisoformat(last)).withColumn("doy", F.dayofyear("obs_date")).where("doy <= 365")


def season(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One value for each pixel and day of three years; every third pixel has two cycles."""
    s, doy = F.col("s_suppkey"), F.col("doy")
    d = table(spark, sf_dir, "supplier").select("s_suppkey").crossJoin(F.broadcast(calendar(spark)))  # 1,095 days
    wave = 3000 + (1200 + 100 * (s % 7)) * F.sin((doy - 80 - s % 40) * F.lit(0.017214206))
    wave = wave + F.when(s % 3 == 0, 900 * F.sin((doy - 30) * F.lit(0.034428413))).otherwise(0)
    flag = F.when(doy <= 40, 4).when(doy % 9 == 0, 1).otherwise(0)
    return d.select(s.alias("pixel_id"), "obs_date", F.round(wave).cast("int").alias("evi"), ((s * 31 + doy * 17) % 41 - 20).cast("int").alias("resid"), flag.alias("flag"))


def annual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median day (0-based) of each pixel and year."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    d = o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_nationkey").alias("pixel_id"), F.year("o_orderdate").alias("yr"))
    return d.agg(F.median((F.dayofyear("o_orderdate") - 1).cast("double")).alias("doy0"), F.count("*").alias("n"))


def ground(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.dayofyear("o_orderdate")
    return table(spark, sf_dir, "orders").select((F.col("o_custkey") % 200).alias("site_id"), F.year("o_orderdate").alias("obs_year"), F.col("o_orderpriority").alias("phase"), day.alias("first_yes"), (day + F.col("o_orderkey") % 60).cast("int").alias("last_yes"))


def tile_of(pixel: Column, nation: Column) -> Column:
    return F.concat(F.lit("h"), F.lpad(nation.cast("string"), 2, "0"), F.lit("v"), F.lpad((pixel % 18).cast("string"), 2, "0"))
