"""Streams of observations, and weekly composites of streams and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def observations(spark: SparkSession, path: str, schema: str | StructType, files: int | None = None, name: str | None = None) -> DataFrame:
    """New files of a Parquet directory, `files` of them in a batch at most, only those named so if given; ts becomes a timestamp, which watermarks need."""
    r = spark.readStream.schema(schema)
    if files:
        r = r.option("maxFilesPerTrigger", files)
    if name:
        r = r.option("pathGlobFilter", name)
    return r.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def week_start(ts: Column) -> Column:
    """The day on which a week begins: weeks are counted from the first of January, so the last one of a year is short."""
    return F.date_add(F.trunc(ts, "year"), (F.floor((F.dayofyear(ts) - 1) / 7) * 7).cast("int")).cast("timestamp")


def weekly(df: DataFrame, late: str = "21 days") -> DataFrame:
    """(week, user_id, mean_value, n) of each pixel and week of the year, 0 counting as missing.

    On a stream the state of a week goes once a week that begins `late` after its own start has been seen, so rows may be late by that
    less a week.
    """
    d = df.where("value <> 0").withColumn("week", week_start(F.col("ts")))
    d = d.withWatermark("week", late) if df.isStreaming else d
    return d.groupBy("week", "user_id").agg(F.avg("value").alias("mean_value"), F.count("*").alias("n"))
