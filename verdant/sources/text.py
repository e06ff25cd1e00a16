"""Text sources: daily flux tables, site lists, parameter files."""

from __future__ import annotations

import dataclasses
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

P = TypeVar("P")


def read_flux_csv(spark: SparkSession, path: str, time: str = "TIMESTAMP", value: str = "GPP", weight: str | None = None) -> DataFrame | None:
    """(obs_date, value, weight) of daily tables with a header; -9999 and 9999 are NULL, the weight is 1 without a column for it. None if a column is absent."""
    d = spark.read.csv(path, header=True)
    if not {time, value, *([weight] if weight else [])} <= set(d.columns):
        return None

    def number(c: str):  # noqa: ANN202
        x = F.col(f"`{c}`").try_cast("double")
        return F.when(~x.isin(-9999.0, 9999.0), x)

    return d.select(F.try_to_timestamp(F.col(f"`{time}`"), F.lit("yyyyMMdd")).cast("date").alias("obs_date"), number(value).alias("value"), (number(weight) if weight else F.lit(1.0)).alias("weight"))


def read_sites(spark: SparkSession, path: str, sep: str = "|") -> DataFrame:
    """(site_id, lat, lon) of a separated list with a header that has these names, in any order and case; rows without both coordinates are left out."""
    d = spark.read.csv(path, sep=sep, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    by = {c.lower(): c for c in d.columns}
    pick = lambda *names: F.col(f"`{next(by[n] for n in names if n in by)}`")
    d = d.select(pick("site_id", "site", "id").alias("site_id"), pick("lat", "latitude").try_cast("double").alias("lat"), pick("lon", "long", "longitude").try_cast("double").alias("lon"))
    return d.where("lat IS NOT NULL AND lon IS NOT NULL")


def parameters(lines: DataFrame) -> DataFrame:
    """(name, value) of lines `name = value # comment` in a column value; NA and NULL in either case have no value, other text is no number and neither has."""
    line = F.regexp_replace("value", "#.*$", "")
    d = lines.select(F.trim(F.regexp_extract(line, r"^([^=]*)=", 1)).alias("name"), F.trim(F.regexp_extract(line, r"=([^=]*)$", 1)).alias("value")).where("name <> '' AND value <> ''")
    return d.select("name", F.col("value").try_cast("double").alias("value"))


def read_params(spark: SparkSession, path: str, default: P) -> P:
    """A copy of a dataclass with the file's values; unknown names are ignored, unnamed fields keep their defaults, and of a repeated name the last counts."""
    text = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("i", "value"))
    rows = text.select("i", "value").orderBy("i")
    known = {f.name: f for f in dataclasses.fields(default)}
    found = parameters(rows).where(F.col("name").isin(*known)).collect()  # a line for each field, a few in all
    new = {}
    for r in found:
        old = getattr(default, r["name"])
        if isinstance(old, (int, float, type(None))) and not isinstance(old, bool):
            new[r["name"]] = None if r["value"] is None else int(r["value"]) if isinstance(old, int) else r["value"]
    return dataclasses.replace(default, **new)
