"""Results written by partition: a rerun of a tile and year, or of a layer, replaces only that.

Every write is dynamic partition overwrite, so the job that recomputes one tile-year of a collection does not touch the others, and a
task that is run twice leaves one copy. Rows are dealt by partition and a salt first, so a partition is written by a few tasks, each
with one file for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.phenology import FIELDS

FILL = 32767


def write_partitions(df: DataFrame, path: str, by: list[str], files: int = 8) -> None:
    """Replace the partitions of `by` that df has; each gets up to so many files. No rows change nothing."""
    salt = F.pmod(F.xxhash64(*[c for c in df.columns if c not in by]), F.lit(files))
    d = df.withColumn("_salt", salt).repartition(*by, "_salt").drop("_salt")
    d.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def whole(c: str | Column, fill: int = FILL) -> Column:
    """Rounded half to even; NULL becomes the fill."""
    return F.coalesce(F.bround(F.col(c) if isinstance(c, str) else c, 0).cast("int"), F.lit(fill))


def write_metrics(df: DataFrame, path: str, tile: str = "tile", year: str = "year", key: str = "pixel_id") -> None:
    """The 25 integers of each pixel's yearly record, fill for NULL, by tile and year."""
    write_partitions(df.select(tile, year, key, *[whole(f).alias(f) for f in FIELDS]), path, [tile, year])


def metric_layers(df: DataFrame, land: DataFrame, tile: str = "tile", year: str = "year", key: str = "pixel_id", land_value: int = 2) -> DataFrame:
    """(tile, year, metric, layer, key, value): a row for each metric and cycle; the fill off land. num_cycles has one layer.

    land: (key, mask). A pixel that it lacks is not land.
    """
    names = [f.removesuffix("_1") for f in FIELDS if f.endswith("_1")]
    layers = [F.struct(F.lit("num_cycles").alias("metric"), F.lit(1).alias("layer"), F.col("num_cycles").alias("value"))]
    layers += [F.struct(F.lit(n).alias("metric"), F.lit(c).alias("layer"), F.col(f"{n}_{c}").alias("value")) for n in names for c in (1, 2)]
    d = df.join(land.select(key, "mask"), key, "left").select(tile, year, key, "mask", F.inline(F.array(*layers)))
    return d.select(tile, year, "metric", "layer", key, F.when(F.col("mask") == land_value, whole("value")).otherwise(F.lit(FILL)).alias("value"))


def write_metric_layers(df: DataFrame, path: str, land: DataFrame, tile: str = "tile", year: str = "year", key: str = "pixel_id", land_value: int = 2) -> None:
    """A dataset for each metric, tile and year."""
    write_partitions(metric_layers(df, land, tile, year, key, land_value), path, ["metric", tile, year])


def write_layers(df: DataFrame, path: str, bands: list[str], by: list[str], keys: list[str], scale: float = 1.0, fill: int = FILL) -> None:
    """Any bands as integers: scaled, rounded half to even, fill for NULL."""
    write_partitions(df.select(*by, *keys, *[whole(F.col(b) * scale, fill).alias(b) for b in bands]), path, by)
