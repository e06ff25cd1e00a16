"""Joins between observation tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest_date(a: DataFrame, b: DataFrame, max_diff: int | None, key: str = "pixel_id", day: str = "obs_date", tie: str = "min") -> DataFrame:
    """For each (key, day) of a, the closest day of b within max_diff days as `match`, or NULL; of equals the earlier one, or with tie='max' the later one.

    Days of b go into bins of max_diff days; each day of a asks three bins, so the join is an equi-join. Without a limit the days of both
    stand in one order, and each takes the last one before and the first one after.
    """
    a1, later = a.select(key, day).distinct(), tie == "max"
    gap = F.abs(F.datediff("other", day))
    best = F.min(F.struct(gap.alias("gap"), (-F.unix_date("other") if later else F.unix_date("other")).alias("_o"), "other"))
    if max_diff is None:
        both = a1.withColumn("_own", F.lit(None).cast("date")).unionByName(b.select(key, day).distinct().withColumn("_own", F.col(day)))
        w = Window.partitionBy(key).orderBy(day)
        before, after = F.last("_own", True).over(w.rangeBetween(Window.unboundedPreceding, 0)), F.first("_own", True).over(w.rangeBetween(0, Window.unboundedFollowing))
        asked = both.withColumns({"_a": before, "_b": after}).where("_own IS NULL").select(key, day, F.explode(F.array("_a", "_b")).alias("other")).where("other IS NOT NULL")
        found = asked.groupBy(key, day).agg(best.alias("m"))
    else:
        bin_of = lambda c: F.floor(F.unix_date(c) / max(max_diff, 1))
        ask = a1.withColumn("bin", F.explode(F.array(*[bin_of(F.col(day)) + k for k in (-1, 0, 1)])))
        have = b.select(key, F.col(day).alias("other")).distinct().withColumn("bin", bin_of(F.col("other")))
        found = ask.join(have, [key, "bin"]).where(gap <= max_diff).groupBy(key, day).agg(best.alias("m"))
    return a1.join(found, [key, day], "left").select(key, day, F.col("m.other").alias("match"))


def missing(expected: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    return expected.join(existing, keys, "left_anti")


def latest(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    """df with its rank among versions: 1 is current, the others are superseded."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(version))))


def expand_tasks(a: DataFrame, *dims: DataFrame) -> DataFrame:
    """All combinations of tasks, years, products and the like: the product is what is asked for. Which side is sent, Spark decides by size."""
    for d in dims:
        a = a.crossJoin(d)
    return a


def pair_same_date(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("pixel_id", "obs_date")) -> DataFrame:
    return a.join(b, [*keys])


def cell_map_join(fine: DataFrame, cells: DataFrame, coarse: DataFrame, on: str = "pixel_id", cell: str = "cell", day: str = "obs_date") -> DataFrame:
    """Each fine row with the values of the coarse cell that covers it; the map is (on, cell)."""
    return fine.join(cells, on).join(coarse, [cell, day])


def disaggregate(df: DataFrame, fact: int = 2, row: str = "row", col: str = "col") -> DataFrame:
    """Each cell as fact x fact cells of the finer grid."""
    steps = F.sequence(F.lit(0), F.lit(fact - 1))
    d = df.withColumn("_i", F.explode(steps)).withColumn("_j", F.explode(steps))
    return d.withColumn(row, F.col(row) * fact + F.col("_i")).withColumn(col, F.col(col) * fact + F.col("_j")).drop("_i", "_j")


def complete_calendar(df: DataFrame, days: DataFrame, key: str = "pixel_id", day: str = "obs_date", fills: dict | None = None) -> DataFrame:
    """A row for each key and day; absent ones are NULL but for fills."""
    out = expand_tasks(df.select(key).distinct(), days.select(day)).join(df, [key, day], "left")
    return out.na.fill(fills) if fills else out


def merge_products(a: DataFrame, b: DataFrame, x: str, y: str, keys: tuple[str, ...] = ("pixel_id", "obs_date"), expected: DataFrame | None = None, done: DataFrame | None = None) -> DataFrame:
    """Full join with a status: 0 both, 1 the first only, 2 the second only; 3 neither, of the expected keys; 4 already done, whatever there is."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    d = a.join(b, [*keys], "full")
    if expected is not None:
        d = d.join(expected.select(*keys).distinct(), [*keys], "full")
    status = F.when(both, 0).when(F.col(x).isNotNull(), 1).when(F.col(y).isNotNull(), 2).otherwise(3)
    if done is not None:
        d = d.join(done.select(*keys).distinct().withColumn("_done", F.lit(True)), [*keys], "left")
        status = F.when(F.col("_done"), 4).otherwise(status)
    return d.withColumn("status", status).drop("_done")


def compare_products(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Paired values and their difference."""
    return a.select(*keys, F.col(value).alias("x")).join(b.select(*keys, F.col(value).alias("y")), keys).withColumn("difference", F.col("x") - F.col("y"))


def class_params_join(pixels: DataFrame, classes: DataFrame, on: str = "class") -> DataFrame:
    """Parameters of each pixel's class; the class table is left to the optimizer to broadcast by its size."""
    return pixels.join(classes, on, "left")


def extract_at_sites(obs: DataFrame, sites: DataFrame, on: str = "pixel_id") -> DataFrame:
    return obs.join(sites.select(on).distinct(), on, "left_semi")


def tiles_intersecting(scenes: DataFrame, tiles: DataFrame, size: float) -> DataFrame:
    """Pairs of overlapping boxes (x0, x1, y0, y1 of scenes; tx0, tx1, ty0, ty1 of tiles, each at most size wide), by bins of size: an equi-join.

    A pair counts only in the bin of the lower left corner of its overlap, so it comes once and no pairs are shuffled.
    """
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / size), F.floor(F.col(b) / size)))
    s = scenes.withColumn("_bx", cells("x0", "x1")).withColumn("_by", cells("y0", "y1"))
    t = tiles.withColumn("_bx", cells("tx0", "tx1")).withColumn("_by", cells("ty0", "ty1"))
    hit = s.join(t, ["_bx", "_by"]).where("x0 <= tx1 AND x1 >= tx0 AND y0 <= ty1 AND y1 >= ty0")
    corner = lambda a, b: F.floor(F.greatest(a, b) / size)
    return hit.where((F.col("_bx") == corner("x0", "tx0")) & (F.col("_by") == corner("y0", "ty0"))).drop("_bx", "_by")


def coverage_check(pairs: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """pairs with `present`, whether an output exists."""
    have = existing.select(*keys).distinct().withColumn("_have", F.lit(True))
    return pairs.join(have, keys, "left").withColumn("present", F.coalesce("_have", F.lit(False))).drop("_have")


def assemble_three_years(a: DataFrame, b: DataFrame, c: DataFrame, year: int, key: str = "pixel_id", day: str = "obs_date") -> DataFrame:
    """Three layers of year-1 to year+1 side by side; pixels that lack one of the nine parts are left out."""
    def layer(df: DataFrame) -> DataFrame:
        d = df.where(F.year(day).between(year - 1, year + 1))
        whole = d.groupBy(key).agg(F.count_distinct(F.year(day)).alias("_y")).where("_y = 3").select(key)
        return d.join(whole, key, "left_semi")

    return layer(a).join(layer(b), [key, day]).join(layer(c), [key, day])


def long_to_packed(df: DataFrame, values: list[str], key: str = "pixel_id", day: str = "obs_date") -> DataFrame:
    return df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(day, *values))).alias("series"))


def packed_to_long(df: DataFrame, key: str = "pixel_id") -> DataFrame:
    return df.select(key, F.inline("series"))


def long_to_wide(df: DataFrame, bands: list[str], days: list, key: str = "pixel_id", day: str = "obs_date") -> DataFrame:
    """A row for each key with a column YYYYDDD_band for each of the given days and bands; NULL where there is no row."""
    d = df.select(key, F.date_format(day, "yyyyDDD").alias("_d"), *bands)
    names = sorted({f"{t:%Y%j}" for t in days})
    wide = d.groupBy(key).pivot("_d", names).agg(*[F.first(b, True).alias(b) for b in bands])
    return wide.withColumnsRenamed({n: f"{n}_{bands[0]}" for n in names}) if len(bands) == 1 else wide


def wide_to_long(df: DataFrame, bands: list[str], key: str = "pixel_id", day: str = "obs_date") -> DataFrame:
    """Back from columns YYYYDDD_band: a row for each key and day on which some band has a value."""
    names = sorted({c.split("_", 1)[0] for c in df.columns if re.fullmatch(r"[0-9]{7}_.+", c)})
    have = set(df.columns)
    each = [F.struct(F.to_date(F.lit(n), "yyyyDDD").alias(day), *[(F.col(f"{n}_{b}") if f"{n}_{b}" in have else F.lit(None)).alias(b) for b in bands]) for n in names]
    return df.select(key, F.inline(F.array(*each))).where(" OR ".join(f"{b} IS NOT NULL" for b in bands))
