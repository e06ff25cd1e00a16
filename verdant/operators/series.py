"""Operators on the ordered series of a pixel, as windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order(key: str = "pixel_id", day: str = "obs_date") -> Window:
    return Window.partitionBy(key).orderBy(day)


def peaks(df: DataFrame, value: str = "evi", key: str = "pixel_id", day: str = "obs_date") -> DataFrame:
    """(key, day, value) of each peak: a run of equal values above both neighbours, dated in its middle (half to even)."""
    w = order(key, day)
    d = df.select(key, day, value, (F.coalesce(F.col(value) != F.lag(value).over(w), F.lit(True))).cast("int").alias("new"))
    d = d.withColumn("run", F.sum("new").over(w))
    runs = d.groupBy(key, "run").agg(F.first(value).alias(value), F.sort_array(F.collect_list(day)).alias("days"))  # a run is part of a series
    r = Window.partitionBy(key).orderBy("run")
    top = runs.withColumn("a", F.lag(value).over(r)).withColumn("b", F.lead(value).over(r)).where(f"{value} > a AND {value} > b")
    return top.select(key, F.get("days", F.bround((F.size("days") - 1) / 2, 0).cast("int")).alias(day), value)


def interpolate(value: str, key: str, day: str) -> Column:
    """Linear in time over interior NULLs; the ends stay NULL. Values ahead are those behind in the order from the last day, as a frame that reaches to the end is read anew for each row."""
    back = order(key, day).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(key).orderBy(F.desc(day)).rowsBetween(Window.unboundedPreceding, 0)
    t = F.when(F.col(value).isNotNull(), F.col(day))
    (x0, x1), (t0, t1) = ((F.last(c, True).over(back), F.last(c, True).over(ahead)) for c in (value, t))
    return F.coalesce(F.col(value), x0 + (x1 - x0) * F.datediff(F.col(day), t0) / F.nullif(F.datediff(t1, t0), F.lit(0)))


def despike(df: DataFrame, value: str, key: str = "pixel_id", day: str = "obs_date", ratio: float = 2.0, least: float = 0.0) -> DataFrame:
    """Adds `spike`: a fall against the mean of both non-null neighbours that is large beside their difference."""
    w = order(key, day)
    a = F.last(value, True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    b = F.first(value, True).over(w.rowsBetween(1, Window.unboundedFollowing))
    dev = F.col(value) - (b - a) / 2 - a
    return df.withColumn("spike", F.coalesce((dev < 0) & (F.abs(dev) > least) & (F.abs(dev) > ratio * F.abs(b - a)), F.lit(False)))


def longest_gap(df: DataFrame, value: str, key: str = "pixel_id", day: str = "obs_date", max_span: int | None = None) -> DataFrame:
    """(key, longest_gap) of series with NULLs, the most of them in a row. With max_span: all series, 0 where none is missing, and usable, whether no gap is longer."""
    w = order(key, day)
    d = df.withColumn("g", F.count(value).over(w)).where(F.col(value).isNull())
    d = d.groupBy(key, "g").agg(F.count("*").alias("n")).groupBy(key).agg(F.max("n").alias("longest_gap"))
    if max_span is None:
        return d
    d = df.select(key).distinct().join(d, key, "left").withColumn("longest_gap", F.coalesce("longest_gap", F.lit(0)))
    return d.withColumn("usable", F.col("longest_gap") <= max_span)


def local_extrema(value: str, key: str = "pixel_id", day: str = "obs_date", minima: bool = False, partial: bool = False) -> Column:
    """Where the direction turns: the last row of a top (bottom), flat or not; the ends count only if partial.

    Partial: the first row is a top if the next is lower, the last one if none before it is higher. NULL values are no extrema.
    """
    w, x = order(key, day), F.col(value)
    up, down = x - F.lag(value).over(w), F.lead(value).over(w) - x
    first, last = F.row_number().over(w) == 1, F.lead(F.lit(True)).over(w).isNull()
    before, after = (up <= 0, down > 0) if minima else (up >= 0, down < 0)
    if partial:
        before, after = before | first, after | last
    return F.coalesce(before & after & x.isNotNull(), F.lit(False))


def cross_threshold(df: DataFrame, value: str, level: Column, key: str = "pixel_id", day: str = "obs_date") -> DataFrame:
    """(key, rise_first, rise_last, fall_first, fall_last): the first day at or above the level and the last at or below it; the first at or below it and the last at or above it. Both sides to six decimals."""
    x, t = F.round(value, 6), F.round(level, 6)
    above, below = F.when(x >= t, F.col(day)), F.when(x <= t, F.col(day))
    return df.groupBy(key).agg(F.min(above).alias("rise_first"), F.max(below).alias("rise_last"), F.min(below).alias("fall_first"), F.max(above).alias("fall_last"))


def crossing_dates(df: DataFrame, value: str, up: float, down: float, key: str = "pixel_id", day: str = "obs_date") -> DataFrame:
    """(key, peak, rise, fall) around the global maximum, at fractions of each side's own amplitude; the fall starts after the peak."""
    top = df.groupBy(key).agg(F.min_by(F.struct(day, value), F.struct(-F.col(value), F.col(day))).alias("top"))
    d = df.join(top, key)
    before, after = F.col(day) <= F.col("top")[day], F.col(day) > F.col("top")[day]
    low = d.groupBy(key).agg(F.min(F.when(before, F.col(value))).alias("a"), F.min(F.when(after, F.col(value))).alias("b"))
    d = d.join(low, key)
    high = F.col("top")[value]
    rise = F.when(before & (F.col(value) >= F.col("a") + up * (high - F.col("a"))), F.col(day))
    fall = F.when(after & (F.col(value) <= F.col("b") + down * (high - F.col("b"))), F.col(day))
    return d.groupBy(key).agg(F.first(F.col("top")[day]).alias("peak"), F.min(rise).alias("rise"), F.min(fall).alias("fall"))


def hampel(df: DataFrame, value: str, k: int, t0: float = 3.0, key: str = "pixel_id", day: str = "obs_date") -> DataFrame:
    """Adds `clean` and `flag`: 3 where a value lies over t0 scaled MADs from the median of 2k+1 values and is replaced by it; k values at the ends stay.

    Windows run over the values, so NULLs between them do not count; they stay NULL.
    """
    w = Window.partitionBy(key, F.col(value).isNull()).orderBy(day)
    near = F.sort_array(F.collect_list(value).over(w.rowsBetween(-k, k)))
    d = df.withColumn("_s", near)
    med = F.element_at("_s", k + 1)
    off = F.element_at(F.sort_array(F.transform("_s", lambda v: F.abs(v - med))), k + 1)
    bad = (F.size("_s") == 2 * k + 1) & (F.abs(F.col(value) - med) > t0 * 1.4826 * off)
    return d.withColumn("flag", F.when(bad, 3).otherwise(0)).withColumn("clean", F.when(bad, med).otherwise(F.col(value))).drop("_s")


def snow_filter(df: DataFrame, value: str, ndsi: str, key: str = "pixel_id", limit: float = 0.2, q: float = 0.05) -> DataFrame:
    """Adds `filled` and `flag`: snow (1) and all values that lie lower become a low quantile of the snow-free values; other NULLs stay NULL."""
    snow = F.coalesce(F.col(ndsi) > limit, F.lit(False))
    low = df.where(F.col(ndsi) <= limit).groupBy(key).agg(F.percentile(value, F.lit(q)).alias("_low"))
    d = df.join(low, key, "left")
    raised = F.when(snow | (F.col(value) < F.col("_low")), F.col("_low")).otherwise(F.col(value).cast("double"))
    return d.withColumn("flag", snow.cast("int")).withColumn("filled", raised).drop("_low")


def daily_change(value: str, key: str = "pixel_id", day: str = "obs_date") -> Column:
    """Difference to the day before within a year."""
    return F.col(value) - F.lag(value).over(Window.partitionBy(key, F.year(day)).orderBy(day))


def pad_year(df: DataFrame, year: int, days: int, fake: bool = False, key: str = "pixel_id", day: str = "obs_date", qc: str = "qc") -> DataFrame:
    """A year with its neighbours' last and first days. With fake, and a column qc: a key without rows in a neighbour year has the year's own last (first) days there instead, their dates shifted by the year's length, qc 1."""
    first, after = (F.make_date(F.lit(y), F.lit(1), F.lit(1)) for y in (year, year + 1))
    d = df.where((F.col(day) >= F.date_sub(first, days)) & (F.col(day) < F.date_add(after, days)))
    if not fake:
        return d
    size = F.datediff(after, first)
    own = d.where(F.year(day) == year)
    out = d
    for side, shift, slice_ in ((year - 1, -size, F.col(day) >= F.date_sub(after, days)), (year + 1, size, F.col(day) < F.date_add(first, days))):
        there = df.where(F.year(day) == side).select(key).distinct()
        more = own.where(slice_).join(there, key, "left_anti").withColumns({day: F.date_add(day, shift), qc: F.lit(1)})
        out = out.unionByName(more)
    return out


def fill_share(flag: str, key: str = "pixel_id", day: str = "obs_date", reach: int = 14) -> Column:
    """Share of flags other than 0, 1, 2 within reach positions; at the left edge the divisor is one larger than the rows counted."""
    w = order(key, day)
    near = w.rowsBetween(-reach, reach)
    bad = F.sum((~F.col(flag).isin(0, 1, 2)).cast("int")).over(near)
    return bad / (F.count(F.lit(1)).over(near) + (F.row_number().over(w) <= reach).cast("int"))


def nth_event(df: DataFrame, key: str, at: str, start: str, end: str, n: int) -> DataFrame:
    """The nth event of each key whose day lies in the period."""
    d = df.where(F.col(at).between(start, end)).withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(at)))
    return d.where(F.col("_n") == n).drop("_n")


def events_in_window(events: DataFrame, windows: DataFrame, key: str, at: str) -> DataFrame:
    """(key, start, n) of half-open windows (start, stop); a short list of them is sent to the tasks, as Spark decides by its size."""
    return events.join(windows, (F.col(at) >= F.col("start")) & (F.col(at) < F.col("stop"))).groupBy(key, "start").agg(F.count("*").alias("n"))


def season_length_window(df: DataFrame, key: str, up: str, down: str, start: str, end: str, n: int) -> DataFrame:
    """(key, length): the nth end less the nth beginning in the period."""
    a = nth_event(df.select(key, up), key, up, start, end, n)
    b = nth_event(df.select(key, down), key, down, start, end, n)
    return a.join(b, key).select(key, F.datediff(down, up).alias("length"))
