"""Grouped statistics: normals, robust spread and slopes, Tukey filters, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import aggregate, correlation, mad, sensor_error
from .joins import nearest_date


def with_mad(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """keys, med, mad: the medians come back to the rows by the same keys, so both aggregates share one partitioning."""
    med = df.groupBy(*keys).agg(F.median(x).alias("med"))
    return df.join(med, keys).groupBy(*keys, "med").agg(mad(F.col(x), F.col("med")).alias("mad"))


def tukey(df: DataFrame, keys: list[str], x: str, k: float = 1.5) -> DataFrame:
    """df with x NULL outside the quartiles widened by k interquartile ranges."""
    q = df.groupBy(*keys).agg(F.percentile(x, F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    d = df.join(q, keys).withColumn("r", k * (F.col("q")[1] - F.col("q")[0]))
    return d.withColumn(x, F.when(F.col(x).between(F.col("q")[0] - F.col("r"), F.col("q")[1] + F.col("r")), F.col(x))).drop("q", "r")


def target_year_anomaly(df: DataFrame, key: str, year: str, x: str, target: int, first: int, last: int) -> DataFrame:
    """(key, anomaly, z) of the target year against median and MAD of first..last; z is NULL where the MAD is 0."""
    base = with_mad(df.where(F.col(year).between(first, last)), [key], x)
    off = F.col(x) - F.col("med")
    return df.where(F.col(year) == target).join(base, key).select(key, off.alias("anomaly"), (off / F.nullif("mad", F.lit(0.0))).alias("z"))


def band_profile(df: DataFrame, lat: str, x: str, width: float = 1.0) -> DataFrame:
    """(centre, med, mad, n) of bands of latitude."""
    return with_mad(df.withColumn("centre", (F.floor(F.col(lat) / width) + 0.5) * width), ["centre"], x).join(
        df.groupBy(((F.floor(F.col(lat) / width) + 0.5) * width).alias("centre")).agg(F.count(x).alias("n")), "centre")


def quantile_type3(x: str, q: float) -> Column:
    """Nearest even order statistic, as an aggregate."""
    s, n = F.sort_array(F.collect_list(x)), F.count(x) * q
    return F.try_element_at(s, F.greatest(F.lit(1), F.bround(n, 0).cast("int")))


def ground_site_year(df: DataFrame, filters: list[str], least: float, metric: str, last: bool = False, first_cols: tuple[str, ...] = ()) -> DataFrame:
    """One row for each site and year of observations that pass the ordered filters and last long enough.

    day: median of the first (last) day on which the phase was seen; other: that of the day without it before (after); midpoint: median of
    first day + duration / 2; variance of the day; lag: median of day less other; value: median of the metric; first_cols: the least of
    each. filter_steps counts the rows that each filter drops.
    """
    seen, not_seen = ("last_yes", "first_no") if last else ("first_yes", "last_no")
    d = df
    for f in filters:
        d = d.where(f)
    d = d.withColumn("_len", F.col("last_yes") - F.col("first_yes")).where(F.col("_len") >= least)
    return d.groupBy("site_id", "obs_year").agg(
        *[F.min(c).alias(c) for c in first_cols], F.median(seen).alias("day"), F.median(not_seen).alias("other"), F.median(F.col("first_yes") + F.col("_len") / 2).alias("midpoint"),
        F.var_samp(seen).alias("variance"), F.median(F.col(seen) - F.col(not_seen)).alias("lag"), F.median(metric).alias("value"))


def weighted_ols(df: DataFrame, key: str, y: str, x: str, w: str) -> DataFrame:
    """(key, slope, intercept, r2) in closed form from one aggregation."""
    W, X, Y = F.col(w), F.col(x), F.col(y)
    s = df.groupBy(key).agg(F.sum(W).alias("sw"), F.sum(W * X).alias("sx"), F.sum(W * Y).alias("sy"), F.sum(W * X * X).alias("sxx"), F.sum(W * X * Y).alias("sxy"), F.sum(W * Y * Y).alias("syy"))
    cxy, cxx, cyy = (F.expr(f"sw * {a} - {b}") for a, b in (("sxy", "sx * sy"), ("sxx", "sx * sx"), ("syy", "sy * sy")))
    slope = cxy / F.nullif(cxx, F.lit(0.0))
    return s.select(key, slope.alias("slope"), ((F.col("sy") - slope * F.col("sx")) / F.col("sw")).alias("intercept"), (cxy * cxy / F.nullif(cxx * cyy, F.lit(0.0))).alias("r2"))


def tukey_cov(df: DataFrame, keys: list[str], bands: list[str], k: float = 1.5) -> DataFrame:
    """Covariance and correlation of each pair of bands over rows inside the Tukey bounds of every band."""
    q = df.groupBy(*keys).agg(*[F.percentile(b, F.array(F.lit(0.25), F.lit(0.75))).alias(f"q_{b}") for b in bands])
    good = F.lit(True)
    for b in bands:
        lo, hi = F.col(f"q_{b}")[0], F.col(f"q_{b}")[1]
        good &= F.col(b).between(lo - k * (hi - lo), hi + k * (hi - lo))
    return band_covariance(df.join(q, keys).where(good), keys, bands)


def band_covariance(df: DataFrame, keys: list[str], bands: list[str]) -> DataFrame:
    pairs = [(a, b) for i, a in enumerate(bands) for b in bands[i:]]
    return df.groupBy(*keys).agg(*[f(a, b).alias(f"{n}_{a}_{b}") for a, b in pairs for n, f in (("cov", F.covar_samp), ("cor", correlation))])


def weekly_composite(df: DataFrame, key: str, day: str, x: str, func: str = "mean", closed: str = "left", centre: bool = False) -> DataFrame:
    """(key, yr, week, value, n): weeks from the first of January; 0 is missing.

    closed: weeks are [lo, hi), or with `right` (lo, hi], where the first of January belongs to none. centre: the day at the middle of
    the week, the even one of the two days next to it (counted from 1970-01-01).
    """
    at = F.dayofyear(day) - 1
    week = F.floor(at / 7) if closed == "left" else F.ceil(at / 7) - 1
    d = df.withColumn("yr", F.year(day)).withColumn("week", week.cast("int")).where((F.col(x) != 0) & (F.col("week") >= 0))
    d = d.groupBy(key, "yr", "week").agg(aggregate(func, F.col(x)).alias("value"), F.count("*").alias("n"))
    if not centre:
        return d
    low = F.unix_date(F.make_date("yr", F.lit(1), F.lit(1))) + 7 * F.col("week")
    return d.withColumn("centre", F.date_from_unix_date(F.bround(low + F.lit(3.5), 0).cast("int")))


def bin_observations(df: DataFrame, x: str, res: str = "weekly", func: str = "median", share: dict[str, float] | None = None, key: str = "pixel_id", sensor: str = "sensor", day: str = "obs_date") -> DataFrame:
    """(key, sensor, bin, value, error, n): daily bins, or weeks counted on from the first of January of the pixel's first year.

    error: the value's share by sensor, as sensor_error; NULL for sensors without one. Missing values are left out, and do not move
    the first year. One shuffle, by key.
    """
    d = df.where(F.col(x).isNotNull())
    first = F.trunc(F.min(day).over(Window.partitionBy(key)), "year")
    low = F.col(day) if res == "daily" else F.date_add("_first", (F.floor(F.datediff(day, "_first") / 7) * 7).cast("int"))
    d = d.withColumn("_first", first).groupBy(key, sensor, low.alias("bin")).agg(aggregate(func, F.col(x)).alias("value"), F.count("*").alias("n"))
    return d.withColumn("error", sensor_error(F.col("value"), F.col(sensor), share))


def population_prior(df: DataFrame, week: str, x: str) -> DataFrame:
    """(week, mean, variance, rate): the rate leads to the next week's mean; 1 in the last."""
    d = df.groupBy(week).agg(F.avg(x).alias("mean"), F.var_samp(x).alias("variance"))
    return d.withColumn("rate", F.coalesce(F.lead("mean").over(Window.orderBy(week)) / F.col("mean"), F.lit(1.0)))  # a row for each week


def class_shares(df: DataFrame, cls: str, least: float = 0.01) -> DataFrame:
    n = df.groupBy(cls).agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("total")))).select(cls, "n", (F.col("n") / F.col("total")).alias("share")).where(F.col("share") >= least)  # one row


BINS = 4096


def stratified_sample(df: DataFrame, cls: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """round(n x share) rows of each class, those of the least hash of the key.

    Rows are counted by class and bin of the hash; the bins that make up the quota are kept, and only these few rows are ranked.
    """
    d = df.withColumns({"_h": F.xxhash64(F.lit(seed), key)}).withColumn("_bin", F.pmod("_h", F.lit(BINS)))
    bins = d.groupBy(cls, "_bin").agg(F.count("*").alias("_c"))
    own = Window.partitionBy(cls)
    bins = bins.withColumns({"_n": F.sum("_c").over(own), "_before": F.sum("_c").over(own.orderBy("_bin")) - F.col("_c")})  # 4,096 rows a class
    total = bins.groupBy(cls).agg(F.first("_n").alias("_n")).agg(F.sum("_n").alias("_total"))
    bins = bins.crossJoin(F.broadcast(total))  # one row
    bins = bins.withColumn("_quota", F.bround(F.col("_n") / F.col("_total") * n, 0)).where("_before < _quota").select(F.col(cls).alias("_cls"), F.col("_bin").alias("_b"), "_quota")
    d = d.join(bins, F.col(cls).eqNullSafe(F.col("_cls")) & (F.col("_bin") == F.col("_b")))
    rank = F.row_number().over(Window.partitionBy(cls).orderBy("_bin", "_h", key))
    return d.withColumn("_rank", rank).where("_rank <= _quota").select(df.columns)


def random_sample(df: DataFrame, key: str, n: int | None = None, share: float | None = None, seed: int = 0) -> DataFrame:
    """n rows of the least hash of the key, or the rows whose hash lies below a share."""
    if share is not None:
        return df.where(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 31)) < int(share * (1 << 31)))
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def missing_fraction(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols])


def coarsen_median(df: DataFrame, row: str, col: str, x: str, factor: int) -> DataFrame:
    return df.groupBy(F.floor(F.col(row) / factor).alias(row), F.floor(F.col(col) / factor).alias(col)).agg(F.median(x).alias(x))


def order_statistic(d: DataFrame, k: int, least: int = 10_000) -> float:
    """The value of rank k (from 0) of column v, without a buffer of all rows.

    Approximate quantiles bracket the rank and the bracket's rows are counted, until at most `least` rows are left; values at a
    bracket's ends are counted out, so ties end it, too. A pass cuts the rows about 500 times: 10^12 rows take three or four.
    """
    v, below = F.col("v"), 0
    low, high, left = d.agg(F.min(v), F.max(v), F.count(v)).first()
    while left > least:
        first, last = d.agg(F.count_if(v == low), F.count_if(v == high)).first()
        if k - below < first:
            return low
        if k - below >= left - last:
            return high
        d, below, left = d.where((v > low) & (v < high)), below + first, left - first - last
        margin, held = 0.001, False
        while not held:
            p, q = (k - below) / left - margin, (k - below) / left + margin
            a, b, (x, y) = d.agg(F.min(v), F.max(v), F.percentile_approx(v, [max(0.0, p), min(1.0, q)], 10_000)).first()
            low, high = (a if p <= 0 else x), (b if q >= 1 else y)
            under, there = d.agg(F.count_if(v < low), F.count_if(v.between(low, high))).first()
            held, margin = under <= k - below < under + there, margin * 4
        below, left = below + under, there
    return d.where(v.between(low, high)).orderBy(v).collect()[k - below][0]  # `least` rows at most


def exact_quantile(df: DataFrame, x: str, p: float, least: int = 10_000) -> float | None:
    """The interpolated quantile of a whole column, by order_statistic; NULLs and NaN are left out, and none of no rows."""
    d = df.select(F.col(x).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    at = p * (d.count() - 1)
    if at < 0:
        return None
    low = order_statistic(d, int(at), least)
    if at == int(at):
        return low
    up_to, after = d.agg(F.count_if(F.col("v") <= low), F.min(F.when(F.col("v") > low, F.col("v")))).first()
    return low if up_to > int(at) + 1 else low + (at - int(at)) * (after - low)


def stretch_breaks(df: DataFrame, x: str, p: tuple[float, float] = (0.02, 0.98), n: int = 254, symmetric: bool = False, digits: int | None = None) -> DataFrame:
    """(i, at): minimum, n equal steps between two quantiles, maximum. symmetric: the larger absolute value of each pair on both sides
    of 0. digits: rounded, and each value once."""
    low, high = (exact_quantile(df, x, q) for q in p)
    s = df.agg(F.min(x).cast("double").alias("a"), F.lit(low).cast("double").alias("p"), F.lit(high).cast("double").alias("q"), F.max(x).cast("double").alias("b"))
    if symmetric:
        for lo, hi in (("a", "b"), ("p", "q")):
            s = s.withColumn(hi, F.greatest(F.abs(lo), F.abs(hi))).withColumn(lo, -F.col(hi))
    steps = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.col("p") + (F.col("q") - F.col("p")) * i / (n - 1))
    at = F.concat(F.array("a"), steps, F.array("b"))
    if digits is not None:
        at = F.array_distinct(F.transform(at, lambda v: F.round(v, digits)))
    return s.select(F.posexplode(at).alias("i", "at"))


def density2d(df: DataFrame, x: str, y: str, bin: float) -> DataFrame:
    return df.groupBy(F.floor(F.col(x) / bin).alias("bin_x"), F.floor(F.col(y) / bin).alias("bin_y")).agg(F.count("*").alias("n"))


def mosaic(frames: list[DataFrame], keys: list[str], x: str) -> DataFrame:
    """Overlaid layers: the first non-null value wins; and the mean over the layers."""
    d = None
    for i, f in enumerate(frames):
        f = f.select(*keys, x, F.lit(i).alias("_i"))
        d = f if d is None else d.unionByName(f)
    return d.groupBy(*keys).agg(F.min_by(x, F.when(F.col(x).isNotNull(), F.col("_i"))).alias("first"), F.avg(x).alias("mean"))


def filter_steps(df: DataFrame, steps: list[str]) -> DataFrame:
    """(step, n): rows left after each of the ordered predicates, in one pass."""
    kept = [" AND ".join(f"({s})" for s in steps[:i]) or "TRUE" for i in range(len(steps) + 1)]
    one = df.agg(*[F.count_if(F.expr(k)).alias(f"s{i}") for i, k in enumerate(kept)])
    return one.select(F.posexplode(F.array(*one.columns)).alias("step", "n"))


def low_value_replace(df: DataFrame, keys: list[str], x: str, q: float = 0.05) -> DataFrame:
    """Negatives become the q-quantile of the series' non-negative values."""
    low = df.where(F.col(x) >= 0).groupBy(*keys).agg(F.percentile(x, F.lit(q)).alias("_low"))
    return df.join(low, keys, "left").withColumn(x, F.when(F.col(x) < 0, F.col("_low")).otherwise(F.col(x).cast("double"))).drop("_low")


def sensor_rmse(pixels: DataFrame, a: DataFrame, b: DataFrame, x: str, max_diff: int, default: float, key: str = "pixel_id", day: str = "obs_date") -> DataFrame:
    """(key, rmse) over each day of a and the nearest of b; the default where no pair exists."""
    near = nearest_date(a, b, max_diff, key, day).where("match IS NOT NULL")
    pairs = near.join(a.select(key, day, F.col(x).alias("_x")), [key, day]).join(b.select(key, F.col(day).alias("match"), F.col(x).alias("_y")), [key, "match"])
    off = F.col("_x") - F.col("_y")
    return pixels.join(pairs.groupBy(key).agg(F.sqrt(F.avg(off * off)).alias("rmse")), key, "left").withColumn("rmse", F.coalesce("rmse", F.lit(default)))


def class_week_profile(df: DataFrame, cls: str, week: str, x: str, head: int = 10, tail: int = 50) -> DataFrame:
    """(cls, week, mean, rate): weekly means, flat before the head and after the tail week; the rate leads to the next week, 1 in the last."""
    d = df.groupBy(cls, week).agg(F.avg(x).alias("mean"))  # a row for each class and week from here on
    own = Window.partitionBy(cls)
    edge = lambda w: F.max(F.when(F.col(week) == w, F.col("mean"))).over(own)
    d = d.withColumn("mean", F.when(F.col(week) < head, edge(head)).when(F.col(week) > tail, edge(tail)).otherwise(F.col("mean")))
    return d.withColumn("rate", F.coalesce(F.lead("mean").over(own.orderBy(week)) / F.col("mean"), F.lit(1.0)))


def anomaly_by_latitude(df: DataFrame, lat: str, z: str, cls: str, classes: list, width: float = 1.0) -> DataFrame:
    """(centre, z, n): the median z of the pixels of the classes, by band of latitude."""
    d = df.where(F.col(cls).isin(classes) & F.col(z).isNotNull()).withColumn("centre", (F.floor(F.col(lat) / width) + 0.5) * width)
    return d.groupBy("centre").agg(F.median(z).alias("z"), F.count("*").alias("n"))


def difference_stats(df: DataFrame, a: str, b: str, breaks: list[float]) -> DataFrame:
    """(bin, n, share, mean): the histogram of a - b, bin i from break i to below the next, 0 and the last beyond the ends; mean is that of all."""
    d = df.select((F.col(a) - F.col(b)).cast("double").alias("_d")).where("_d IS NOT NULL")
    at = F.size(F.filter(F.array(*[F.lit(float(x)) for x in breaks]), lambda x: x <= F.col("_d")))
    h = d.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.sum("_d").alias("_s"))
    every = Window.partitionBy(F.lit(0))  # a row for each bin
    return h.select("bin", "n", (F.col("n") / F.sum("n").over(every)).alias("share"), (F.sum("_s").over(every) / F.sum("n").over(every)).alias("mean"))


def growing_season_length(df: DataFrame, up: str, down: str) -> DataFrame:
    """df with gsl, the days from the one date to the other."""
    return df.withColumn("gsl", F.col(down) - F.col(up))


def cycle_counts(df: DataFrame, first: list[str], second: list[str]) -> DataFrame:
    """(records, with_first, with_second, cycles): records that have any metric of the first and of the second cycle."""
    some = lambda cols: F.coalesce(*[F.col(c).cast("double") for c in cols]).isNotNull()
    one = df.agg(F.count("*").alias("records"), F.count_if(some(first)).alias("with_first"), F.count_if(some(second)).alias("with_second"))
    return one.withColumn("cycles", F.col("with_first") + F.col("with_second"))
