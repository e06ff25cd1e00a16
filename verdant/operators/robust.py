"""Robust fits of short series: one aggregate gathers a pixel's years in an array, and median, MAD and all slopes follow from it.

A series is a few tens of years; its pairs are its square. Missing values are left out, and equal times give no slope.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def array_median(a: Column) -> Column:
    s, n = F.sort_array(a), F.size(a)
    return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def points(df: DataFrame, key: str, t: str, x: str) -> DataFrame:
    """(key, pts): structs (t, x) in order of t."""
    d = df.where(F.col(x).isNotNull() & F.col(t).isNotNull())
    return d.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(t).cast("double").alias("t"), F.col(x).cast("double").alias("x")))).alias("pts"))


def pairs(forward: bool) -> Column:
    """For each point the slopes to the others, or to the later ones."""
    others = lambda i: F.filter("pts", lambda j: (j["t"] > i["t"]) if forward else (j["t"] != i["t"]))
    return F.transform("pts", lambda i: F.transform(others(i), lambda j: (j["x"] - i["x"]) / (j["t"] - i["t"])))


def crossings() -> Column:
    """For each point the intercepts of the lines to the others."""
    return F.transform("pts", lambda i: F.transform(F.filter("pts", lambda j: j["t"] != i["t"]), lambda j: (j["t"] * i["x"] - i["t"] * j["x"]) / (j["t"] - i["t"])))


def repeated(d: DataFrame) -> DataFrame:
    """d (.., pts) with slopes and intercepts, the median of each point's; points that have no other are left out."""
    some = lambda a: F.filter(F.transform(a, array_median), lambda m: m.isNotNull())
    return d.withColumns({"slopes": some(pairs(False)), "intercepts": some(crossings())})


def theil_sen(df: DataFrame, key: str, t: str, x: str) -> DataFrame:
    """(key, slope, intercept): the median slope of all pairs, and the median of x - slope t."""
    d = points(df, key, t, x).withColumn("slope", array_median(F.flatten(pairs(True)))).where("slope IS NOT NULL")
    return d.select(key, "slope", array_median(F.transform("pts", lambda p: p["x"] - F.col("slope") * p["t"])).alias("intercept"))


def siegel(df: DataFrame, key: str, t: str, x: str) -> DataFrame:
    """(key, slope): the median of each point's median slope."""
    return repeated(points(df, key, t, x)).select(key, array_median(F.col("slopes")).alias("slope")).where("slope IS NOT NULL")


def slope_rank_interval(df: DataFrame, key: str, t: str, x: str, z: float = 1.96) -> DataFrame:
    """(key, slope, intercept, slope_low, slope_high, intercept_low, intercept_high) of repeated medians: of n sorted values those at ranks n/2 - z sqrt(n)/2 and 1 + n/2 + z sqrt(n)/2; NULL beyond the ends."""
    d = repeated(points(df, key, t, x)).where("size(slopes) > 0")
    n = F.size("slopes")
    low, high = (F.bround(n / 2 - z * F.sqrt(n) / 2, 0).cast("int"), F.bround(1 + n / 2 + z * F.sqrt(n) / 2, 0).cast("int"))
    at = lambda a, r: F.when(r >= 1, F.get(F.sort_array(a), r - 1))
    out = [f(c).alias(f"{k}{e}") for c, k in (("slopes", "slope"), ("intercepts", "intercept")) for e, f in (("", lambda c: array_median(F.col(c))), ("_low", lambda c: at(F.col(c), low)), ("_high", lambda c: at(F.col(c), high)))]
    return d.select(key, *out)


@lru_cache(maxsize=128)
def signed_rank_counts(n: int) -> np.ndarray:
    """How many of the 2^n sets of ranks 1..n have each sum."""
    c = np.ones(1)
    for k in range(1, n + 1):
        c = np.r_[c, np.zeros(k)] + np.r_[np.zeros(k), c]
    return c


def signed_rank_p(x: np.ndarray) -> float:
    """Two-sided p-value that the values lie around 0: exact for under 50 values without zeros and ties, else normal with both corrections."""
    x = x[~np.isnan(x)]
    zeros, x = (x == 0).any(), x[x != 0]
    n = len(x)
    if not n:
        return float("nan")
    size, place, times = np.unique(np.abs(x), return_inverse=True, return_counts=True)
    rank = (np.cumsum(times) - (times - 1) / 2)[place]
    v = rank[x > 0].sum()
    if n < 50 and not zeros and len(size) == n:
        c = signed_rank_counts(n)
        v = int(v)
        tail = c[v:].sum() if v > n * (n + 1) / 4 else c[: v + 1].sum()
        return float(min(1.0, 2 * tail / c.sum()))
    off = v - n * (n + 1) / 4
    sd = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - (times**3 - times).sum() / 48)
    return math.erfc(abs(off - np.sign(off) * 0.5) / sd / math.sqrt(2)) if sd else 1.0


def signed_rank(slopes: str) -> Column:
    @F.pandas_udf("double")
    def p(a: pd.Series) -> pd.Series:
        return a.map(lambda v: signed_rank_p(np.asarray(v, float)))

    return p(slopes)


def climate_normals(df: DataFrame, key: str, t: str, x: str, rounded: bool = True) -> DataFrame:
    """(key, med, mad, mean, sd, slope, p, n): median and mean rounded half to even for days, the slope of repeated medians, and its signed-rank p-value."""
    d = repeated(points(df, key, t, x))
    xs = F.transform("pts", lambda p: p["x"])
    d = d.withColumn("xs", xs).withColumn("_med", array_median(F.col("xs"))).withColumn("_mean", F.aggregate("xs", F.lit(0.0), lambda a, v: a + v) / F.size("xs"))
    ss = F.aggregate("xs", F.lit(0.0), lambda a, v: a + (v - F.col("_mean")) * (v - F.col("_mean")))
    r = (lambda c: F.bround(c, 0)) if rounded else (lambda c: F.col(c))
    return d.select(
        key, r("_med").alias("med"), (1.4826 * array_median(F.transform("xs", lambda v: F.abs(v - F.col("_med"))))).alias("mad"), r("_mean").alias("mean"), F.when(F.size("xs") > 1, F.sqrt(ss / (F.size("xs") - 1))).alias("sd"),
        array_median(F.col("slopes")).alias("slope"), signed_rank("slopes").alias("p"), F.size("xs").cast("long").alias("n"))


def climate_anomalies(df: DataFrame, key: str, t: str, x: str, rounded: bool = True) -> DataFrame:
    """(key, t, anomaly, z): each year off the median, rounded for days, and in MADs; z is NULL where the MAD is 0."""
    d = points(df, key, t, x).withColumn("_med", array_median(F.transform("pts", lambda p: p["x"])))
    d = d.withColumn("_mad", 1.4826 * array_median(F.transform("pts", lambda p: F.abs(p["x"] - F.col("_med"))))).select(key, "_med", "_mad", F.explode("pts").alias("p"))
    off = F.col("p.x") - F.col("_med")
    return d.select(key, F.col("p.t").cast("long").alias(t), (F.bround(off, 0) if rounded else off).alias("anomaly"), (off / F.nullif("_mad", F.lit(0.0))).alias("z"))


def _beta_tail(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function by its continued fraction."""
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_tail(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    f = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d)
            c = 1 + num / c
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * f


@lru_cache(maxsize=4096)
def t_quantile(level: float, df: int) -> float:
    """The t value that a share `level` of the distribution lies within, on both sides of 0."""
    low, high = 0.0, 1.0
    inside = lambda t: 1 - _beta_tail(df / (df + t * t), df / 2, 0.5) if t else 0.0
    while inside(high) < level:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if inside(mid) < level else (low, mid)
    return (low + high) / 2


def ols_interval(df: DataFrame, key: str, y: str, x: str, w: str | None = None, level: float = 0.95) -> DataFrame:
    """(key, n, slope, intercept, r2, and the limits of slope and intercept) of a weighted line; rows of weight 0 or with a NULL do not count. No limits under three rows."""
    W, X, Y = (F.col(w) if w else F.lit(1.0)).cast("double"), F.col(x).cast("double"), F.col(y).cast("double")
    d = df.where(W.isNotNull() & (W > 0) & X.isNotNull() & Y.isNotNull())
    means = d.groupBy(key).agg(F.count("*").alias("n"), F.sum(W).alias("_sw"), (F.sum(W * X) / F.sum(W)).alias("_mx"), (F.sum(W * Y) / F.sum(W)).alias("_my"))
    dx, dy = X - F.col("_mx"), Y - F.col("_my")
    s = d.join(means, key).groupBy(key, "n", "_sw", "_mx", "_my").agg(F.sum(W * dx * dx).alias("_xx"), F.sum(W * dx * dy).alias("_xy"), F.sum(W * dy * dy).alias("_yy"))

    @F.pandas_udf("double")
    def quantile(n: pd.Series) -> pd.Series:
        return n.map(lambda k: t_quantile(level, int(k) - 2) if k > 2 else float("nan"))

    slope = F.col("_xy") / F.nullif("_xx", F.lit(0.0))
    s = s.withColumn("slope", slope).withColumn("intercept", F.col("_my") - F.col("slope") * F.col("_mx")).withColumn("r2", F.col("_xy") * F.col("slope") / F.nullif("_yy", F.lit(0.0)))
    s = s.withColumn("_v", F.when(F.col("n") > 2, F.greatest(F.col("_yy") - F.col("slope") * F.col("_xy"), F.lit(0.0)) / (F.col("n") - 2)))
    s = s.withColumn("_q", F.nanvl(quantile("n"), F.lit(None)))
    es, ei = F.col("_q") * F.sqrt(F.col("_v") / F.col("_xx")), F.col("_q") * F.sqrt(F.col("_v") * (1 / F.col("_sw") + F.col("_mx") * F.col("_mx") / F.col("_xx")))
    return s.select(key, "n", "slope", "intercept", "r2", (F.col("slope") - es).alias("slope_low"), (F.col("slope") + es).alias("slope_high"), (F.col("intercept") - ei).alias("intercept_low"), (F.col("intercept") + ei).alias("intercept_high"))
