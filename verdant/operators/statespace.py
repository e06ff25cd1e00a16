"""Kalman filters and smoothers, many pixels at once.

Series are dealt to buckets by a hash of their key, in one shuffle; the number of buckets follows from a count, so that each holds
about ROWS rows. A task sorts a bucket once, takes its pixels in blocks whose arrays stay near BYTES, lays them side by side on the
union of their days, and runs the recursion over days in numpy for all pixels of the block together. Covariances of all days are kept
only for smoothing. Days that a pixel lacks are no steps of it. Missing values skip the update. Dynamics, noise and errors are those
of the model, or columns of the rows, so they may differ by pixel, class and day.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS = 250_000  # of a bucket, about
BYTES = 64_000_000  # of a block's arrays, about


@dataclass(frozen=True)
class Model:
    """x = G x + noise(W), y = FF x + noise(V): n states, p observations. Shapes: G, W (n, n); FF (p, n); V (p,) variances."""

    FF: np.ndarray
    G: np.ndarray
    W: np.ndarray
    V: np.ndarray
    m0: np.ndarray = field(default_factory=lambda: np.zeros(1))
    C0: np.ndarray = field(default_factory=lambda: np.eye(1))


def model(states: int, sensors: list[list[int]], w: float = 1e6, v: float = 1e6, m0: float = 0.0, c0: float = 1.0) -> Model:
    """Identity dynamics; each sensor observes a subset of the states, one observation for each."""
    rows = [s for sensor in sensors for s in sensor]
    return Model(np.eye(states)[rows], np.eye(states), np.eye(states) * w, np.full(len(rows), float(v)), np.full(states, float(m0)), np.eye(states) * c0)


def seasonal(period: int, sensors: int, w: float, v: float) -> Model:
    """The state holds one value for each step of the period and turns by one each step; all sensors see the first."""
    return Model(np.eye(period)[[0] * sensors], np.roll(np.eye(period), 1, 1), np.diag([w] + [0.0] * (period - 1)), np.full(sensors, float(v)), np.zeros(period), np.eye(period))


def predict(m: np.ndarray, c: np.ndarray, g: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """m (pixels, n), c (pixels, n, n); g and w are one matrix, or one for each pixel."""
    return np.einsum("...ij,...j->...i", g, m), g @ c @ np.swapaxes(g, -1, -2) + w


def update(m: np.ndarray, c: np.ndarray, y: np.ndarray, ff: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One scalar observation after the other (their errors are independent); a NaN value or error skips. v: (p,) or (pixels, p)."""
    v = np.broadcast_to(v, y.shape)
    for k in range(len(ff)):
        seen = ~(np.isnan(y[:, k]) | np.isnan(v[:, k]))
        f = c @ ff[k]
        s = f @ ff[k] + np.where(seen, v[:, k], 1)
        gain = np.where((seen & (s > 0))[:, None], f / np.where(s > 0, s, 1)[:, None], 0)
        m = m + gain * np.where(seen, y[:, k] - m @ ff[k], 0)[:, None]
        c = c - gain[:, :, None] * f[:, None, :]
    return m, c


@dataclass
class Varying:
    """What replaces parts of a model: G and W (pixels, days, n, n), V (pixels, days, p), m0 (pixels, n), C0 (pixels, n, n)."""

    G: np.ndarray | None = None
    W: np.ndarray | None = None
    V: np.ndarray | None = None
    m0: np.ndarray | None = None
    C0: np.ndarray | None = None


def run(y: np.ndarray, there: np.ndarray, model: Model, smooth: bool = False, by: Varying | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Means (pixels, days, n) and variances (pixels, days, n) of y (pixels, days, p); days not `there` are no steps."""
    by = by or Varying()
    b, t, _ = y.shape
    n = len(model.m0)
    m = np.tile(model.m0, (b, 1)) if by.m0 is None else by.m0
    c = np.tile(model.C0, (b, 1, 1)) if by.C0 is None else by.C0
    at = lambda x, i, plain: plain if x is None else x[:, i]
    ms, vs = np.zeros((b, t, n)), np.zeros((b, t, n))
    cs, mp, cp = (np.zeros((b, t, n, n)), np.zeros((b, t, n)), np.zeros((b, t, n, n))) if smooth else (None, None, None)
    for i in range(t):
        a, r = predict(m, c, at(by.G, i, model.G), at(by.W, i, model.W))
        if smooth:
            mp[:, i], cp[:, i] = a, r
        a, r = update(a, r, y[:, i], model.FF, at(by.V, i, model.V))
        on = there[:, i]
        m, c = np.where(on[:, None], a, m), np.where(on[:, None, None], r, c)
        ms[:, i], vs[:, i] = m, np.diagonal(c, axis1=1, axis2=2)
        if smooth:
            cs[:, i] = c
    if smooth:
        after = np.full(b, -1)
        for i in range(t - 1, -1, -1):
            on = np.flatnonzero(there[:, i])
            has_next = on[after[on] >= 0]
            k = after[has_next]
            if len(has_next):
                pf = cp[has_next, k]
                forward = np.broadcast_to(model.G, pf.shape) if by.G is None else by.G[has_next, k]
                g = cs[has_next, i] @ np.swapaxes(forward, 1, 2)
                g = g / pf if n == 1 else np.linalg.solve(np.swapaxes(pf, 1, 2), np.swapaxes(g, 1, 2)).swapaxes(1, 2)
                ms[has_next, i] += np.einsum("bij,bj->bi", g, ms[has_next, k] - mp[has_next, k])
                cs[has_next, i] += g @ (cs[has_next, k] - pf) @ np.swapaxes(g, 1, 2)
            after[on] = i
        vs = np.diagonal(cs, axis1=2, axis2=3)
    return ms, vs


def side_by_side(b: pd.DataFrame, names: list[str], key: str, day: str) -> tuple:
    """Pixel and day number of each row, values (pixels, days, columns), which days each pixel has, and the days."""
    _, i = np.unique(b[key].to_numpy(), return_inverse=True)
    days, j = np.unique(pd.to_datetime(b[day]).to_numpy(), return_inverse=True)
    y = np.full((i.max() + 1, len(days), len(names)), np.nan)
    there = np.zeros(y.shape[:2], bool)
    y[i, j], there[i, j] = b[names].to_numpy(float), True
    return i, j, y, there, days


def blocks(b: pd.DataFrame, key: str, width: int) -> Iterator[pd.DataFrame]:
    """Whole series in groups that take about BYTES; width: numbers kept for each pixel and day."""
    b = b.sort_values(key, kind="stable")
    starts = np.flatnonzero(np.r_[True, b[key].to_numpy()[1:] != b[key].to_numpy()[:-1]]) if len(b) else np.array([], int)
    days = max(1, b.iloc[:, 1].nunique())  # the union of days is the width of the block
    step = max(1, int(BYTES // (8 * width * days)))
    for k in range(0, len(starts), step):
        yield b.iloc[starts[k] : starts[k + step] if k + step < len(starts) else len(b)]


def by_buckets(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, key: str = "pixel_id", buckets: int | None = None, width: int = 8, rows: int | None = None) -> DataFrame:
    """fn over blocks of whole series. buckets: their number; counted if not given, for about so many rows each, ROWS by default."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = buckets or max(least, -(-df.select(key).count() // (rows or ROWS)))
    each = lambda b: pd.concat([fn(x.reset_index(drop=True)) for x in blocks(b.drop(columns="_bucket"), key, width)], ignore_index=True)
    return df.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(n))).groupBy("_bucket").applyInPandas(each, schema)


def kf_multi(df: DataFrame, values: list[str], m: Model, smooth: bool = False, key: str = "pixel_id", day: str = "obs_date", buckets: int | None = None, errors: list[Column] | None = None, noise: list[Column] | None = None, growth: Column | None = None, first_mean: list[Column] | None = None, first_variance: list[Column] | None = None, keep: bool = False) -> DataFrame:
    """(key, day, mean_1.., variance_1..) of each state, with keep the values, too; values are the observations' columns, NULL where not observed. One row for each key and day.

    Columns that replace parts of the model on their row: errors, the variance of each observation; noise, the lower triangle of W by
    columns; growth, a factor on G; first_mean and first_variance (a diagonal), read on a pixel's first day.
    """
    n = len(m.m0)
    names = [f"{k}_{i}" for k in ("mean", "variance") for i in range(1, n + 1)]
    groups = {"v": errors, "w": noise, "g": [growth] if growth is not None else None, "m": first_mean, "c": first_variance}
    extra = {f"_{g}{i}": c for g, cols in groups.items() for i, c in enumerate(cols or [])}
    cols, kept = [*values, *extra], values if keep else []
    places = {g: [cols.index(c) for c in extra if c.startswith(f"_{g}")] for g in groups}

    def fn(b: pd.DataFrame) -> pd.DataFrame:
        i, j, x, there, _ = side_by_side(b, cols, key, day)
        of = {g: x[:, :, at] for g, at in places.items() if at}
        by = Varying(V=of.get("v"))
        if "w" in of:
            by.W = np.zeros((*x.shape[:2], n, n))
            for q, (r, c) in enumerate((r, c) for c in range(n) for r in range(c, n)):
                by.W[:, :, r, c] = by.W[:, :, c, r] = np.nan_to_num(of["w"][:, :, q])
        if "g" in of:
            by.G = np.where(np.isnan(of["g"]), 1, of["g"])[:, :, :, None] * m.G
        head = there.argmax(1)
        if "m" in of:
            by.m0 = of["m"][np.arange(len(x)), head]
        if "c" in of:
            by.C0 = of["c"][np.arange(len(x)), head][:, :, None] * np.eye(n)
        ms, vs = run(x[:, :, : len(values)], there, m, smooth, by)
        return pd.concat([b[[key, day, *kept]], pd.DataFrame(np.concatenate([ms[i, j], vs[i, j]], 1), columns=names)], axis=1)

    d = df.select(key, day, *[F.col(v).cast("double").alias(v) for v in values], *[c.cast("double").alias(k) for k, c in extra.items()])
    width = len(cols) + 2 * n + (3 * n * n + n if smooth else 0) + (n * n if noise else 0) + (n * n if growth is not None else 0)
    return by_buckets(d, fn, f"{key} bigint, {day} date, " + ", ".join(f"{x} double" for x in (*kept, *names)), key, buckets, width)


def _one(df: DataFrame, value: Column, smooth: bool, a: float, q: float, r: float, m0: float, c0: float, key: str, day: str) -> DataFrame:
    m = Model(np.ones((1, 1)), np.array([[a]]), np.array([[q]]), np.array([r]), np.array([m0]), np.array([[c0]]))
    d = kf_multi(df.select(key, day, value.cast("double").alias("y")), ["y"], m, smooth, key, day)
    return d.select(key, day, F.col("mean_1").alias("mean"), F.col("variance_1").alias("variance"))


def kf_filter(df: DataFrame, value: Column, a: float = 1.0, q: float = 0.01, r: float = 0.05, m0: float = 0.0, c0: float = 1.0, key: str = "pixel_id", day: str = "obs_date") -> DataFrame:
    """(key, day, mean, variance)."""
    return _one(df, value, False, a, q, r, m0, c0, key, day)


def kf_smooth(df: DataFrame, value: Column, a: float = 1.0, q: float = 0.01, r: float = 0.05, m0: float = 0.0, c0: float = 1.0, key: str = "pixel_id", day: str = "obs_date") -> DataFrame:
    """(key, day, mean, variance) after a backward pass over the filtered series."""
    return _one(df, value, True, a, q, r, m0, c0, key, day)


def annual_carry(df: DataFrame, value: Column, q: float, r: float, key: str = "pixel_id", day: str = "obs_date") -> DataFrame:
    """Each year is filtered from the last mean and variance of the year before; as a filter predicts before its first update, that is one filter over all years."""
    return kf_filter(df, value, q=q, r=r, key=key, day=day)


def leave_one_out_error(df: DataFrame, value: Column, q: float, r: float, key: str = "pixel_id", day: str = "obs_date") -> DataFrame:
    """(key, day, error): each observation less the smoothed estimate without it, by removing its weight from the smoother in closed form."""
    m = Model(np.ones((1, 1)), np.eye(1), np.array([[q]]), np.array([r]), np.zeros(1), np.eye(1))
    s = kf_multi(df.select(key, day, value.cast("double").alias("y")), ["y"], m, True, key, day, keep=True).where("y IS NOT NULL AND NOT isnan(y)")
    return s.select(key, day, ((F.col("y") - F.col("mean_1")) / (1 - F.col("variance_1") / r)).alias("error"))


def two_sensor_model(w: float, v1: float, v2: float, slope: float = 1.0) -> Model:
    """One state that two sensors see, the second times slope; starts at 0 with 1."""
    return Model(np.array([[1.0], [slope]]), np.eye(1), np.array([[w]]), np.array([v1, v2]), np.zeros(1), np.eye(1))


def fuse_two_sensors(df: DataFrame, first: str, second: str, w: float, v1: float, v2: float, slope: float = 1.0, bias: float = 0.0, key: str = "pixel_id", day: str = "obs_date") -> DataFrame:
    """(key, day, mean, se) of one state seen by two sensors; the second reads slope x state + bias. Errors are variances."""
    m = two_sensor_model(w, v1, v2, slope)
    d = kf_multi(df.select(key, day, F.col(first).alias("y1"), (F.col(second) - bias).alias("y2")), ["y1", "y2"], m, True, key, day)
    return d.select(key, day, F.col("mean_1").alias("mean"), F.sqrt("variance_1").alias("se"))


def as_variance(error: Column, squared: bool) -> Column:
    return error * error if squared else error


def fuse_multiband(df: DataFrame, fine: list[str], coarse: list[str], fine_error: list[Column], coarse_error: list[Column], class_cov: DataFrame, cls: str = "cls", squared: bool = True, smooth: bool = True, key: str = "pixel_id", day: str = "obs_date", buckets: int | None = None) -> DataFrame:
    """(key, day, mean_1.., variance_1..) of bands that two sensors see on a daily grid.

    Noise is that of the pixel's class on the day: class_cov has (cls, doy, w_ij for i >= j from 1), its first day taken for a missing
    one. Errors are standard deviations, squared unless `squared` is off. Starts at 0 with 0.1.
    """
    n = len(fine)
    lower = [f"w_{r}{c}" for c in range(1, n + 1) for r in range(c, n + 1)]
    table = class_cov.select(cls, F.col("doy").alias("_doy"), *lower)
    least = table.groupBy(cls).agg(*[F.min_by(w, "_doy").alias(f"_first_{w}") for w in lower])
    d = df.withColumn("_doy", F.dayofyear(day)).join(table, [cls, "_doy"], "left").join(least, cls, "left")
    m = Model(np.vstack([np.eye(n)] * 2), np.eye(n), np.eye(n), np.ones(2 * n), np.zeros(n), np.eye(n) * 0.1)
    errors = [as_variance(e, squared) for e in (*fine_error, *coarse_error)]
    return kf_multi(d, [*fine, *coarse], m, smooth, key, day, buckets, errors=errors, noise=[F.coalesce(w, f"_first_{w}") for w in lower])


def kf_by_cluster(df: DataFrame, value: Column, priors: DataFrame, r: float, cluster: str = "cluster", step: str = "step", smooth: bool = True, key: str = "pixel_id", day: str = "obs_date", buckets: int | None = None) -> DataFrame:
    """(key, day, mean, variance): growth and noise of each step, first mean and variance, from the priors (cluster, step, rate, var, mean) of the pixel's cluster."""
    first = priors.groupBy(cluster).agg(F.min_by("mean", step).alias("_m0"), F.min_by("var", step).alias("_c0"))
    d = df.withColumn("_y", value.cast("double")).join(priors.select(cluster, step, "rate", "var"), [cluster, step], "left").join(first, cluster, "left")
    m = Model(np.ones((1, 1)), np.eye(1), np.eye(1), np.array([r]), np.zeros(1), np.eye(1))
    out = kf_multi(d, ["_y"], m, smooth, key, day, buckets, noise=[F.col("var")], growth=F.col("rate"), first_mean=[F.col("_m0")], first_variance=[F.col("_c0")])
    return out.select(key, day, F.col("mean_1").alias("mean"), F.col("variance_1").alias("variance"))


def kf_class_growth(df: DataFrame, value: Column, growth: DataFrame, cls: str = "cls", week: str = "week", q: float = 0.05, r: float = 0.05, m0: float = 0.0, smooth: bool = True, key: str = "pixel_id", day: str = "obs_date", buckets: int | None = None) -> DataFrame:
    """(key, day, mean, variance): each step multiplies the state by the growth rate (cls, week, rate) of the week before it."""
    d = df.withColumn("_y", value.cast("double")).join(growth.select(cls, (F.col(week) + 1).alias(week), "rate"), [cls, week], "left")
    m = Model(np.ones((1, 1)), np.eye(1), np.array([[q]]), np.array([r]), np.array([m0]), np.eye(1))
    out = kf_multi(d, ["_y"], m, smooth, key, day, buckets, growth=F.coalesce("rate", F.lit(1.0)))
    return out.select(key, day, F.col("mean_1").alias("mean"), F.col("variance_1").alias("variance"))


@dataclass(frozen=True)
class Quality:
    """What each quality class (1 to 3) weighs: factor on the measurement variance, factor on the input, gain of the sensor."""

    weight: tuple[float, float, float] = (3.0, 0.5, 0.0)
    input: tuple[float, float, float] = (0.8, 1.0, 1.0)
    gain: tuple[float, float, float] = (1.1, 1.0, 1.0)
    q: float = 0.5
    r: float = 8.0
    p0: float = 5.0


def quality_step(x: np.ndarray, p: np.ndarray, y: np.ndarray, qa: np.ndarray, u: np.ndarray, m: Quality) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Estimate of this step, then state and variance carried to the next. NaN y, or a class other than 1 to 3: no update; NaN u: no input."""
    known = np.isin(qa, (1, 2, 3))
    k = np.where(known, np.nan_to_num(qa, nan=1), 1).astype(int) - 1
    k = np.clip(k, 0, 2)
    c, b, r = np.array(m.gain)[k], np.array(m.input)[k], np.array(m.weight)[k] * m.r
    gain = np.where(known & ~np.isnan(y), p * c / (c * p * c + r), 0)
    x = x + gain * (np.nan_to_num(y) - c * x)
    return x, x + b * np.nan_to_num(u), p - gain * c * p + m.q


def quality_row(x: float, p: float, y: float, qa: float, u: float, m: Quality) -> tuple[float, float, float]:
    """quality_step of one row, in plain numbers."""
    known = qa in (1, 2, 3)
    k = int(qa) - 1 if known else 0
    c, gain = m.gain[k], 0.0
    if known and y == y:
        s = c * p * c + m.weight[k] * m.r
        gain = p * c / s if s else float("nan")
        x = x + gain * (y - c * x)
    return x, x + m.input[k] * (u if u == u else 0.0), p - gain * c * p + m.q


def kf_quality(df: DataFrame, value: str, qa: str, signal: str, m: Quality = Quality(), key: str = "pixel_id", day: str = "obs_date", buckets: int | None = None) -> DataFrame:
    """(key, day, mean): a filter whose errors follow the quality class, driven by an external signal; 0 on the first day, which is not used."""

    def fn(b: pd.DataFrame) -> pd.DataFrame:
        i, j, v, there, _ = side_by_side(b, ["y", "qa", "u"], key, day)
        x, p, out, begun = np.zeros(len(v)), np.full(len(v), m.p0), np.zeros(there.shape), np.zeros(len(v), bool)
        for t in range(there.shape[1]):
            on = there[:, t] & begun
            est, nx, np_ = quality_step(x, p, v[:, t, 0], v[:, t, 1], v[:, t, 2], m)
            out[:, t] = np.where(on, est, 0)
            x, p = np.where(on, nx, x), np.where(on, np_, p)
            begun |= there[:, t]
        return b[[key, day]].assign(mean=out[i, j])

    d = df.select(key, day, F.col(value).cast("double").alias("y"), F.col(qa).cast("double").alias("qa"), F.col(signal).cast("double").alias("u"))
    return by_buckets(d, fn, f"{key} bigint, {day} date, mean double", key, buckets)


def _mix(*parts: np.ndarray) -> np.ndarray:
    """64 bits that depend on all parts: a draw that is the same wherever it is made."""
    h = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for p in parts:
            h = (np.asarray(p).astype(np.int64).astype(np.uint64) ^ h) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h = h ^ (h >> np.uint64(31))
    return h


def _held_out(df: DataFrame, values: list[str], m: Model, hide: Callable[[np.ndarray, np.ndarray, int], Iterator[tuple[int, float, str, np.ndarray]]], key: str, day: str, buckets: int | None, seconds: tuple[str, ...] = ("both",)) -> DataFrame:
    """(key, day, replicate, part, mode, error): first-sensor values less the smoothed estimate without them.

    Each batch of replicates gives one frame, and buckets are small, as a row has many errors. Replicates are rows of the batch: hide(y, days, pixel) yields the number, the part and the places hidden in one pixel's first
    sensor; mode `fine` leaves out the other sensors.
    """

    def fn(b: pd.DataFrame) -> pd.DataFrame:
        _, _, y, there, days = side_by_side(b, values, key, day)
        pixels = np.unique(b[key].to_numpy())
        number = days.astype("datetime64[D]").astype(int)
        out, batch, size = [], [], max(1, int(BYTES // (8 * len(days) * (len(values) + 3 * len(m.m0) ** 2 + 3))))

        def flush() -> None:
            if not batch:
                return
            x = np.stack([np.where(np.arange(len(values)) == 0, np.where(np.isin(np.arange(len(days)), at), np.nan, y[k, :, 0])[:, None], np.nan if mode == "fine" else y[k]) for k, _, _, mode, at in batch])
            ms, _ = run(x, there[[k for k, *_ in batch]], m, True)
            n = np.array([len(at) for *_, at in batch])
            k, replicate, part = (np.repeat([x[c] for x in batch], n) for c in (0, 1, 2))
            z, at = np.repeat(np.arange(len(batch)), n), np.concatenate([at for *_, at in batch])
            mode = np.repeat(np.array([seconds.index(mode) for *_, mode, _ in batch], np.int8), n)
            out.append(pd.DataFrame({key: pixels[k], day: days[at], "replicate": replicate.astype(np.int32), "part": part.astype(float), "mode": mode, "error": y[k, at, 0] - ms[z, at] @ m.FF[0]}))
            batch.clear()

        for k in range(len(y)):
            for replicate, part, at in hide(y[k, :, 0], number, int(pixels[k])):
                for mode in seconds:
                    batch.append((k, replicate, part, mode, at))
                    if len(batch) >= size:
                        flush()
        flush()
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({key: [], day: [], "replicate": [], "part": [], "mode": [], "error": []})

    d = df.select(key, day, *[F.col(v).cast("double").alias(v) for v in values])
    return by_buckets(d, fn, f"{key} bigint, {day} date, replicate int, part double, mode tinyint, error double", key, buckets, rows=ROWS // 10).withColumn("mode", F.element_at(F.array(*map(F.lit, seconds)), F.col("mode") + 1))


def holdout_runs(df: DataFrame, values: list[str], m: Model, k: int = 1, key: str = "pixel_id", day: str = "obs_date", buckets: int | None = None) -> DataFrame:
    """(key, day, replicate, error): k consecutive valid values of the first sensor are hidden, from each in turn, as long as k are left."""

    def hide(y: np.ndarray, days: np.ndarray, pixel: int) -> Iterator[tuple[int, float, np.ndarray]]:
        valid = np.flatnonzero(~np.isnan(y))
        for s in range(len(valid) - k + 1):
            yield s, 0.0, valid[s : s + k]

    return _held_out(df, values, m, hide, key, day, buckets).drop("part", "mode")


def holdout_sweep(df: DataFrame, values: list[str], m: Model, parts: tuple[float, ...] = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9), iterations: int = 10, modes: tuple[str, ...] = ("both", "fine"), key: str = "pixel_id", day: str = "obs_date", buckets: int | None = None) -> DataFrame:
    """(key, day, replicate, part, mode, error): a share of the first sensor's values is hidden, drawn by hash, with and without the other sensors."""

    def hide(y: np.ndarray, days: np.ndarray, pixel: int) -> Iterator[tuple[int, float, np.ndarray]]:
        valid = np.flatnonzero(~np.isnan(y))
        for q, part in enumerate(parts):
            for i in range(iterations):
                drawn = np.argsort(_mix(np.full(len(valid), pixel), days[valid], np.full(len(valid), q * 1000 + i)), kind="stable")
                at = np.sort(valid[drawn[: round(len(valid) * part)]])
                if len(at):
                    yield i, part, at

    return _held_out(df, values, m, hide, key, day, buckets, modes)


def holdout_fraction(df: DataFrame, values: list[str], m: Model, part: float, iterations: int = 10, key: str = "pixel_id", day: str = "obs_date", buckets: int | None = None) -> DataFrame:
    """(key, day, replicate, error) of one share."""
    return holdout_sweep(df, values, m, (part,), iterations, ("both",), key, day, buckets).drop("part", "mode")


def holdout_rmse(errors: DataFrame, *by: str) -> DataFrame:
    """(by.., rmse, n) of held-out errors."""
    return errors.where(F.col("error").isNotNull()).groupBy(*by).agg(F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse"), F.count("*").alias("n"))


def crossing_of_each_prefix(x: np.ndarray, share: float) -> np.ndarray:
    """For x (pixels, days): at each day t the first day on which x[..t] reaches min + share * (max - min) of its rise to the highest value so far; -1 without a value."""
    b, t = x.shape
    out = np.full((b, t), -1)
    rows = np.arange(b)
    for k in range(t):
        seen = x[:, : k + 1]
        filled = np.where(np.isnan(seen), -np.inf, seen)
        peak = filled.argmax(1)
        high = filled[rows, peak]
        rise = np.arange(k + 1)[None, :] <= peak[:, None]
        low = np.where(rise & ~np.isnan(seen), seen, np.inf).min(1)
        reached = rise & (filled >= (low + (high - low) * share)[:, None])
        out[:, k] = np.where(np.isfinite(high), reached.argmax(1), -1)
    return out


def crossing_so_far(x: np.ndarray, share: float) -> int:
    """The last value of crossing_of_each_prefix for one series without NaN."""
    rise = x[: x.argmax() + 1]
    low = rise.min()
    return int((rise >= low + (rise[-1] - low) * share).argmax())


def forecast_phenology(df: DataFrame, value: Column, share: float = 0.2, q: float = 0.01, r: float = 0.05, m0: float = 0.0, c0: float = 1.0, key: str = "pixel_id", day: str = "obs_date", buckets: int | None = None) -> DataFrame:
    """(key, day, estimate, error): after each step the crossing date that the series so far gives, and its days off the last estimate.

    One forward pass serves all truncations, as the filter up to a day does not depend on later days; between steps it is linear.
    """
    m = Model(np.ones((1, 1)), np.eye(1), np.array([[q]]), np.array([r]), np.array([m0]), np.array([[c0]]))

    def fn(b: pd.DataFrame) -> pd.DataFrame:
        i, j, y, there, days = side_by_side(b, ["y"], key, day)
        ms, _ = run(y, there, m)
        number = days.astype("datetime64[D]").astype(int)
        grid = np.arange(number[0], number[-1] + 1)
        daily = np.full((len(y), len(grid)), np.nan)
        for k in range(len(y)):
            own = np.flatnonzero(there[k])
            span = slice(number[own[0]] - grid[0], number[own[-1]] - grid[0] + 1)
            daily[k, span] = np.interp(grid[span], number[own], ms[k, own, 0])
        at = crossing_of_each_prefix(daily, share)
        est = at[i, number[j] - grid[0]] + grid[0]
        last = np.array([at[k, number[np.flatnonzero(there[k])[-1]] - grid[0]] for k in range(len(y))])[i] + grid[0]
        return b[[key, day]].assign(estimate=est.astype("datetime64[D]").astype("datetime64[ns]"), error=est - last)

    return by_buckets(df.select(key, day, value.cast("double").alias("y")), fn, f"{key} bigint, {day} date, estimate date, error int", key, buckets)
