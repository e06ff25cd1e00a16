"""Column expressions: indices, quality bits, masks and calendar rules. NULL in gives NULL out unless said otherwise."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def evi2(nir: Column, red: Column, scale: float = 1e-4) -> Column:
    n, r = nir * scale, red * scale
    return 2.5 * (n - r) / (n + 2.4 * r + 1)


def evi(nir: Column, red: Column, blue: Column, scale: float = 1e-4, blue_sign: int = -1) -> Column:
    n, r, b = nir * scale, red * scale, blue * scale
    return 2.5 * (n - r) / (n + 6 * r + blue_sign * 7.5 * b + 1)


def normalized(a: Column, b: Column) -> Column:
    """Difference over sum, times 10,000, rounded half to even; NULL where the sum is 0."""
    return F.bround(10000 * (a - b) / F.nullif(a + b, F.lit(0)), 0).cast("int")


def clamp_valid(x: Column, lo: float, hi: float, scale: float = 1.0) -> Column:
    return F.when(x.between(lo, hi), x * scale)


def fill_to_null(x: Column, *fills: int) -> Column:
    return F.when(~x.isin(*fills), x)


def bits(x: Column, first: int, n: int = 1) -> Column:
    return F.shiftright(x, first).bitwiseAND((1 << n) - 1)


def band_quality(qa: Column, band: int) -> Column:
    """Four bits for each band, band 1 lowest."""
    return bits(qa, 4 * (band - 1), 4)


def pixel_class(qa: Column, oli: bool) -> Column:
    """5 fill, 3 water, 2 shadow, 4 snow, 1 cloud, in this order; 0 clear."""
    high = F.when(bits(qa, 8, 2) >= 2, 1) if oli else F.when(bits(qa, 6, 2) >= 2, 1)
    rules = [(qa.isNull() | (bits(qa, 0) == 1), 5), (bits(qa, 2) == 1, 3), (bits(qa, 3) == 1, 2), (bits(qa, 4) == 1, 4), (bits(qa, 5) == 1, 1)]
    out = F
    for test, value in rules:
        out = out.when(test, value)
    return out.otherwise(F.coalesce(high, F.lit(0)))


def lst_class(qc: Column) -> Column:
    """Mandatory bits 00 are 0; 10 and 11 have no value; else the error bits 6-7."""
    return F.when(bits(qc, 0, 2) == 0, 0).when(bits(qc, 0, 2) == 1, bits(qc, 6, 2))


def find_interval(x: Column, breaks: list[float], all_inside: bool = True, rightmost_closed: bool = False) -> Column:
    """How many breaks are not above x; all_inside: within 1 and the number of intervals; rightmost_closed: the last break lies in the last interval."""
    n = sum(((x >= b).cast("int") for b in breaks), F.lit(0))
    if rightmost_closed:
        n = n - (x == breaks[-1]).cast("int")
    if all_inside:
        n = F.greatest(F.lit(1), F.least(F.lit(len(breaks) - 1), n))
    return F.when(x.isNotNull(), n)


def quality_score(q: Column) -> Column:
    """Quarters of the unit range as 3, 2, 1, 0; NULL is 3."""
    return F.coalesce(4 - find_interval(q, [0, 0.25, 0.5, 0.75, 1]), F.lit(3))


def pack(scores: list[Column]) -> Column:
    """Two bits for each score, the first lowest."""
    return sum((F.shiftleft(s, 2 * i) for i, s in enumerate(scores)), F.lit(0))


def unpack(packed: Column, i: int) -> Column:
    return bits(packed, 2 * i, 2)


def evi2_error(red: Column, nir: Column, u_red: Column, u_nir: Column) -> Column:
    d = nir + 2.4 * red + 1
    by_nir, by_red = 2.5 * (3.4 * red + 1) / (d * d), -2.5 * (3.4 * nir + 1) / (d * d)
    return F.sqrt(by_nir * by_nir * u_nir * u_nir + by_red * by_red * u_red * u_red)


def snow_class(product: Column, ndsi: Column, threshold: float = 0.2) -> Column:
    index = F.coalesce(ndsi > threshold, F.lit(False))
    seen = F.coalesce(product == 1, F.lit(False))
    return F.when(seen & index, "both").when(seen, "product").when(index, "index").otherwise("none")


def growing_degrees(tmin: Column, tmax: Column) -> Column:
    return (tmin + tmax) / 2 - 273.3


def mad(x: Column, median: Column) -> Column:
    return 1.4826 * F.median(F.abs(x - median))


def null_to_fill(x: Column, fill: int = 32767) -> Column:
    return F.coalesce(x, F.lit(fill))


def pixel_qa_clear(qa: Column, oli: bool = False) -> Column:
    """No bit of fill, water, shadow, snow, cloud or high confidence (and cirrus for OLI) is set."""
    return qa.bitwiseAND(0b1010111101 if oli else 0b10111101) == 0


def radsat_clear(qa: Column, bands: list[int]) -> Column:
    """No saturation bit among the bands (bit b of band b)."""
    return qa.bitwiseAND(sum(1 << b for b in bands)) == 0


def image_mask(clear: Column, unsaturated: Column, mode: str = "and") -> Column:
    return clear & unsaturated if mode == "and" else clear | unsaturated


def apply_mask(x: Column, qa: Column, good: list[int]) -> Column:
    return F.when(qa.isin(*good), x)


def modis_mask(x: Column, snow: Column, qa: Column) -> Column:
    return F.when(~((snow != 0) | (qa == 4)), x)


def qa_weight(qa: Column, table: dict[int, float]) -> Column:
    """1 for classes of a weight other than 0, else NULL."""
    return F.when(qa.isin(*[k for k, w in table.items() if w]), 1)


def significant_slope(slope: Column, p: Column, alpha: float = 0.05) -> Column:
    return F.when(p <= alpha, slope)


def epoch_to_doy0(day: Column) -> Column:
    return F.datediff(day, F.trunc(day, "year"))


def epoch_to_doy1(day: Column) -> Column:
    return F.dayofyear(day)


def epoch2000_to_1970(n: Column) -> Column:
    """Days of the older product, which count from 1 at 2000-01-01, as days since 1970-01-01."""
    return n + 10957 - 1


def phenology_year(tile: Column, year: Column) -> tuple[Column, Column]:
    """First and last day: the calendar year for tiles north of v09, July to June for the others."""
    north = F.substring(tile, 5, 2).cast("int") < 9
    return F.when(north, F.make_date(year, F.lit(1), F.lit(1))).otherwise(F.make_date(year, F.lit(7), F.lit(1))), F.when(north, F.make_date(year, F.lit(12), F.lit(31))).otherwise(F.make_date(year + 1, F.lit(6), F.lit(30)))


def hemisphere_shift(doy: Column, lat: Column) -> Column:
    return doy + F.when(lat < 0, 182.5).otherwise(0.0)


#: The sinusoidal grid.
GRID_X, GRID_Y, TILE = -20015109.354, 10007554.677, 1111950.5197


def tile_of(x: Column, y: Column) -> Column:
    two = lambda c, most: F.lpad(F.least(F.greatest(F.floor(c), F.lit(0)), F.lit(most)).cast("string"), 2, "0")
    return F.concat(F.lit("h"), two((x - GRID_X) / TILE, 35), F.lit("v"), two((GRID_Y - y) / TILE, 17))


def tile_origin(tile: Column) -> tuple[Column, Column]:
    """Upper left corner."""
    return F.substring(tile, 2, 2).cast("int") * TILE + GRID_X, GRID_Y - F.substring(tile, 5, 2).cast("int") * TILE


def cell_number(row: Column, col: Column, ncols: int) -> Column:
    """Linear cell number from 1."""
    return (row - 1) * ncols + col


def cell_offset(cell: Column, first_row: int, ncols: int) -> Column:
    return cell - (first_row - 1) * ncols


def scale_metrics(value: Column, name: Column, scale: float = 1e4, fill: int = 32767) -> Column:
    """Minimum and amplitude times scale, area times a thousandth of it, others as they are; integers with a fill value."""
    by = F.when(name.isin("evi_min", "evi_amp"), scale).when(name == "evi_area", scale / 1000).otherwise(1.0)
    return F.coalesce(F.bround(value * by, 0).cast("int"), F.lit(fill))


def sensor_error(x: Column, sensor: Column, share: dict[str, float] | None = None) -> Column:
    out = F
    for name, k in (share or {"TM": 0.07, "ETM": 0.05, "OLI": 0.05}).items():
        out = out.when(sensor == name, x * k)
    return out


def mid_phase(a: Column, b: Column) -> Column:
    return (a + b) / 2


def kf_band(mean: Column, se: Column, level: float = 0.95) -> tuple[Column, Column]:
    z = NormalDist().inv_cdf((1 + level) / 2)
    return mean - z * se, mean + z * se


def parse_scene_name(name: Column) -> tuple[Column, Column, Column]:
    """Sensor, pixel and date of names such as S1.17.A1995005."""
    part = lambda i: F.regexp_extract(name, r"^(\w+)\.(\d+)\.A(\d{7})$", i)
    return part(1), part(2).cast("long"), F.to_date(part(3), "yyyyDDD")


def aggregate(name: str, x: Column) -> Column:
    """An aggregate by its name."""
    return {"mean": F.avg, "median": F.median, "min": F.min, "max": F.max, "sd": F.stddev_samp, "n": F.count}[name](x)


def week_of_year(day: str) -> Column:
    """Weeks that begin on Sunday; 0 before the first one of the year."""
    return F.floor((F.dayofyear(day) - 1 + 7 - (F.dayofweek(day) - 1)) / 7).cast("int")


def correlation(a: str | Column, b: str | Column) -> Column:
    """Over complete pairs, as an aggregate; NULL where either is constant (the built-in one divides by zero there)."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    both = a.isNotNull() & b.isNotNull()
    x, y = (F.when(both, c.cast("double")) for c in (a, b))
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def _middle(a: str) -> str:
    """SQL for the median of a sorted array; NULL if empty."""
    return f"(get({a}, (size({a}) - 1) div 2) + get({a}, size({a}) div 2)) / 2"


def mad_sql(x: str) -> str:
    """SQL of the scaled median absolute deviation as one aggregate, for GROUP BY and HAVING; a group's values stand in one array."""
    return f"element_at(transform(array(array_sort(collect_list(CAST({x} AS DOUBLE)))), s -> 1.4826D * element_at(transform(array(array_sort(transform(s, v -> abs(v - {_middle('s')})))), r -> {_middle('r')}), 1)), 1)"


def tukey_bounds_sql(x: str, k: float = 1.5) -> str:
    """SQL of the quartiles widened by k interquartile ranges, as an aggregate struct (low, high)."""
    return f"element_at(transform(array(percentile({x}, array(0.25D, 0.75D))), q -> named_struct('low', q[0] - {k}D * (q[1] - q[0]), 'high', q[1] + {k}D * (q[1] - q[0]))), 1)"
