"""Column functions of the state-change model: leaders, packed states, dates, grids and distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
KM_PER_LAT = 110.574
EPOCH = "2010-01-01"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_capture(state, prev) -> Column:
    """The holder changed; null counts as uncaptured (0)."""
    return F.coalesce(_c(state), F.lit(0)) != F.coalesce(_c(prev), F.lit(0))


def leader(holder, a, b, c) -> Column:
    """The faction with most bots; the holder wins a tie for the most, then the lower number; 0 when empty."""
    holder, a, b, c = map(_c, (holder, a, b, c))
    most = F.greatest(a, b, c)
    held = F.when(holder == 1, a).when(holder == 2, b).when(holder == 3, c)
    return F.when(a + b + c <= 0, 0).when(held == most, holder.cast("int")).when(a == most, 1).when(b == most, 2).otherwise(3)


def magnitude(total) -> Column:
    """Eight buckets a decade, 1 to 63; 0 when empty. Halves are rounded up."""
    total = _c(total)
    return F.when(total <= 0, 0).otherwise(F.least(F.lit(63), (1 + F.round(F.log10(total + 1) * 8)).cast("int")))


def pack_display(holder, a, b, c) -> Column:
    total = _c(a) + _c(b) + _c(c)
    return F.when(total <= 0, 0).otherwise(leader(holder, a, b, c) * 64 + magnitude(total))


def faction_of(packed) -> Column:
    return F.shiftright(_c(packed), 6)


def magnitude_of(packed) -> Column:
    return _c(packed).bitwiseAND(63)


def approx_total(bucket) -> Column:
    bucket = _c(bucket)
    return F.when(bucket == 0, 0).otherwise(F.round(F.pow(F.lit(10.0), (bucket - 1) / 8) - 1)).cast("long")


def day_no(day, epoch: str = EPOCH) -> Column:
    return F.datediff(_c(day), F.lit(epoch).cast("date"))


def day_date(number, epoch: str = EPOCH) -> Column:
    return F.date_add(F.lit(epoch).cast("date"), _c(number))


def last_complete_day(newest, today) -> Column:
    """The newest day, or the one before it while it is still today."""
    return F.when(_c(newest) == _c(today), F.date_sub(_c(newest), 1)).otherwise(_c(newest))


#: Named windows in days; None is the whole record.
WINDOWS = {"day": 1, "week": 7, "month": 30, "quarter": 91, "year": 365, "all": None}


def window_start(key: str, end, first) -> Column:
    days = WINDOWS[key]
    return _c(first) if days is None else F.greatest(_c(first), F.date_sub(_c(end), days))


def range_km(day, cutover: str = "2017-04-26", before: float = 643.7, after: float = 1609.3) -> Column:
    return F.when(_c(day) >= F.lit(cutover).cast("date"), after).otherwise(before)


def quantize(x) -> Column:
    """Fixed-point degrees, four digits, halves to even."""
    return F.rint(_c(x) * 10000).cast("int")


def _row(lat, lon, size: int) -> Column:
    # greatest() passes over nulls
    placed = _c(lat).isNotNull() & _c(lon).isNotNull()
    lat = F.least(F.greatest(_c(lat), F.lit(-90.0)), F.lit(90.0))
    lon = F.least(F.greatest(_c(lon), F.lit(-180.0)), F.lit(180.0))
    rows, cols = -(-180 // size), -(-360 // size)
    row = F.least(F.floor((lat + 90) / size), F.lit(rows - 1))
    col = F.least(F.floor((lon + 180) / size), F.lit(cols - 1))
    return F.when(placed, (row * cols + col).cast("int"))


def tile_of(lat, lon) -> Column:
    """16-degree tiles; coordinates are clamped first."""
    return _row(lat, lon, 16)


def cell_of(lat, lon) -> Column:
    """1-degree cells; coordinates are clamped first."""
    return _row(lat, lon, 1)


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    half = lambda a, b: F.sin(F.radians(b - a) / 2)
    h = half(lat1, lat2) * half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2) * half(lon1, lon2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def in_bounds(lat, lon, west: float, south: float, east: float, north: float) -> Column:
    """Inclusive box; a box with west > east crosses the antimeridian. Null and NaN fall out."""
    lon = _c(lon)
    across = lon.between(west, east) if west <= east else ((lon >= west) & (lon <= 180)) | (lon <= east)
    return _c(lat).between(south, north) & across


def within_km(lat, lon, lat0: float, lon0: float, km: float) -> Column:
    """A latitude band first, then the great circle."""
    return (F.abs(_c(lat) - lat0) <= km / KM_PER_LAT * 1.05) & (haversine_km(lat, lon, F.lit(lat0), F.lit(lon0)) <= km)


def occupancy_class(packed, ever_active) -> Column:
    return F.when(_c(packed) != 0, "held").when(_c(ever_active), "emptied").otherwise("never")


def category_bit(packed, ever_active) -> Column:
    """Bits 1 to 3 by leader, bit 0 for emptied, bit 4 for never played."""
    return F.when(_c(packed) != 0, F.expr("1") * F.pow(F.lit(2), faction_of(packed)).cast("int")).when(_c(ever_active), 1).otherwise(16)


def growth(now, then) -> Column:
    """Ratio; null when there is nothing to compare with."""
    return F.when((_c(then).isNull()) | (_c(then) == 0), None).otherwise(_c(now) / _c(then))


def region_in(country, region, want_country, want_region=None) -> Column:
    """A region, if given, overrides the country."""
    return _c(region) == want_region if want_region is not None else _c(country) == want_country


def growth_label(now, then) -> Column:
    """``same`` under 0.05 % of change, ``times`` from a factor of 10 on, else ``up`` or ``down``; null without a ratio."""
    ratio = growth(now, then)
    return F.when(F.abs(ratio - 1) < 0.0005, "same").when(ratio >= 10, "times").when(ratio > 1, "up").when(ratio.isNotNull(), "down")


def in_gap(day, year: int = 2019) -> Column:
    """Whether a day lies in the year of the collection gap."""
    return F.year(_c(day)) == year


def in_categories(packed, ever_active, mask: int) -> Column:
    """Whether a zone's category is one of those in the bit mask."""
    return category_bit(packed, ever_active).bitwiseAND(F.lit(mask)) != 0


def identity_label(label, known) -> Column:
    """A label, or what stands for one that an existing zone lacks; null where no zone is known."""
    return F.when(known, F.coalesce(_c(label), F.lit("Region not identified")))
