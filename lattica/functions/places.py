"""Places: great-circle distances, a nested grid, Mercator metres, polygons and lines.

Cells are quadkeys over latitude and longitude: a cell at resolution r is a string of r digits, and its parent is the string
without its last ones, so cells nest exactly. Ids differ from those of hexagonal grids; binning, parents, centres and
neighbours serve alike.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
EQUATOR_M = 6378137.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.sqrt(a), F.lit(1.0)))


def _index(value: Column, low: float, span: float, res: int) -> Column:
    n = 1 << res
    return F.least(F.greatest(F.floor((value - low) / span * n), F.lit(0)), F.lit(n - 1)).cast("long")


def cell_xy(lat: Column, lon: Column, res: int) -> tuple[Column, Column]:
    return _index(lon, -180.0, 360.0, res), _index(lat, -90.0, 180.0, res)


def quadkey(x: Column, y: Column, res: int) -> Column:
    bit = lambda v, k: F.shiftright(v, k).bitwiseAND(F.lit(1))
    return F.concat(*((bit(x, k) + 2 * bit(y, k)).cast("string") for k in range(res - 1, -1, -1)))


def cell(lat: Column, lon: Column, res: int) -> Column:
    return quadkey(*cell_xy(lat, lon, res), res)


def parent(cell_id: Column, res: int) -> Column:
    return F.substring(cell_id, 1, res)


def _unpacked(cell_id: Column, axis: int) -> Column:
    digits = F.split(cell_id, "")
    return F.aggregate(digits, F.lit(0).cast("long"), lambda a, d: F.when(d == "", a).otherwise(a * 2 + F.shiftright(d.cast("long"), axis) % 2))


def centre(cell_id: Column) -> tuple[Column, Column]:
    """Latitude and longitude of a cell's middle."""
    n = F.pow(F.lit(2.0), F.length(cell_id))
    return (_unpacked(cell_id, 1) + 0.5) / n * 180 - 90, (_unpacked(cell_id, 0) + 0.5) / n * 360 - 180


def mercator(lat: Column, lon: Column) -> tuple[Column, Column]:
    """x and y in metres."""
    return F.radians(lon) * EQUATOR_M, F.ln(F.tan(F.lit(0.7853981633974483) + F.radians(lat) / 2)) * EQUATOR_M


def inside(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point is inside a ring, an array of (x, y) structs, by the number of edges east of it."""
    following = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    crosses = lambda a, b: ((a["y"] > y) != (b["y"] > y)) & (x < F.try_divide((b["x"] - a["x"]) * (y - a["y"]), b["y"] - a["y"]) + a["x"])
    hits = F.zip_with(ring, following, lambda a, b: F.coalesce(crosses(a, b), F.lit(False)).cast("int"))
    return F.aggregate(hits, F.lit(0), lambda n, h: n + h) % 2 == 1


def clipped_share(x1: Column, y1: Column, x2: Column, y2: Column, left: Column, bottom: Column, right: Column, top: Column) -> Column:
    """The part of a segment that lies in a box, from 0 to 1 (Liang-Barsky)."""
    dx, dy = x2 - x1, y2 - y1
    low, high = F.lit(0.0), F.lit(1.0)
    outside = F.lit(False)
    for d, near, far in ((dx, left - x1, right - x1), (dy, bottom - y1, top - y1)):
        a, b = F.try_divide(near, d), F.try_divide(far, d)
        low = F.when(d != 0, F.greatest(low, F.least(a, b))).otherwise(low)
        high = F.when(d != 0, F.least(high, F.greatest(a, b))).otherwise(high)
        outside = outside | ((d == 0) & ((near > 0) | (far < 0)))
    return F.when(outside, 0.0).otherwise(F.greatest(high - low, F.lit(0.0)))
