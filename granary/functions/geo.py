"""Geographic values: a point is one integer, 32 bits of longitude above 32 bits of latitude counted from the north pole."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The earth's radius and half circumference in metres, latitude units a metre, units of a full 32-bit turn.
RADIUS, HALF_AROUND, UNITS_PER_METRE, TURN = 6378137, 20037508, 214, 2**32
LOW = (1 << 32) - 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 & 1 else x


def pack(lat: float, lon: float) -> int:
    """The point as a signed 64-bit integer; latitude is clamped, longitude goes round."""
    lat = min(90.0, max(-90.0, lat))
    a = min(int((90 - lat) / 180.0 * TURN), LOW)
    b = int((180 + lon) / 360.0 * TURN) % TURN
    return _signed(b << 32 | a)


def unpack(geo: int) -> tuple[int, int]:
    """Units of latitude and longitude."""
    return geo & LOW, geo >> 32 & LOW


def degrees(geo: int) -> tuple[float, float]:
    a, b = unpack(geo)
    return 90 - a * 180.0 / TURN, b * 360.0 / TURN - 180


def pack_column(lat: Column, lon: Column) -> Column:
    lat = F.least(F.lit(90.0), F.greatest(F.lit(-90.0), lat.cast("double")))
    a = F.least(((90 - lat) / 180.0 * TURN).cast("bigint"), F.lit(LOW))
    b = ((180 + lon.cast("double")) / 360.0 * TURN).cast("bigint").bitwiseAND(F.lit(LOW))
    return F.shiftleft(b, 32).bitwiseOR(a)


def lat_units(geo: Column) -> Column:
    return geo.bitwiseAND(F.lit(LOW))


def lon_units(geo: Column) -> Column:
    return F.shiftrightunsigned(geo, 32)


def distance(p: Column, q: Column) -> Column:
    """Whole metres between two points on a sphere (haversine)."""
    lat = lambda g: 90 - lat_units(g) * 180.0 / TURN
    lon = lambda g: lon_units(g) * 360.0 / TURN - 180
    a, b = F.sin(F.radians((lat(p) - lat(q)) / 2)), F.sin(F.radians((lon(p) - lon(q)) / 2))
    h = a * a + F.cos(F.radians(lat(p))) * F.cos(F.radians(lat(q))) * b * b
    return F.floor(2 * F.asin(F.least(F.sqrt(h), F.lit(1.0))) * RADIUS).cast("bigint")


def in_circle(point: Column, centre: int, radius: int) -> Column:
    """A band of latitudes first, which prunes files, then the distance; the band is 214 units a metre wide."""
    radius = min(radius, HALF_AROUND)
    lat, reach = unpack(centre)[0], UNITS_PER_METRE * radius
    band = lat_units(point).between(max(lat - reach, 0), min(lat + reach, LOW))
    return band & (distance(point, F.lit(centre)) <= radius)


def in_polygon(point: Column, corners: list[int]) -> Column:
    """Bounding box first; inside, the corners wind once around the point."""
    if not corners:
        return F.lit(False)
    units = [unpack(c) for c in corners]
    lat, lon = lat_units(point), lon_units(point)
    lats, lons = [a for a, _ in units], [b for _, b in units]
    box = lat.between(min(lats), max(lats)) & lon.between(min(lons), max(lons))
    bearing = [F.atan2((F.lit(b) - lon).cast("double"), (F.lit(a) - lat).cast("double")) for a, b in units]

    def turn(then: Column, first: Column) -> Column:
        d = then - first
        return F.when(d > math.pi, d - 2 * math.pi).when(d < -math.pi, d + 2 * math.pi).otherwise(d)

    # each bearing is taken once, bound to a variable, and compared with the one before it
    wind = lambda v: F.aggregate(F.zip_with(v, F.concat(F.slice(v, -1, 1), F.slice(v, 1, len(units) - 1)) if len(units) > 1 else v, turn), F.lit(0.0), lambda x, y: x + y)
    whole = F.transform(F.array(F.array(*bearing)), wind)[0]
    return box & (F.abs(F.abs(whole) - 2 * math.pi) < 0.01)
