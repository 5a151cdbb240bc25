"""Grid codes, tiles and distances as column arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000
TILE_ZOOM = 15


def _int(c: Column) -> Column:
    return c.cast("int")


def _text(c: Column) -> Column:
    return c.cast("string")


def _two(c: Column) -> Column:
    return F.lpad(_text(c), 2, "0")


def mesh_code(lat: Column, lng: Column, level: int = 3) -> Column:
    """JIS X 0410 grid code: 4, 6, 8 or 9 digits for levels 1 to 4.

    Minutes and degrees are reduced step by step so that doubles fall into the same cell
    as in the standard's own worked order.
    """
    minutes = lat * F.lit(60.0)
    p = _int(minutes / F.lit(40.0))
    minutes = minutes - p * F.lit(40.0)
    u = _int(lng - F.lit(100.0))
    degrees = lng - F.lit(100.0) - u
    parts = [_two(p), _two(u)]
    if level >= 2:
        q = _int(minutes / F.lit(5.0))
        minutes = minutes - q * F.lit(5.0)
        v = _int(degrees * F.lit(60.0) / F.lit(7.5))
        degrees = degrees - v * F.lit(7.5) / F.lit(60.0)
        parts += [_text(q), _text(v)]
    if level >= 3:
        r = _int(minutes * F.lit(60.0) / F.lit(30.0))
        w = _int(degrees * F.lit(3600.0) / F.lit(45.0))
        parts += [_text(r), _text(w)]
        if level >= 4:
            north = F.when(minutes * F.lit(60.0) - r * F.lit(30.0) < 15, 0).otherwise(2)
            east = F.when(degrees * F.lit(3600.0) - w * F.lit(45.0) < 22.5, 0).otherwise(1)
            parts.append(_text(north + east + F.lit(1)))
    return F.concat(*parts)


def mesh_bounds(code: Column) -> Column:
    """struct(south, north, west, east) of a 4/6/8/9 digit code; null for a shorter one."""

    def digit(i: int, n: int = 1) -> Column:
        return F.substring(code, i, n).try_cast("int")

    size = F.length(code)
    deep2, deep3, deep4 = size >= 6, size >= 8, size >= 9
    south = digit(1, 2) * F.lit(40.0) / F.lit(60.0)
    west = (digit(3, 2) + F.lit(100)).cast("double")
    height, width = F.lit(40.0) / F.lit(60.0), F.lit(1.0)
    south = F.when(deep2, south + digit(5) * F.lit(5.0) / F.lit(60.0)).otherwise(south)
    west = F.when(deep2, west + digit(6) * F.lit(7.5) / F.lit(60.0)).otherwise(west)
    height = F.when(deep2, F.lit(5.0) / F.lit(60.0)).otherwise(height)
    width = F.when(deep2, F.lit(7.5) / F.lit(60.0)).otherwise(width)
    south = F.when(deep3, south + digit(7) * F.lit(30.0) / F.lit(3600.0)).otherwise(south)
    west = F.when(deep3, west + digit(8) * F.lit(45.0) / F.lit(3600.0)).otherwise(west)
    height = F.when(deep3, F.lit(30.0) / F.lit(3600.0)).otherwise(height)
    width = F.when(deep3, F.lit(45.0) / F.lit(3600.0)).otherwise(width)
    # half cells halve the distance between the (rounded) edges of the full cell
    half = digit(9) - 1
    half_height, half_width = (south + height - south) / F.lit(2.0), (west + width - west) / F.lit(2.0)
    south4 = F.when(deep4, south + F.floor(half / F.lit(2)) * half_height).otherwise(south)
    west4 = F.when(deep4, west + F.pmod(half, F.lit(2)) * half_width).otherwise(west)
    north = south4 + F.when(deep4, half_height).otherwise(height)
    east = west4 + F.when(deep4, half_width).otherwise(width)
    box = F.struct(south4.alias("south"), north.alias("north"), west4.alias("west"), east.alias("east"))
    return F.when(size >= 4, box)


def mesh_center(code: Column) -> Column:
    box = mesh_bounds(code)
    return F.when(
        F.length(code) >= 4,
        F.struct(
            ((box["south"] + box["north"]) / F.lit(2.0)).alias("lat"),
            ((box["west"] + box["east"]) / F.lit(2.0)).alias("lng"),
        ),
    )


def tile_x(lng: Column, zoom: int = TILE_ZOOM) -> Column:
    return _int((lng + F.lit(180.0)) / F.lit(360.0) * F.lit(float(2**zoom)))


def tile_y(lat: Column, zoom: int = TILE_ZOOM) -> Column:
    rad = F.radians(lat)
    mercator = F.log(F.tan(rad) + F.lit(1.0) / F.cos(rad)) / F.lit(math.pi)
    return _int((F.lit(1.0) - mercator) / F.lit(2.0) * F.lit(float(2**zoom)))


def haversine_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    dlat, dlng = F.radians(lat2 - lat1), F.radians(lng2 - lng1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlng / 2), 2)
    return F.lit(2.0 * EARTH_RADIUS_M) * F.asin(F.sqrt(a))


def in_japan(lat: Column, lng: Column) -> Column:
    return lat.between(24.0, 46.0) & lng.between(122.0, 154.0)
