"""Map coordinates and the line between day and night as Column expressions."""

from __future__ import annotations

from datetime import datetime, timezone
from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

# The map projection's radius of the earth, and below the constants of the almanac's low-precision sun.
EARTH_RADIUS_M = 6378137.0


def mercator_x(lon: Column) -> Column:
    return lon * F.lit(pi / 180 * EARTH_RADIUS_M)


def mercator_y(lat: Column) -> Column:
    return F.log(F.tan(F.lit(pi / 4) + lat * F.lit(pi / 360))) * F.lit(EARTH_RADIUS_M)


def in_extent(x: Column, y: Column, low_x: float, low_y: float, high_x: float, high_y: float) -> Column:
    return (x >= low_x) & (x <= high_x) & (y >= low_y) & (y <= high_y)


def speed_kmh(vx: Column, vy: Column, vz: Column) -> Column:
    """Of km/s components."""
    return F.sqrt(vx * vx + vy * vy + vz * vz) * F.lit(3600.0)


def julian_day(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / F.lit(86400e6) + F.lit(2440587.5)


def sun(jd: Column) -> tuple[Column, Column]:
    """Right ascension and declination of the sun in degrees (low-precision formulas of the almanac)."""
    n = jd - F.lit(2451545.0)
    length = (F.lit(280.460) + F.lit(0.9856474) * n) % F.lit(360.0)
    anomaly = F.radians((F.lit(357.528) + F.lit(0.9856003) * n) % F.lit(360.0))
    ecliptic = F.radians(length + F.lit(1.915) * F.sin(anomaly) + F.lit(0.02) * F.sin(anomaly * 2))
    century = n / F.lit(36525.0)
    tilt = F.radians(F.lit(23.43929111) - century * (F.lit(46.836769 / 3600) - century * (F.lit(0.0001831 / 3600) + century * (F.lit(0.00200340 / 3600) - century * (F.lit(0.576e-6 / 3600) - century * F.lit(4.34e-8 / 3600))))))
    ascension = F.degrees(F.atan(F.cos(tilt) * F.tan(ecliptic)))
    quadrant, own = F.floor(F.degrees(ecliptic) / 90) * 90, F.floor(ascension / 90) * 90
    return ascension + (quadrant - own), F.degrees(F.asin(F.sin(tilt) * F.sin(ecliptic)))


def sidereal_hours(jd: Column) -> Column:
    return (F.lit(18.697374558) + F.lit(24.06570982441908) * (jd - F.lit(2451545.0))) % F.lit(24.0)


def terminator_latitude(lng: Column, sidereal: Column, ascension: Column, declination: Column) -> Column:
    """Latitude of the day-night line on a meridian; null on an exact equinox."""
    hour_angle = F.radians(sidereal * 15 + lng - ascension)
    return F.degrees(F.atan(-F.try_divide(F.cos(hour_angle), F.tan(F.radians(declination)))))


def terminator_ring(day: Column, resolution: int = 2) -> Column:
    """The closed ring of (lng, lat) around the night side at a day's midnight: 720 degrees of line, then the dark pole."""
    jd = julian_day(day)
    ascension, declination = sun(jd)
    steps = 720 * resolution
    pole = F.when(declination < 0, F.lit(90.0)).otherwise(F.lit(-90.0))

    def vertex(i: Column) -> Column:
        lng = i / F.lit(float(resolution)) - F.lit(360.0)
        return F.struct(lng.alias("lng"), terminator_latitude(lng, sidereal_hours(jd), ascension, declination).alias("lat"))

    line = F.transform(F.sequence(F.lit(0), F.lit(steps)), vertex)
    corner = lambda lng: F.struct(F.lit(lng).alias("lng"), pole.alias("lat"))
    ring = F.concat(F.array(corner(-360.0)), line, F.array(corner(360.0)))
    return F.reverse(F.concat(ring, F.array(corner(-360.0))))


def utc(year: int, month: int, day: int) -> datetime:
    return datetime(year, month, day, tzinfo=timezone.utc)
