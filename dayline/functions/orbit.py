"""Satellite positions: the SGP4 theory for near-earth orbits (Hoots and Roehrich 1980, revised 2006), vectorised over times, behind Arrow UDFs.

Orbits with periods of 225 minutes or more, element sets that can't be read and decayed orbits give nulls.
"""

from __future__ import annotations

from functools import lru_cache
from math import cos, pi, radians, sin, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The theory's earth (WGS 72).
MU, RE, J2, J3, J4 = 398600.8, 6378.135, 0.001082616, -0.00000253881, -0.00000165597
XKE = 60.0 / sqrt(RE**3 / MU)
TWO_PI = 2 * pi
STATE = "x double, y double, z double, vx double, vy double, vz double"
PLACE = "lat double, lng double, height_km double, speed_kmh double"


class Orbit:
    """An element set made ready for propagation."""

    def __init__(self, line1: str, line2: str):
        year = int(line1[18:20])
        self.epoch_jd = _new_year(year + (1900 if year >= 57 else 2000)) + float(line1[20:32]) - 1
        self.bstar = float(f"{line1[53]}.{line1[54:59].strip()}e{line1[59:61]}".replace(" ", ""))
        self.i, self.node, self.argp, self.m = (radians(float(line2[a:b])) for a, b in ((8, 16), (17, 25), (34, 42), (43, 51)))
        self.e, n = float("." + line2[26:33].strip()), float(line2[52:63]) * TWO_PI / 1440
        if TWO_PI / n >= 225:
            raise ValueError("not a near-earth orbit")
        e, c = self.e, cos(self.i)
        s, c2 = sin(self.i), c * c
        beta2 = 1 - e * e
        beta = sqrt(beta2)
        # mean motion and axis of the theory
        d1 = 0.75 * J2 * (3 * c2 - 1) / (beta * beta2)
        a = (XKE / n) ** (2 / 3)
        d = d1 / a**2
        a *= 1 - d * d - d * (1 / 3 + 134 * d * d / 81)
        self.n = n / (1 + d1 / a**2)
        self.a = a = (XKE / self.n) ** (2 / 3)
        n = self.n
        self.con41, self.x1mth2, self.x7thm1, con42 = 3 * c2 - 1, 1 - c2, 7 * c2 - 1, 1 - 5 * c2
        p = a * beta2
        perigee = a * (1 - e)
        height = (perigee - 1) * RE
        low = 78.0 if height >= 156 else max(20.0, height - 78)
        q4, s4 = ((120 - low) / RE) ** 4, low / RE + 1
        self.simple = perigee < 220 / RE + 1
        # drag
        tsi = 1 / (a - s4)
        self.eta = eta = a * e * tsi
        eta2, eeta = eta * eta, e * eta
        psi = abs(1 - eta2)
        coef = q4 * tsi**4
        coef1 = coef / psi**3.5
        c2d = coef1 * n * (a * (1 + 1.5 * eta2 + eeta * (4 + eta2)) + 0.375 * J2 * tsi / psi * self.con41 * (8 + 3 * eta2 * (8 + eta2)))
        self.c1 = c1 = self.bstar * c2d
        c3 = -2 * coef * tsi * J3 / J2 * n * s / e if e > 1e-4 else 0.0
        self.c4 = 2 * n * coef1 * a * beta2 * (eta * (2 + 0.5 * eta2) + e * (0.5 + 2 * eta2) - J2 * tsi / (a * psi) * (-3 * self.con41 * (1 - 2 * eeta + eta2 * (1.5 - 0.5 * eeta)) + 0.75 * self.x1mth2 * (2 * eta2 - eeta * (1 + eta2)) * cos(2 * self.argp)))
        self.c5 = 2 * coef1 * a * beta2 * (1 + 2.75 * (eta2 + eeta) + eeta * eta2)
        # secular rates
        c4 = c2 * c2
        t1 = 1.5 * J2 / p**2 * n
        t2 = 0.5 * t1 * J2 / p**2
        t3 = -0.46875 * J4 / p**4 * n
        self.m_dot = n + 0.5 * t1 * beta * self.con41 + 0.0625 * t2 * beta * (13 - 78 * c2 + 137 * c4)
        self.argp_dot = -0.5 * t1 * con42 + 0.0625 * t2 * (7 - 114 * c2 + 395 * c4) + t3 * (3 - 36 * c2 + 49 * c4)
        node1 = -t1 * c
        self.node_dot = node1 + (0.5 * t2 * (4 - 19 * c2) + 2 * t3 * (3 - 7 * c2)) * c
        self.omg = self.bstar * c3 * cos(self.argp)
        self.xm = -2 / 3 * coef * self.bstar / eeta if e > 1e-4 else 0.0
        self.node_cf, self.t2c = 3.5 * beta2 * node1 * c1, 1.5 * c1
        self.xl = -0.25 * J3 / J2 * s * (3 + 5 * c) / (1 + c if abs(1 + c) > 1.5e-12 else 1.5e-12)
        self.ay = -0.5 * J3 / J2 * s
        self.d2 = 4 * a * tsi * c1 * c1
        t = self.d2 * tsi * c1 / 3
        self.d3, self.d4 = (17 * a + s4) * t, 0.5 * t * a * tsi * (221 * a + 31 * s4) * c1
        self.t3c = self.d2 + 2 * c1 * c1
        self.t4c = 0.25 * (3 * self.d3 + c1 * (12 * self.d2 + 10 * c1 * c1))
        self.t5c = 0.2 * (3 * self.d4 + 12 * c1 * self.d3 + 6 * self.d2**2 + 15 * c1 * c1 * (2 * self.d2 + c1 * c1))

    def state(self, t: np.ndarray) -> np.ndarray:
        """Positions (km) and velocities (km/s) in the frame of the true equator and mean equinox, t minutes after the epoch: rows of six."""
        xmdf, argp, node = self.m + self.m_dot * t, self.argp + self.argp_dot * t, self.node + self.node_dot * t + self.node_cf * t * t
        mm, ta, te, tl = xmdf, 1 - self.c1 * t, self.bstar * self.c4 * t, self.t2c * t * t
        if not self.simple:
            shift = self.omg * t + self.xm * ((1 + self.eta * np.cos(xmdf)) ** 3 - (1 + self.eta * cos(self.m)) ** 3)
            mm, argp = xmdf + shift, argp - shift
            ta = ta - self.d2 * t**2 - self.d3 * t**3 - self.d4 * t**4
            te = te + self.bstar * self.c5 * (np.sin(mm) - sin(self.m))
            tl = tl + self.t3c * t**3 + t**4 * (self.t4c + t * self.t5c)
        a = self.a * ta * ta
        n, e = XKE / a**1.5, np.clip(self.e - te, 1e-6, 1 - 1e-6)
        mm = mm + self.n * tl
        xlm = (mm + argp + node) % TWO_PI
        node, argp = node % TWO_PI, argp % TWO_PI
        mm = (xlm - argp - node) % TWO_PI
        # long-period terms and Kepler's equation
        ax, part = e * np.cos(argp), 1 / (a * (1 - e * e))
        ay = e * np.sin(argp) + part * self.ay
        u = (mm + argp + part * self.xl * ax) % TWO_PI
        w = u.copy()
        for _ in range(10):
            sw, cw = np.sin(w), np.cos(w)
            w = w + np.clip((u - ay * cw + ax * sw - w) / (1 - cw * ax - sw * ay), -0.95, 0.95)
        sw, cw = np.sin(w), np.cos(w)
        ecos, esin, el2 = ax * cw + ay * sw, ax * sw - ay * cw, ax * ax + ay * ay
        pl, r = a * (1 - el2), a * (1 - ecos)
        r_dot, rv_dot, beta = np.sqrt(a) * esin / r, np.sqrt(pl) / r, np.sqrt(1 - el2)
        k = esin / (1 + beta)
        su, cu = a / r * (sw - ay - ax * k), a / r * (cw - ax + ay * k)
        s2, c2 = 2 * cu * su, 1 - 2 * su * su
        # short-period terms
        t1 = 0.5 * J2 / pl
        t2 = t1 / pl
        c, s = cos(self.i), sin(self.i)
        rad = r * (1 - 1.5 * t2 * beta * self.con41) + 0.5 * t1 * self.x1mth2 * c2
        angle = np.arctan2(su, cu) - 0.25 * t2 * self.x7thm1 * s2
        node, inc = node + 1.5 * t2 * c * s2, self.i + 1.5 * t2 * c * s * c2
        v1 = r_dot - n * t1 * self.x1mth2 * s2 / XKE
        v2 = rv_dot + n * t1 * (self.x1mth2 * c2 + 1.5 * self.con41) / XKE
        sa, ca, sn, cn, si, ci = np.sin(angle), np.cos(angle), np.sin(node), np.cos(node), np.sin(inc), np.cos(inc)
        ux = np.stack([-sn * ci * sa + cn * ca, cn * ci * sa + sn * ca, si * sa])
        vx = np.stack([-sn * ci * ca - cn * sa, cn * ci * ca - sn * sa, si * ca])
        out = np.concatenate([rad * ux * RE, (v1 * ux + v2 * vx) * RE * XKE / 60]).T
        out[(rad < 1) | (a < 0.95)] = np.nan
        return out


def _new_year(year: int) -> float:
    """Julian day of January 1st, midnight."""
    y = year - 1
    return 1721425.5 + 365 * y + y // 4 - y // 100 + y // 400


@lru_cache(maxsize=4096)
def orbit(line1: str, line2: str) -> Orbit | None:
    try:
        return Orbit(line1, line2)
    except (ValueError, IndexError, TypeError, ZeroDivisionError):
        return None


def sidereal(jd: np.ndarray) -> np.ndarray:
    """Greenwich mean sidereal angle (1982)."""
    c = (jd - 2451545.0) / 36525
    return np.radians((67310.54841 + (876600 * 3600 + 8640184.812866) * c + 0.093104 * c * c - 6.2e-6 * c**3) / 240 % 360)


def geodetic(xyz: np.ndarray, jd: np.ndarray) -> np.ndarray:
    """Latitude, longitude (degrees) and height (km) of positions."""
    a, f = 6378.137, 1 / 298.257223563
    e2 = f * (2 - f)
    x, y, z = xyz[:, 0], xyz[:, 1], xyz[:, 2]
    lng = (np.arctan2(y, x) - sidereal(jd) + pi) % TWO_PI - pi
    r = np.hypot(x, y)
    lat = np.arctan2(z, r)
    for _ in range(8):
        c = 1 / np.sqrt(1 - e2 * np.sin(lat) ** 2)
        lat = np.arctan2(z + a * c * e2 * np.sin(lat), r)
    return np.column_stack([np.degrees(lat), np.degrees(lng), r / np.cos(lat) - a * c])


def states(line1: pd.Series, line2: pd.Series, jd: np.ndarray) -> np.ndarray:
    out = np.full((len(line1), 6), np.nan)
    for (a, b), rows in pd.Series(np.arange(len(line1))).groupby([line1.to_numpy(), line2.to_numpy()]):
        o = orbit(a, b)
        if o is not None:
            at = rows.to_numpy()
            out[at] = o.state((jd[at] - o.epoch_jd) * 1440)
    return out


def place(line1: Column, line2: Column, ts: Column) -> Column:
    """struct(lat, lng, height_km, speed_kmh) below a satellite at a time."""

    @F.pandas_udf(PLACE)
    def under(a: pd.Series, b: pd.Series, micros: pd.Series) -> pd.DataFrame:
        jd = micros.to_numpy(dtype=float) / 86400e6 + 2440587.5
        s = states(a, b, jd)
        g = geodetic(s[:, :3], jd)
        speed = np.sqrt((s[:, 3:] ** 2).sum(axis=1)) * 3600
        return pd.DataFrame({"lat": g[:, 0], "lng": g[:, 1], "height_km": g[:, 2], "speed_kmh": speed})

    return under(line1, line2, F.unix_micros(ts.cast("timestamp")))


def track(bases: DataFrame, *, start: int = -2000, end: int = 3790, step: int = 10) -> DataFrame:
    """Of rows (t, tle_line1, tle_line2): positions at t + i seconds, i from start to end, and the part of the track that each belongs to. Several element sets at one time are tracks of their own."""
    from ..operators.sequences import split_track

    rows = bases.withColumn("i", F.explode(F.sequence(F.lit(start), F.lit(end), F.lit(step))))
    at = F.timestamp_micros(F.unix_micros(F.col("t").cast("timestamp")) + F.col("i").cast("long") * 1_000_000)
    rows = rows.withColumn("p", place(F.col("tle_line1"), F.col("tle_line2"), at)).select("t", "tle_line1", "tle_line2", "i", "p.*")
    return split_track(rows, ["t", "tle_line1", "tle_line2"])


def nearest_elements(bases: DataFrame, elements: DataFrame) -> DataFrame:
    """Base times (t) with the element set (epoch, tle_line1, tle_line2) whose epoch is nearest, however far; the earlier of two as near, the first by its lines of equals. A null time has none.

    All are one key of the as-of join, which it scans in slices.
    """
    from ..operators.joins import nearest
    from ..operators.scans import unused

    (every,) = unused(bases, "every")
    found = nearest(bases.withColumn(every, F.lit(0)), elements.withColumn(every, F.lit(0)), by=[every], at="t", epoch="epoch", order=["tle_line1", "tle_line2"], payload=["tle_line1", "tle_line2"])
    return found.drop(every)
