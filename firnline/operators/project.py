"""Map projections between the reference systems that elevation models come in:
geographic, transverse Mercator (UTM) and Albers' conic one. Datums of the
GRS80 ellipsoid and WGS84 are taken as one (they differ by less than a metre).
Arrays in, arrays out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

#: Half-axis and flattening.
WGS84, GRS80 = (6378137.0, 1 / 298.257223563), (6378137.0, 1 / 298.257222101)
#: EPSG numbers of geographic systems.
GEOGRAPHIC = (4326, 4258, 4269, 4617)


@dataclass(frozen=True)
class Geographic:
    def to_degrees(self, x, y):
        return x, y

    def from_degrees(self, lon, lat):
        return lon, lat


@dataclass(frozen=True)
class TransverseMercator:
    """By the series in the third flattening, to its fourth power: errors below
    a millimetre within 3000 km of the central meridian."""

    lon0: float
    k0: float = 0.9996
    fe: float = 500000.0
    fn: float = 0.0
    ellipsoid: tuple[float, float] = WGS84

    def _terms(self):
        a, f = self.ellipsoid
        n = f / (2 - f)
        radius = self.k0 * a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
        ahead = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
        back = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280)
        return radius, np.sqrt(f * (2 - f)), ahead, back

    def from_degrees(self, lon, lat):
        radius, e, ahead, _ = self._terms()
        s, lam = np.sin(np.radians(lat)), np.radians(lon - self.lon0)
        t = np.sinh(np.arctanh(s) - e * np.arctanh(e * s))
        xi, eta = np.arctan2(t, np.cos(lam)), np.arctanh(np.sin(lam) / np.sqrt(1 + t * t))
        x, y = eta, xi
        for j, k in enumerate(ahead, 1):
            x, y = x + k * np.cos(2 * j * xi) * np.sinh(2 * j * eta), y + k * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
        return self.fe + radius * x, self.fn + radius * y

    def to_degrees(self, x, y):
        radius, e, _, back = self._terms()
        xi, eta = (y - self.fn) / radius, (x - self.fe) / radius
        u, v = xi, eta
        for j, k in enumerate(back, 1):
            u, v = u - k * np.sin(2 * j * xi) * np.cosh(2 * j * eta), v - k * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
        psi = np.arctanh(np.sin(u) / np.cosh(v))
        q = psi
        for _ in range(8):  # each step gains two places and more
            q = psi + e * np.arctanh(e * np.tanh(q))
        return self.lon0 + np.degrees(np.arctan2(np.sinh(v), np.cos(u))), np.degrees(np.arcsin(np.tanh(q)))


@dataclass(frozen=True)
class Albers:
    """Equal areas between two standard parallels."""

    lon0: float
    lat0: float
    lat1: float
    lat2: float
    fe: float = 0.0
    fn: float = 0.0
    ellipsoid: tuple[float, float] = GRS80

    def _q(self, s, e):
        return (1 - e * e) * (s / (1 - (e * s) ** 2) + np.arctanh(e * s) / e)

    def _terms(self):
        a, f = self.ellipsoid
        e = np.sqrt(f * (2 - f))
        s = np.sin(np.radians(np.array([self.lat0, self.lat1, self.lat2])))
        q, m2 = self._q(s, e), (1 - s * s) / (1 - (e * s) ** 2)
        n = (m2[1] - m2[2]) / (q[2] - q[1])
        c = m2[1] + n * q[1]
        return a, e, n, c, a * np.sqrt(c - n * q[0]) / n

    def from_degrees(self, lon, lat):
        a, e, n, c, rho0 = self._terms()
        rho = a * np.sqrt(c - n * self._q(np.sin(np.radians(lat)), e)) / n
        theta = n * np.radians(lon - self.lon0)
        return self.fe + rho * np.sin(theta), self.fn + rho0 - rho * np.cos(theta)

    def to_degrees(self, x, y):
        a, e, n, c, rho0 = self._terms()
        x, y = x - self.fe, rho0 - (y - self.fn)
        q = (c - (np.hypot(x, y) * n / a) ** 2) / n
        phi = np.arcsin(np.clip(q / 2, -1, 1))
        for _ in range(8):
            s = np.sin(phi)
            phi = phi + (1 - (e * s) ** 2) ** 2 / (2 * np.cos(phi)) * (q - self._q(s, e)) / (1 - e * e)
        return self.lon0 + np.degrees(np.arctan2(x, y) / n), np.degrees(phi)


def projection(crs: str):
    """By its EPSG number; ValueError for one that isn't known."""
    number = int(crs[5:]) if crs.upper().startswith("EPSG:") and crs[5:].isdigit() else 0
    zone = number % 100
    if number in GEOGRAPHIC:
        return Geographic()
    if number // 100 in (326, 327) and 1 <= zone <= 60:
        return TransverseMercator(zone * 6 - 183.0, fn=10_000_000.0 * (number // 100 == 327))
    if number // 100 in (258, 269) and 1 <= zone <= 60 and number != 26999:
        return TransverseMercator(zone * 6 - 183.0, ellipsoid=GRS80)
    if number == 3005:
        return Albers(-126.0, 45.0, 50.0, 58.5, 1_000_000.0)
    raise ValueError(f"reference system {crs!r} isn't known here: rasters must share it, or be geographic, UTM or EPSG:3005")


def between(a: str, b: str) -> Callable:
    """Coordinates of system a to those of system b."""
    if a == b:
        return lambda x, y: (x, y)
    one, other = projection(a), projection(b)
    return lambda x, y: other.from_degrees(*one.to_degrees(x, y))
