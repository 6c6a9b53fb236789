"""Projections by known values and round trips; rasters on other grids."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from firnline.grid import GridSpec
from firnline.operators import align
from firnline.operators.project import between, projection


def test_known_values():
    x, y = between("EPSG:4326", "EPSG:32631")(np.array([3.0, 9.0]), np.array([45.0, 0.0]))
    assert x[0] == pytest.approx(500000.0) and y[0] == pytest.approx(0.9996 * 4984944.378, abs=0.002)  # the meridian's arc to 45 degrees
    assert y[1] == pytest.approx(0.0, abs=1e-6) and x[1] > 1_160_000
    x, y = between("EPSG:4326", "EPSG:3005")(np.array([-126.0]), np.array([45.0]))
    assert (x[0], y[0]) == (pytest.approx(1_000_000.0), pytest.approx(0.0, abs=1e-6))


@pytest.mark.parametrize("crs", ["EPSG:32611", "EPSG:26910", "EPSG:32759", "EPSG:3005"])
def test_round_trips(crs):
    p = projection(crs)
    lon0 = p.lon0
    lon, lat = (v.ravel() for v in np.meshgrid(np.linspace(lon0 - 5, lon0 + 5, 9), np.linspace(-70, 80, 11) if crs != "EPSG:3005" else np.linspace(45, 62, 9)))
    back = p.to_degrees(*p.from_degrees(lon, lat))
    assert np.allclose(back[0], lon, atol=1e-9) and np.allclose(back[1], lat, atol=1e-9)


def test_areas_keep_in_albers():
    """A small square of the ellipsoid near a standard parallel is as large there."""
    lon, lat, d = np.array([-125.0, -124.999, -125.0]), np.array([50.0, 50.0, 50.001]), 0.001
    x, y = between("EPSG:4326", "EPSG:3005")(lon, lat)
    got = abs((x[1] - x[0]) * (y[2] - y[0]) - (x[2] - x[0]) * (y[1] - y[0]))
    e2, s = 0.00669438, np.sin(np.radians(50.0005))
    want = 6378137.0**2 * (1 - e2) / (1 - e2 * s * s) ** 2 * np.cos(np.radians(50.0005)) * np.radians(d) ** 2
    assert got == pytest.approx(want, rel=1e-4)


def test_unknown_systems_are_refused():
    for crs in ("EPSG:1", "", "local"):
        with pytest.raises(ValueError):
            between(crs, "EPSG:4326")
    assert between("local", "local")(1, 2) == (1, 2)


def test_the_lattice_is_as_dense_as_needed():
    s = GridSpec(3000, 2000, 20.0, 500000.0, 5600000.0, "EPSG:32611")
    t = align.grid_in(s, "EPSG:4326")
    move = between(t.crs, s.crs)
    rows, cols = (100, 356), (200, 456)
    want = align.source_places(t, s, move, rows, cols, 0.0)
    for error in (1.0, 0.01, 1e-4):
        got = align.source_places(t, s, move, rows, cols, error)
        assert max(np.abs(a - b).max() for a, b in zip(got, want, strict=True)) < 2 * error
    lon, lat = between(s.crs, t.crs)(*(v.ravel() for v in np.meshgrid(s.x0 + np.array([0.0, 30_000.0, 60_000.0]), s.y0 - np.array([0.0, 20_000.0, 40_000.0]))))
    assert (lon > t.x0 - 1e-9).all() and (lon < t.x0 + t.width * t.cell + 1e-9).all()  # all of the source is on the grid
    assert (lat < t.y0 + 1e-9).all() and (lat > t.y0 - t.height * t.cell - 1e-9).all()


@pytest.mark.parametrize("tile", [7, 64])
def test_a_reprojected_slope_keeps_its_values(spark, tile):
    s = GridSpec(30, 26, 30.0, 552000.0, 5660000.0, "EPSG:32611")
    df = spark.createDataFrame([(r, c, 2.0 * r + 0.5 * c, r * 100 + c) for r in range(26) for c in range(30)], "r long, c long, z double, k int")
    t = align.grid_in(s, "EPSG:4326")
    got = {(q.r, q.c): q.z for q in align.align(df, s, t, "z", tile=tile).collect()}
    assert len(got) == t.width * t.height
    fr, fc = align.source_places(t, s, between(t.crs, s.crs), (0, t.height), (0, t.width), 0.0)
    inside = (fr >= 0) & (fc >= 0) & (fr <= 25) & (fc <= 29)
    assert inside.sum() > 300
    for r, c in np.argwhere(inside).tolist():
        assert got[r, c] == pytest.approx(2.0 * fr[r, c] + 0.5 * fc[r, c], abs=0.03)  # a hundredth of a cell, two metres a cell
    near = {(q.r, q.c): q.k for q in align.align(df, s, t, "k", "nearest", error=0.0, tile=tile).collect()}
    assert all(near[r, c] == int(np.floor(fr[r, c] + 0.5)) * 100 + int(np.floor(fc[r, c] + 0.5)) for r, c in np.argwhere(inside).tolist())
    assert align.align(df.limit(0), s, t, "z", fill=-1.0, tile=tile).where("z <> -1").count() == 0


def test_cutlines_and_a_raster_per_feature(spark):
    s = GridSpec(10, 8, 2.0, 100.0, 50.0)
    df = spark.createDataFrame([(r, c, r * 10.0 + c) for r in range(8) for c in range(10)], "r long, c long, z double")
    ring = lambda x0, y0, x1, y1: [[x0, y0], [x1, y0], [x1, y1], [x0, y1]]
    layer = spark.createDataFrame([("a", [ring(102.0, 48.0, 108.0, 42.0)]), ("b", [ring(106.0, 46.0, 112.0, 40.0)]), ("none", [ring(0.0, 0.0, 1.0, 1.0)])], "name string, rings array<array<array<double>>>")
    part, t = align.crop(df, s, layer.where("name = 'a'"))
    assert (t.width, t.height, t.x0, t.y0) == (3, 3, 102.0, 48.0)
    assert {(q.r, q.c): q.z for q in part.collect()} == {(r, c): (r + 1) * 10.0 + c + 1 for r in range(3) for c in range(3)}
    rasters, windows = align.by_feature(df, s, layer)
    assert {q.name: q[1:] for q in windows.collect()} == {"a": (102.0, 48.0, 3, 3), "b": (106.0, 46.0, 3, 3)}
    assert {(q.name, q.r, q.c): q.z for q in rasters.collect()} == {(n, r, c): (r + k) * 10.0 + c + j for n, k, j in (("a", 1, 1), ("b", 2, 3)) for r in range(3) for c in range(3)}
    assert align.crop(df, s, layer.where("name = 'none'"))[1].width == 0
    assert rasters.where(F.col("name") == "none").count() == 0
