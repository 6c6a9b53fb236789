"""Images with overviews: every page against arrays, decoded here byte by byte."""

import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from firnline.grid import GridSpec
from firnline.operators import align
from firnline.sources import geotiff, imagery


def decoded(path, page):
    """The pixels of a page, from its tables and bytes alone."""
    t = geotiff.header(path, page)
    w, h, side = t[256][0], t[257][0], t[322][0]
    across, out = -(-w // side), np.zeros((-(-h // side) * side, -(-w // side) * side, 4), np.uint8)
    with open(path, "rb") as f:
        for k, (at, n) in enumerate(zip(t[324], t[325], strict=True)):
            f.seek(at)
            x = np.frombuffer(zlib.decompress(f.read(n)), np.uint8).reshape(side, side, 4)
            r, c = k // across * side, k % across * side
            out[r : r + side, c : c + side] = np.cumsum(x, axis=1, dtype=np.uint8)
    assert not out[h:].any() and not out[:, w:].any()
    return out[:h, :w]


def cells_of(spark, x, holes):
    h, w = x.shape[:2]
    rows = [(r, c, *map(int, x[r, c])) for r in range(h) for c in range(w) if (r, c) not in holes]
    return spark.createDataFrame(rows, "r long, c long, red int, green int, blue int, alpha int")


@pytest.mark.parametrize("tile", [16, 32])
def test_pages_hold_the_pyramid(spark, tmp_path, tile):
    h, w = 75, 130
    x = np.random.default_rng(3).integers(0, 256, (h, w, 4), dtype=np.uint8)
    holes = {(r, c) for r in range(16) for c in range(32, 64)} | {(74, 129), (8, 8)}  # two whole tiles
    for r, c in holes:
        x[r, c] = 0
    s = GridSpec(w, h, 2.5, 500.0, 9000.0, "EPSG:32611")
    cells = cells_of(spark, x, holes).repartition(5)
    path = imagery.write_image(cells, s, f"file://{tmp_path}/new/a.tif", tile=tile)
    assert os.listdir(f"{tmp_path}/new") == ["a.tif"]
    first = geotiff.header(path)
    assert geotiff.spec_of(first) == s and first[254] == (0,) and first[258] == (8,) * 4 and first[262] == (2,) and first[338] == (2,)
    levels = {(q.factor, q.r, q.c): q.v for q in align.pyramid(cells.withColumn("v", F.array(*imagery.BANDS)), "v", "nearest").collect()}
    for k, f in enumerate((1, *imagery.FACTORS)):
        want = np.zeros((-(-h // f), -(-w // f), 4), np.uint8)
        if f == 1:
            want[:] = x
        else:
            for (g, r, c), v in levels.items():
                if g == f:
                    want[r, c] = v
            assert geotiff.header(path, k)[254] == (1,)
        assert (decoded(path, k) == want).all()
        got = imagery.read_image(spark, path, k).collect()
        assert len(got) == want.shape[0] * want.shape[1]
        assert all((q.red, q.green, q.blue, q.alpha) == tuple(want[q.r, q.c].tolist()) for q in got)
    with pytest.raises(ValueError, match="5 images"):
        geotiff.header(path, 5)
    sparse = [n for at, n in zip(first[324], first[325], strict=True) if at == min(first[324])]
    assert tile != 16 or len(sparse) >= 2  # tiles without cells share one
    # Coarse pages lie before finer ones.
    ends = [max(geotiff.header(path, k)[324]) for k in range(5)]
    assert ends == sorted(ends, reverse=True)


def test_runs_of_tiles_follow_each_other(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(imagery, "RUN", 3)  # in place of 256 tiles
    x = np.random.default_rng(4).integers(0, 256, (40, 70, 4), dtype=np.uint8)
    path = imagery.write_image(cells_of(spark, x, set()), GridSpec(70, 40), f"{tmp_path}/b.tif", (4,), 16)
    assert (decoded(path, 0) == x).all() and (decoded(path, 1)[:, :17] == x[2::4, 2::4]).all()
    t = [q for k in range(2) for q in zip(geotiff.header(path, k)[324], geotiff.header(path, k)[325], strict=True)]
    t = sorted(set(t))
    assert all(a + n == b for (a, n), (b, _) in zip(t, t[1:], strict=False)) and sum(t[-1]) == os.path.getsize(path)


def test_odd_rows_and_failures(spark, tmp_path):
    kinds = "r long, c long, red int, green int, blue int, alpha int, k string, at int, data string"
    rows = [(0, 0, 300, -4, 7, 255, "x", 1, ""), (0, 1, None, None, None, None, None, None, None), (1, 0, 1, 2, 3, 4, "", 0, ""), (1, 0, 9, 9, 9, 3, "", 0, ""), (-1, 0, 5, 5, 5, 5, "", 0, ""), (9, 9, 5, 5, 5, 5, "", 0, ""), (None, 0, 5, 5, 5, 5, "", 0, "")]
    s = GridSpec(2, 2)
    path = imagery.write_image(spark.createDataFrame(rows, kinds), s, f"{tmp_path}/c.tif", tile=16)
    assert decoded(path, 0).tolist() == [[[255, 0, 7, 255], [0, 0, 0, 0]], [[1, 2, 3, 4], [0, 0, 0, 0]]]
    assert decoded(path, 4).tolist() == [[[0, 0, 0, 0]]]  # a block of sixteen has no middle cell here
    empty = imagery.write_image(spark.createDataFrame([], kinds), s, f"{tmp_path}/d.tif", tile=16)
    assert not decoded(empty, 0).any() and decoded(empty, 0).shape == (2, 2, 4)
    before = open(path, "rb").read()
    broken = spark.createDataFrame(rows, kinds).withColumn("red", F.when(F.col("r") == 1, F.raise_error(F.lit("boom")).cast("int")).otherwise(F.col("red")))
    with pytest.raises(Exception, match="boom"):
        imagery.write_image(broken, s, path, tile=16)
    assert open(path, "rb").read() == before and sorted(os.listdir(tmp_path)) == ["c.tif", "d.tif"]
    with pytest.raises(ValueError, match="middle"):
        imagery.write_image(broken, s, "s3://bucket/c.tif")
    with pytest.raises(ValueError, match="a cell"):
        imagery.write_image(broken, GridSpec(0, 0), f"{tmp_path}/e.tif")


def test_geographic_systems_are_told(spark, tmp_path):
    s = GridSpec(3, 2, 0.5, -120.0, 51.0, "EPSG:4326")
    path = imagery.write_image(spark.createDataFrame([(0, 0, 1, 1, 1, 1)], "r long, c long, red int, green int, blue int, alpha int"), s, f"{tmp_path}/g.tif")
    assert geotiff.spec_of(geotiff.header(path)) == s and 2048 in geotiff.header(path)[34735]
    assert geotiff.spec_of({256: (3,), 257: (2,), 34735: geotiff.geo_keys("EPSG:4484")}).crs == "EPSG:4484" and 3072 in geotiff.geo_keys("EPSG:4484")
