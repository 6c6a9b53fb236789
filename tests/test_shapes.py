"""Outlines by chains and polygons by runs, against versions that hold a region
or a polygon in memory."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from firnline.grid import GridSpec
from firnline.operators import regions
from firnline.plans import config, run
from firnline.sources import vectors


def traced(cells):
    """Rings of a set of cells, side by side, as sets of corners in order."""
    after = {}
    for r, c in cells:
        for (dr, dc), a, b in (((-1, 0), (r, c), (r, c + 1)), ((0, 1), (r, c + 1), (r + 1, c + 1)), ((1, 0), (r + 1, c + 1), (r + 1, c)), ((0, -1), (r + 1, c), (r, c))):
            if (r + dr, c + dc) not in cells:
                after.setdefault(a, []).append(b)
    rings = []
    while after:
        ring = [min(after)]
        came = None
        while True:
            at = ring[-1]
            ways = after[at]
            if len(ways) > 1 and came:  # to the right
                ways.sort(key=lambda w: (w[0] - at[0], w[1] - at[1]) != (at[1] - came[1], came[0] - at[0]))
            step = ways.pop(0)
            if not ways:
                del after[at]
            came = at
            if step == ring[0]:
                break
            ring.append(step)
        n = len(ring)
        ring = [p for i, p in enumerate(ring) if not (ring[i - 1][0] == p[0] == ring[(i + 1) % n][0] or ring[i - 1][1] == p[1] == ring[(i + 1) % n][1])]
        k = ring.index(min(ring))
        rings.append(tuple(ring[k:] + ring[:k]))
    return sorted(rings)


@pytest.mark.parametrize("tile", [4, 11, 64])
def test_outlines_are_the_same_by_any_tiles(spark, tile):
    rng = np.random.default_rng(6)
    g = (rng.random((21, 26)) < 0.62).astype(int) * 2
    g[5:8, 3:20] = 1
    g[6, 5:18] = 2
    x = spark.createDataFrame([(r, c, int(v)) for (r, c), v in np.ndenumerate(g) if v], "r long, c long, v long")
    s = GridSpec(26, 21, 1.0)
    members = regions.connected(x, s, "v", 4)
    cells = {}
    for q in members.collect():
        cells.setdefault(q.label, set()).add((q.r, q.c))
    got = {}
    for q in regions.outlines(members, s, tile).collect():
        rings = [[(int(-y), int(x)) for x, y in ring] for ring in vectors.rings_of_wkt(q.wkt)]
        assert all(ring[0] == ring[-1] for ring in rings)
        rings = [ring[:-1] for ring in rings]
        got[q.label] = sorted(tuple(ring[ring.index(min(ring)) :] + ring[: ring.index(min(ring))]) for ring in rings)
    assert got == {k: traced(v) for k, v in cells.items()}
    assert regions.outlines(members.limit(0), s, tile).count() == 0


def even_odd(x, y, rings):
    inside = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                inside = not inside
    return inside


def test_runs_of_any_shape(spark):
    rng = np.random.default_rng(2)
    s = GridSpec(17, 13, 1.5, 4.0, -3.0)
    layer = []
    for k in range(40):
        rings = [[[float(v) for v in p] for p in np.c_[rng.uniform(-2, 36, n), rng.uniform(-28, 3, n)]] for n in rng.integers(3, 9, rng.integers(1, 3))]
        layer.append((k, rings + [[[1.0, 1.0]]], k * 10))  # a ring of one point holds nothing
    layer += [(40, layer[0][1], 400), (41, [], 1), (42, None, 2)]
    df = spark.createDataFrame(layer, "id long, rings array<array<array<double>>>, value long")
    x = spark.createDataFrame([(r, c) for r in range(13) for c in range(17) if (r + c) % 5], "r long, c long")
    at = {(r, c): [k for k, rings, _ in layer if even_odd(4.0 + (c + 0.5) * 1.5, -3.0 - (r + 0.5) * 1.5, rings or [])] for r in range(13) for c in range(17) if (r + c) % 5}
    got = {(q.r, q.c): q.burned for q in regions.rasterize(x, s, df).collect()}
    assert got == {p: max(ks) * 10 if ks else None for p, ks in at.items()}
    named = df.select(F.concat(F.lit("n"), F.col("id") % 40).alias("name"), "rings")  # two of one name
    found = {}
    for q in vectors.burn(x, s, named).collect():
        found.setdefault((q.r, q.c), []).append(q.name)
    assert {p: sorted(v) for p, v in found.items()} == {p: sorted(f"n{k % 40}" for k in ks) for p, ks in at.items() if ks}


def test_features_by_line(spark, tmp_path):
    one = '{"type":"Feature","properties":{"name":"%s"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[2,0],[2,-1],[0,-1],[0,0]]]}}'
    (tmp_path / "a.geojsonl").write_text(one % "a" + "\n\n" + one % "b" + "\n")
    got = vectors.read_layer(spark, f"file://{tmp_path}/a.geojsonl").collect()
    assert sorted(q.name for q in got) == ["a", "b"] and len(got[0].rings[0]) == 5


def test_a_treeline_that_cannot_be_had_is_none(spark, tmp_path, caplog):
    x = spark.createDataFrame([(0, c, 1000.0, 60.0) for c in range(4)], "r long, c long, z double, canopy double")
    (tmp_path / "bad.geojson").write_text("{not json")
    p = config.ReleaseConfig(enable_treeline=True, subregions_path=f"file://{tmp_path}/bad.geojson")
    assert "treeline" not in run.with_treeline(x, GridSpec(4, 1, 10.0), p).columns
    assert "no treeline" in caplog.text
