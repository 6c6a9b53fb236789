"""Operators on grids small enough to check by hand."""

import json
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from firnline.functions import fuzzy, palette
from firnline.functions import votes as V
from firnline.grid import GridSpec
from firnline.operators import align, distance, flow, focal, regions, segment, zonal
from firnline.plans import config, manifest
from firnline.plans.run import colour_run, release_areas, run, run_stack, terrain
from firnline.sources import imagery, tables


def cells(spark, grid, band="z", **more):
    rows = [(r, c, None if v is None else float(v)) for r, row in enumerate(grid) for c, v in enumerate(row)]
    return spark.createDataFrame(rows, f"r long, c long, {band} double")


def as_grid(df, band, h, w):
    out = np.full((h, w), np.nan)
    for row in df.select("r", "c", band).collect():
        if row[2] is not None:
            out[row[0], row[1]] = row[2]
    return out


def test_plane(spark):
    x = cells(spark, [[10.0 * c for c in range(5)] for _ in range(5)])
    s = GridSpec(5, 5, 10.0)
    assert as_grid(focal.slope(x, s), "slope", 5, 5)[2, 2] == pytest.approx(45)
    assert np.isnan(as_grid(focal.slope(x, s), "slope", 5, 5)[0, 0])
    assert as_grid(focal.slope(x, s, edges=True), "slope", 5, 5)[2, 0] == pytest.approx(45)
    assert as_grid(focal.aspect(x, s), "aspect", 5, 5)[2, 2] == pytest.approx(270)  # down to the west
    flat = focal.ruggedness(focal.aspect(focal.slope(x, s, edges=True), s))
    assert as_grid(flat, "ruggedness", 5, 5)[2, 2] == pytest.approx(0, abs=0.2)
    wind = as_grid(focal.wind_shelter(x, s, radius_m=20), "windshelter", 5, 5)
    assert wind[2, 2] == pytest.approx(0, abs=1e-12) and np.isnan(wind[0, 0])


def test_void_next_to_a_cell(spark):
    g = [[10.0 * c for c in range(5)] for _ in range(5)]
    g[1][1] = None
    got = as_grid(focal.whole_slope(cells(spark, g), GridSpec(5, 5, 10.0)), "slope", 5, 5)
    assert np.isnan(got[2, 2]) and got[3, 3] == 45


def test_box_means_at_edges(spark):
    x = cells(spark, [[1, 2, 3, 4, 5, 6, 7]] * 7, "v")
    s = GridSpec(7, 7)
    a = np.tile(np.arange(1.0, 8), (7, 1))
    for edge, mode in (("reflect", "symmetric"), ("nearest", "edge")):
        p = np.pad(a, 2, mode=mode)
        want = [[p[r : r + 5, c : c + 5].mean() for c in range(7)] for r in range(7)]
        assert np.allclose(as_grid(focal.box_mean(x, s, "v", 5, edge, "m"), "m", 7, 7), want)
    assert focal.box_width(300, 21.34) == 15 and focal.box_width(300, 5) == 61


@pytest.mark.parametrize("connectivity,n", [(4, 13), (8, 1)])
@pytest.mark.parametrize("tile", [2, 3, 64])
def test_checkerboard(spark, connectivity, n, tile):
    x = cells(spark, [[1 if (r + c) % 2 == 0 else None for c in range(5)] for r in range(5)], "v")
    got = regions.connected(x, GridSpec(5, 5), "v", connectivity, tile)
    assert got.select("label").distinct().count() == n
    assert got.agg(F.min("label")).first()[0] == 0


def test_labels_do_not_depend_on_tiles(spark):
    rng = np.random.default_rng(0)
    x = cells(spark, rng.integers(0, 2, (20, 20)).tolist(), "v")
    s = GridSpec(20, 20)
    a, b = (sorted(map(tuple, regions.connected(x, s, "v", 4, t).collect())) for t in (3, 64))
    assert a == b


def test_sieve_keeps_holes(spark):
    g = np.zeros((9, 9))
    g[1:6, 1:6] = 1
    g[3, 3] = 0
    g[7, 7] = g[7, 8] = 1
    got = as_grid(regions.sieve(cells(spark, g.tolist(), "m"), GridSpec(9, 9, 10.0), "m", 300.0), "sieved", 9, 9)
    assert got.sum() == 24 and got[3, 3] == 0 and got[7, 7] == 0


def test_mmu_takes_the_nearest_class(spark):
    g = np.ones((12, 12))
    g[:, 6:] = 2
    g[5, 2] = 3
    x = cells(spark, g.tolist(), "k").withColumn("k", F.col("k").cast("int"))
    got = as_grid(regions.mmu_clean(x, GridSpec(12, 12, 10.0), "k", {1: 1000, 2: 1000, 3: 1000}), "cleaned", 12, 12)
    g[5, 2] = 1
    assert (got == g).all()


def test_gap_area_is_capped(spark):
    x = cells(spark, [[0.0] * 70] * 70, "canopy_pct").withColumn("valid", F.lit(True))
    got = regions.gap_metrics(x, GridSpec(70, 70, 21.34))
    assert got.agg(F.min("gap_area_ha"), F.max("gap_area_ha")).first()[:] == (100.0, 100.0)
    edge = regions.gap_metrics(x, GridSpec(70, 70, 21.34), enclosed_only=True, with_width=False)
    assert edge.agg(F.max("gap_area_ha")).first()[0] == 0


def test_distances_against_brute_force(spark):
    rng = np.random.default_rng(1)
    g = (rng.random((15, 17)) < 0.05).astype(float)
    g[4, 4] = 1
    x = cells(spark, g.tolist(), "t")
    s = GridSpec(17, 15)
    at = np.argwhere(g == 1)
    want = np.array([[min(math.hypot(r - a, c - b) for a, b in at) for c in range(17)] for r in range(15)])
    assert np.allclose(as_grid(distance.distance_to(x, s, F.col("t") == 1), "distance", 15, 17), want)
    x = x.withColumn("id", F.col("r") * 17 + F.col("c"))
    near = as_grid(distance.nearest_feature(x, s, F.col("t") == 1, "id", "n"), "n", 15, 17)
    for r in range(15):
        for c in range(17):
            a, b = min(map(tuple, at), key=lambda p: ((r - p[0]) ** 2 + (c - p[1]) ** 2, p))
            assert near[r, c] == a * 17 + b
    assert distance.distance_to(x, s, F.lit(False)).where("distance is not null").count() == 0


def test_merging_and_adjacency(spark):
    g = np.ones((6, 9))
    g[:, 4:] = 2
    g[0, 3] = 3
    x = cells(spark, g.tolist(), "v").withColumn("label", F.col("v").cast("long")).drop("v")
    got = {(r.a, r.b): r.sides for r in regions.adjacency(x).collect()}
    assert got[1, 3] == 2 and got[2, 3] == 1 and got[1, 2] == 5
    merged = {r.label: r.merged for r in regions.merge_small(x, GridSpec(9, 6, 10.0), 500.0).collect()}
    assert merged == {1: 1, 2: 2, 3: 1}


def test_outlines(spark):
    g = np.zeros((5, 5))
    g[1:4, 1:4] = 1
    g[2, 2] = 0
    x = cells(spark, g.tolist(), "v").where("v = 1").withColumn("v", F.col("v").cast("int"))
    s = GridSpec(5, 5, 1.0)
    table, members = regions.polygonize(x, s, "v")
    assert table.first().area_m2 == 8.0
    wkt = regions.outlines(members, s).first().wkt
    assert wkt.count("(") == 3 and "1 -1" in wkt and "4 -4" in wkt


def test_alignment(spark):
    x = cells(spark, [[0, 10], [20, 30]], "v")
    s = GridSpec(2, 2, 2.0)
    fine = GridSpec(4, 4, 1.0)
    got = as_grid(align.align(x, s, fine, "v"), "v", 4, 4)
    assert got[1, 1] == pytest.approx(7.5) and got[0, 0] == 0
    assert as_grid(align.align(x, s, fine, "v", "nearest"), "v", 4, 4)[3].tolist() == [20, 20, 30, 30]
    moved = align.align(x, s, GridSpec(2, 2, 2.0, x0=100.0), "v", fill=-1.0)
    assert moved.agg(F.max("v")).first()[0] == -1
    with pytest.raises(ValueError):
        align.align(x, s, GridSpec(2, 2, 2.0, crs="EPSG:1"), "v")


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def test_memberships(spark):
    m = lambda x: value(spark, fuzzy.cauchy(F.lit(x), 3, 10, 3))
    assert m(3.0) == 1 and m(6.0) == 0.5 and m(-9999.0) < 1e-60
    two = fuzzy.cauchy_two_sided(F.lit(50.0), 40, 10, 2, 5, 2)
    assert value(spark, two) == pytest.approx(1 / 17)
    assert value(spark, fuzzy.fuzzy_and(F.lit(0.5), F.lit(1.0))) == pytest.approx(0.625)
    assert value(spark, fuzzy.slope_membership(F.lit(None).cast("double"), 12, 4, 40)) == 0
    assert value(spark, fuzzy.forest_membership(F.lit(None).cast("double"), 50, 1.5, 0)) == 1


def test_votes(spark):
    assert value(spark, V.split_vote(F.lit(0.5), F.lit(0.0), 0, 0.1, 1)) == 2
    assert value(spark, V.step_vote(F.lit(float("nan")), (0, 1))) == 0
    assert value(spark, V.compass(F.lit(337.6))) == "N" and value(spark, V.compass(F.lit(100.0))) == "E"
    assert V.area_factor(5.0) * 500 == pytest.approx(27.4487, abs=1e-3)


def test_palettes(spark):
    p = palette.parse("# a ramp\n# @ramp scale=linear lab=0 per_seg=2 floor=10 alpha=100\n10,#000000\n20,#0A0A0A\nnv 1 2 3 4")
    assert p.stops[0][4] == 0 and p.nothing == (1, 2, 3, 0)  # missing values can't be seen
    assert value(spark, palette.colour(F.lit(15.0), p))[:] == (5, 5, 5, 100)
    assert value(spark, palette.colour(F.lit(None).cast("double"), p))[:] == (1, 2, 3, 0)
    assert value(spark, palette.colour(F.lit(3), palette.CLASSES, True))[:] == (241, 83, 147, 166)
    for rgb in ((255, 0, 0), (12, 200, 99), (0, 0, 0), (255, 255, 255)):
        assert max(abs(a - b) for a, b in zip(palette.lab_to_rgb(palette.rgb_to_lab(rgb)), rgb, strict=True)) <= 1
    assert palette.mix((0, 0, 0), (10, 20, 30), 0.5) == (5, 10, 15)


def test_runout_on_a_plane(spark):
    h, w = 30, 9
    x = cells(spark, [[1000.0 - 10.0 * r for _ in range(w)] for r in range(h)])
    x = x.withColumn("go", ((F.col("r") == 2) & (F.col("c") == 4)).cast("int"))
    s = GridSpec(w, h, 10.0)
    got = flow.runout(x, s, "go", flow.FlowParams(alpha=30.0, tile=64, halo=32)).toPandas()
    assert got.r.min() == 2 and got.r.max() == h - 1  # 45 degrees: never stops
    assert got.zDelta.max() <= 270 and abs(got.fpTravelAngleMax.max() - 45) < 1e-6
    steep = flow.runout(x, s, "go", flow.FlowParams(alpha=50.0, tile=64, halo=32)).toPandas()
    assert len(steep) == 1
    a = flow.runout(x, s, "go", flow.FlowParams(tile=8, halo=40)).orderBy("r", "c").toPandas()
    b = flow.runout(x, s, "go", flow.FlowParams(tile=64, halo=40)).orderBy("r", "c").toPandas()
    assert np.allclose(a[["r", "c", "flux", "zDelta"]], b[["r", "c", "flux", "zDelta"]])


def test_flood_and_peaks():
    r, c = (x.ravel() for x in np.meshgrid(np.arange(3), np.arange(7), indexing="ij"))
    marker = np.zeros(21, dtype=np.int64)
    marker[(r == 1) & (c == 0)], marker[(r == 1) & (c == 6)] = 1, 2
    got = segment.flood(r, c, np.where(c == 3, 5.0, 0.0), marker)
    assert (got[c < 3] == 1).all() and (got[c > 3] == 2).all()
    kept = segment.thin_peaks(np.array([0, 0, 5]), np.array([0, 1, 5]), np.array([1.0, 2.0, 1.0]), 2)
    assert kept.tolist() == [1, 2]


def test_start_zones_cover_the_mask(spark):
    rng = np.random.default_rng(2)
    g = (rng.random((24, 24)) * 5 + np.arange(24)[:, None] * 8).tolist()
    x = cells(spark, g).withColumns({"pra": (F.col("r") % 7) / 7.0, "mask": ((F.col("c") < 10) | (F.col("c") > 13)).cast("int")})
    p = segment.SegmentParams(opening=0, closing=0, merge_m2=2000.0)
    got = segment.segment(x, GridSpec(24, 24, 21.34), p)
    assert got.count() == x.where("mask = 1").count() == got.select("r", "c").distinct().count()
    sides = got.groupBy("label").agg(F.min("c").alias("a"), F.max("c").alias("b")).where("a < 10 and b > 13").count()
    assert sides == 0


def faces(spark, z):
    """One zone over a whole grid, with the bands that subdividing needs."""
    x = cells(spark, z)
    s = GridSpec(len(z[0]), len(z), 21.34)
    x = focal.slope(x, s, edges=True).withColumns({"pra": F.lit(0.5), "cost": F.col("c") * 0.0 + 1.0})
    return x.select("r", "c", F.lit(7).cast("long").alias("label")), x, s


def test_zones_are_split_at_benches_and_the_treeline(spark):
    steep = [40.0] * 12 + [4.0] * 3 + [40.0] * 12  # metres a row: a bench in the middle of a face
    height = np.concatenate([[0.0], np.cumsum(steep)])
    zones, x, s = faces(spark, (height[:, None] + np.zeros(16)).tolist())
    p = segment.SegmentParams(least_m2=0.0)
    split = lambda x, **k: segment.subdivide(zones, x, s, segment.SegmentParams(**({"least_m2": 0.0} | k)))
    parts = split(x).groupBy("label").agg(F.min("r").alias("a"), F.max("r").alias("b"), F.count("*").alias("n")).orderBy("a").collect()
    assert len(parts) == 2 and 11 <= parts[0].b <= 15 and sum(q.n for q in parts) == 28 * 16 and 7 in {q.label for q in parts}
    whole = lambda y: y.select("label").distinct().count() == 1
    assert whole(split(x, prominence=80.0)) and whole(split(x, least_m2=1e9)) and whole(split(x, trigger="size")) and whole(split(x, trigger="none"))
    assert segment.split_elevations(height, np.full(28, 45.0), None, p).tolist() == []
    smooth_z, smooth, _ = faces(spark, (np.arange(28.0)[:, None] * 40.0 + np.zeros(16)).tolist())
    assert whole(segment.subdivide(smooth_z, smooth, s, p))
    lined = smooth.withColumn("treeline", F.lit(500.0))
    at = segment.subdivide(smooth_z, lined, s, p).join(smooth.select("r", "c", "z"), ["r", "c"]).groupBy("label").agg(F.min("z").alias("a"), F.max("z").alias("b")).orderBy("a").collect()
    assert len(at) == 2 and abs(at[0].b - 500) < 80
    assert whole(segment.subdivide(smooth_z, lined, s, segment.SegmentParams(least_m2=0.0, use_treeline=False)))


def test_the_cap_tiles_large_zones(spark):
    zones, x, s = faces(spark, (np.arange(30.0)[:, None] * 10 + np.zeros(30)).tolist())
    for enforce in (False, True):
        p = segment.SegmentParams(max_m2=100 * s.cell_area, trigger="size", enforce_cap=enforce)
        most = segment.subdivide(zones, x, s, p).groupBy("label").count().agg(F.max("count")).first()[0]
        assert most <= 100 if enforce else most == 900


def naive_flood(r, c, cost, marker):
    """The same by searching all reached cells for the least (cost, age)."""
    place = {p: i for i, p in enumerate(zip(r.tolist(), c.tolist(), strict=True))}
    out, edge = marker.copy(), [(cost[i], k, i) for k, i in enumerate(np.flatnonzero(marker))]
    age = len(edge)
    while edge:
        best = min(edge)
        edge.remove(best)
        i = best[2]
        for d in ((-1, 0), (0, -1), (0, 1), (1, 0)):
            j = place.get((r[i] + d[0], c[i] + d[1]))
            if j is not None and not out[j]:
                out[j] = out[i]
                edge.append((cost[j], age, j))
                age += 1
    return out


@pytest.mark.parametrize("seed", range(4))
def test_flooding_against_a_naive_one(seed):
    rng = np.random.default_rng(seed)
    r, c = (x.ravel() for x in np.meshgrid(np.arange(14), np.arange(11), indexing="ij"))
    keep = rng.random(len(r)) < 0.85
    r, c = r[keep], c[keep]
    cost = rng.integers(0, 5, len(r)) / 2.0
    marker = np.where(rng.random(len(r)) < 0.06, np.arange(1, len(r) + 1), 0)
    assert (segment.flood(r, c, cost, marker) == naive_flood(r, c, cost, marker)).all()


def test_distances_with_missing_cells_and_ties(spark):
    rng = np.random.default_rng(7)
    rows = [(r, c, int(rng.random() < 0.06)) for r in range(300) for c in range(17) if rng.random() < 0.7]
    x = spark.createDataFrame(rows, "r long, c long, t int")
    s = GridSpec(17, 300, 1.0)
    got = {(q.r, q.c): (q.d2, q.tr, q.tc) for q in distance._nearest(x, s, F.col("t") == 1).collect()}
    targets = [(r, c) for r, c, t in rows if t]
    for r, c, _ in rows:
        assert got[r, c] == min(((r - a) ** 2 + (c - b) ** 2, a, b) for a, b in targets)
    none = distance._nearest(x, s, F.col("t") == 2)
    assert none.where("d2 is not null").count() == 0


def test_wide_neighbourhoods_do_not_depend_on_tiles(spark):
    from firnline.operators import tiles

    rng = np.random.default_rng(1)
    g = [[float(v) if v > 0.1 else None for v in row] for row in rng.random((40, 23))]
    x = cells(spark, g)
    s = GridSpec(23, 40, 10.0)
    whole = focal.wind_shelter(focal.box_means(x, s, {"a": ("z", 7, "reflect"), "b": ("z", 5, "nearest")}), s, radius=3).orderBy("r", "c").toPandas()
    a = np.array([[0.0 if v is None else v for v in row] for row in g])
    for name, k, mode in (("a", 3, "symmetric"), ("b", 2, "edge")):
        pad = np.pad(a, k, mode=mode)
        for q in whole.itertuples():
            assert getattr(q, name) == pytest.approx(pad[q.r : q.r + 2 * k + 1, q.c : q.c + 2 * k + 1].mean())
    for q in whole.itertuples():
        if 3 <= q.r < 37 and 3 <= q.c < 20 and g[q.r][q.c] is not None:
            seen = [math.atan((g[q.r + i][q.c + j] - g[q.r][q.c]) / (10.0 * math.hypot(i, j))) for i in range(-3, 4) for j in range(-3, 4) if 0 < math.hypot(i, j) <= 3 and g[q.r + i][q.c + j]]
            assert q.windshelter == pytest.approx(np.median(seen))
    kept = tiles.TILE
    parts = tiles.tile_kernel(x, s, 2, ["z"], ["m"], lambda arrays, first, size: [np.nan_to_num(arrays["z"]) + first[0] * 0], 8)
    assert parts.where("m = z").count() == x.where("z is not null").count() and kept == 256


def test_labels_by_rounds_equal_those_of_one_task(spark):
    pairs = spark.createDataFrame([(int(b), int(a)) for a, b in np.sort(np.random.default_rng(3).integers(0, 400, (300, 2)), axis=1)], "a long, b long")
    roots = lambda few: sorted(tuple(q) for q in regions._roots(pairs, few).collect())
    assert roots(10**6) == roots(0) == roots(7)


def test_values_come_along_with_their_targets(spark):
    """Of any type, NULL too, and whole numbers that no double holds."""
    rows = [(r, c, (1 << 60) + r * 50 + c if (r, c) != (7, 9) else None, f"{r}-{c}", (r * c) % 7 == 3 or (r, c) == (7, 9)) for r in range(20) for c in range(30) if (r + c) % 5]
    x, s = spark.createDataFrame(rows, "r int, c int, n long, s string, t boolean"), GridSpec(30, 20)
    for band in "ns":
        got = {(q.r, q.c): q.near for q in distance.nearest_feature(x, s, F.col("t"), band, "near").collect()}
        want = {(r, c): (n if band == "n" else k) for r, c, n, k, t in rows if t}
        assert len(got) == len(rows)
        for (r, c), v in got.items():
            assert v == want[min(want, key=lambda p: ((p[0] - r) ** 2 + (p[1] - c) ** 2, p))]
    assert distance.nearest_feature(x, s, F.lit(False), "s", "near").where("near is not null").count() == 0


@pytest.mark.parametrize("most", [1, 5, 1000])
def test_roots_of_long_and_hot_components(spark, most):
    """A path, a star that holds a third of all nodes, repeated pairs and loops,
    dealt out so that no task has a component's pairs."""
    path = [(k + 1, k) for k in range(60)]
    star = [(k, 1000) for k in range(1001, 1060)] + [(1030, 1029)] * 20 + [(7, 7), (5000, 5000)]
    pairs = spark.createDataFrame(path + star, "a long, b long").repartition(7)
    want = [(k, 0) for k in range(1, 61)] + [(k, 1000) for k in range(1001, 1060)]
    assert sorted(tuple(q) for q in regions._roots(pairs, most).collect()) == want
    assert regions._roots(pairs.limit(0), most).count() == 0


def fill(wkt, height, width):
    """Cells whose centre an odd number of rings hold."""
    from firnline.sources.vectors import rings_of_wkt

    out = np.zeros((height, width), dtype=bool)
    for ring in rings_of_wkt(wkt):
        for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False):
            for r in range(height):
                y = -(r + 0.5)
                if (ay > y) != (by > y):
                    out[r] ^= np.arange(width) + 0.5 < ax + (bx - ax) * (y - ay) / (by - ay)
    return out


def test_outlines_by_filling_them(spark):
    g = np.random.default_rng(2).random((14, 12)) < 0.55
    x = cells(spark, g.astype(float).tolist()).withColumn("v", F.when(F.col("z") == 1, 1))
    s = GridSpec(12, 14, 1.0)
    _, members = regions.polygonize(x, s, "v")
    cells_of = {}
    for q in members.collect():
        cells_of.setdefault(q.label, set()).add((q.r, q.c))
    shapes = {q.label: q.wkt for q in regions.outlines(members, s).collect()}
    assert set(shapes) == set(cells_of)
    for label, wkt in shapes.items():
        assert {tuple(p) for p in np.argwhere(fill(wkt, 14, 12)).tolist()} == cells_of[label]


def test_treelines_of_regions(spark):
    x = spark.createDataFrame([(r, c, 1000.0 + r, 60.0 if c < 6 or r < 20 else 0.0) for r in range(60) for c in range(12)], "r long, c long, z double, canopy double")
    one = zonal.treelines(x).select("treeline").distinct().collect()
    assert len(one) == 1 and one[0].treeline is None  # too little forest
    zones = x.select("r", "c", F.when(F.col("c") < 6, "west").otherwise("east").alias("name")).unionByName(x.where("c = 0").select("r", "c", F.lit("zenith").alias("name")))
    table = spark.createDataFrame([("west", "R", "G", 1111.0, 200.0), ("east", "R", "G", 5.0, 1.0), ("zenith", "S", "H", 9.0, 999.0)], "name string, range string, `group` string, treeline double, n_forest_kpx double")
    got = {(q.c, q.treeline) for q in zonal.treelines(x, zones, table).select("c", "treeline").distinct().collect()}
    assert got == {(0, 9.0), *((c, 1111.0) for c in range(1, 12))}  # east falls back on its range, the later name wins
    assert zonal.kind_counts(x.select("r", "c", F.lit(1).alias("label")), GridSpec(12, 60, 1.0), {"big": 700.0, "huge": 721.0}).first()[:] == (1, 720.0, 1, 0)


def test_polygon_layers(spark, tmp_path):
    from firnline.sources import vectors

    (tmp_path / "a.geojson").write_text(
        '{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"name":"ring"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[4,0],[4,-4],[0,-4],[0,0]],[[1,-1],[3,-1],[3,-3],[1,-3],[1,-1]]]}},'
        '{"type":"Feature","properties":{},"geometry":{"type":"MultiPolygon","coordinates":[[[[5,0],[6,0],[6,-1],[5,-1],[5,0]]]]}},{"type":"Feature","properties":{},"geometry":null}]}'
    )
    (tmp_path / "b.csv").write_text('name,wkt\nring,"POLYGON ((0 0, 4 0, 4 -4, 0 -4, 0 0), (1 -1, 3 -1, 3 -3, 1 -3, 1 -1))"\nnone,\n')
    x = cells(spark, np.zeros((6, 7)).tolist())
    for name, more in (("a.geojson", {(0, 5)}), ("b.csv", set())):
        got = vectors.burn(x, GridSpec(7, 6, 1.0), vectors.read_layer(spark, f"file://{tmp_path}/{name}"))
        assert {(q.r, q.c) for q in got.collect()} == {(r, c) for r in range(4) for c in range(4) if not (1 <= r <= 2 and 1 <= c <= 2)} | more
    assert vectors.burn(x, GridSpec(7, 6, 1.0), vectors.read_layer(spark, f"file://{tmp_path}/b.csv").limit(0)).count() == 0


def test_treelines(spark):
    x = spark.createDataFrame([(float(z), 50.0 if z < 80 else 0.0) for z in range(100)], "z double, canopy double")
    assert zonal.treeline_percentile(x, least=50).first().treeline == pytest.approx(0.95 * 79)
    assert zonal.treeline_percentile(x, least=500).first().treeline is None
    assert zonal.treeline_fraction(x, bin_m=10, least=5).first().treeline == 75
    t = spark.createDataFrame([("a", "R", "G", 100.0, 200.0), ("b", "R", "G", 5.0, 1.0), ("c", "S", "G", 7.0, 1.0), ("d", "T", "H", 1.0, 1.0)], "name string, range string, `group` string, treeline double, n_forest_kpx double")
    assert {r.name: r.treeline for r in zonal.treeline_fallback(t).collect()} == {"a": 100, "b": 100, "c": 100, "d": None}


SHIPPED = """[General]
project_name = shipped
working_dir = ./outputs
output_basename = x
target_resolution_x = 0
aoi_path =
[Input]
dem_path = ./dem.tif
[Processing]
run_colorize = False
[PRA]
frequent_slope_c = 41.5 ; degrees
enable_ruggedness = True
forest_type = bav
extreme_forest_a = 33
wind_radius_cells = 4
[PRA_Segmentation]
downsample_factor = 1
extreme_merge_threshold = 123
split_trigger = terrain
[FlowPy]
engine = numba
tile_size = 15000
max_added_friction = 40
[ATES]
model = legacy
sat12 = 24
class4_alpha = 61
[Output]
save_shp = False
"""


def test_every_section_of_the_configuration_is_read(tmp_path):
    ini = tmp_path / "run.ini"
    ini.write_text(SHIPPED)
    cfg = config.load(ini)
    assert cfg.pra.frequent_slope_c == 41.5 and cfg.pra.enable_ruggedness and cfg.ates.model == "legacy" and cfg.flow.exponent == 8
    assert cfg.pra.forest("frequent") == (20.0, 3.5, -10.0) and cfg.pra.forest("extreme") == (33.0, 3.5, -10.0) and cfg.pra.wind_radius_cells == 4
    p = cfg.segments.params("extreme")
    assert (p.merge_m2, p.trigger, p.curvature_weight, p.least_m2) == (123.0, "terrain", 1.0, 60000.0)
    f = cfg.flow.params("extreme", 20.0)
    assert (f.alpha, f.tile, f.max_friction) == (18.0, 750, 40.0)
    assert cfg.ates.cuts()["sat"] == (15.0, 24.0, 32.0, 45.0) and cfg.ates.cuts()["overhead"] == 61.0 and not cfg.output.save_shp and not cfg.run_colorize
    for wrong in ("[Other]\nx = 1\n", "[PRA]\nfrequent_slope_d = 1\n", "[PRA]\nrun_extreme = perhaps\n", "[PRA]\nwind_a = much\n"):
        ini.write_text(wrong)
        with pytest.raises(ValueError):
            config.load(ini)


def test_changed_keys_change_results(spark):
    rng = np.random.default_rng(4)
    x = cells(spark, [[2000.0 - 14.0 * r + 6 * math.sin(c / 3) + rng.random() for c in range(16)] for r in range(20)]).withColumn("canopy", F.col("c") * 6.0)
    s = GridSpec(16, 20, 21.34)

    def area(**keys):
        p = config.ReleaseConfig(**keys)
        return release_areas(terrain(x, s, p), s, p, "frequent").agg(F.round(F.sum("pra"), 6)).first()[0]

    usual = area()
    for keys in ({"forest_type": "ch"}, {"frequent_forest_a": 20.0}, {"wind_radius_cells": 5}, {"frequent_slope_clip_lo": 40.0}, {"frequent_slope_a_low": 3.0}, {"enable_ruggedness": True}):
        assert area(**keys) != usual, keys


def test_manifest_and_versions(tmp_path):
    ini = tmp_path / "run.ini"
    ini.write_text("[ATES]\nmodel = legacy\n")
    cfg = config.load(ini)
    (tmp_path / "tiles").mkdir()
    (tmp_path / "tiles/part").write_text("x")
    m = manifest.Manifest(tmp_path / "m.json", cfg, inputs=[ini, tmp_path / "tiles", tmp_path / "not there", ""])
    assert [i["exists"] for i in m.data["inputs"]] == [True, True, False] and m.data["inputs"][1]["files"] == 1
    assert m.data["packages"]["pyspark"] and "branch" in m.data["code"]
    m.failed("b", ValueError("why"))
    m.step("a", 60)
    m.finish("done")
    assert '"wall_clock_min"' in (tmp_path / "m.json").read_text()
    assert manifest.digest(ini)["sha256"] and manifest.plain({"x": float("nan")}) == {"x": None}
    assert tables.next_version(tmp_path, "zones") == 1
    (tmp_path / "zones_v3.parquet").mkdir()
    (tmp_path / "zones_vx.parquet").mkdir()
    assert tables.next_version(tmp_path, "zones") == 4
    (tmp_path / "a_Z_Delta.txt").write_text("")
    assert tables.find_by_token(tmp_path, "zdelta").name == "a_Z_Delta.txt"


def test_rasters_are_tiled(spark, tmp_path):
    x = cells(spark, [[float(r * 10 + c) for c in range(10)] for r in range(10)])
    tables.write_raster(x, f"file://{tmp_path}/z", tile=4)
    part = tables.read_window(spark, f"file://{tmp_path}/z", 2, 6, 3, 5, tile=4)
    assert part.count() == 8 and "PartitionFilters" in part._jdf.queryExecution().executedPlan().toString()
    (tmp_path / "g.asc").write_text("ncols 2\nnrows 2\nxllcorner 0\nyllcorner 0\ncellsize 5\nNODATA_value -9999\n1 2\n3 -9999\n")
    got, head = tables.read_ascii_grid(spark, f"file://{tmp_path}/g.asc")
    assert head["cellsize"] == 5 and sorted((r.r, r.c, r.z) for r in got.where("z is not null").collect()) == [(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0)]


def test_whole_workflow(spark):
    rng = np.random.default_rng(3)
    x = cells(spark, [[2000.0 - 14.0 * r + 6 * math.sin(c / 3) + rng.random() for c in range(20)] for r in range(26)])
    x = x.withColumn("canopy", F.when(F.col("r") > 18, 70.0).otherwise(5.0))
    cfg = config.RunConfig()
    cfg.flow.forest_interaction = True
    out = run_stack(x, GridSpec(20, 26, 21.34), cfg)
    assert {"pra_frequent", "zones_extreme", "runout_frequent", "ates", "ates_regions", "ates_rgba"} <= set(out)
    classes = {r.ates for r in out["ates"].select("ates").distinct().collect()}
    assert classes <= {None, 0, 1, 2, 3, 4} and len(classes) > 1
    assert out["zone_metrics_frequent"].count() == out["zones_frequent"].select("label").distinct().count()


def test_a_run_from_files(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = cells(spark, [[2000.0 - 14.0 * r + 6 * math.sin(c / 3) + rng.random() for c in range(20)] for r in range(26)])
    x.select("r", "c", "z").write.parquet(f"file://{tmp_path}/dem")
    x.select("r", "c", F.lit(5.0).alias("canopy")).write.parquet(f"file://{tmp_path}/canopy")
    (tmp_path / "aoi.csv").write_text(f'name,wkt\na,"POLYGON ((0 0, {10 * 21.34} 0, {10 * 21.34} -900, 0 -900, 0 0))"\n')
    (tmp_path / "run.ini").write_text(
        f"[General]\nproject_name = p\nworking_dir = {tmp_path}/out\naoi_path = file://{tmp_path}/aoi.csv\n[Input]\ndem_path = file://{tmp_path}/dem\nforest_canopy_path = file://{tmp_path}/canopy\n[PRA]\nrun_extreme = False\n"
    )
    folder = run(spark, config.load(tmp_path / "run.ini"), "run.ini")
    told = json.loads(open(f"{folder}/manifest.json").read())
    assert told["status"] == "done" and [i["exists"] for i in told["inputs"]] == [True, True, True] and "zones" in told["steps"]["pra_frequent"]
    assert os.path.getsize(f"{folder}/run.log") > 0
    ates = spark.read.parquet(f"file://{folder}/ates")
    assert ates.agg(F.max("c")).first()[0] == 9 and {"tr", "tc"} <= set(ates.columns)
    assert spark.read.parquet(f"file://{folder}/ates_rgba").where("factor = 16").count() <= 4
    shapes = spark.read.parquet(f"file://{folder}/zone_metrics_frequent_v1.parquet")
    assert shapes.where("wkt like 'POLYGON%' and treeline_m is null").count() == shapes.count() > 0
    assert "ates_rgba" in colour_run(spark, folder, GridSpec(20, 26, 21.34), {"ates_rgba": palette.parse("0 9 9 9\n1 9 9 9\n2 9 9 9\n3 9 9 9\n4 9 9 9")}, images=True)
    assert {q.red for q in spark.read.parquet(f"file://{folder}/ates_rgba").where("alpha > 0").select("red").distinct().collect()} == {9}
    pixels = imagery.read_image(spark, f"{folder}/ates_rgba.tif")
    assert pixels.count() == 520 and {q.red for q in pixels.where("alpha > 0").select("red").distinct().collect()} == {9}


def test_ascii_grids_of_many_splits(spark, tmp_path):
    (tmp_path / "g.asc").write_text("ncols 3\nnrows 4000\n" + "".join(f"{r} {r + 0.5} -9999\n" for r in range(4000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got, _ = tables.read_ascii_grid(spark, f"file://{tmp_path}/g.asc")
        assert got.where("c = 0 and r = z").count() == 4000 and got.where("c = 2 and z is null").count() == 4000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_merging_under_a_cap_counts_what_has_been_taken(spark):
    row = [1, 1, 1] + [2] * 10 + [3, 3, 3]
    x = spark.createDataFrame([(0, c, v) for c, v in enumerate(row)], "r long, c long, label long")
    merged = {r.label: r.merged for r in regions.merge_small(x, GridSpec(16, 1, 1.0), 5.0, 14.0).collect()}
    assert merged == {1: 2, 2: 2, 3: 3}  # the second cluster no longer fits


def test_capped_merging_as_one_after_another(spark):
    rng = np.random.default_rng(3)
    blocks = rng.integers(0, 6, (12, 12)).repeat(3, axis=0).repeat(3, axis=1)
    noisy = np.where(rng.random(blocks.shape) < 0.25, 9, blocks)
    s = GridSpec(36, 36, 1.0)
    cells = spark.createDataFrame([(r, c, int(v)) for (r, c), v in np.ndenumerate(noisy)], "r long, c long, v long")
    labels = regions.connected(cells, s, "v", 4).select("r", "c", "label").cache()
    at = {(r.r, r.c): r.label for r in labels.collect()}
    area, border, touch = {}, {}, {}
    for (r, c), v in at.items():
        area[v] = area.get(v, 0) + 1
        for dr, dc in ((a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b):
            w = at.get((r + dr, c + dc))
            if w is not None and w != v:
                touch.setdefault(v, set()).add(w)
                border[v, w] = border.get((v, w), 0) + (dr == 0 or dc == 0)
    least, cap = 4, 12
    cluster, want, total = {}, {v: v for v in area}, dict(area)
    for v in sorted(area):
        if area[v] < least and v not in cluster:
            todo = [v]
            while todo:
                w = todo.pop()
                if area[w] < least and w not in cluster:
                    cluster[w] = v
                    todo += touch.get(w, ())
    for root in sorted(set(cluster.values())):
        mine = [v for v in cluster if cluster[v] == root]
        name, size = max(mine, key=lambda v: (area[v], -v)), sum(area[v] for v in mine)
        near = {w for v in mine for w in touch.get(v, ()) if area[w] >= least and total[w] + size <= cap} if size < least else set()
        into = max(near, key=lambda w: (sum(border.get((v, w), 0) for v in mine), -w), default=name)
        total[into] = total.get(into, 0) + size * (into != name)
        want |= dict.fromkeys(mine, into)
    got = {r.label: r.merged for r in regions.merge_small(labels, s, float(least), float(cap)).collect()}
    assert got == want and any(want[v] != v for v in want)
