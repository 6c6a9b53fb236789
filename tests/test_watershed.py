"""Flooding, peak spacing and quantiles in rounds against versions that hold
everything in memory."""

import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from firnline.grid import GridSpec
from firnline.operators import segment, zonal
from firnline.operators.distance import distance_to
from firnline.operators.focal import closing, local_maxima, opening
from firnline.operators.watershed import spaced_peaks, watershed


def holes(seed, shape=(19, 27), keep=0.85):
    rng = np.random.default_rng(seed)
    r, c = (x.ravel() for x in np.meshgrid(np.arange(shape[0]), np.arange(shape[1]), indexing="ij"))
    there = rng.random(len(r)) < keep
    return rng, r[there], c[there]


def table(spark, schema, *columns):
    return spark.createDataFrame(list(zip(*[x.tolist() for x in columns], strict=True)), schema)


@pytest.mark.parametrize("tile", [8, 14, 64])
def test_tiles_flood_as_one_map(spark, tile):
    rng, r, c = holes(tile)
    cost = rng.random(len(r))  # no two alike
    marker = np.where(rng.random(len(r)) < 0.02, np.arange(1, len(r) + 1), 0)
    want = segment.flood(r, c, cost, marker)
    got = {(q.r, q.c): q.label for q in watershed(table(spark, "r long, c long, cost double, marker long", r, c, cost, marker), tile=tile).collect()}
    assert got == {(a, b): m for a, b, m in zip(r.tolist(), c.tolist(), want.tolist(), strict=True) if m}


def by_state(r, c, cost, marker, zone):
    """Cells by (level, steps, inner, marker), all in one heap."""
    place = {p: i for i, p in enumerate(zip(r.tolist(), c.tolist(), strict=True))}
    out = marker.copy()
    heap = [(cost[i], 0, 0, marker[i], i) for i in np.flatnonzero(marker)]
    heapq.heapify(heap)
    while heap:
        lv, n, k, m, i = heapq.heappop(heap)
        for d in ((0, 1), (1, 0), (0, -1), (-1, 0)):
            j = place.get((r[i] + d[0], c[i] + d[1]))
            if j is not None and not out[j] and zone[i] == zone[j]:
                out[j] = m
                heapq.heappush(heap, (cost[j], 0, 0, m, j) if cost[j] > lv else (lv, n + 1, 0, m, j) if cost[j] == lv else (lv, n, k + 1, m, j))
    return out


@pytest.mark.parametrize("tile", [6, 64])
def test_plateaus_and_zones_do_not_depend_on_tiles(spark, tile):
    rng, r, c = holes(3)
    cost, zone = rng.integers(0, 3, len(r)).astype(float), (c > 13).astype(int) + 2 * (r > 9)
    marker = np.where(rng.random(len(r)) < 0.03, rng.integers(1, 9, len(r)), 0)  # markers of several cells
    want = by_state(r, c, cost, marker, zone)
    df = table(spark, "r long, c long, cost double, marker long, zone long", r, c, cost, marker, zone)
    got = {(q.r, q.c): (q.label, q.zone) for q in watershed(df, "zone", tile).collect()}
    assert got == {(a, b): (m, z) for a, b, m, z in zip(r.tolist(), c.tolist(), want.tolist(), zone.tolist(), strict=True) if m}


def test_a_long_way_crosses_many_tiles(spark):
    """A corridor that winds through all tiles, with one marker at its end."""
    path = [(2 * k + (0 if j < 20 else 1), (j if k % 2 == 0 else 19 - j) if j < 20 else (19 if k % 2 == 0 else 0)) for k in range(5) for j in range(21)]
    df = spark.createDataFrame([(a, b, None if k % 7 else 1.0, 5 if k == 0 else None) for k, (a, b) in enumerate(path)], "r long, c long, cost double, marker long")
    got = watershed(df, tile=8).collect()
    assert len(got) == len(path) and {q.label for q in got} == {5}
    assert watershed(df.withColumn("marker", F.lit(0)), tile=8).count() == watershed(df.limit(0)).count() == 0


@pytest.mark.parametrize("tile", [5, 64])
def test_spacing_as_highest_first(spark, tile):
    rng, r, c = holes(8)
    height = rng.integers(0, 4, len(r)).astype(float)
    peaks = table(spark, "r long, c long, height double, zone long", r, c, height, np.zeros(len(r), dtype=int))
    want = segment.thin_peaks(r, c, height, 2)
    assert {(q.r, q.c) for q in spaced_peaks(peaks, 2, tile).collect()} == set(zip(r[want].tolist(), c[want].tolist(), strict=True))
    halves = peaks.withColumn("zone", (F.col("c") > 12).cast("long"))
    got = {(q.r, q.c) for q in spaced_peaks(halves, 2, tile).collect()}
    left, right = (np.flatnonzero(side) for side in (c <= 12, c > 12))
    want = [i for part in (left, right) for i in part[segment.thin_peaks(r[part], c[part], height[part], 2)]]
    assert got == set(zip(r[want].tolist(), c[want].tolist(), strict=True))
    assert spaced_peaks(peaks.limit(0), 2, tile).count() == 0


def test_start_zones_by_flooding_in_memory(spark):
    """All steps of the segmentation before zones are cut, from the same bands."""
    rng, height = np.random.default_rng(5), 0
    n, m = 33, 41
    z = (np.sin(np.arange(n) / 4.0)[:, None] * 80 + np.cos(np.arange(m) / 5.0)[None] * 60 + rng.random((n, m)) * 9).ravel()
    r, c = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(m), indexing="ij"))
    x = table(spark, "r long, c long, z double, pra double", r, c, z, rng.random(n * m).round(3)).withColumn("mask", ((F.col("c") % 17 > 1) & (F.col("pra") > 0.05)).cast("int"))
    s, p = GridSpec(m, n, 21.34), segment.SegmentParams(trigger="none")
    got = {(q.r, q.c): q.label for q in segment.segment(x, s, p, merge=False).collect()}
    y = segment.cost_surface(closing(opening(x, "mask", 1), "mask", 1), p)
    high = (F.col("pra_norm") > p.high) & (F.col("mask") == 1)
    y = distance_to(y, s, ~high, "_edt").withColumns({"_edt": F.when(high, F.coalesce("_edt", F.lit(1e6))).otherwise(0.0), "_bend": F.when(F.col("mask") == 1, F.abs("curvature")).otherwise(0.0)})
    y = local_maxima(y, s, {"_peak": ("_edt", 2), "_crest": ("_bend", 2)}).where("mask = 1").orderBy("r", "c").toPandas()
    r, c, marker = y.r.to_numpy(), y.c.to_numpy(), np.zeros(len(y), dtype=np.int64)
    for flag, height in (("_peak", "_edt"), ("_crest", "_bend")):
        at = np.flatnonzero(y[flag])
        at = at[segment.thin_peaks(r[at], c[at], y[height].to_numpy()[at], 2)]
        marker[at] = at + 1
    want = segment.flood(r, c, y.cost.to_numpy(), marker)
    flooded = {(a, b): int(r[k - 1] * m + c[k - 1]) for a, b, k in zip(r.tolist(), c.tolist(), want.tolist(), strict=True) if k}
    assert {k: v for k, v in got.items() if k in flooded} == flooded
    assert len(got) == len(y) and min([v for k, v in got.items() if k not in flooded], default=1 << 60) > max(flooded.values())


@pytest.mark.parametrize(("p", "bins"), [(0.0, 4096), (0.25, 8), (0.5, 4096), (0.95, 64), (1.0, 4096)])
def test_exact_quantiles(spark, p, bins):
    rng = np.random.default_rng(9)
    groups = {0: rng.normal(size=301), 1: np.repeat([3.0, -1.0, 3.0], 50), 2: np.array([7.5]), 3: 10.0 ** rng.integers(-4, 5, 200) * rng.choice([-1, 1], 200), 4: np.array([-0.0, 0.0, 1.0, 2.0])}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [(0, None), (0, float("nan")), (5, None), (None, 1.0)]
    df = spark.createDataFrame(rows, "g long, v double").repartition(5)
    got = {q.g: (q.quantile, q.n) for q in zonal.group_quantile(df, ["g"], "v", p, bins=bins).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        assert got[k][0] == pytest.approx(np.quantile(vs, p), rel=1e-9) and got[k][1] == len(vs)
    whole = zonal.group_quantile(df.where("g < 3"), [], "v", p, bins=bins).collect()
    assert [q.n for q in whole] == [452] and whole[0].quantile == pytest.approx(np.quantile(np.concatenate([groups[k] for k in range(3)]), p))
    assert zonal.group_quantile(df.limit(0), [], "v", p).collect() == []


def test_mask_is_opened_and_closed_in_one_shuffle(spark):
    """As by the steps one after another, across tiles and beside missing cells."""
    from firnline.operators import focal

    x = spark.range(70 * 300).select(F.floor(F.col("id") / 300).alias("r"), (F.col("id") % 300).alias("c")).where("(r * 7 + c * 3) % 41 > 0")
    x = x.withColumn("mask", ((F.floor(F.col("r") / 3) * 5 + F.floor(F.col("c") / 4) * 3 + F.hash("r", "c") % 2) % 3 > 0).cast("int"))
    s = GridSpec.of(x)
    for a, b in ((1, 1), (2, 0), (1, 2)):
        got = focal.opened_and_closed(x, s, "mask", a, b)
        want = focal.closing(focal.opening(x, "mask", a), "mask", b)
        assert got.dtypes == want.dtypes
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    plan = focal.opened_and_closed(x, s, "mask")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1, plan
