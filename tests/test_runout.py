import math

import numpy as np
from pyspark.sql import functions as F

from firnline.operators import flow
from firnline.plans import queries


def test_registered_query_runs_every_release_cell(spark, sf):
    go = {(x.r, x.c) for x in queries._released(spark, sf).where("pra >= 0.25 and z is not null").select("r", "c").collect()}
    got = queries.QUERIES["runout"](spark, sf).where(F.col("travelLengthMin") == 0).collect()
    assert {(x.r, x.c) for x in got} == go


def test_kernel_follows_the_energy_line():
    z = 1000.0 - 5.0 * np.arange(40)[:, None] + np.zeros((40, 9))
    p = flow.FlowParams(alpha=25.0)
    w = flow.Window(z, np.zeros_like(z), p, 10.0)
    got = flow.run_release(w, w.place(3, 4))
    for flux, energy, length, angle, *_ in got.values():
        assert 0 < flux <= 1 + 1e-9 and 0 <= energy <= p.max_z
        assert not length or angle > math.degrees(math.atan(0.45))
    assert sum(v[0] for at, v in got.items() if at // w.width - 1 == 10) <= 1 + 1e-9


def test_no_path_is_cut_at_a_window(spark):
    rows = [(r, c, 3000.0 - 6.0 * r + abs(c - 3), int((r, c) in {(1, 3), (30, 2), (47, 4)})) for r in range(150) for c in range(7)]
    x = spark.createDataFrame(rows, "r long, c long, z double, go int")
    s = flow.GridSpec(7, 150, 10.0)
    whole = flow.runout(x, s, "go", flow.FlowParams(alpha=25.0, tile=256, halo=256)).orderBy("r", "c").toPandas()
    assert whole.r.max() == 149  # 31 degrees: never stops
    for tile, halo in ((8, 4), (16, 0), (64, 64)):
        got = flow.runout(x, s, "go", flow.FlowParams(alpha=25.0, tile=tile, halo=halo)).orderBy("r", "c").toPandas()
        assert got[["r", "c", "cellCounts"]].equals(whole[["r", "c", "cellCounts"]])
        assert np.allclose(got, whole)


def naive(z, canopy, start, p, cell):
    """The flow path from one cell by the rules alone: of the cells reached, the
    one with the highest energy line is next; those equal come in the order in
    which they got that high."""
    height, width = z.shape
    heads = {start: (z[start], 0)}
    flux, energy, length, came, done, out, put = {start: 1.0}, {start: 0.0}, {start: 0.0}, {start: {}}, set(), {}, 0
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]
    while len(done) < len(heads):
        at = min((k for k in heads if k not in done), key=lambda k: (-heads[k][0], heads[k][1]))
        done.add(at)
        shares = []
        for d in steps:
            to = at[0] + d[0], at[1] + d[1]
            if not (0 <= to[0] < height and 0 <= to[1] < width) or to in done or math.isnan(z[to]):
                continue
            run = cell * math.hypot(*d)
            drop = z[at] - z[to]
            angle = p.alpha
            if p.forest and canopy[to] > 0:
                angle = min(85.0, angle + (p.min_friction + (p.max_friction - p.min_friction) * max(0.0, 1.0 - energy[at] / p.friction_velocity_z)) * canopy[to] / 100.0)
            left = min(p.max_z, energy[at] + drop - math.tan(math.radians(angle)) * run)
            if left <= 0:
                continue
            ahead = sum(f * max(0.0, (d[0] * e[0] + d[1] * e[1]) / (math.hypot(*d) * math.hypot(*e))) for e, f in came[at].items()) if came[at] else 1.0
            weight = math.tan((math.atan2(drop, run) + math.pi / 2) / 2) ** p.exponent * ahead
            if weight > 0:
                shares.append((to, weight, left, run, d))
        rest, whole = flux[at], sum(x[1] for x in shares)
        if p.forest and canopy[at] > 0:
            rest = max(0.0, rest - (p.min_detrainment + (p.max_detrainment - p.min_detrainment) * max(0.0, 1.0 - energy[at] / p.detrainment_velocity_z)) * canopy[at] / 100.0)
        good = [x for x in shares if rest * x[1] / whole >= p.flux_threshold]
        out[at] = (flux[at], energy[at], length[at])
        risen = []
        for to, weight, left, run, d in good:
            f = rest * weight / sum(x[1] for x in good)
            before = heads.get(to, (-math.inf, 0))
            flux[to] = flux.get(to, 0.0) + f
            length[to] = min(length.get(to, math.inf), length[at] + run)
            came.setdefault(to, {})[d] = came.get(to, {}).get(d, 0.0) + f
            if left > energy.get(to, 0.0):
                energy[to] = left
                risen.append((before, to))
        for before, to in sorted(risen, key=lambda x: (-x[0][0], x[0][1])):
            if z[to] + energy[to] > before[0]:
                put += 1
                heads[to] = (z[to] + energy[to], put)
    return out


def test_registered_query_against_a_naive_version(spark, sf):
    x = queries._released(spark, sf).select("r", "c", "z", "canopy", (F.col("pra") >= 0.25).alias("go")).toPandas()
    z = np.full((x.r.max() + 1, x.c.max() + 1), np.nan)
    z[x.r, x.c] = x.z
    total = {}
    for q in x[x.go.fillna(False)].itertuples():
        for at, v in naive(z, np.zeros_like(z), (q.r, q.c), flow.FlowParams(alpha=30.0), queries.CELL).items():
            t = total.setdefault(at, [0, 0.0, 0.0, 0.0, math.inf, 0.0])
            t[:] = [t[0] + 1, max(t[1], v[0]), max(t[2], v[1]), max(t[3], v[2]), min(t[4], v[2]), t[5] + v[0]]
    got = {(q.r, q.c): (q.cellCounts, q.flux, q.zDelta, q.travelLengthMax, q.travelLengthMin, q.routFluxSum) for q in queries.QUERIES["runout"](spark, sf).collect()}
    assert set(got) == set(total)
    for at, t in total.items():
        assert np.allclose(got[at], t)


def test_forest_against_a_naive_version():
    rng = np.random.default_rng(0)
    z = 500.0 - 8.0 * np.arange(14)[:, None] + rng.random((14, 9)) * 6
    canopy = np.where(rng.random(z.shape) < 0.5, rng.integers(1, 100, z.shape), 0).astype(float)
    p = flow.FlowParams(alpha=22.0, forest=True, detrainment_velocity_z=90.0)
    w = flow.Window(z, canopy, p, 10.0)
    for start in ((0, 4), (3, 1), (5, 8)):
        got = flow.run_release(w, w.place(*start))
        want = naive(z, canopy, start, p, 10.0)
        assert {(at // w.width - 1, at % w.width - 1) for at in got} == set(want)
        for at, v in got.items():
            assert np.allclose(v[:3], want[at // w.width - 1, at % w.width - 1])


def test_releases_beside_each_other_give_the_paths_of_single_ones(monkeypatch):
    """All kinds of ends: a path that stops, one that comes to the rim, one with
    more cells than fit beside others; with and without forest."""
    r, c = np.mgrid[0:90, 0:40]
    z = 1500.0 - 6.0 * r + 25.0 * np.sin(r / 5.0) * np.cos(c / 4.0) + 7.0 * np.sin(c * r)
    canopy = np.maximum(0.0, 60.0 * np.sin(c / 3.0))
    monkeypatch.setattr(flow, "LARGEST", 64)
    seen = set()
    for forest in (False, True):
        p = flow.FlowParams(alpha=20.0, forest=forest)
        w = flow.Window(z, canopy, p, 10.0, (False, True, False, False))
        starts = np.array([w.place(a, b) for a in range(0, 90, 2) for b in range(1, 40, 3)])
        counts, flux, energy = {}, {}, {}
        for kind, x in flow.Beside(w, starts).paths():
            seen.add(kind)
            if kind != "done":
                for j in x.tolist():
                    alone = flow.run_release(w, int(starts[j]))
                    assert alone is None if kind == "rim" else alone is None or len(alone) > 40
                    starts[j] = -1
                continue
            for at, f, e in zip(x[0].tolist(), x[1], x[2], strict=True):
                counts[at], flux[at], energy[at] = counts.get(at, 0) + 1, flux.get(at, 0.0) + f, energy.get(at, 0.0) + e
        assert (starts > 0).any()
        for start in starts[starts > 0].tolist():
            for at, v in flow.run_release(w, start).items():
                counts[at], flux[at], energy[at] = counts[at] - 1, flux[at] - v[0], energy[at] - v[1]
        assert not any(counts.values())
        assert max(map(abs, flux.values())) < 1e-9 and max(map(abs, energy.values())) < 1e-6
    assert seen == {"done", "rim", "long"}
