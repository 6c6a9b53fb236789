"""Marker-controlled watershed and peak spacing over masks of any extent, in
rounds over tiles: no task sees more than a tile and its rim.

A cell's state is (level, steps, inner, marker). Level is the least height at
which water from any marker reaches it, steps how many cells of that very height
the water has come through on a plateau, inner how far it has run below that
height since; the marker decides between equals. A cell takes the marker of its
least neighbour by state, so the result doesn't depend on how the map is tiled.

A tile is flooded from its own markers and from its neighbours' rims as they
stand. Where a rim's state changes, the tiles across it are flooded again; when
no rim changes any more, one last pass labels all cells. Rounds are as many as
tiles that the longest way from a marker crosses.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firnline.grid import TILE, cut_lineage, workers_see

STATE = "level double, steps long, inner long, label long"
NEAR = ((-1, 0), (0, -1), (0, 1), (1, 0))


def flood_tile(cost: np.ndarray, zone: np.ndarray, marker: np.ndarray, rim: dict[int, tuple]) -> dict[str, np.ndarray]:
    """States of a tile's cells. Arrays have one more cell on all sides, NaN in
    cost where there is none; water doesn't pass between zones. rim: of cells
    beside the tile, by place in the flat array, the state they have."""
    wide = cost.shape[1]
    steps = (-wide, -1, 1, wide)
    height, part, mark = cost.ravel().tolist(), zone.ravel().tolist(), marker.ravel().tolist()
    inside = ~np.isnan(cost)
    if rim:
        inside.ravel()[list(rim)] = False  # theirs isn't computed here
    free = inside.ravel().tolist()
    level, label = np.full(cost.size, np.nan), np.zeros(cost.size, dtype=np.int64)
    count, inner = np.zeros(cost.size, dtype=np.int64), np.zeros(cost.size, dtype=np.int64)
    heap = [(*state, i) for i, state in rim.items()]
    for i in np.flatnonzero(marker.ravel() * inside.ravel()).tolist():
        heap.append((height[i], 0, 0, mark[i], i))
        level[i], label[i], free[i] = height[i], mark[i], False
    heapq.heapify(heap)
    while heap:
        lv, n, k, m, i = heapq.heappop(heap)
        for d in steps:
            j = i + d
            if 0 <= j < len(free) and free[j] and part[j] == part[i]:
                h = height[j]
                state = (h, 0, 0, m, j) if h > lv else (lv, n + 1, 0, m, j) if h == lv else (lv, n, k + 1, m, j)
                free[j] = False
                level[j], count[j], inner[j], label[j] = state[:4]
                heapq.heappush(heap, state)
    return {"level": level, "steps": count, "inner": inner, "label": label}


def _flood(base: DataFrame, rims: DataFrame | None, tile: int, rim_only: bool) -> DataFrame:
    """One round: base (tr, tc, r, c, cost, zone, marker) of the tiles to flood,
    rims with the tile that they are beside."""
    own = base.select("tr", "tc", "r", "c", "cost", "zone", "marker", *[F.lit(None).cast(k).alias(n) for n, k in (f.split() for f in STATE.split(", "))])
    if rims is not None:
        own = own.unionByName(rims.select("tr", "tc", "r", "c", F.lit(None).cast("double").alias("cost"), "zone", F.lit(0).cast("long").alias("marker"), "level", "steps", "inner", "label"))

    def run(key, table):
        tr, tc = (k.as_py() for k in key)
        r, c = table.column("r").to_numpy(), table.column("c").to_numpy()
        wide = tile + 2
        at = (r - tr * tile + 1) * wide + c - tc * tile + 1
        outer = table.column("level").is_valid().to_numpy()
        mine = ~outer
        cost, zone, marker = np.full(wide * wide, np.nan), np.full(wide * wide, -1, dtype=np.int64), np.zeros(wide * wide, dtype=np.int64)
        cost[at[mine]] = table.column("cost").to_numpy()[mine]
        zone[at] = table.column("zone").to_numpy()
        marker[at[mine]] = table.column("marker").to_numpy()[mine]
        seen = table.filter(pa.array(outer)).select(["level", "steps", "inner", "label"]).to_pydict()
        rim = dict(zip(at[outer].tolist(), zip(*seen.values(), strict=True), strict=True))
        got = flood_tile(cost.reshape(wide, wide), zone.reshape(wide, wide), marker.reshape(wide, wide), rim)
        out = at[mine]
        keep = got["label"][out] != 0
        if rim_only:
            y, x = np.divmod(out, wide)
            keep &= (y == 1) | (y == tile) | (x == 1) | (x == tile)
        cells, out = np.flatnonzero(mine)[keep], out[keep]
        return pa.table({"tr": np.full(len(out), tr), "tc": np.full(len(out), tc), "r": r[cells], "c": c[cells], "zone": zone[out], **{k: v[out] for k, v in got.items()}})

    return own.groupBy("tr", "tc").applyInArrow(run, f"tr long, tc long, r long, c long, zone long, {STATE}")


def _across(rims: DataFrame, tile: int) -> DataFrame:
    """rims, a row for each tile beside which one stands."""
    sides = F.array(*[F.struct(F.floor((F.col("r") + dr) / tile).alias("tr"), F.floor((F.col("c") + dc) / tile).alias("tc")) for dr, dc in NEAR])
    x = rims.withColumn("_t", F.explode(sides)).where((F.col("_t.tr") != F.col("tr")) | (F.col("_t.tc") != F.col("tc")))
    return x.select(F.col("_t.tr").alias("tr"), F.col("_t.tc").alias("tc"), "r", "c", "zone", "level", "steps", "inner", "label")


def watershed(cells: DataFrame, zone: str | None = None, tile: int = TILE) -> DataFrame:
    """r, c, zone, label of the cells that water reaches from any marker. cells:
    r, c, cost, marker (a number that isn't 0, else 0 or NULL), and perhaps a
    column of whole numbers whose borders water doesn't pass. A NULL cost is the
    highest."""
    workers_see(cells.sparkSession)
    base = cells.select(
        F.floor(F.col("r") / tile).alias("tr"), F.floor(F.col("c") / tile).alias("tc"), F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"),
        F.coalesce(F.col("cost").cast("double"), F.lit(1e9)).alias("cost"), (F.col(zone) if zone else F.lit(0)).cast("long").alias("zone"),
        F.coalesce(F.col("marker").cast("long"), F.lit(0)).alias("marker"),
    )
    base = cut_lineage(base, "basins")
    rims = cut_lineage(_flood(base, None, tile, True), "rims")
    changed = rims
    while True:
        active = cut_lineage(_across(changed, tile).select("tr", "tc").distinct(), "active")
        if not active.limit(1).count():
            break
        beside = _across(rims, tile).join(active, ["tr", "tc"], "left_semi")
        new = cut_lineage(_flood(base.join(active, ["tr", "tc"], "left_semi"), beside, tile, True), "flooded")
        changed = new.join(rims, new.columns, "left_anti")
        rims = cut_lineage(rims.join(active, ["tr", "tc"], "left_anti").unionByName(new), "rims")
        changed = cut_lineage(changed, "changed")
    return _flood(base, _across(rims, tile), tile, False).select("r", "c", "zone", "label")


def _decide(r: np.ndarray, c: np.ndarray, height: np.ndarray, zone: np.ndarray, state: np.ndarray, own: np.ndarray, distance: int) -> np.ndarray:
    """States (0 open, 1 kept, 2 dropped) of own peaks, highest first (ties by
    row and column), as far as those beside allow."""
    out, seen = state.copy(), {}
    for i in np.lexsort((c, r, -height)).tolist():
        a, b, z = int(r[i]), int(c[i]), int(zone[i])
        ka, kb = a // (distance + 1), b // (distance + 1)
        if own[i] and out[i] == 0:
            near = [s for da in (-1, 0, 1) for db in (-1, 0, 1) for p, q, s in seen.get((z, ka + da, kb + db), ()) if max(abs(a - p), abs(b - q)) <= distance]
            out[i] = 2 if 1 in near else 0 if 0 in near else 1
        if out[i] != 2:
            seen.setdefault((z, ka, kb), []).append((a, b, int(out[i])))
    return out


def spaced_peaks(peaks: DataFrame, distance: int, tile: int = TILE) -> DataFrame:
    """Of peaks (r, c, height, zone) those that stay when the highest of all is
    kept, all within the distance (Chebyshev) of it in its zone go, and so on.
    Ties go by row, then column. Tiles decide what doesn't depend on open peaks
    beside them, round by round; the highest open peak is always decided."""
    workers_see(peaks.sparkSession)
    x = peaks.select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.col("height").cast("double").alias("height"), F.col("zone").cast("long").alias("zone"), F.lit(0).alias("state"))
    x, kept = cut_lineage(x, "peaks"), None
    near = lambda axis: F.sequence(F.floor((F.col(axis) - distance) / tile), F.floor((F.col(axis) + distance) / tile))

    def run(key, table):
        tr, tc = (k.as_py() for k in key)
        r, c, h, z, s = (table.column(n).to_numpy() for n in ("r", "c", "height", "zone", "state"))
        own = (r // tile == tr) & (c // tile == tc)
        got = _decide(r, c, h, z, s, own, distance)
        return table.select(["r", "c", "height", "zone"]).append_column("state", pa.array(got.astype(np.int32))).filter(pa.array(own))

    while True:
        spread = x.withColumn("_tr", F.explode(near("r"))).withColumn("_tc", F.explode(near("c")))
        y = cut_lineage(spread.groupBy("_tr", "_tc").applyInArrow(run, "r long, c long, height double, zone long, state int"), "peaks")
        if not y.where("state = 0").limit(1).count():
            return y.where("state = 1").select("r", "c", "height", "zone")
        x = y.where("state < 2")  # kept ones still keep others off
