"""Start-zone segmentation: markers, a weighted cost surface, and watersheds,
then zones cut at benches, the treeline and a size. Flooding and the spacing of
markers go tile by tile (operators/watershed.py), what is known of a zone is
aggregated: neither a mask's component nor a zone is one task."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firnline.grid import GridSpec, cut_lineage, workers_see
from firnline.operators.distance import distance_to
from firnline.operators.focal import curvature, local_maxima, opened_and_closed
from firnline.operators.regions import merge_small, uncovered
from firnline.operators.tiles import tile_kernel
from firnline.operators.watershed import spaced_peaks, watershed
from firnline.operators.zonal import dips, group_quantile, normalised


@dataclass(frozen=True)
class SegmentParams:
    min_distance: int = 2
    maxima_distance: int = 2
    scale: float = 1.0
    merge_m2: float = 5000.0
    max_m2: float = 250000.0
    pra_weight: float = 5.0
    curvature_weight: float = 2.5
    aspect_weight: float = 1.0
    elevation_weight: float = 1.0
    opening: int = 1
    closing: int = 1
    high: float = 0.40
    enforce_cap: bool = False
    trigger: str = "both"  # what splits a zone: size, terrain, both or none
    prominence: float = 1.5
    least_m2: float = 20000.0
    use_treeline: bool = True
    bin_m: float = 30.0
    ridge: float = 3.0


def thin_peaks(r: np.ndarray, c: np.ndarray, height: np.ndarray, distance: int) -> np.ndarray:
    """Places of peaks no two of which are within the distance (Chebyshev): the
    highest first, ties by row and column."""
    kept, taken = [], set()
    for i in np.lexsort((c, r, -height)):
        cell = (r[i] // (distance + 1), c[i] // (distance + 1))
        near = ((cell[0] + a, cell[1] + b) for a in (-1, 0, 1) for b in (-1, 0, 1))
        if all(max(abs(r[i] - p), abs(c[i] - q)) > distance for k in near for p, q in (x[1] for x in taken if x[0] == k)):
            kept.append(i)
            taken.add((cell, (r[i], c[i])))
    return np.array(sorted(kept), dtype=np.int64)


def flood(r: np.ndarray, c: np.ndarray, cost: np.ndarray, marker: np.ndarray) -> np.ndarray:
    """Marker-controlled watershed over 4-neighbours of a few cells in memory:
    cells are taken in order of cost, then of when they were reached. Returns
    marker numbers; cells that no marker reaches keep 0. Where no two costs are
    equal, `watershed` gives the same for any number of cells."""
    place = {(a, b): i for i, (a, b) in enumerate(zip(r.tolist(), c.tolist(), strict=True))}
    out, heap, age = marker.copy(), [], 0
    for i in np.flatnonzero(marker):
        heap.append((cost[i], age, i))
        age += 1
    heapq.heapify(heap)
    while heap:
        _, _, i = heapq.heappop(heap)
        for dr, dc in ((-1, 0), (0, -1), (0, 1), (1, 0)):
            j = place.get((r[i] + dr, c[i] + dc))
            if j is not None and not out[j]:
                out[j] = out[i]
                heapq.heappush(heap, (cost[j], age, j))
                age += 1
    return out


def cost_surface(cells: DataFrame, p: SegmentParams) -> DataFrame:
    """pra_norm, cost and the gradients they come from."""
    x = curvature(cells)
    x = normalised(x, ["curvature", "z"])
    top = x.agg(F.max("pra").alias("_top"))
    x = x.crossJoin(F.broadcast(top)).withColumn("pra_norm", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("pra") / F.greatest("_top", F.lit(1e-12)) * p.scale)))
    cost = (
        (1.0 - F.col("pra_norm")) * p.pra_weight
        + F.abs("curvature_norm") * p.curvature_weight
        + F.abs(F.sin(F.radians("math_aspect"))) * p.aspect_weight
        + F.col("z_norm") * p.elevation_weight
    )
    return x.withColumn("cost", cost).drop("_top", "curvature_norm", "z_norm")


def segment(cells: DataFrame, spec: GridSpec, p: SegmentParams | None = None, merge: bool = True) -> DataFrame:
    """r, c, label of start zones. cells: z, pra, mask (0/1)."""
    p = p or SegmentParams()
    kept = [b for b in ("z", "pra", "slope", "treeline") if b in cells.columns]
    x = cells.select("r", "c", *kept, F.coalesce(F.col("mask"), F.lit(0)).alias("mask"))
    if p.opening or p.closing:
        x = opened_and_closed(x, spec, "mask", p.opening, p.closing)
    cells = cut_lineage(x, "masked")  # read again where zones are split
    x = cost_surface(cells.select("r", "c", "z", "pra", "mask"), p)
    high = (F.col("pra_norm") > p.high) & (F.col("mask") == 1)
    x = distance_to(x, spec, ~high, "_edt").withColumns({"_edt": F.when(high, F.coalesce("_edt", F.lit(1e6))).otherwise(0.0), "_bend": F.when(F.col("mask") == 1, F.abs("curvature")).otherwise(0.0)})
    x = local_maxima(x, spec, {"_peak": ("_edt", p.maxima_distance), "_crest": ("_bend", p.min_distance)})
    x = cut_lineage(x.where("mask = 1").select("r", "c", "cost", "_edt", "_bend", "_peak", "_crest"), "segment")
    marks = None
    for flag, height, d in (("_peak", "_edt", p.maxima_distance), ("_crest", "_bend", p.min_distance)):
        peaks = x.where(flag).select("r", "c", F.col(height).alias("height"), F.lit(0).alias("zone"))
        found = spaced_peaks(peaks, d).select("r", "c")
        marks = found if marks is None else marks.union(found)
    number = F.col("r") * spec.width + F.col("c") + 1
    marked = x.select("r", "c", "cost").join(marks.distinct().withColumn("_m", F.lit(True)), ["r", "c"], "left")
    got = watershed(marked.withColumn("marker", F.when(F.col("_m"), number)))
    zones = cut_lineage(got.select("r", "c", (F.col("label") - 1).alias("label")), "zones")
    zones = zones.unionByName(uncovered(x, zones, spec))
    if p.trigger != "none" and "slope" in cells.columns:
        treeline = ["treeline"] if "treeline" in cells.columns else []
        bands = cells.select("r", "c", "z", "pra", "slope", *treeline).join(x.select("r", "c", "cost"), ["r", "c"])
        zones = cut_lineage(subdivide(zones, bands, spec, p), "subdivided")
    if not merge:
        return zones
    merged = merge_small(zones, spec, p.merge_m2, p.max_m2 if p.enforce_cap else None)
    return zones.join(merged, "label").select("r", "c", F.col("merged").alias("label"))


def split_elevations(z: np.ndarray, slope: np.ndarray, treeline: float | None, p: SegmentParams, ends: tuple[float, float] | None = None) -> np.ndarray:
    """Where a zone's slope profile has benches, and the treeline if it runs
    through the zone; the lowest first, none within a bin of the one before.
    z, slope: of cells, or means of bins between the zone's `ends`."""
    (lo, hi), found = ends or (float(z.min()), float(z.max())), []
    if hi - lo > 3 * p.bin_m:
        edges = np.arange(lo, hi + p.bin_m, p.bin_m)
        k = np.clip(np.digitize(z, edges) - 1, 0, len(edges) - 2)
        ok = np.isfinite(slope)
        n = np.bincount(k[ok], minlength=len(edges) - 1)
        profile = np.where(n > 0, np.bincount(k[ok], slope[ok], len(edges) - 1) / np.maximum(n, 1), np.nan)
        mean = np.nanmean(profile) if (n > 0).any() else 0.0
        found = [(edges[i] + edges[i + 1]) / 2 for i in dips(np.where(np.isnan(profile), mean, profile), p.prominence)]
    if treeline is not None and np.isfinite(treeline) and lo + p.bin_m < treeline < hi - p.bin_m:
        found.append(treeline)
    out: list[float] = []
    for e in sorted(found):
        if not out or e - out[-1] > p.bin_m:
            out.append(float(e))
    return np.array(out)


def _split_elevations_of(x: DataFrame, p: SegmentParams, treeline: bool) -> DataFrame:
    """A row per label: cells, ends of elevation and cost, and `at`, the
    elevations at which to split."""
    known = F.when(~F.isnan("cost"), F.col("cost"))
    stats = x.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("z").alias("lo"), F.max("z").alias("hi"), F.min(known).alias("low"), F.max(known).alias("high"))
    stats = cut_lineage(stats, "stats")
    slope = F.when(~F.isnan("slope"), F.col("slope"))
    profile = x.join(stats, "label").groupBy("label", F.floor((F.col("z") - F.col("lo")) / p.bin_m).alias("bin")).agg(F.avg(slope).alias("m"))
    rows = profile.join(stats.select("label", "lo", "hi"), "label")
    if treeline:
        rows = rows.join(group_quantile(x.where("treeline is not null"), ["label"], "treeline", 0.5, "line"), "label", "left")
    else:
        rows = rows.withColumn("line", F.lit(None).cast("double"))

    def find(pdf: pd.DataFrame) -> pd.DataFrame:  # as many rows as the zone has bins of elevation
        lo, hi, line = float(pdf.lo.iloc[0]), float(pdf.hi.iloc[0]), pdf.line.iloc[0]
        z = np.minimum(lo + (pdf.bin.to_numpy(dtype=float) + 0.5) * p.bin_m, hi)
        at = split_elevations(z, pdf.m.to_numpy(dtype=float), None if pd.isna(line) else float(line), p, (lo, hi))
        return pd.DataFrame({"label": [pdf.label.iloc[0]], "at": [at]})

    # A zone is little to read, but long to run: as many tasks as the setting says.
    rows = rows.where("lo is not null").repartition(int(x.sparkSession.conf.get("spark.sql.shuffle.partitions")), "label")
    at = rows.groupBy("label").applyInPandas(find, "label long, at array<double>")
    return stats.join(at, "label", "left").withColumn("at", F.coalesce("at", F.array().cast("array<double>")))


def zone_cost(p: SegmentParams) -> Column:
    """The terrain's cost, 0 to 1 within the zone (low to high), and a ridge at
    each split elevation: borders go there, and bend with the terrain."""
    base = F.when(F.col("cost").isNull() | F.isnan("cost"), 1.0).otherwise((F.col("cost") - F.col("low")) / (F.col("high") - F.col("low") + 1e-9))
    return F.aggregate("at", base, lambda s, e: s + p.ridge * F.exp(-0.5 * F.pow((F.col("z") - e) / (1.3 * p.bin_m), F.lit(2))))


def stratified(x: DataFrame, p: SegmentParams) -> DataFrame:
    """r, c, label, part by flooding out of the strata between split elevations
    (`at`), of labels with at least two strata."""
    near = F.exists("at", lambda e: F.abs(F.col("z") - e) < 1.3 * p.bin_m)
    stratum = F.size(F.filter("at", lambda e: e <= F.col("z"))) + 1
    marked = cut_lineage(x.withColumn("marker", F.when(~near, stratum)), "strata")
    several = marked.groupBy("label").agg(F.min("marker").alias("_a"), F.max("marker").alias("_b")).where("_a < _b").select("label")
    got = watershed(marked.join(several, "label", "left_semi"), "label")
    return got.select("r", "c", F.col("zone").alias("label"), F.col("label").alias("part"))


def _zone_peaks(x: DataFrame, spec: GridSpec, step: int) -> DataFrame:
    """r, c, height, zone of cells that no cell of their zone within step
    (Chebyshev) exceeds in `pra`."""

    def kernel(arrays, first, size):
        out = np.zeros(arrays["pra"].shape)
        for z in np.unique(arrays["_z"][~np.isnan(arrays["_z"])]):
            rows, cols = np.nonzero(arrays["_z"] == z)
            box = np.s_[rows.min() : rows.max() + 1, cols.min() : cols.max() + 1]
            own = np.where(arrays["_z"][box] == z, np.nan_to_num(arrays["pra"][box]), -np.inf)
            top = own
            for axis in (0, 1):
                wide = np.pad(top, [(step, step) if k == axis else (0, 0) for k in (0, 1)], constant_values=-np.inf)
                top = np.lib.stride_tricks.sliding_window_view(wide, 2 * step + 1, axis=axis).max(axis=-1)
            out[box] = np.maximum(out[box], (own == top) & (own > -np.inf))
        return [out]

    y = x.select("r", "c", F.coalesce(F.col("pra").cast("double"), F.lit(0.0)).alias("pra"), F.col("label").cast("double").alias("_z"))
    return tile_kernel(y, spec, step, ["pra", "_z"], ["_top"], kernel).where("_top = 1").select("r", "c", F.col("pra").alias("height"), F.col("_z").cast("long").alias("zone"))


def _far(points: DataFrame, peaks: DataFrame, step: int) -> DataFrame:
    """Points (r, c, zone) further than step from all peaks of their zone."""
    cell = lambda a, d=0: F.floor(F.col(a) / step) + d
    near = F.explode(F.array(*[F.struct(cell("r", a).alias("a"), cell("c", b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    around = peaks.select(F.col("zone"), F.col("r").alias("_pr"), F.col("c").alias("_pc"), near.alias("_k")).select("zone", "_pr", "_pc", F.col("_k.a").alias("_a"), F.col("_k.b").alias("_b"))
    d2 = (F.col("r") - F.col("_pr")) * (F.col("r") - F.col("_pr")) + (F.col("c") - F.col("_pc")) * (F.col("c") - F.col("_pc"))
    y = points.withColumns({"_a": cell("r"), "_b": cell("c")}).alias("y")
    beside = (F.col("y.zone") == F.col("k.zone")) & (F.col("y._a") == F.col("k._a")) & (F.col("y._b") == F.col("k._b")) & (d2 <= step * step)
    return y.join(around.alias("k"), beside, "left_anti").select("r", "c", "zone")


def densified(x: DataFrame, spec: GridSpec, cap_cells: float) -> DataFrame:
    """r, c, label, part such that, if spacing allows, no part has more cells
    than the cap: flooding from release-area peaks and, away from them, grid
    points, closer and closer for the zones that still have a larger part."""
    x = cut_lineage(x, "dense")
    step0, out = max(2, int(np.sqrt(max(cap_cells, 1.0)))), None
    number = F.col("r") * spec.width + F.col("c") + 1
    ends = x.groupBy("label").agg(F.min("r").alias("_r"), F.min("c").alias("_c"))

    def lattice(step: int) -> DataFrame:
        y = x.join(ends, "label")
        return y.where(((F.col("r") - F.col("_r")) % step == 0) & ((F.col("c") - F.col("_c")) % step == 0)).select("r", "c", F.col("label").alias("zone"))

    shrinks = (1.0, 0.7, 0.5, 0.35, 0.25)
    for k, shrink in enumerate(shrinks):
        step = max(2, int(step0 * shrink))
        peaks = cut_lineage(spaced_peaks(_zone_peaks(x, spec, step), step).select("r", "c", "zone"), "peaks")
        marks = cut_lineage(peaks.unionByName(_far(lattice(step), peaks, step)), "marks")
        single = x.select(F.col("label").alias("zone")).distinct().join(marks.groupBy("zone").count().where("count > 1"), "zone", "left_anti")
        marks = marks.unionByName(lattice(max(2, step // 2)).join(single, "zone", "left_semi")).distinct()
        marked = x.join(marks.select("r", "c", F.lit(True).alias("_m")), ["r", "c"], "left").withColumn("marker", F.when(F.col("_m"), number))
        got = cut_lineage(watershed(marked, "label").select("r", "c", F.col("zone").alias("label"), F.col("label").alias("part")), "parts")
        over = got.groupBy("label", "part").count().where(F.col("count") > cap_cells).select("label").distinct()
        last = k == len(shrinks) - 1
        over = cut_lineage(over, "over") if not last else over.limit(0)
        good = got.join(over, "label", "left_anti")
        out = good if out is None else out.unionByName(good)
        if last or not over.limit(1).count():
            return out
        x = cut_lineage(x.join(over, "label", "left_semi"), "dense")
        ends = ends.join(over, "label", "left_semi")


def subdivide(zones: DataFrame, cells: DataFrame, spec: GridSpec, p: SegmentParams) -> DataFrame:
    """Split zones: those above the size (trigger size or both), and those of
    least_m2 or more that a bench or the treeline crosses (terrain or both), at
    these elevations; with the cap enforced, zones above it until no part is.
    cells: z, pra, slope, cost, perhaps treeline."""
    workers_see(cells.sparkSession)
    zones = zones.select("r", "c", F.col("label").cast("long").alias("label"))
    x = cut_lineage(zones.join(cells, ["r", "c"]), "bands")
    area = F.col("n") * spec.cell_area
    big = (area > p.max_m2) if p.max_m2 > 0 else F.lit(False)
    wanted = F.lit(False)
    if p.trigger in ("size", "both"):
        wanted = wanted | big
    if p.trigger in ("terrain", "both"):
        wanted = wanted | (area >= p.least_m2) & (F.size("at") > 0)
    about = _split_elevations_of(x, p, "treeline" in cells.columns and p.use_treeline)
    about = cut_lineage(about.where(wanted).withColumn("dense", F.lit(p.enforce_cap) & big).where("dense or size(at) > 0"), "splits")
    y = cut_lineage(x.join(about, "label").withColumn("cost", zone_cost(p)).select("r", "c", "label", "z", "pra", "cost", "at", "dense"), "costs")
    parts = stratified(y.where("not dense"), p)
    if p.enforce_cap:
        parts = parts.unionByName(densified(y.where("dense").drop("at"), spec, p.max_m2 / spec.cell_area))
    parts = cut_lineage(parts, "cut")
    # The first part keeps the label; the others' come after all, by their first cell.
    names = parts.groupBy("label", "part").agg(F.min(F.col("r") * spec.width + F.col("c")).alias("_cell"))
    first = names.groupBy("label").agg(F.min("part").alias("_first"))
    names = names.join(first, "label").where("part > _first").drop("_first")
    top = zones.agg(F.max("label").alias("_top"))  # one row
    moved = parts.join(names, ["label", "part"]).crossJoin(F.broadcast(top)).select("r", "c", (F.col("_top") + F.col("_cell") + 1).alias("_new"))
    return zones.join(moved, ["r", "c"], "left").select("r", "c", F.coalesce("_new", "label").alias("label"))


def grid_markers(zones: DataFrame, step: int) -> DataFrame:
    """Every step-th row and column of each label, from its bounding box's
    corner."""
    ends = zones.groupBy("label").agg(F.min("r").alias("_r"), F.min("c").alias("_c"))
    x = zones.join(ends, "label")
    return x.where((F.pmod(F.col("r") - F.col("_r"), F.lit(step)) == 0) & (F.pmod(F.col("c") - F.col("_c"), F.lit(step)) == 0)).select("r", "c", "label")
