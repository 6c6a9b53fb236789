"""Neighbourhood operators over cell tables.

3x3 operators read all eight neighbours in one window pass along columns, to
which each cell also sends its value to the columns beside it: one shuffle.
Wider neighbourhoods (box means, wind shelter, maxima) are read by tile
kernels: one shuffle for any width and number of bands.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firnline.grid import GridSpec
from firnline.operators.tiles import box_sums, quantile, tile_kernel


def rows():
    return Window.partitionBy("r").orderBy("c")


def columns():
    return Window.partitionBy("c").orderBy("r")


def _step(band: str, axis: str, k: int) -> Column:
    """The band k cells further along an axis; NULL where no such cell is."""
    w = rows() if axis == "c" else columns()
    return F.when(F.lead(axis, k).over(w) == F.col(axis) + k, F.lead(band, k).over(w)) if k > 0 else F.when(
        F.lag(axis, -k).over(w) == F.col(axis) + k, F.lag(band, -k).over(w)
    )


#: Neighbours: steps to them down and to the right.
STEPS = {"nw": (-1, -1), "n": (-1, 0), "ne": (-1, 1), "w": (0, -1), "e": (0, 1), "sw": (1, -1), "s": (1, 0), "se": (1, 1)}


def neighbours(cells: DataFrame, band: str = "z") -> DataFrame:
    """Adds nw, n, ne, w, e, sw, s, se of a band; NULL where there is no cell."""
    side = F.col("_side")  # how far to the left of this column a value's cell is
    x = cells.withColumn("_side", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))))
    own = [F.when(side == 0, F.col(c)).alias(c) for c in cells.columns if c not in ("r", "c", band)]
    x = x.select("r", (F.col("c") - side).alias("c"), band, "_side", *own)
    at = Window.partitionBy("c").orderBy("r")
    around = {n: F.max(F.when(side == dc, F.col(band))).over(at.rangeBetween(dr, dr)) for n, (dr, dc) in STEPS.items()}
    return x.withColumns(around).where(side == 0).select(*cells.columns, *STEPS)


AROUND = tuple(STEPS)


def horn(cell: float) -> tuple[Column, Column]:
    """dz/dx (east) and dz/dy (south) from neighbour columns."""
    x = lambda n: F.col(n)
    gx = ((x("ne") + 2.0 * x("e") + x("se")) - (x("nw") + 2.0 * x("w") + x("sw"))) / F.lit(8.0 * cell)
    gy = ((x("sw") + 2.0 * x("s") + x("se")) - (x("nw") + 2.0 * x("n") + x("ne"))) / F.lit(8.0 * cell)
    return gx, gy


def filled_edges(cells: DataFrame, band: str = "z") -> DataFrame:
    """Neighbour columns where a missing neighbour is continued linearly from
    the opposite one through the centre (else the centre's own value)."""
    x = neighbours(cells, band)
    pairs = {"n": "s", "s": "n", "w": "e", "e": "w", "nw": "se", "se": "nw", "ne": "sw", "sw": "ne"}
    z = F.col(band)
    return x.withColumns({a: F.coalesce(F.col(a), 2.0 * z - F.col(b), z) for a, b in pairs.items()})


def slope(cells: DataFrame, spec: GridSpec, band: str = "z", edges: bool = False, out: str = "slope") -> DataFrame:
    """Degrees, by 3x3 differences. Without edges, NULL next to a missing cell."""
    x = filled_edges(cells, band) if edges else neighbours(cells, band)
    gx, gy = horn(spec.cell)
    value = F.degrees(F.atan(F.sqrt(gx * gx + gy * gy)))
    return x.withColumn(out, F.when(F.col(band).isNotNull(), value)).drop(*AROUND)


def whole_slope(cells: DataFrame, spec: GridSpec, band: str = "z", out: str = "slope") -> DataFrame:
    """Slope cut to whole degrees, and `valid`: all neighbours were there."""
    x = slope(cells, spec, band, out=out)
    return x.withColumn("valid", F.col(out).isNotNull()).withColumn(out, F.col(out).cast("smallint"))


def aspect(cells: DataFrame, spec: GridSpec, band: str = "z", out: str = "aspect") -> DataFrame:
    """Compass degrees of the downhill direction; NULL on flat ground."""
    gx, gy = horn(spec.cell)
    value = F.pmod(F.degrees(F.atan2(-gx, gy)), F.lit(360.0))
    return neighbours(cells, band).withColumn(out, F.when((gx != 0) | (gy != 0), value)).drop(*AROUND)


def gradient(cells: DataFrame, band: str, axis: str, out: str) -> DataFrame:
    """Central differences per cell step, one-sided at the ends."""
    a, b, z = _step(band, axis, -1), _step(band, axis, 1), F.col(band)
    return cells.withColumn(out, F.coalesce((b - a) / 2.0, b - z, z - a))


def curvature(cells: DataFrame, band: str = "z", most: float = 5.0) -> DataFrame:
    """math_aspect (0 = +x, uphill) and profile curvature cut to +-most, from
    per-cell gradients (unit spacing)."""
    x = gradient(gradient(cells, band, "r", "dy"), band, "c", "dx")
    x = gradient(gradient(gradient(x, "dx", "c", "dxx"), "dy", "r", "dyy"), "dx", "r", "dxy")
    dx, dy = F.col("dx"), F.col("dy")
    top = F.col("dxx") * dy * dy - 2.0 * F.col("dxy") * dx * dy + F.col("dyy") * dx * dx
    k = -top / F.pow(dx * dx + dy * dy + 1e-8, F.lit(1.5))
    return x.withColumns(
        {"math_aspect": F.pmod(F.degrees(F.atan2(-dy, dx)), F.lit(360.0)), "curvature": F.greatest(F.lit(-most), F.least(F.lit(most), k))}
    ).drop("dx", "dy", "dxx", "dyy", "dxy")


def ruggedness(cells: DataFrame, slope_band: str = "slope", aspect_band: str = "aspect", out: str = "ruggedness") -> DataFrame:
    """1 - |sum of the unit normals of 3x3 cells| / 9; 0 at the border."""
    s, a = F.radians(slope_band), F.radians(F.coalesce(aspect_band, F.lit(0.0)))
    parts = {"_x": F.sin(s) * F.sin(a), "_y": F.sin(s) * F.cos(a), "_z": F.cos(s)}
    x = cells.withColumns(parts)
    for w, axis in ((rows(), "c"), (columns(), "r")):
        near = w.rangeBetween(-1, 1)
        n = F.count("_x") if axis == "c" else F.sum("_nc")
        x = x.withColumns({p: F.sum(p).over(near) for p in parts} | {f"_n{axis}": n.over(near)})
    norm = F.sqrt(F.col("_x") * F.col("_x") + F.col("_y") * F.col("_y") + F.col("_z") * F.col("_z"))
    return x.withColumn(out, F.when(F.col("_nr") == 9, 1.0 - norm / 9.0).otherwise(0.0)).drop(*parts, "_nc", "_nr")


def box_width(metres: float, cell: float) -> int:
    return max(3, int(metres / cell + 0.5) | 1)


def box_means(cells: DataFrame, spec: GridSpec, bands: dict[str, tuple[str, int, str]]) -> DataFrame:
    """Means over width x width cells, missing ones counted as 0, of several
    bands in one pass. bands: name of the mean -> (band, width, edge). edge:
    `reflect` mirrors the grid at its border, `nearest` repeats the border."""
    halo = max(w // 2 for _, w, _ in bands.values())

    def kernel(arrays, first, size):
        out = []
        for band, width, edge in bands.values():
            a, k = np.nan_to_num(arrays[band]), width // 2
            # Where the window ends short of the grid's border, what is missing isn't needed.
            pad = [(k, k), (k, k)]
            whole = np.pad(a, pad, mode="symmetric" if edge == "reflect" else "edge")
            for axis in (0, 1):
                at_start, at_end = first[axis] == 0, first[axis] + a.shape[axis] == size[axis]
                cut = [slice(None), slice(None)]
                for there, part in ((at_start, slice(0, k)), (at_end, slice(whole.shape[axis] - k, None))):
                    if not there:
                        cut[axis] = part
                        whole[tuple(cut)] = 0.0
            out.append(box_sums(whole, k) / float(width * width))
        return out

    return tile_kernel(cells, spec, halo, sorted({b for b, _, _ in bands.values()}), list(bands), kernel)


def box_mean(cells: DataFrame, spec: GridSpec, band: str, width: int, edge: str = "reflect", out: str | None = None) -> DataFrame:
    """One band's `box_means`."""
    return box_means(cells, spec, {out or f"{band}_mean": (band, width, edge)})


def smooth_2x2(cells: DataFrame, band: str, out: str) -> DataFrame:
    """Mean of the valid ones of a cell, its right, lower and lower right
    neighbours; NULL stays NULL."""
    x = neighbours(cells, band)
    parts = [F.col(p) for p in (band, "e", "s", "se")]
    total = sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0))
    n = sum((p.isNotNull().cast("int") for p in parts), F.lit(0))
    return x.withColumn(out, F.when(F.col(band).isNotNull(), total / n)).drop(*AROUND)


def _morph(cells: DataFrame, band: str, grow: bool) -> DataFrame:
    x = cells.withColumns({f"_{i}": F.coalesce(_step(band, a, k), F.lit(0)) for i, (a, k) in enumerate((("c", -1), ("c", 1), ("r", -1), ("r", 1)))})
    pick = F.greatest if grow else F.least
    return x.withColumn(band, pick(F.col(band), *[F.col(f"_{i}") for i in range(4)])).drop("_0", "_1", "_2", "_3")


def opening(cells: DataFrame, band: str, iterations: int = 1) -> DataFrame:
    """Erosions, then dilations, of a 0/1 band by a cross; outside is 0."""
    for grow in [False] * iterations + [True] * iterations:
        cells = _morph(cells, band, grow)
    return cells


def closing(cells: DataFrame, band: str, iterations: int = 1) -> DataFrame:
    for grow in [True] * iterations + [False] * iterations:
        cells = _morph(cells, band, grow)
    return cells


def opened_and_closed(cells: DataFrame, spec: GridSpec, band: str, opening: int = 1, closing: int = 1) -> DataFrame:
    """The same as opening, then closing, of a whole 0/1 band without NULL, in
    one tile kernel: one shuffle instead of two for each step."""
    steps = [False] * opening + [True] * (opening + closing) + [False] * closing

    def kernel(arrays, first, size):
        there = ~np.isnan(arrays[band])
        m = np.where(there, arrays[band], 0.0)
        for grow in steps:
            w = np.pad(m, 1)
            m = (np.maximum if grow else np.minimum).reduce([m, w[:-2, 1:-1], w[2:, 1:-1], w[1:-1, :-2], w[1:-1, 2:]]) * there
        return [m]

    x = tile_kernel(cells, spec, len(steps), [band], ["_morphed"], kernel)
    return x.withColumn(band, F.col("_morphed").cast(cells.schema[band].dataType)).drop("_morphed")


def sector_offsets(radius: int, direction: float = 0.0, tolerance: float = 180.0) -> list[tuple[int, int, float]]:
    """(dr, dc, distance in cells) of a disc's cells within an angular sector."""
    lo, hi = math.radians(direction - tolerance + 270.0), math.radians(direction + tolerance + 270.0)
    span = (hi - lo) % (2 * math.pi)
    span = 2 * math.pi if span == 0 and tolerance > 0 else span
    out = []
    for dr in range(-radius, radius + 1):
        for dc in range(-radius, radius + 1):
            d = math.hypot(dr, dc)
            if 0 < d <= radius and (math.atan2(dr, dc) - lo) % (2 * math.pi) <= span + 1e-12:
                out.append((dr, dc, d))
    return out


def wind_shelter(cells: DataFrame, spec: GridSpec, band: str = "z", direction: float = 0.0, tolerance: float = 180.0, probability: float = 0.5, radius_m: float = 60.0, out: str = "windshelter", radius: int = 0) -> DataFrame:
    """A quantile of atan(rise / distance) over a cell's sector. Neighbours that
    are missing or exactly 0 don't count; none left: 0; the frame as wide as
    the radius is NULL. radius: in cells; 0 takes it from radius_m."""
    radius = radius or max(2, round(radius_m / spec.cell))
    offsets, cell = sector_offsets(radius, direction, tolerance), spec.cell

    def kernel(arrays, first, size):
        z = arrays[band]
        n, m = (max(0, k - 2 * radius) for k in z.shape)
        out = np.full(z.shape, np.nan)
        if n and m:
            seen = np.where(z == 0, np.nan, z)
            mid = z[radius : radius + n, radius : radius + m]
            stack = np.array([np.arctan((seen[radius + dr : radius + dr + n, radius + dc : radius + dc + m] - mid) / (d * cell)) for dr, dc, d in offsets])
            out[radius : radius + n, radius : radius + m] = np.nan_to_num(quantile(stack, probability))
        return [out]

    return tile_kernel(cells, spec, radius, [band], [out], kernel)


def local_maxima(cells: DataFrame, spec: GridSpec, bands: dict[str, tuple[str, int]], least: float = 0.0) -> DataFrame:
    """Cells that equal the maximum of their (2d+1)^2 window and exceed `least`.
    bands: name of the flag -> (band, d)."""
    halo = max(d for _, d in bands.values())

    def kernel(arrays, first, size):
        out = []
        for band, d in bands.values():
            top = np.where(np.isnan(arrays[band]), -np.inf, arrays[band])
            for axis in (0, 1):
                wide = np.pad(top, [(d, d) if k == axis else (0, 0) for k in (0, 1)], constant_values=-np.inf)
                top = np.lib.stride_tricks.sliding_window_view(wide, 2 * d + 1, axis=axis).max(axis=-1)
            out.append(((arrays[band] == top) & (arrays[band] > least)).astype(float))
        return out

    x = tile_kernel(cells, spec, halo, sorted({b for b, _ in bands.values()}), list(bands), kernel)
    return x.withColumns({o: F.col(o) > 0 for o in bands})
