"""Bringing rasters onto one grid, and overviews."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firnline.grid import TILE, GridSpec, cut_lineage, workers_see
from firnline.operators.project import between
from firnline.sources.vectors import burn


Map = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def source_places(target: GridSpec, source: GridSpec, move: Map, rows: tuple[int, int], cols: tuple[int, int], error: float) -> tuple[np.ndarray, np.ndarray]:
    """Fractional source rows and columns of the centres of target cells rows x
    cols (from, to). The projection is computed on a coarse lattice of them and
    interpolated; the lattice gets denser until in its middles it is off by less
    than `error` of a source cell."""

    def exact(r, c):
        x, y = move(target.x0 + (c + 0.5) * target.cell, target.y0 - (r + 0.5) * target.cell)
        return (source.y0 - y) / source.cell - 0.5, (x - source.x0) / source.cell - 0.5

    r, c = np.arange(*rows, dtype=float), np.arange(*cols, dtype=float)
    step = 32
    while step > 1:
        lr, lc = (np.append(np.arange(a, b - 1, step, dtype=float), float(b - 1)) for a, b in (rows, cols))
        at = exact(*np.meshgrid(lr, lc, indexing="ij"))
        mr, mc = ((v[1:] + v[:-1]) / 2 if len(v) > 1 else v for v in (lr, lc))
        off = max(np.abs(_between(g, lr, lc, mr, mc) - e).max() for g, e in zip(at, exact(*np.meshgrid(mr, mc, indexing="ij")), strict=True))
        if off < error:
            return tuple(_between(g, lr, lc, r, c) for g in at)
        step //= 2
    return exact(*np.meshgrid(r, c, indexing="ij"))


def _between(grid: np.ndarray, lr: np.ndarray, lc: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Bilinear values at rows r and columns c of a lattice at lr and lc."""

    def weights(at, v):
        k = np.clip(np.searchsorted(at, v, side="right") - 1, 0, max(len(at) - 2, 0))
        nxt = np.minimum(k + 1, len(at) - 1)
        return k, nxt, (v - at[k]) / np.where(nxt > k, at[nxt] - at[k], 1.0)

    i, i2, u = weights(lr, r)
    j, j2, w = weights(lc, c)
    u, w = u[:, None], w[None]
    return (1 - u) * ((1 - w) * grid[np.ix_(i, j)] + w * grid[np.ix_(i, j2)]) + u * ((1 - w) * grid[np.ix_(i2, j)] + w * grid[np.ix_(i2, j2)])


def _sample(values: np.ndarray, first: tuple[int, int], fr: np.ndarray, fc: np.ndarray, how: str) -> np.ndarray:
    """Values (NaN: none) of a window that begins at `first` at places fr, fc."""

    def at(r, c):
        r, c = r.astype(np.int64) - first[0], c.astype(np.int64) - first[1]
        ok = (r >= 0) & (c >= 0) & (r < values.shape[0]) & (c < values.shape[1])
        return np.where(ok, values[np.where(ok, r, 0), np.where(ok, c, 0)], np.nan)

    if how == "nearest":
        return at(np.floor(fr + 0.5), np.floor(fc + 0.5))
    r0, c0 = np.floor(fr), np.floor(fc)
    total, weight = np.zeros(fr.shape), np.zeros(fr.shape)
    for i in (0, 1):
        for j in (0, 1):
            w = np.where(i, fr - r0, 1 - (fr - r0)) * np.where(j, fc - c0, 1 - (fc - c0))
            v = at(r0 + i, c0 + j)
            w = np.where(np.isnan(v), 0.0, w)
            total, weight = total + w * np.nan_to_num(v), weight + w
    return np.where(weight > 0, total / np.where(weight > 0, weight, 1.0), np.nan)


def align(cells: DataFrame, source: GridSpec, target: GridSpec, band: str, how: str = "bilinear", fill: float | None = None, error: float = 0.01, tile: int = TILE) -> DataFrame:
    """The band on the target grid, which may be of another reference system.
    Nearest takes the cell that holds a target's centre; bilinear weighs the
    four around it, over those that have a value. Uncovered cells get `fill`.

    Target tiles say which window of the source they need; source cells go to
    the tiles whose window holds them, in one shuffle."""
    spark = cells.sparkSession
    workers_see(spark)
    move = between(target.crs, source.crs)
    across = -(-target.width // tile)

    def extent(tr: int, tc: int) -> tuple[tuple[int, int], tuple[int, int]]:
        return (tr * tile, min(target.height, (tr + 1) * tile)), (tc * tile, min(target.width, (tc + 1) * tile))

    def windows(batches):
        for b in batches:
            out = []
            for k in b.column(0).to_pylist():
                tr, tc = divmod(k, across)
                fr, fc = source_places(target, source, move, *extent(tr, tc), error)
                box = [f(g[np.isfinite(g)]) if np.isfinite(g).any() else -9 for g in (fr, fc) for f in (np.min, np.max)]
                out.append((tr, tc, int(np.floor(box[0])) - 1, int(np.ceil(box[1])) + 1, int(np.floor(box[2])) - 1, int(np.ceil(box[3])) + 1))
            yield pa.RecordBatch.from_arrays([pa.array([q[i] for q in out], pa.int64()) for i in range(6)], names=["tr", "tc", "r0", "r1", "c0", "c1"])

    tiles = spark.range(across * -(-target.height // tile)).mapInArrow(windows, "tr long, tc long, r0 long, r1 long, c0 long, c1 long")
    held = tiles.where(F.expr(f"r1 >= 0 and c1 >= 0 and r0 < {source.height} and c0 < {source.width}"))
    held = held.withColumn("_sr", F.explode(F.expr(f"sequence(greatest(r0, 0) div {tile}, least(r1, {source.height - 1}) div {tile})")))
    held = held.withColumn("_sc", F.explode(F.expr(f"sequence(greatest(c0, 0) div {tile}, least(c1, {source.width - 1}) div {tile})")))
    values = cells.select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.col(band).cast("double").alias("v")).where("v is not null")
    x = values.withColumns({"_sr": F.floor(F.col("r") / tile), "_sc": F.floor(F.col("c") / tile)}).join(held, ["_sr", "_sc"])
    x = x.where("r between r0 and r1 and c between c0 and c1").select("tr", "tc", "r", "c", "v")
    every = tiles.select("tr", "tc", *[F.lit(None).cast(k).alias(n) for n, k in (("r", "long"), ("c", "long"), ("v", "double"))])  # tiles without a source, too

    def run(key, table):
        tr, tc = (k.as_py() for k in key)
        rows, cols = extent(tr, tc)
        table = table.filter(table.column("r").is_valid())
        r, c, v = (table.column(n).to_numpy() for n in ("r", "c", "v"))
        out = np.full((rows[1] - rows[0], cols[1] - cols[0]), np.nan)
        if len(r):
            first = int(r.min()), int(c.min())
            window = np.full((int(r.max()) - first[0] + 1, int(c.max()) - first[1] + 1), np.nan)
            window[r - first[0], c - first[1]] = v
            out = _sample(window, first, *source_places(target, source, move, rows, cols, error), how)
        gr, gc = np.meshgrid(np.arange(*rows), np.arange(*cols), indexing="ij")
        return pa.table({"r": gr.ravel(), "c": gc.ravel(), band: pa.array(out.ravel(), pa.float64(), from_pandas=True)})

    got = x.unionByName(every).groupBy("tr", "tc").applyInArrow(run, f"r long, c long, `{band}` double")
    kind = dict(cells.dtypes)[band]
    got = got if kind == "double" or how != "nearest" else got.withColumn(band, F.col(band).cast(kind))
    return got if fill is None else got.withColumn(band, F.coalesce(band, F.lit(fill)))


def grid_in(source: GridSpec, crs: str, cell: float | None = None) -> GridSpec:
    """The grid of another reference system that covers the source: its borders
    are projected, the cell is as large as the source's at its middle."""
    move = between(source.crs, crs)
    edge = np.linspace(0, 1, 65)
    x, y = source.x0 + edge * source.width * source.cell, source.y0 - edge * source.height * source.cell
    px, py = (np.concatenate(v) for v in ((x, x, np.full(65, x[0]), np.full(65, x[-1])), (np.full(65, y[0]), np.full(65, y[-1]), y, y)))
    tx, ty = move(px, py)
    if cell is None:
        mx, my = source.x0 + source.width * source.cell / 2, source.y0 - source.height * source.cell / 2
        ax, ay = move(np.array([mx, mx + source.cell, mx]), np.array([my, my, my - source.cell]))
        cell = float(np.sqrt(abs((ax[1] - ax[0]) * (ay[2] - ay[0]) - (ax[2] - ax[0]) * (ay[1] - ay[0]))))
    return GridSpec(int(np.ceil((tx.max() - tx.min()) / cell)), int(np.ceil((ty.max() - ty.min()) / cell)), cell, float(tx.min()), float(ty.max()), crs)


def crop(cells: DataFrame, spec: GridSpec, layer: DataFrame) -> tuple[DataFrame, GridSpec]:
    """Cells whose centre is in a polygon of the layer, and the grid of their
    window, in which rows and columns begin at 0."""
    inside = burn(cells, spec, layer).select("r", "c").distinct()
    x = cut_lineage(cells.join(inside, ["r", "c"], "left_semi"), "crop")
    r0, r1, c0, c1 = x.agg(F.min("r"), F.max("r"), F.min("c"), F.max("c")).first()
    if r0 is None:
        return x, replace(spec, width=0, height=0)
    part = replace(spec, width=c1 - c0 + 1, height=r1 - r0 + 1, x0=spec.x0 + c0 * spec.cell, y0=spec.y0 - r0 * spec.cell)
    return x.withColumns({"r": F.col("r") - r0, "c": F.col("c") - c0}), part


def by_feature(cells: DataFrame, spec: GridSpec, layer: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A raster per feature: name, r and c from the corner of the feature's own
    window, and the bands; and the windows (name, x0, y0, width, height). A cell
    in several features is in each of their rasters."""
    x = cut_lineage(cells.join(burn(cells, spec, layer).distinct(), ["r", "c"]), "features")
    ends = x.groupBy("name").agg(F.min("r").alias("_r"), F.max("r").alias("_r1"), F.min("c").alias("_c"), F.max("c").alias("_c1"))
    windows = ends.select(
        "name", (F.lit(spec.x0) + F.col("_c") * spec.cell).alias("x0"), (F.lit(spec.y0) - F.col("_r") * spec.cell).alias("y0"),
        (F.col("_c1") - F.col("_c") + 1).alias("width"), (F.col("_r1") - F.col("_r") + 1).alias("height"),
    )
    out = x.join(ends, "name").withColumns({"r": F.col("r") - F.col("_r"), "c": F.col("c") - F.col("_c")})
    return out.select("name", *cells.columns), windows


def align_and_clip(dem: DataFrame, dem_spec: GridSpec, canopy: DataFrame, canopy_spec: GridSpec, mask: DataFrame | None = None) -> DataFrame:
    """r, c, z, canopy on the elevation model's grid: canopy by the nearest
    cell; elevations of 0 are voids, canopy of 0 is open ground."""
    from firnline.grid import to_null

    z = dem.select("r", "c", to_null("z", zero_too=True).alias("z"))
    trees = align(canopy.select("r", "c", to_null("canopy").alias("canopy")), canopy_spec, dem_spec, "canopy", "nearest")
    out = z.join(trees, ["r", "c"], "left")
    return out if mask is None else out.join(mask.select("r", "c"), ["r", "c"], "left_semi")


def overview(cells: DataFrame, factor: int, band: str, how: str = "average") -> DataFrame:
    """One level of a pyramid: block means, or (nearest) the value at the block's
    middle cell."""
    r, c = F.floor(F.col("r") / factor).alias("r"), F.floor(F.col("c") / factor).alias("c")
    if how == "average":
        return cells.groupBy(r, c).agg(F.avg(band).alias(band))
    mid = factor // 2
    return cells.where((F.pmod("r", F.lit(factor)) == mid) & (F.pmod("c", F.lit(factor)) == mid)).select(r, c, band)


def pyramid(cells: DataFrame, band: str, how: str = "average", factors=(2, 4, 8, 16)) -> DataFrame:
    levels = [overview(cells, f, band, how).withColumn("factor", F.lit(f)) for f in factors]
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out
