"""Kernels over tiles: a neighbourhood too wide for windows is read from a
dense array of one tile and a halo around it. Each cell goes to its own tile,
and a cell near a border to the neighbours as well: one shuffle, whatever the
width, and a working set that the tile and the halo bound."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firnline.grid import TILE, GridSpec, workers_see


def tile_kernel(
    cells: DataFrame,
    spec: GridSpec,
    halo: int,
    bands: list[str],
    outs: list[str],
    kernel: Callable[[dict[str, np.ndarray], tuple[int, int], tuple[int, int]], Iterator[np.ndarray]],
    tile: int = TILE,
) -> DataFrame:
    """cells with double columns `outs` added.

    kernel(arrays, first, size) gets, for each band, an array of a window, NaN
    where there is no cell or value; the window's first row and column; and the
    grid's rows and columns. It returns an array of the window's shape for each
    of outs. A window is a tile with `halo` more cells on all sides, within the
    grid."""
    workers_see(cells.sparkSession)
    names, height, width = cells.columns, spec.height, spec.width
    near = lambda axis, size: F.sequence(
        F.floor(F.greatest(F.col(axis) - halo, F.lit(0)) / tile), F.floor(F.least(F.col(axis) + halo, F.lit(size - 1)) / tile)
    )
    x = cells.withColumn("_tr", F.explode(near("r", height))).withColumn("_tc", F.explode(near("c", width)))
    schema = T.StructType([*cells.schema.fields, *(T.StructField(o, T.DoubleType()) for o in outs)])

    def run(key, table):
        tr, tc = (k.as_py() for k in key)
        r, c = table.column("r").to_numpy(), table.column("c").to_numpy()
        first = max(0, tr * tile - halo), max(0, tc * tile - halo)
        shape = min(height, (tr + 1) * tile + halo) - first[0], min(width, (tc + 1) * tile + halo) - first[1]
        arrays = {}
        for b in bands:
            a = np.full(shape, np.nan)
            a[r - first[0], c - first[1]] = table.column(b).cast(pa.float64()).to_numpy()
            arrays[b] = a
        own = np.flatnonzero((r // tile == tr) & (c // tile == tc))
        mine = table.select(names).take(pa.array(own))
        for o, got in zip(outs, kernel(arrays, first, (height, width)), strict=True):
            mine = mine.append_column(o, pa.array(got[r[own] - first[0], c[own] - first[1]], pa.float64(), from_pandas=True))
        return mine

    return x.groupBy("_tr", "_tc").applyInArrow(run, schema)


def box_sums(a: np.ndarray, k: int) -> np.ndarray:
    """Sums over (2k + 1) x (2k + 1) cells of an array padded by k."""
    s = np.zeros((a.shape[0] + 1, a.shape[1] + 1))
    np.cumsum(np.cumsum(a, axis=0), axis=1, out=s[1:, 1:])
    n = 2 * k + 1
    return s[n:, n:] - s[:-n, n:] - s[n:, :-n] + s[:-n, :-n]


def quantile(stack: np.ndarray, p: float) -> np.ndarray:
    """Linear-interpolated quantile along the first axis over values that are
    not NaN; NaN where there is none."""
    stack = np.sort(stack, axis=0)  # NaN last
    n = (~np.isnan(stack)).sum(axis=0)
    at = np.maximum(n - 1, 0) * p
    lo = np.floor(at).astype(np.int64)
    hi = np.minimum(lo + 1, np.maximum(n - 1, 0))
    a, b = (np.take_along_axis(stack, i[None], axis=0)[0] for i in (lo, hi))
    return a + (b - a) * (at - lo)
