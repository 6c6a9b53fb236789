"""Exact Euclidean distances and nearest features, in two passes: the nearest
target of each column by windows, then along the rows the lower envelope of the
columns' parabolas, in time linear in the row's length, for a block of rows at
once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from firnline.grid import GridSpec, workers_see

ROWS = 128


def envelope(t: np.ndarray, r: np.ndarray) -> np.ndarray:
    """For each cell of some rows the column whose target is the nearest. t:
    rows x columns, the row of the nearest target of each column, -1: none; r:
    the rows' numbers. Ties: least target row, then column. -1 without target."""
    n, m = t.shape
    g = (t - r[:, None]) ** 2
    held, start = np.zeros((n, m + 1), dtype=np.int64), np.zeros((n, m + 1), dtype=np.int64)
    top = np.full(n, -1)
    for q in range(m):
        rows = np.flatnonzero(t[:, q] >= 0)
        at = np.zeros(len(rows), dtype=np.int64)  # where q begins to be the nearest
        open_ = np.flatnonzero(top[rows] >= 0)
        while len(open_):
            i = rows[open_]
            p = held[i, top[i]]
            num, den = g[i, q] + q * q - g[i, p] - p * p, 2 * (q - p)
            first, rest = num // den, num % den
            # Equally far at `first` itself: the lesser row, then the lesser column (p).
            at[open_] = first + ~((rest == 0) & (t[i, q] < t[i, p]))
            gone = at[open_] <= start[i, top[i]]
            top[i[gone]] -= 1
            open_ = open_[gone]
            at[open_[top[rows[open_]] < 0]] = 0
            open_ = open_[top[rows[open_]] >= 0]
        at = np.maximum(at, 0)
        use = at < m
        i = rows[use]
        top[i] += 1
        held[i, top[i]], start[i, top[i]] = q, at[use]
    which = np.full((n, m), -1)
    live = np.arange(m + 1)[None, :] <= top[:, None]
    i, k = np.nonzero(live)
    np.maximum.at(which, (i, start[i, k]), k)
    which = np.maximum.accumulate(which, axis=1)
    return np.where(which >= 0, np.take_along_axis(held, np.maximum(which, 0), axis=1), -1)


def _nearest(cells: DataFrame, spec: GridSpec, target: Column, band: str | None = None) -> DataFrame:
    """r, c, d2, tr, tc: squared cell distance to the nearest target and its
    place (ties: least row, then column); NULL without any target. With a band,
    its value there, too, as v: it comes along with the target's row, so that
    nothing is looked up by place. Cells that the table lacks are given, too,
    where their column has any."""
    workers_see(cells.sparkSession)
    down, up = (Window.partitionBy("c").orderBy(o) for o in (F.col("r"), F.col("r").desc()))  # frames that grow: linear both ways
    row = F.col("r").cast("long")
    carried = row if band is None else F.struct(row.alias("r"), F.col(band).alias("v"))
    at = (lambda t: t) if band is None else lambda t: t["r"]
    x = cells.select(row.alias("r"), F.col("c").cast("long").alias("c"), F.when(target, carried).alias("_t"))
    x = x.withColumns(
        {
            "_u": F.last("_t", ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, 0)),
            "_l": F.last("_t", ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, 0)),
            "_m": F.last("_t", ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, -1)),
            "_first": F.lag("r").over(down).isNull(),
            "_next": F.lead("r").over(down),
        }
    )
    # A row for each missing cell up to the next one of its column.
    own = F.col("r")
    lo, hi = F.when(F.col("_first"), 0).otherwise(own), F.coalesce(F.col("_next") - 1, F.lit(spec.height - 1).cast("long"))
    x = x.withColumn("_r", F.explode(F.sequence(lo.cast("long"), F.greatest(hi, own))))
    above, low = F.when(F.col("_r") >= own, F.col("_u")), F.when(F.col("_r") > own, F.col("_m")).otherwise(F.col("_l"))
    nearer = F.when(low.isNull() | (F.col("_r") - at(above) <= at(low) - F.col("_r")), above).otherwise(low)
    x = x.select(F.col("_r").alias("r"), "c", F.coalesce(nearer, low).alias("t"))
    x = x.select("r", "c", F.coalesce(at(F.col("t")), F.lit(-1)).alias("_row"), *([F.col("t.v").alias("v")] if band else []))
    kind, width = f", v {cells.schema[band].dataType.simpleString()}" if band else "", spec.width

    def block(table: pa.Table) -> pa.Table:
        r, c, row = (table[n].to_numpy() for n in ("r", "c", "_row"))
        some = np.unique(r)
        place = np.searchsorted(some, r), c
        t = np.full((len(some), width), -1, dtype=np.int64)
        t[place] = row
        col = envelope(t, some)
        tc = col[place]
        at = place[0], np.maximum(tc, 0)
        tr = np.where(tc >= 0, t[at], -1)
        out = {"r": r, "c": c, "d2": np.where(tc >= 0, (r - tr) ** 2 + (c - tc) ** 2, -1), "tr": tr, "tc": tc}
        if band:
            held = np.zeros(t.shape, dtype=np.int64)  # by row and column, the place in this table
            held[place] = np.arange(len(r))
            out["v"] = table["v"].combine_chunks().take(pa.array(held[at]))
        return pa.table(out)

    y = x.groupBy(F.floor(F.col("r") / ROWS)).applyInArrow(block, "r long, c long, d2 long, tr long, tc long" + kind)
    return y.select("r", "c", *[F.when(F.col("tc") >= 0, F.col(n)).alias(n) for n in ("d2", "tr", "tc", *(["v"] if band else []))])


def distances(spark: SparkSession, places: DataFrame, spec: GridSpec, out: str = "distance") -> DataFrame:
    """r, c and the distance in cells to the nearest of the places (r, c; within
    the grid), for every cell of the grid; NULL if there is none."""
    ends = spark.range(spec.width).select(F.lit(0).cast("long").alias("r"), F.col("id").alias("c"), F.lit(False).alias("_at"))
    x = ends.unionByName(places.select(F.col("r").cast("long"), F.col("c").cast("long"), F.lit(True).alias("_at"))).groupBy("r", "c").agg(F.max("_at").alias("_at"))
    return _nearest(x, spec, F.col("_at")).select("r", "c", F.sqrt(F.col("d2").cast("double")).alias(out))


def distance_to(cells: DataFrame, spec: GridSpec, target: Column, out: str = "distance") -> DataFrame:
    """Distance in cells to the nearest target; NULL if there is none."""
    d = _nearest(cells, spec, target).select("r", "c", F.sqrt(F.col("d2").cast("double")).alias(out))
    return cells.join(d, ["r", "c"])


def proximity(cells: DataFrame, spec: GridSpec, target: Column, out: str = "proximity", whole: bool = False) -> DataFrame:
    """Distance in map units; whole: rounded to integers."""
    x = distance_to(cells, spec, target, out)
    d = F.col(out) * spec.cell
    return x.withColumn(out, F.round(d).cast("smallint") if whole else d)


def nearest_feature(cells: DataFrame, spec: GridSpec, target: Column, band: str, out: str) -> DataFrame:
    """The band's value at the nearest target."""
    near = _nearest(cells, spec, target, band).select("r", "c", F.col("v").alias(out))
    return cells.join(near, ["r", "c"], "left")
