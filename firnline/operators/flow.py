"""Runout of snow avalanches from release cells, after the published flow-path
model with an energy line.

From each release cell flux of 1 runs down. A cell gives its flux to lower-lying
or still-moving neighbours by terrain (tan of half the slope angle plus 90
degrees, to an exponent) times persistence of direction; shares below the
threshold are dropped and spread over the rest. Energy height falls along the
way by the travel angle and stops the flow at 0; it can't exceed max_z.

Assumptions where publications leave room: persistence weighs 1 for straight
on, 0.707 at 45 degrees, 0 beyond; forest adds friction in proportion to canopy
and to how slow the flow is.

Release cells are independent: cells are dealt by tiles with a halo, each
tile's releases run in one kernel, and cells are combined by max, min, sum and
count. A release whose path comes to the rim of its window is run again in a
further round, with twice the halo, until none does: no path is cut, whatever
the tile and the first halo.
"""

from __future__ import annotations

import heapq
import math
from array import array
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firnline.grid import GridSpec, cut_lineage, workers_see

STEPS = tuple((dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if dr or dc)
#: Weight of going on in one direction (first) after coming in another.
AHEAD = [[max(0.0, (dr * a + dc * b) / (math.hypot(dr, dc) * math.hypot(a, b))) for a, b in STEPS] for dr, dc in STEPS]


@dataclass(frozen=True)
class FlowParams:
    alpha: float = 30.0
    exponent: float = 8.0
    flux_threshold: float = 0.003
    max_z: float = 270.0
    max_friction: float = 52.0
    min_friction: float = 5.0
    friction_velocity_z: float = 270.0
    max_detrainment: float = 0.003
    min_detrainment: float = 0.00001
    detrainment_velocity_z: float = 270.0
    forest: bool = False
    tile: int = 128
    halo: int = 64


class Window:
    """Elevation and canopy of a part of the grid, flat and with a border of
    one cell, and what doesn't depend on the release. more: whether cells follow
    above, below, to the left and right; there the border is infinite."""

    KEPT = 100_000

    def __init__(self, z: np.ndarray, canopy: np.ndarray, p: FlowParams, cell: float, more: tuple[bool, bool, bool, bool] = (False,) * 4):
        self.p, self.cell, self.width = p, cell, z.shape[1] + 2
        edged = np.pad(np.where(np.isinf(z), np.nan, z), 1, constant_values=np.inf)
        for side, goes_on in zip((edged[0], edged[-1], edged[:, 0], edged[:, -1]), more, strict=True):
            if not goes_on:
                side[:] = np.nan
        self.z = array("d", edged.tobytes())
        self.canopy = array("d", np.pad(canopy, 1).tobytes())
        self.steps = [(dr * self.width + dc, cell * math.hypot(dr, dc)) for dr, dc in STEPS]
        self.known: dict[int, list] = {}

    def place(self, r: int, c: int) -> int:
        return (r + 1) * self.width + c + 1

    def ways(self, at: int) -> list[tuple] | None:
        """Neighbour, direction, length, fall and terrain's weight; None at a rim
        beyond which there are cells."""
        if at not in self.known:
            if len(self.known) >= self.KEPT:
                self.known.clear()
            z, out = self.z, []
            for k, (by, run) in enumerate(self.steps):
                drop = z[at] - z[at + by]
                if drop == -math.inf:
                    out = None
                    break
                if drop == drop:
                    out.append((at + by, k, run, drop, math.tan((math.atan2(drop, run) + math.pi / 2) / 2) ** self.p.exponent))
            self.known[at] = out
        return self.known[at]


def run_release(w: Window, start: int) -> dict[int, tuple] | None:
    """Per reached cell: flux, energy height, path length, angle and straight
    angle to the release, deposit and whether there is forest. None if the path
    comes to the window's rim."""
    p, cell, z, canopy, width = w.p, w.cell, w.z, w.canopy, w.width
    z0, r0, c0 = z[start], start // width, start % width
    tan_alpha = math.tan(math.radians(p.alpha))
    state = {start: [1.0, 0.0, 0.0, {}, ()]}  # flux, energy height, path length, inflow by direction, place in the queue
    # A cell whose energy grows is put in again; its earlier entry comes later.
    queue, put, done, out = [(-z0, 0, start)], 0, set(), {}
    while queue:
        at = heapq.heappop(queue)[2]
        if at in done:
            continue
        done.add(at)
        flux, energy, length, came, _ = state[at]
        ways = w.ways(at)
        if ways is None:
            return None
        shares = []
        for to, k, run, drop, terrain in ways:
            if to in done:
                continue
            loss = tan_alpha * run
            if p.forest and canopy[to] > 0:
                calm = max(0.0, 1.0 - energy / p.friction_velocity_z)
                extra = (p.min_friction + (p.max_friction - p.min_friction) * calm) * canopy[to] / 100.0
                loss = math.tan(math.radians(min(85.0, p.alpha + extra))) * run
            left = min(p.max_z, energy + drop - loss)
            if left <= 0:
                continue
            keep = 1.0
            if came:
                ahead = AHEAD[k]
                keep = sum([f * ahead[j] for j, f in came.items()])
            if terrain * keep > 0:
                shares.append((to, terrain * keep, left, run, k))
        whole = sum([s[1] for s in shares])
        rest = flux
        if p.forest and canopy[at] > 0:
            calm = max(0.0, 1.0 - energy / p.detrainment_velocity_z)
            rest = max(0.0, flux - (p.min_detrainment + (p.max_detrainment - p.min_detrainment) * calm) * canopy[at] / 100.0)
        good = [s for s in shares if whole and rest * s[1] / whole >= p.flux_threshold]
        kept = sum([s[1] for s in good])
        deposit = rest if not good else 0.0
        flat = cell * math.hypot(at // width - r0, at % width - c0)
        angle = math.degrees(math.atan2(z0 - z[at], length)) if length else 0.0
        straight = math.degrees(math.atan2(z0 - z[at], flat)) if flat else 0.0
        out[at] = (flux, energy, length, angle, straight, deposit, float(canopy[at] > 0))
        later = []
        for to, share, left, run, k in good:
            f = rest * share / kept
            s = state.get(to)
            if s is None:
                s = state[to] = [0.0, 0.0, length + run, {}, (math.inf, 0, to)]
            s[0] += f
            if left > s[1]:
                s[1] = left
                later.append((s[4], to))
            s[2] = min(s[2], length + run)
            s[3][k] = s[3].get(k, 0.0) + f
        # Energy lines are often equal: the cell that was ahead stays ahead, new ones come last.
        for (last, _, _), to in sorted(later, key=lambda x: x[0][:2]):
            if (now := -(z[to] + state[to][1])) < last:
                put += 1
                state[to][4] = (now, put, to)
                heapq.heappush(queue, state[to][4])
    return out


LARGEST = 1024  # cells of a path that runs beside others
_tan = np.frompyfunc(math.tan, 1, 1)
_weight = np.frompyfunc(lambda drop, run, exponent: math.tan((math.atan2(drop, run) + math.pi / 2) / 2) ** exponent, 3, 1)


def _place_in_row(i: np.ndarray) -> np.ndarray:
    """Of each entry of sorted rows, how many of its row are before it."""
    n = np.arange(len(i))
    return n - np.maximum.accumulate(np.where(np.append(True, i[1:] != i[:-1]), n, 0)) if len(i) else n


class Beside:
    """Many releases of a window at once, step by step: each step takes one cell
    of each, in the order in which run_release does, and gives the same paths (sums
    of flux aside, whose last digits may differ).
    A row of the arrays is a release, a column one of its cells; in key, put and
    which, one of the cells that wait, in any order."""

    FIELDS = {"cell": "i4", "flux": "f8", "energy": "f8", "length": "f8", "deposit": "f8", "done": "?", "at": "i2"}
    WAITING = {"key": "f8", "put": "i4", "which": "i2"}

    def __init__(self, w: Window, starts: np.ndarray):
        self.w, self.starts, self.z, self.canopy = w, starts, np.array(w.z), np.array(w.canopy)
        cells = len(self.z)
        self.rows = max(1, min(len(starts), 1024, (32 << 20) // cells))
        self.by, self.run = np.array([s[0] for s in w.steps]), np.array([s[1] for s in w.steps])
        self.ahead = np.array(AHEAD).T.copy()  # by direction of coming, then of going
        around = np.clip(np.arange(cells)[:, None] + self.by, 0, cells - 1)
        with np.errstate(invalid="ignore"):
            self.drop = self.z[:, None] - self.z[around]
        self.rim = (self.drop == -np.inf).any(axis=1)
        self.weight = np.zeros(self.drop.shape)
        known = np.isfinite(self.drop)
        self.weight[known] = _weight(self.drop[known], np.broadcast_to(self.run, known.shape)[known], w.p.exponent).astype(float)
        self.place = np.full((self.rows, cells), -1, dtype="i2")
        self.of = np.full(self.rows, -1)
        self.used, self.puts = np.zeros(self.rows, dtype="i4"), np.zeros(self.rows, dtype="i4")
        self.waits, self.size = np.zeros(self.rows, dtype="i4"), 0
        self.key = np.full((self.rows, 0), np.inf)
        self._more_waiting(16)
        self._widen(64)

    def _widen(self, size: int) -> None:
        for name, kind in self.FIELDS.items():
            new = np.zeros((self.rows, size), dtype=kind)
            if self.size:
                new[:, : self.size] = getattr(self, name)
            setattr(self, name, new)
        new = np.zeros((self.rows, size, 8))  # by direction
        if self.size:
            new[:, : self.size] = self.inflow
        self.inflow = new
        self.size = size

    def _more_waiting(self, size: int) -> None:
        had = self.key.shape[1]
        for name, kind in self.WAITING.items():
            new = np.full((self.rows, size), np.inf if name == "key" else 0, dtype=kind)
            if had:
                new[:, :had] = getattr(self, name)
            setattr(self, name, new)

    def _start(self, rows: np.ndarray, which: np.ndarray) -> None:
        """Begin releases in rows, which are empty."""
        at = self.starts[which]
        self.of[rows], self.used[rows], self.puts[rows] = which, 1, 0
        self.place[rows, at] = 0
        self.waits[rows] = 1
        for name, value in (("cell", at), ("flux", 1.0), ("energy", 0.0), ("length", 0.0), ("done", False), ("at", 0), ("key", -self.z[at]), ("put", 0), ("which", 0)):
            getattr(self, name)[rows, 0] = value

    def _clear(self, rows: np.ndarray) -> None:
        r, k = np.nonzero(np.arange(self.size) < self.used[rows][:, None])
        self.place[rows[r], self.cell[rows[r], k]] = -1
        self.key[rows] = np.inf
        self.of[rows], self.waits[rows] = -1, 0

    def _found(self, rows: np.ndarray) -> tuple:
        """Cells of finished releases and the values that run_release gives."""
        r, k = np.nonzero(np.arange(self.size) < self.used[rows][:, None])
        r = rows[r]
        at, start, width, cell = self.cell[r, k], self.starts[self.of[r]], self.w.width, self.w.cell
        length, fall = self.length[r, k], self.z[start] - self.z[at]
        flat = cell * np.hypot(at // width - start // width, at % width - start % width)
        angle, straight = (np.where(x > 0, np.degrees(np.arctan2(fall, x)), 0.0) for x in (length, flat))
        return at, self.flux[r, k], self.energy[r, k], length, angle, straight, self.deposit[r, k], (self.canopy[at] > 0).astype(float)

    def paths(self):
        """("done", cells and values), of some releases each; ("rim", releases)
        whose path comes to the window's rim; ("long", releases) with more
        cells than fit here."""
        begun = 0
        while True:
            free = np.flatnonzero(self.of < 0)[: len(self.starts) - begun]
            if len(free):
                self._start(free, np.arange(begun, begun + len(free)))
                begun += len(free)
            rows = np.flatnonzero(self.of >= 0)
            if not len(rows):
                return
            top = int(self.used[rows].max())
            if top + 8 > self.size:
                if self.size >= LARGEST:
                    big = rows[self.used[rows] + 8 > self.size]
                    yield "long", self.of[big]
                    self._clear(big)
                    continue
                self._widen(2 * self.size)
            wide = max(1, int(self.waits.max()))
            if wide + 8 > self.key.shape[1]:
                self._more_waiting(2 * self.key.shape[1])
            key = self.key[:, :wide]
            least = key.min(axis=1)
            at = np.where(key == least[:, None], self.put[:, :wide], np.iinfo("i4").max).argmin(axis=1)
            least, at = least[rows], at[rows]
            ended = np.isinf(least)
            if ended.any():
                yield "done", self._found(rows[ended])
                self._clear(rows[ended])
            rim = ~ended & self.rim[self.cell[rows, self.which[rows, at]]]
            if rim.any():
                yield "rim", self.of[rows[rim]]
                self._clear(rows[rim])
            go = ~ended & ~rim
            if go.any():
                self._step(rows[go], at[go])

    def _taken(self, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Take cells from among those that wait; the last one takes its place."""
        slot = self.which[rows, at]
        self.waits[rows] -= 1
        end = self.waits[rows]
        for x in (self.key, self.put, self.which):
            x[rows, at] = x[rows, end]
        self.at[rows, self.which[rows, at]] = at
        self.key[rows, end] = np.inf
        return slot

    def _step(self, rows: np.ndarray, at: np.ndarray) -> None:
        p = self.w.p
        at = self._taken(rows, at)
        cell, flux, energy, length = (x[rows, at] for x in (self.cell, self.flux, self.energy, self.length))
        self.done[rows, at] = True
        run, gain = self.run, energy[:, None] + self.drop[cell]
        if not p.forest:
            left = gain - math.tan(math.radians(p.alpha)) * run
        else:
            wood = self.canopy[cell[:, None] + self.by]
            calm = np.maximum(0.0, 1.0 - energy / p.friction_velocity_z)[:, None]
            extra = (p.min_friction + (p.max_friction - p.min_friction) * calm) * wood / 100.0
            loss = np.broadcast_to(math.tan(math.radians(p.alpha)) * run, wood.shape).copy()
            slower = wood > 0
            loss[slower] = _tan(np.radians(np.minimum(85.0, p.alpha + extra[slower]))).astype(float) * np.broadcast_to(run, wood.shape)[slower]
            left = gain - loss
        i, k = np.nonzero(left > 0)  # a release and a direction
        left = np.minimum(p.max_z, left[i, k])
        r, to = rows[i], cell[i] + self.by[k]
        slot = self.place[r, to].astype(np.int64)
        keep = self.inflow[rows, at] @ self.ahead
        keep[at == 0] = 1.0  # the release itself
        share = self.weight[cell[i], k] * keep[i, k]
        ok = np.flatnonzero((share > 0) & ~((slot >= 0) & self.done[r, slot]))
        i, k, r, to, slot, left, share = (x[ok] for x in (i, k, r, to, slot, left, share))
        rest = flux
        if p.forest:
            wood = self.canopy[cell]
            calm = np.maximum(0.0, 1.0 - energy / p.detrainment_velocity_z)
            rest = np.where(wood > 0, np.maximum(0.0, flux - (p.min_detrainment + (p.max_detrainment - p.min_detrainment) * calm) * wood / 100.0), flux)
        good = np.flatnonzero(rest[i] * share / np.bincount(i, share, len(rows))[i] >= p.flux_threshold)
        i, k, r, to, slot, left, share = (x[good] for x in (i, k, r, to, slot, left, share))
        self.deposit[rows, at] = np.where(np.bincount(i, minlength=len(rows)), 0.0, rest)
        if not len(i):
            return
        f = rest[i] * share / np.bincount(i, share, len(rows))[i]
        new = slot < 0
        if new.any():
            a, nth, many = r[new], _place_in_row(i[new]), np.bincount(i[new], minlength=len(rows))
            b, q = self.used[a] + nth, self.waits[a] + nth
            slot[new] = b
            self.used[rows] += many
            self.waits[rows] += many
            self.place[a, to[new]] = b
            for name, value in (("cell", to[new]), ("flux", 0.0), ("energy", 0.0), ("length", np.inf), ("done", False), ("inflow", 0.0), ("at", q)):
                getattr(self, name)[a, b] = value
            self.which[a, q], self.put[a, q] = b, 0
        self.flux[r, slot] += f
        self.length[r, slot] = np.minimum(self.length[r, slot], length[i] + run[k])
        self.inflow[r, slot, k] = f
        # Cells whose energy grows, in the order of their places in the queue so far.
        more = left > self.energy[r, slot]
        i, r, to, slot, left = (x[more] for x in (i, r, to, slot, left))
        self.energy[r, slot] = left
        q = self.at[r, slot]
        last, now = self.key[r, q], -(self.z[to] + left)
        order = np.lexsort((self.put[r, q], last, i))
        order = order[now[order] < last[order]]
        if len(order):
            i, r, q = i[order], r[order], q[order]
            nth = _place_in_row(i)
            self.put[r, q] = self.puts[r] + nth + 1
            self.puts[rows] += np.bincount(i, minlength=len(rows))
            self.key[r, q] = now[order]


def runout(cells: DataFrame, spec: GridSpec, release: str, p: FlowParams | None = None) -> DataFrame:
    """r, c and the aggregates over all release cells. cells: z, optional
    canopy, and a 0/1 release band."""
    p = p or FlowParams()
    workers_see(cells.sparkSession)
    canopy = F.coalesce(F.col("canopy"), F.lit(0.0)) if "canopy" in cells.columns else F.lit(0.0)
    x = cells.where("z is not null").select("r", "c", F.col("z").cast("double"), canopy.cast("double").alias("canopy"), F.coalesce(F.col(release), F.lit(0)).cast("int").alias("release"))
    x = cut_lineage(x, "runout-cells")
    edge = tuple(x.agg(F.min("r"), F.max("r"), F.min("c"), F.max("c")).first())
    halo, parts = p.halo, []
    while True:
        got = cut_lineage(_round(x, edge, spec.cell, p, halo), "runout-paths")
        parts.append(got.where("n > 0"))
        again = got.where("n = 0").select("r", "c", F.lit(1).alias("again")).distinct()
        if not again.head(1):
            break
        x = x.join(again, ["r", "c"], "left").withColumn("release", F.coalesce("again", F.lit(0))).drop("again")
        x, halo = cut_lineage(x, "runout-cells"), 2 * max(halo, 1)
    how = {"n": F.sum, "flux": F.max, "zDelta": F.max, "travelLengthMax": F.max, "travelLengthMin": F.min, "fpTravelAngleMax": F.max,
           "fpTravelAngleMin": F.min, "slTravelAngle": F.max, "zDeltaSum": F.sum, "routFluxSum": F.sum, "depFluxSum": F.sum, "forestInteraction": F.sum}
    return reduce(DataFrame.union, parts).groupBy("r", "c").agg(*[f(k).alias("cellCounts" if k == "n" else k) for k, f in how.items()])


def _round(x: DataFrame, edge: tuple, cell: float, p: FlowParams, halo: int) -> DataFrame:
    """Aggregates per tile and cell of the releases whose paths stay in their
    tile's window; the other releases with n = 0. edge: the grid's first and
    last row and column."""
    tile = p.tile
    lo = lambda v: F.floor((F.col(v) - halo) / tile)
    hi = lambda v: F.floor((F.col(v) + halo) / tile)
    dealt = x.withColumn("tr", F.explode(F.sequence(lo("r"), hi("r")))).withColumn("tc", F.explode(F.sequence(lo("c"), hi("c"))))
    home = (F.floor(F.col("r") / tile) == F.col("tr")) & (F.floor(F.col("c") / tile) == F.col("tc"))
    dealt = dealt.withColumn("release", F.when(home, F.col("release")).otherwise(0))
    has = dealt.where("release = 1").select("tr", "tc").distinct()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tr, tc = int(pdf.tr.iloc[0]) * tile, int(pdf.tc.iloc[0]) * tile
        r0, r1 = max(edge[0], tr - halo), min(edge[1], tr + tile - 1 + halo)
        c0, c1 = max(edge[2], tc - halo), min(edge[3], tc + tile - 1 + halo)
        r, c = pdf.r.to_numpy() - r0, pdf.c.to_numpy() - c0
        z = np.full((r1 - r0 + 1, c1 - c0 + 1), np.nan)
        wood = np.zeros_like(z)
        z[r, c], wood[r, c] = pdf.z, pdf.canopy
        w = Window(z, wood, p, cell, (r0 > edge[0], r1 < edge[1], c0 > edge[2], c1 < edge[3]))
        mine = np.flatnonzero(pdf.release.to_numpy() == 1)
        starts = (r[mine] + 1) * w.width + c[mine] + 1
        total = np.zeros((len(COLUMNS), len(w.z)))
        for t, how in zip(total, HOW, strict=True):
            t[:] = {np.maximum: -np.inf, np.minimum: np.inf, np.add: 0.0}[how]
        again = []

        def add(at, flux, energy, length, angle, straight, deposit, forest):
            given = (1.0, flux, energy, length, length, angle, angle, straight, energy, flux, deposit, forest)
            for t, how, v in zip(total, HOW, given, strict=True):
                how.at(t, at, v)

        for kind, x in Beside(w, starts).paths():
            if kind == "done":
                add(*x)
                continue
            for j in x.tolist():
                found = run_release(w, int(starts[j])) if kind == "long" else None
                if found is None:
                    again.append(int(starts[j]))
                else:
                    add(np.array(list(found)), *np.array(list(found.values())).T)
        at = np.append(np.flatnonzero(total[0]), np.array(again, dtype=np.int64))
        values = total[:, at]
        values[:, len(at) - len(again) :] = 0.0
        got = pd.DataFrame({"r": at // w.width - 1 + r0, "c": at % w.width - 1 + c0, **dict(zip(COLUMNS, values, strict=True))})
        return got.astype({"n": "int64"})

    kinds = "n long, " + ", ".join(f"{k} double" for k in COLUMNS[1:])
    # As many tasks as the setting says: a tile is little to read, but long to run.
    dealt = dealt.join(has, ["tr", "tc"], "left_semi").repartition(int(x.sparkSession.conf.get("spark.sql.shuffle.partitions")), "tr", "tc")
    return dealt.groupBy("tr", "tc").applyInPandas(run, f"r long, c long, {kinds}")


COLUMNS = ("n", "flux", "zDelta", "travelLengthMax", "travelLengthMin", "fpTravelAngleMax", "fpTravelAngleMin", "slTravelAngle", "zDeltaSum", "routFluxSum", "depFluxSum", "forestInteraction")
HOW = (np.add, np.maximum, np.maximum, np.maximum, np.minimum, np.maximum, np.minimum, np.maximum, np.add, np.add, np.add, np.add)
