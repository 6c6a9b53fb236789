"""Registered terrain queries over the driver tables, and the same in SQL."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firnline.functions import fuzzy
from firnline.functions import palette as P
from firnline.functions import votes as V
from firnline.grid import GridSpec, scratch_path
from firnline.operators import align, classify, distance, flow, focal, regions, segment, zonal
from firnline.operators.stack import Stack
from firnline.plans.derived import AROUND, BANDS, CELL, GRID, SLOPE, WIDTH, bands, grid, spec
from firnline.sources import imagery, tables, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
AREA = CELL * CELL
FLAT = GridSpec(WIDTH, 0, CELL)  # for operators that need no more than the cell size


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def rounded(x: Column, places: int) -> Column:
    """A double as the SQL's round gives it, from the scaled binary number.
    Spark's own goes by the shortest decimal, and the two part at halves."""
    return F.round(x * 10.0**places) / 10.0**places


def keyed(x: DataFrame, *columns, places: int = 5) -> DataFrame:
    """r, c and the columns; doubles rounded for comparison."""
    kinds = dict(x.dtypes)
    return x.select("r", "c", *[(rounded(F.col(b), places) + 0.0).alias(b) if kinds[b] == "double" else F.col(b) for b in columns])


def _rounded(sql: str, places: int = 5) -> str:
    return f"round({sql}, {places}) + 0e0"


# Focal.


@query(f"WITH {GRID}, {SLOPE} SELECT r, c, {_rounded('slope')} AS slope FROM sl")
def slope_horn(spark, sf):
    return keyed(focal.slope(grid(spark, sf), FLAT), "slope")


@query(
    f"""WITH {GRID}, {AROUND}, fill AS (SELECT r, c, z, {", ".join(f"coalesce({a}, 2e0 * z - {b}, z) AS {a}" for a, b in (("n", "s"), ("s", "n"), ("w", "e"), ("e", "w"), ("nw", "se"), ("se", "nw"), ("ne", "sw"), ("sw", "ne")))} FROM n8)
    SELECT r, c, {_rounded("degrees(atan(sqrt(pow(((ne + 2e0 * e + se) - (nw + 2e0 * w + sw)) / (8e0 * 21.34e0), 2) + pow(((sw + 2e0 * s + se) - (nw + 2e0 * n + ne)) / (8e0 * 21.34e0), 2))))")} AS slope FROM fill"""
)
def slope_with_edges(spark, sf):
    return keyed(focal.slope(grid(spark, sf), FLAT, edges=True), "slope")


@query(f"WITH {GRID}, {SLOPE} SELECT r, c, CAST(coalesce(trunc(slope), -9999) AS SMALLINT) AS slope, slope IS NOT NULL AS valid FROM sl")
def slope_whole_degrees(spark, sf):
    x = grid(spark, sf)
    return keyed(focal.whole_slope(x, FLAT).withColumn("slope", F.coalesce("slope", F.lit(-9999).cast("smallint"))), "slope", "valid")


_ASPECT = "CASE WHEN gx <> 0 OR gy <> 0 THEN (degrees(atan2(-gx, gy)) + 360e0) % 360e0 END"


@query(f"WITH {GRID}, {SLOPE} SELECT r, c, {_rounded(_ASPECT)} AS aspect FROM sl")
def aspect(spark, sf):
    return keyed(focal.aspect(grid(spark, sf), FLAT), "aspect")


def _step_sql(table: str, band: str, axis: str, out: str) -> str:
    o = "c" if axis == "r" else "r"
    return (
        f"SELECT t.*, coalesce((b.{band} - a.{band}) / 2e0, b.{band} - t.{band}, t.{band} - a.{band}) AS {out} FROM {table} t "
        f"LEFT JOIN {table} a ON a.{o} = t.{o} AND a.{axis} = t.{axis} - 1 LEFT JOIN {table} b ON b.{o} = t.{o} AND b.{axis} = t.{axis} + 1"
    )


def _step_sql_all() -> str:
    """The curvature query's steps, up to both bands."""
    return f"""a1 AS ({_step_sql("g", "z", "r", "dy")}), a2 AS ({_step_sql("a1", "z", "c", "dx")}), a3 AS ({_step_sql("a2", "dx", "c", "dxx")}),
    a4 AS ({_step_sql("a3", "dy", "r", "dyy")}), a5 AS ({_step_sql("a4", "dx", "r", "dxy")}), k5 AS (SELECT r, c, z, (degrees(atan2(-dy, dx)) + 360e0) % 360e0 AS math_aspect,
    greatest(-5e0, least(5e0, -(dxx * dy * dy - 2e0 * dxy * dx * dy + dyy * dx * dx) / pow(dx * dx + dy * dy + 1e-8, 1.5e0))) AS curvature FROM a5)"""


@query(
    f"""WITH {GRID}, a1 AS ({_step_sql("g", "z", "r", "dy")}), a2 AS ({_step_sql("a1", "z", "c", "dx")}), a3 AS ({_step_sql("a2", "dx", "c", "dxx")}),
    a4 AS ({_step_sql("a3", "dy", "r", "dyy")}), a5 AS ({_step_sql("a4", "dx", "r", "dxy")})
    SELECT r, c, {_rounded("(degrees(atan2(-dy, dx)) + 360e0) % 360e0", 4)} AS math_aspect,
    {_rounded("greatest(-5e0, least(5e0, -(dxx * dy * dy - 2e0 * dxy * dx * dy + dyy * dx * dx) / pow(dx * dx + dy * dy + 1e-8, 1.5e0)))", 4)} AS curvature FROM a5"""
)
def curvature(spark, sf):
    return keyed(focal.curvature(grid(spark, sf)), "math_aspect", "curvature", places=4)


@query(
    f"""WITH {GRID}, {SLOPE}, u AS (SELECT r, c, sin(radians(slope)) * sin(radians(coalesce({_ASPECT}, 0e0))) AS x, sin(radians(slope)) * cos(radians(coalesce({_ASPECT}, 0e0))) AS y, cos(radians(slope)) AS w FROM sl),
    m AS (SELECT t.r, t.c, sum(n.x) AS x, sum(n.y) AS y, sum(n.w) AS w, count(n.x) AS k FROM u t JOIN u n ON n.r BETWEEN t.r - 1 AND t.r + 1 AND n.c BETWEEN t.c - 1 AND t.c + 1 GROUP BY t.r, t.c)
    SELECT r, c, {_rounded("CASE WHEN k = 9 THEN 1e0 - sqrt(x * x + y * y + w * w) / 9e0 ELSE 0e0 END")} AS ruggedness FROM m"""
)
def ruggedness_3x3(spark, sf):
    x = grid(spark, sf)
    return keyed(focal.ruggedness(focal.aspect(focal.slope(x, FLAT), FLAT)), "ruggedness")


_OFFSETS = ", ".join(f"({dr}, {dc}, {d!r}e0)" for dr, dc, d in focal.sector_offsets(3))


@query(
    f"""WITH {GRID}, o(dr, dc, d) AS (VALUES {_OFFSETS}), lim AS (SELECT max(r) AS h, max(c) AS w FROM g),
    q AS (SELECT g.r, g.c, quantile_cont(atan((n.z - g.z) / (o.d * 21.34e0)), 0.5) AS v FROM g, o, g n WHERE n.r = g.r + o.dr AND n.c = g.c + o.dc AND n.z <> 0 GROUP BY g.r, g.c)
    SELECT g.r, g.c, CASE WHEN g.r BETWEEN 3 AND h - 3 AND g.c BETWEEN 3 AND w - 3 THEN {_rounded("coalesce(v, 0e0)")} END AS windshelter FROM g CROSS JOIN lim LEFT JOIN q ON q.r = g.r AND q.c = g.c"""
)
def windshelter_p50(spark, sf):
    x = grid(spark, sf)
    return keyed(focal.wind_shelter(x, spec(x)), "windshelter")


def _box_sql(band: str, width: int, edge: str) -> str:
    k = width // 2
    def at(v, n):
        if edge == "reflect":
            return f"CASE WHEN {v} < 0 THEN -1 - ({v}) WHEN {v} >= {n} THEN 2 * {n} - 1 - ({v}) ELSE {v} END"
        return f"greatest(0, least({n} - 1, {v}))"
    return (
        f"WITH {GRID}, lim AS (SELECT max(r) + 1 AS h, max(c) + 1 AS w FROM g), d AS (SELECT a.i AS dr, b.i AS dc FROM range(-{k}, {k + 1}) a(i), range(-{k}, {k + 1}) b(i)), "
        f"p AS (SELECT g.r, g.c, {at('g.r + dr', 'h')} AS pr, {at('g.c + dc', 'w')} AS pc FROM g, d, lim) "
        f"SELECT p.r, p.c, round(sum(coalesce(n.{band}, 0e0)) / {width * width}e0, 4) + 0e0 AS {band}_mean FROM p LEFT JOIN g n ON n.r = pr AND n.c = pc GROUP BY p.r, p.c"
    )


@query(_box_sql("canopy", 15, "reflect"))
def box_mean_reflect(spark, sf):
    x = grid(spark, sf)
    return keyed(focal.box_mean(x, spec(x), "canopy", focal.box_width(300, CELL)), "canopy_mean", places=4)


@query(_box_sql("z", 5, "nearest"))
def box_mean_nearest(spark, sf):
    x = grid(spark, sf)
    return keyed(focal.box_mean(x, spec(x), "z", 5, "nearest"), "z_mean", places=4)


@query(
    f"""WITH {GRID}, v AS (SELECT r, c, CASE WHEN noise THEN z END AS z FROM g)
    SELECT t.r, t.c, CASE WHEN t.z IS NOT NULL THEN {_rounded("(t.z + coalesce(a.z, 0) + coalesce(b.z, 0) + coalesce(d.z, 0)) / (1 + (a.z IS NOT NULL)::INT + (b.z IS NOT NULL)::INT + (d.z IS NOT NULL)::INT)")} END AS smooth
    FROM v t LEFT JOIN v a ON a.r = t.r AND a.c = t.c + 1 LEFT JOIN v b ON b.r = t.r + 1 AND b.c = t.c LEFT JOIN v d ON d.r = t.r + 1 AND d.c = t.c + 1"""
)
def smooth_2x2(spark, sf):
    x = grid(spark, sf).withColumn("z", F.when(F.col("noise"), F.col("z")))
    return keyed(focal.smooth_2x2(x, "z", "smooth"), "smooth")


def _cross(table: str, f: str) -> str:
    sides = ", ".join(f"coalesce({n}.m, 0)" for n in "news")
    joins = " ".join(f"LEFT JOIN {table} {n} ON {n}.r = t.r + {dr} AND {n}.c = t.c + {dc}" for n, dr, dc in (("n", -1, 0), ("e", 0, 1), ("w", 0, -1), ("s", 1, 0)))
    return f"SELECT t.r, t.c, {f}(t.m, {sides}) AS m FROM {table} t {joins}"


@query(
    f"""WITH {GRID}, m0 AS (SELECT r, c, noise::INT AS m FROM g), m1 AS ({_cross("m0", "least")}), m2 AS ({_cross("m1", "greatest")}),
    m3 AS ({_cross("m2", "greatest")}), m4 AS ({_cross("m3", "least")}) SELECT r, c, m AS mask FROM m4"""
)
def morph_open_close(spark, sf):
    x = grid(spark, sf).withColumn("mask", F.col("noise").cast("int"))
    return keyed(focal.closing(focal.opening(x, "mask"), "mask"), "mask")


@query(
    f"""WITH {GRID}, m AS (SELECT t.r, t.c, t.z, max(n.z) AS top FROM g t JOIN g n ON n.r BETWEEN t.r - 2 AND t.r + 2 AND n.c BETWEEN t.c - 2 AND t.c + 2 GROUP BY t.r, t.c, t.z)
    SELECT r, c, z = top AND z > 0 AS is_peak FROM m"""
)
def local_maxima(spark, sf):
    x = grid(spark, sf)
    return keyed(focal.local_maxima(x, spec(x), {"is_peak": ("z", 2)}), "is_peak")


# Local.

_SLOPE_M = "1e0 / (1e0 + pow((slope - 42.5e0) / 12e0, 8e0))"
_FOREST_M = "1e0 / (1e0 + pow((canopy - 0e0) / 50e0, 6e0))"
_MIN = f"least(coalesce({_SLOPE_M}, 0e0), 0.5e0, {_FOREST_M})"
_PRA = f"((1e0 - {_MIN}) * {_MIN} + {_MIN} * ((coalesce({_SLOPE_M}, 0e0) + 0.5e0 + {_FOREST_M}) / 3e0))"


@query(f"WITH {GRID} SELECT r, c, {_rounded('1e0 / (1e0 + pow((canopy - 20e0) / 30e0, 3e0))')} AS m FROM g")
def membership_cauchy(spark, sf):
    return keyed(grid(spark, sf).withColumn("m", fuzzy.cauchy("canopy", 30, 1.5, 20)), "m")


@query(f"WITH {GRID} SELECT r, c, {_rounded('CASE WHEN canopy < 50 THEN 1e0 / (1e0 + pow((canopy - 50e0) / 10e0, 4e0)) ELSE 1e0 / (1e0 + pow((canopy - 50e0) / 25e0, 2e0)) END')} AS m FROM g")
def membership_asymmetric(spark, sf):
    return keyed(grid(spark, sf).withColumn("m", fuzzy.cauchy_two_sided("canopy", 50, 10, 2, 25, 1)), "m")


def _released(spark, sf, scenario: str = "frequent"):
    x = focal.slope(grid(spark, sf), FLAT)
    abc = (12.0, 4.0, 42.5) if scenario == "frequent" else (14.0, 4.0, 40.0)
    return x.withColumn("pra", fuzzy.release_area("slope", F.lit(0.0), "canopy", abc, (50.0, 3.0, 0.0)))


@query(f"WITH {GRID}, {SLOPE} SELECT r, c, {_rounded(_PRA)} AS pra FROM sl")
def fuzzy_and(spark, sf):
    return keyed(_released(spark, sf), "pra")


@query(
    f"""WITH {GRID}, {SLOPE}, p AS (SELECT zone, z, {_PRA} AS pra FROM sl)
    SELECT zone, count(*) AS cells, CAST(sum((pra >= 0.25)::INT) AS BIGINT) AS release_cells, {_rounded("avg(pra)", 6)} AS pra_mean, {_rounded("avg(z)", 4)} AS z_mean FROM p GROUP BY zone"""
)
def pra_binary_by_zone(spark, sf):
    x = _released(spark, sf)
    return x.groupBy("zone").agg(
        F.count(F.lit(1)).alias("cells"), F.sum((F.col("pra") >= 0.25).cast("long")).alias("release_cells"),
        F.round(F.avg("pra"), 6).alias("pra_mean"), F.round(F.avg("z"), 4).alias("z_mean"),
    )


@query(f"WITH {GRID}, {SLOPE} SELECT r, c, {_rounded('CASE WHEN slope < 30 OR slope > 50 THEN 0e0 ELSE coalesce(' + _SLOPE_M + ', 0e0) END')} AS m FROM sl")
def slope_window(spark, sf):
    x = grid(spark, sf)
    return keyed(focal.slope(x, FLAT).withColumn("m", fuzzy.slope_membership("slope", 12, 4, 42.5, clip_lo=30, clip_hi=50)), "m")


@query(f"WITH {GRID} SELECT r, c, {_rounded('greatest(0e0, least(1e0, canopy / 100e0))')} AS f FROM g")
def forest_scale(spark, sf):
    return keyed(grid(spark, sf).withColumn("f", fuzzy.scale_forest("canopy")), "f")


_F = V.area_factor(CELL)


@query(
    f"""WITH {BANDS} SELECT r, c, CASE WHEN F_pra > 0.1613 THEN 3 WHEN E_pra > 0.0087 THEN 2 WHEN E_pra > 0 THEN 1 ELSE 0 END AS pra,
    CASE WHEN F_pra_size > 0.3086 THEN 3 WHEN E_pra_size > 0.0136 THEN 2 WHEN E_pra_size > 0 THEN 1 ELSE 0 END AS size,
    CASE WHEN F_travel_angle > 34.27 THEN 3 WHEN E_travel_angle > 24.005 THEN 2 WHEN E_travel_angle > 0 THEN 1 ELSE 0 END AS alpha,
    CASE WHEN F_rout_flux_area > 375.18 THEN 3 WHEN E_rout_flux_area > 10.299 THEN 2 WHEN E_rout_flux_area > 0 THEN 1 ELSE 0 END AS flux FROM b"""
)
def split_votes(spark, sf):
    x = bands(spark, sf)
    made = {n: V.split_vote(F.col(f"E_{b}"), F.col(f"F_{b}"), *V.SPLIT_CUTS[n]) for n, b in (("pra", "pra"), ("size", "pra_size"), ("alpha", "travel_angle"), ("flux", "rout_flux_area"))}
    return x.select("r", "c", *[v.alias(k) for k, v in made.items()])


@query(
    f"""WITH {BANDS} SELECT r, c, CAST(trunc((greatest(0e0, least(100e0, E_zdelta / 270e0 * 100e0)) + greatest(0e0, least(100e0, E_travel_angle / 90e0 * 100e0))) / 2e0) AS SMALLINT) AS score FROM b"""
)
def alpha_zdelta(spark, sf):
    return bands(spark, sf).select("r", "c", V.angle_score(F.col("E_zdelta"), F.col("E_travel_angle")).alias("score"))


@query(f"WITH {BANDS} SELECT r, c, {_rounded('CASE WHEN F_travel_angle < 25 THEN 0e0 ELSE F_rout_flux_area * ' + repr(AREA) + 'e0 END', 3)} AS area FROM b")
def flux_area(spark, sf):
    return keyed(bands(spark, sf).withColumn("area", V.flux_area(F.col("F_rout_flux_area"), AREA, F.col("F_travel_angle"))), "area", places=3)


@query(
    f"""WITH {BANDS}, {SLOPE}, t AS (SELECT b.r, b.c, coalesce(trunc(slope), 0) AS s, b.canopy AS k, E_runout_prox AS p, E_pra_proximity AS q FROM b JOIN sl ON sl.id = b.id)
    SELECT r, c, {_rounded("(greatest(0e0, least(1e0, (14e0 - s) / 14e0)) + greatest(0e0, least(1e0, (20e0 - s) / 20e0)) + greatest(0e0, least(1e0, k / 60e0)) + greatest(0e0, least(1e0, (CASE WHEN p < 0 THEN 10000e0 ELSE p END) / 200e0)) + greatest(0e0, least(1e0, (CASE WHEN q < 0 THEN 10000e0 ELSE q END) / 500e0))) / 5e0", 4)} AS score FROM t"""
)
def class0_score(spark, sf):
    x = focal.whole_slope(bands(spark, sf), FLAT)
    s = F.coalesce(F.col("slope").cast("double"), F.lit(0.0))
    return keyed(x.withColumn("score", V.zero_score(s, s, F.col("canopy"), F.col("E_runout_prox"), F.col("E_pra_proximity"))), "score", places=4)


_LUT = "(VALUES " + ", ".join(f"({extra + code + k}, {v})" for extra, t in ((0, V.OPEN_TABLE), (100, V.RELEASE_TABLE)) for code, row in t.items() for k, v in enumerate(row)) + ") l(k, v)"


@query(
    f"""WITH {BANDS}, t AS (SELECT r, c, CASE WHEN canopy <= 20 THEN 10 WHEN canopy <= 60 THEN 20 WHEN canopy <= 85 THEN 30 ELSE 40 END AS f, CAST(least(4, floor(E_zdelta / 60e0)) AS INT) AS m, CASE WHEN F_pra > 0.2 THEN 100 ELSE 0 END AS p FROM b)
    SELECT r, c, v AS class FROM t LEFT JOIN {_LUT} ON k = f + m + p"""
)
def lut_reclass(spark, sf):
    x = bands(spark, sf)
    m = F.least(F.lit(4), F.floor(F.col("E_zdelta") / 60).cast("int"))
    return x.select("r", "c", V.forest_lookup(m, V.forest_code(F.col("canopy")), F.when(F.col("F_pra") > 0.2, 100).otherwise(0)).alias("class"))


# Zonal.


def _zoned(spark, sf):
    return focal.aspect(_released(spark, sf), FLAT), FLAT


@query(
    f"""WITH {GRID}, {SLOPE}, t AS (SELECT zone, z, slope, {_PRA} AS pra, {_ASPECT} AS a FROM sl),
    m AS (SELECT zone, count(*) * {AREA!r}e0 AS n, avg(CASE WHEN pra > 0 THEN pra END) AS pm, max(pra) AS px, min(z) AS zl, max(z) AS zh, avg(z) AS zm, avg(slope) AS sm, max(slope) AS sx,
      (degrees(atan2(avg(sin(radians(a))), avg(cos(radians(a))))) + 360e0) % 360e0 AS ad FROM t GROUP BY zone)
    SELECT zone, round(n, 1) AS area_m2, round(round(n, 1) / 10000e0, 3) AS area_ha, round(coalesce(pm, 0e0), 4) AS pra_mean, round(coalesce(px, 0e0), 4) AS pra_max,
      round(zl, 1) AS elev_min, round(zh, 1) AS elev_max, round(zm, 1) AS elev_mean, round(zh - zl, 1) AS relief_m, round(sm, 1) AS slope_mean, round(sx, 1) AS slope_max, round(ad, 1) AS aspect_deg,
      (['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'])[CAST(floor(((ad + 22.5e0) % 360e0) / 45e0) AS INT) + 1] AS aspect_class,
      round(round(coalesce(pm, 0e0), 4) * round(round(n, 1) / 10000e0, 3), 3) AS release_potential FROM m"""
)
def zonal_metrics(spark, sf):
    x, s = _zoned(spark, sf)
    return zonal.zonal_metrics(x, s, "zone")


@query(f"WITH {GRID}, t AS (SELECT zone, quantile_cont(z, 0.95) AS q, count(z) AS n FROM g WHERE canopy >= 30 GROUP BY zone) SELECT zone, CASE WHEN n >= 100 THEN {_rounded('q', 4)} END AS treeline, n AS n_forest FROM t")
def treeline_p95(spark, sf):
    x = zonal.treeline_percentile(grid(spark, sf), "zone", least=100)
    return x.withColumn("treeline", F.round("treeline", 4))


@query(
    f"""WITH {GRID}, e AS (SELECT min(z) AS lo, max(z) AS hi FROM g), b AS (SELECT least(floor((z - lo) / 50e0), greatest(floor((hi - lo) / 50e0) - 1, 0)) AS k, lo, canopy FROM g, e),
    t AS (SELECT k, lo, count(*) AS n, sum((canopy >= 30)::INT) AS f FROM b GROUP BY k, lo) SELECT round(max(lo + (k + 0.5e0) * 50e0), 4) AS treeline FROM t WHERE n > 50 AND f / n >= 0.3"""
)
def treeline_fraction_limit(spark, sf):
    return zonal.treeline_fraction(grid(spark, sf)).select(F.round("treeline", 4).alias("treeline"))


@query(
    """WITH s AS (SELECT n_name AS name, r_name AS range, CASE WHEN n_regionkey < 2 THEN 'A' ELSE 'B' END AS grp, n_nationkey AS k FROM nation JOIN region ON n_regionkey = r_regionkey),
    t AS (SELECT name, range, grp, avg(c_acctbal) AS tl, CAST(count(*) AS DOUBLE) AS n FROM s JOIN customer ON c_nationkey = k GROUP BY ALL),
    lim AS (SELECT median(n) AS m FROM t), a AS (SELECT range, median(tl) AS v FROM t, lim WHERE n >= m GROUP BY range), b AS (SELECT grp, median(tl) AS v FROM t, lim WHERE n >= m GROUP BY grp)
    SELECT t.name, t.range, t.grp AS "group", round(coalesce(CASE WHEN n >= m THEN tl END, a.v, b.v), 4) AS treeline FROM t CROSS JOIN lim LEFT JOIN a ON a.range = t.range LEFT JOIN b ON b.grp = t.grp"""
)
def treeline_fallback(spark, sf):
    t = {n: spark.read.parquet(f"{sf}/{n}.parquet") for n in ("nation", "region", "customer")}
    x = t["customer"].join(F.broadcast(t["nation"]), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(t["region"]), F.col("n_regionkey") == F.col("r_regionkey"))
    g = x.groupBy(F.col("n_name").alias("name"), F.col("r_name").alias("range"), F.when(F.col("n_regionkey") < 2, "A").otherwise("B").alias("group")).agg(
        F.avg("c_acctbal").alias("treeline"), F.count(F.lit(1)).cast("double").alias("n_forest_kpx")
    )
    least = g.agg(F.median("n_forest_kpx")).first()[0]
    return zonal.treeline_fallback(g, least).withColumn("treeline", F.round("treeline", 4))


@query(f"WITH {GRID}, e AS (SELECT min(z) AS lo, max(z) AS hi FROM g) SELECT r, c, {_rounded('(z - lo) / (hi - lo + 1e-8)')} AS z_norm FROM g, e")
def normalised_band(spark, sf):
    return keyed(zonal.normalised(grid(spark, sf), ["z"]), "z_norm")


@query(f"WITH {GRID}, {SLOPE}, b AS (SELECT zone, CAST(floor(z / 30e0) AS BIGINT) AS bin, slope FROM sl) SELECT zone, bin, {_rounded('avg(slope)', 4)} AS m FROM b GROUP BY zone, bin")
def elevation_profile(spark, sf):
    x = grid(spark, sf)
    return zonal.elevation_profile(focal.slope(x, FLAT), "zone").withColumn("m", F.round("m", 4) + 0.0)


_GAUSS = [math.exp(-0.5 * (d / 1.5) ** 2) for d in range(-6, 7)]


@query(
    f"""WITH {GRID}, {SLOPE}, b AS (SELECT zone, CAST(floor(z / 30e0) AS BIGINT) AS bin, avg(slope) AS m FROM sl GROUP BY zone, bin),
    e AS (SELECT zone, min(bin) AS lo, max(bin) - min(bin) + 1 AS n, coalesce(avg(m), 0e0) AS mean FROM b GROUP BY zone),
    y AS (SELECT e.zone, lo, n, t.i, coalesce(m, mean) AS v FROM e JOIN range(0, 1000) t(i) ON t.i < n LEFT JOIN b ON b.zone = e.zone AND b.bin = lo + t.i),
    k(d, w) AS (VALUES {", ".join(f"({d}, {w / sum(_GAUSS):.20f}e0)" for d, w in zip(range(-6, 7), _GAUSS, strict=True))}),
    q AS (SELECT zone, lo, n, i, w, CASE WHEN n < 6 THEN greatest(0, least(n - 1, i + d)) WHEN i + d < 0 THEN -1 - i - d WHEN i + d >= n THEN 2 * n - 1 - i - d ELSE i + d END AS j FROM y, k),
    s AS (SELECT q.zone, q.lo, q.n, q.i, sum(w * y.v) AS v FROM q JOIN y ON y.zone = q.zone AND y.i = q.j GROUP BY q.zone, q.lo, q.n, q.i),
    a AS (SELECT s.zone, s.i, max(CASE WHEN p.i < s.i THEN p.i END) AS l, min(CASE WHEN p.i > s.i THEN p.i END) AS h FROM s LEFT JOIN s p ON p.zone = s.zone AND p.v < s.v GROUP BY s.zone, s.i),
    r AS (SELECT a.zone, a.i, max(CASE WHEN p.i <= a.i THEN p.v END) AS rl, max(CASE WHEN p.i >= a.i THEN p.v END) AS rh FROM a JOIN s p ON p.zone = a.zone AND p.i > coalesce(l, -1) AND p.i < coalesce(h, 100000) GROUP BY a.zone, a.i)
    SELECT s.zone, (s.lo + s.i + 0.5e0) * 30e0 AS bench FROM s JOIN r ON r.zone = s.zone AND r.i = s.i JOIN s f ON f.zone = s.zone AND f.i = s.i - 1 JOIN s g ON g.zone = s.zone AND g.i = s.i + 1
    WHERE s.v < f.v AND s.v <= g.v AND least(rl, rh) - s.v >= 0.2"""
)
def bench_elevations(spark, sf):
    return zonal.bench_profile(focal.slope(grid(spark, sf), FLAT), "zone", prominence=0.2)


# Regions and distances.


def _labels_sql(mask: str, shifts: str, rest: str) -> str:
    return (
        f"WITH RECURSIVE {GRID}, m AS (SELECT id, r, c FROM g WHERE {mask}), e AS (SELECT a.id AS a, b.id AS b FROM m a JOIN m b ON {shifts}), "
        "cc(id, label) USING KEY (id) AS (SELECT id, id FROM m UNION (SELECT e.a, min(x.label) FROM cc x JOIN e ON e.b = x.id JOIN recurring.cc y ON y.id = e.a WHERE x.label < y.label GROUP BY e.a)) "
        f"{rest}"
    )


_EIGHT = "abs(a.r - b.r) <= 1 AND b.c BETWEEN a.c - 1 AND a.c + 1 AND b.r BETWEEN a.r - 1 AND a.r + 1 AND a.id <> b.id"
_FOUR = "((b.r = a.r AND abs(b.c - a.c) = 1) OR (b.c = a.c AND abs(b.r - a.r) = 1)) AND b.id BETWEEN a.id - 120 AND a.id + 120"


@query(_labels_sql("canopy <= 30", _EIGHT, "SELECT g.r, g.c, label FROM cc JOIN g ON g.id = cc.id"))
def components_8(spark, sf):
    x = grid(spark, sf)
    return regions.connected(x.where("canopy <= 30"), spec(x), None, 8).select("r", "c", "label")


@query(_labels_sql("noise", _FOUR, "SELECT g.r, g.c, label FROM cc JOIN g ON g.id = cc.id"))
def components_4(spark, sf):
    x = grid(spark, sf)
    return regions.connected(x.where("noise"), spec(x), None, 4).select("r", "c", "label")


@query(
    _labels_sql(
        "noise", _FOUR,
        f", s AS (SELECT label, count(*) AS n FROM cc GROUP BY label), k AS (SELECT id FROM cc JOIN s ON s.label = cc.label WHERE n >= {max(1, round(5000 / AREA))}) SELECT g.r, g.c, CASE WHEN noise THEN (k.id IS NOT NULL)::INT ELSE 0 END AS sieved FROM g LEFT JOIN k ON k.id = g.id",
    )
)
def sieve(spark, sf):
    x = grid(spark, sf).withColumn("mask", F.col("noise").cast("int"))
    return regions.sieve(x, spec(x), "mask", 5000.0).select("r", "c", "sieved")


@query(
    _labels_sql(
        "canopy <= 30", _EIGHT,
        f", s AS (SELECT label, count(*) AS n FROM cc GROUP BY label) SELECT g.r, g.c, CASE WHEN n IS NULL THEN 0e0 ELSE round(least(100e0, n * {AREA!r}e0 / 10000e0), 4) END AS gap_area_ha FROM g LEFT JOIN cc ON cc.id = g.id LEFT JOIN s ON s.label = cc.label",
    )
)
def gap_area(spark, sf):
    x = grid(spark, sf).withColumnRenamed("canopy", "canopy_pct").withColumn("valid", F.lit(True))
    return keyed(regions.gap_metrics(x, spec(x), with_width=False), "gap_area_ha", places=4)


_NEAREST = "t AS (SELECT r, c FROM g WHERE canopy <= 10), d AS (SELECT g.r, g.c, min((g.r - t.r) * (g.r - t.r) + (g.c - t.c) * (g.c - t.c)) AS d2 FROM g, t GROUP BY g.r, g.c)"


@query(f"WITH {GRID}, {_NEAREST} SELECT r, c, {_rounded('sqrt(d2)')} AS distance FROM d")
def edt(spark, sf):
    x = grid(spark, sf)
    return keyed(distance.distance_to(x, spec(x), F.col("canopy") <= 10), "distance")


@query(f"WITH {GRID}, {_NEAREST} SELECT r, c, CAST(round(sqrt(d2) * 21.34e0) AS SMALLINT) AS proximity FROM d")
def proximity(spark, sf):
    x = grid(spark, sf)
    return distance.proximity(x, spec(x), F.col("canopy") <= 10, whole=True).select("r", "c", "proximity")


@query(
    f"""WITH {GRID}, t AS (SELECT r, c, id FROM g WHERE canopy <= 10),
    d AS (SELECT g.r, g.c, arg_min(t.id, ((g.r - t.r) * (g.r - t.r) + (g.c - t.c) * (g.c - t.c)) * 1000000000 + t.r * 1000 + t.c) AS nearest FROM g, t GROUP BY g.r, g.c) SELECT * FROM d"""
)
def nearest_survivor(spark, sf):
    x = grid(spark, sf)
    return distance.nearest_feature(x, spec(x), F.col("canopy") <= 10, "id", "nearest").select("r", "c", "nearest")


_ZONES = "z AS (SELECT r, c, (r // 10) * 12 + (c // 10) AS label FROM g)"


@query(
    f"""WITH {GRID}, {_ZONES}, p AS (SELECT a.label AS x, b.label AS y, (a.r = b.r OR a.c = b.c)::INT AS side FROM z a JOIN z b ON b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1 WHERE a.label < b.label)
    SELECT x AS a, y AS b, CAST(sum(side) AS BIGINT) AS sides FROM p GROUP BY x, y"""
)
def region_adjacency(spark, sf):
    x = grid(spark, sf).withColumn("label", F.floor(F.col("r") / 10) * 12 + F.floor(F.col("c") / 10))
    return regions.adjacency(x.select("r", "c", "label"))


_MERGE = f"""WITH RECURSIVE {GRID}, m AS (SELECT id, r, c, KIND AS k FROM g), e AS (SELECT a.id AS a, b.id AS b FROM m a JOIN m b ON {_FOUR} AND a.k = b.k),
    cc(id, label) USING KEY (id) AS (SELECT id, id FROM m UNION (SELECT e.a, min(x.label) FROM cc x JOIN e ON e.b = x.id JOIN recurring.cc y ON y.id = e.a WHERE x.label < y.label GROUP BY e.a)),
    l AS (SELECT r, c, label FROM cc JOIN g ON g.id = cc.id), s AS (SELECT label, count(*) * {AREA!r}e0 AS area FROM l GROUP BY label),
    t AS (SELECT a.label AS a, b.label AS b, sum((a.r = b.r OR a.c = b.c)::INT) AS sides FROM l a JOIN l b ON b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1 AND a.label <> b.label GROUP BY a.label, b.label),
    te AS (SELECT t.a, t.b FROM t JOIN s x ON x.label = t.a JOIN s y ON y.label = t.b WHERE x.area < LEAST AND y.area < LEAST),
    kk(id, root) USING KEY (id) AS (SELECT label, label FROM s UNION (SELECT te.a, min(x.root) FROM kk x JOIN te ON te.b = x.id JOIN recurring.kk y ON y.id = te.a WHERE x.root < y.root GROUP BY te.a)),
    cl AS (SELECT root, sum(area) AS total, arg_max(id, area * 1000000 - id) AS name FROM kk JOIN s ON s.label = kk.id GROUP BY root),
    mem AS (SELECT id AS label, name, total FROM kk JOIN cl ON cl.root = kk.root),
    br AS (SELECT x.name AS small, y.name AS large, sum(sides) AS n FROM t JOIN mem x ON x.label = t.a JOIN mem y ON y.label = t.b WHERE x.name <> y.name AND x.total < LEAST AND y.total >= LEAST GROUP BY x.name, y.name)"""


@query(
    _MERGE.replace("KIND", "floor(canopy / 25)").replace("LEAST", "20000")
    + """, best AS (SELECT small, arg_max(large, n * 100000000 - large) AS goes FROM br GROUP BY small)
    SELECT label, coalesce(goes, name) AS merged FROM mem LEFT JOIN best ON best.small = mem.name"""
)
def merge_small_regions(spark, sf):
    x = grid(spark, sf)
    s = spec(x)
    labels = regions.connected(x.withColumn("k", F.floor(F.col("canopy") / 25)), s, "k", 4).select("r", "c", "label")
    return regions.merge_small(labels, s, 20000.0)


@query(
    _MERGE.replace("KIND", "floor(canopy / 25) * 2 + noise::INT").replace("LEAST", "1500")
    + f""", lg AS (SELECT name AS large, total, row_number() OVER (ORDER BY name) AS k FROM (SELECT DISTINCT name, total FROM mem WHERE total >= 1500)),
    cl2 AS (SELECT br.small, any_value(cl.total) AS total, list(struct_pack(n := n, large := -large, k := lg.k)) AS may, row_number() OVER (ORDER BY any_value(cl.root)) AS i
        FROM br JOIN cl ON cl.name = br.small JOIN lg USING (large) GROUP BY br.small),
    step(i, areas, small, goes) AS (
        SELECT 0, (SELECT list(total ORDER BY k) FROM lg), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT)
        UNION ALL SELECT cl2.i, CASE WHEN pick IS NULL THEN areas ELSE list_transform(areas, lambda v, j: CASE WHEN j = pick.k THEN v + cl2.total ELSE v END) END, cl2.small, -pick.large
        FROM step JOIN (SELECT * FROM cl2) cl2 ON cl2.i = step.i + 1, LATERAL (SELECT list_max(list_filter(cl2.may, lambda x: step.areas[x.k] + cl2.total <= {12 * AREA!r}e0)) AS pick))
    SELECT label, coalesce(goes, name) AS merged FROM mem LEFT JOIN step ON step.small = mem.name"""
)
def merge_small_capped(spark, sf):
    """Regions grow as they take small ones, up to a cap of twelve cells."""
    x = grid(spark, sf)
    s = spec(x)
    labels = regions.connected(x.withColumn("k", F.floor(F.col("canopy") / 25) * 2 + F.col("noise").cast("int")), s, "k", 4).select("r", "c", "label")
    return regions.merge_small(labels, s, 1500.0, 12 * AREA)


_MINIMA = " ".join(f"WHEN {k} THEN {max(1, round(v / AREA))}" for k, v in classify.MINIMUM_M2.items())


@query(
    f"""WITH RECURSIVE {GRID}, m AS (SELECT id, r, c, CAST(floor(z / 60e0) AS INT) % 5 AS k FROM g), e AS (SELECT a.id AS a, b.id AS b FROM m a JOIN m b ON {_EIGHT} AND a.k = b.k),
    cc(id, label) USING KEY (id) AS (SELECT id, id FROM m UNION (SELECT e.a, min(x.label) FROM cc x JOIN e ON e.b = x.id JOIN recurring.cc y ON y.id = e.a WHERE x.label < y.label GROUP BY e.a)),
    s AS (SELECT label, count(*) AS n FROM cc GROUP BY label), j AS (SELECT m.*, n >= CASE k {_MINIMA} END AS stays FROM m JOIN cc ON cc.id = m.id JOIN s ON s.label = cc.label),
    near AS (SELECT a.id, arg_min(b.k, ((a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c)) * 1000000000 + b.r * 1000 + b.c) AS k FROM j a, j b WHERE NOT a.stays AND b.stays GROUP BY a.id)
    SELECT r, c, CASE WHEN stays THEN j.k ELSE coalesce(near.k, j.k) END AS class FROM j LEFT JOIN near ON near.id = j.id"""
)
def mmu_clean(spark, sf):
    x = grid(spark, sf).withColumn("k", F.floor(F.col("z") / 60).cast("int") % 5)
    return regions.mmu_clean(x, spec(x), "k", classify.MINIMUM_M2).select("r", "c", F.col("cleaned").alias("class"))


@query(
    _labels_sql(
        "noise", _FOUR,
        f" SELECT label, count(*) AS cells, round(count(*) * {AREA!r}e0, 2) AS area_m2, min(g.r) AS r_min, max(g.r) AS r_max, min(g.c) AS c_min, max(g.c) AS c_max FROM cc JOIN g ON g.id = cc.id GROUP BY label",
    )
)
def polygonize(spark, sf):
    x = grid(spark, sf)
    got, _ = regions.polygonize(x.withColumn("v", F.when(F.col("noise"), 1)), spec(x), "v")
    return got.drop("value").withColumn("area_m2", F.round("area_m2", 2))


@query()
def region_outlines(spark, sf):
    x = grid(spark, sf)
    s = spec(x)
    _, members = regions.polygonize(x.withColumn("v", F.when(F.col("canopy") <= 30, 1)), s, "v")
    return regions.outlines(members, s)


@query(
    _labels_sql(
        "canopy <= 30", _FOUR,
        f""", l AS (SELECT r, c, label FROM cc JOIN g ON g.id = cc.id),
        n4 AS (SELECT a.label, count(*) AS n FROM l a JOIN l b ON a.label = b.label AND (b.r = a.r AND b.c = a.c + 1 OR b.r = a.r + 1 AND b.c = a.c) GROUP BY a.label),
        corner AS (SELECT label, r + dr AS r, c + dc AS c, count(*) AS n, sum(CASE WHEN dr = dc THEN 1 ELSE -1 END) AS d FROM l, range(2) x(dr), range(2) y(dc) GROUP BY ALL),
        k AS (SELECT label, sum(CASE WHEN n IN (1, 3) THEN 1 WHEN n = 2 AND abs(d) = 2 THEN 2 ELSE 0 END) AS vertices, count(*) FILTER (n = 4) AS full_blocks FROM corner GROUP BY label),
        s AS (SELECT label, count(*) AS n FROM l GROUP BY label)
        SELECT s.label, CAST(2 - (s.n - coalesce(n4.n, 0) + full_blocks) AS BIGINT) AS rings, CAST(vertices AS BIGINT) AS vertices,
        round(s.n * {AREA!r}e0, 2) AS area_m2, round((4 * s.n - 2 * coalesce(n4.n, 0)) * {CELL!r}e0, 2) AS border_m FROM s LEFT JOIN n4 USING (label) JOIN k USING (label)""",
    )
)
def outline_rings(spark, sf):
    """What the outlines enclose, by their own points: rings (outer and holes),
    corners, area by the shoelace formula, length."""
    x = grid(spark, sf)
    s = spec(x)
    _, members = regions.polygonize(x.withColumn("v", F.when(F.col("canopy") <= 30, 1)), s, "v")
    rings = regions.outlines(members, s, 64).select("label", F.explode(F.expr("regexp_extract_all(wkt, '\\\\(([^()]+)\\\\)', 1)")).alias("ring"))
    points = F.transform(F.split("ring", ", "), lambda p: F.split(p, " ").cast("array<double>"))
    pairs = F.arrays_zip(F.slice("p", 1, F.size("p") - 1).alias("a"), F.slice("p", 2, F.size("p") - 1).alias("b"))
    x = rings.withColumn("p", points).select("label", pairs.alias("q"))
    total = lambda f: F.aggregate("q", F.lit(0.0), lambda v, q: v + f(q["a"], q["b"]))
    x = x.select("label", F.size("q").alias("n"), total(lambda a, b: (b[0] * a[1] - a[0] * b[1]) / 2).alias("area"), total(lambda a, b: F.abs(b[0] - a[0]) + F.abs(b[1] - a[1])).alias("len"))
    return x.groupBy("label").agg(F.count(F.lit(1)).alias("rings"), F.sum("n").alias("vertices"), F.round(F.sum("area"), 2).alias("area_m2"), F.round(F.sum("len"), 2).alias("border_m"))


@query(f"WITH {GRID} SELECT r, c, CASE WHEN (c + 0.5e0) * 21.34e0 > 400 AND (c + 0.5e0) * 21.34e0 < 1500 AND (r + 0.5e0) * 21.34e0 > 100 AND (r + 0.5e0) * 21.34e0 < 900 THEN 2 WHEN (c + 0.5e0) * 21.34e0 < 700 AND (r + 0.5e0) * 21.34e0 < 400 THEN 1 ELSE 0 END AS burned FROM g")
def rasterize(spark, sf):
    x = grid(spark, sf)
    shapes = [([(-1, 1), (700, 1), (700, -400), (-1, -400)], 1), ([(400, -100), (1500, -100), (1500, -900), (400, -900)], 2)]
    return regions.rasterize(x, spec(x), shapes, kind="int").select("r", "c", F.coalesce("burned", F.lit(0)).alias("burned"))


@query(
    f"""WITH {GRID}, b AS (SELECT g.r, g.c, max(o.id) AS last, count(*) AS n FROM g JOIN g o ON g.r BETWEEN o.r AND o.r + 4 AND g.c BETWEEN o.c AND o.c + 6
        AND (g.c - o.c + 0.5e0) / (1.3e0 * (o.id % 4 + 1) + 0.4e0) + (g.r - o.r + 0.5e0) / (0.9e0 * (o.id % 4 + 1) + 0.3e0) < 1 GROUP BY g.r, g.c)
    SELECT g.r, g.c, last, coalesce(n, 0) AS shapes FROM g LEFT JOIN b ON b.r = g.r AND b.c = g.c"""
)
def polygons_last_wins(spark, sf):
    """A triangle per order, of four sizes: the last one over each cell, and how
    many there are."""
    x = grid(spark, sf)
    s, k = spec(x), F.col("id") % 4 + 1
    corner = lambda right, down: F.array((F.col("c") + right) * CELL, -(F.col("r") + down) * CELL)
    ring = F.array(corner(F.lit(0.0), F.lit(0.0)), corner(k * 1.3 + 0.4, F.lit(0.0)), corner(F.lit(0.0), k * 0.9 + 0.3))
    shapes = x.select("id", F.array(ring).alias("rings"), F.col("id").alias("value"), F.col("id").cast("string").alias("name"))
    n = vectors.burn(x, s, shapes).groupBy("r", "c").agg(F.count(F.lit(1)).alias("n"))
    return regions.rasterize(x, s, shapes, "last").join(n, ["r", "c"], "left").select("r", "c", "last", F.coalesce("n", F.lit(0)).alias("shapes"))


@query(f"WITH {GRID} SELECT id, r, c FROM g WHERE EXISTS (SELECT 1 FROM g m WHERE m.r = g.r AND m.c = g.c AND m.zone < 5)")
def aoi_clip_semi(spark, sf):
    x = grid(spark, sf)
    return regions.clip_to(x, x.where("zone < 5")).select("id", "r", "c")


@query(f"WITH {GRID} SELECT r, c FROM g WHERE canopy <= 30 AND NOT EXISTS (SELECT 1 FROM g m WHERE m.id = g.id AND m.noise)")
def uncovered_anti(spark, sf):
    x = grid(spark, sf)
    return regions.uncovered(x.where("canopy <= 30"), x.where("noise").select("r", "c", F.col("id").alias("label")), spec(x)).select("r", "c")


# Alignment.


_UTM = "EPSG:32611", 552000.0, 5660000.0  # where the grid is taken to lie
_DEGREES = 130, 0.0003, -116.257, 51.092


def _utm_sql() -> str:
    """Northing and easting of lon, lat by the same series, written out."""
    f = 1 / 298.257223563
    n = f / (2 - f)
    radius = 0.9996 * 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    k = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
    e = math.sqrt(f * (2 - f))
    width, cell, x0, y0 = _DEGREES
    num = lambda v: repr(v) if "e" in repr(v) else f"{v!r}e0"
    series = lambda a, b, first: " + ".join([first, *(f"{num(v)} * {a}({2 * j} * xi) * {b}({2 * j} * eta)" for j, v in enumerate(k, 1))])
    return f"""t0 AS (SELECT r, c, {x0}e0 + (c + 0.5e0) * {cell}e0 AS lon, {y0}e0 - (r + 0.5e0) * {cell}e0 AS lat
        FROM (SELECT max(r) + 1 AS h FROM g), range(CAST(ceil((h * 21.34e0 + 200) / 33.0e0) AS BIGINT)) a(r), range({width}) b(c)),
    t1 AS (SELECT r, c, radians(lon + 117e0) AS lam, sinh(atanh(sin(radians(lat))) - {e!r}e0 * atanh({e!r}e0 * sin(radians(lat)))) AS t FROM t0),
    t2 AS (SELECT r, c, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM t1),
    t3 AS (SELECT r, c, ({_UTM[2]}e0 - {radius!r}e0 * ({series("sin", "cosh", "xi")})) / 21.34e0 - 0.5e0 AS fr,
        (500000e0 + {radius!r}e0 * ({series("cos", "sinh", "eta")}) - {_UTM[1]}e0) / 21.34e0 - 0.5e0 AS fc FROM t2)"""


@query(
    f"""WITH {GRID}, {_utm_sql()}, w AS (SELECT t3.r, t3.c, g.z, CASE WHEN i = 1 THEN fr - floor(fr) ELSE 1 - fr + floor(fr) END * CASE WHEN j = 1 THEN fc - floor(fc) ELSE 1 - fc + floor(fc) END AS w
        FROM t3, range(2) a(i), range(2) b(j), g WHERE g.r = floor(fr) + i AND g.c = floor(fc) + j)
    SELECT r, c, round(sum(w * z) / sum(w), 3) + 0e0 AS z FROM w WHERE w > 0 GROUP BY r, c"""
)
def reproject_bilinear(spark, sf):
    """The grid, taken to lie in a UTM zone, on a grid of degrees."""
    x = grid(spark, sf)
    s = replace(spec(x), crs=_UTM[0], x0=_UTM[1], y0=_UTM[2])
    width, cell, x0, y0 = _DEGREES
    target = GridSpec(width, math.ceil((s.height * CELL + 200) / 33.0), cell, x0, y0, "EPSG:4326")
    return keyed(align.align(x, s, target, "z", error=0.0).where("z is not null"), "z", places=3)


@query(
    f"""WITH {GRID}, t AS (SELECT DISTINCT r // 2 AS r, c // 2 AS c FROM g),
    k AS (SELECT t.r, t.c, g.z, (1e0 - abs(g.r - (t.r * 2e0 + 0.5e0))) * (1e0 - abs(g.c - (t.c * 2e0 + 0.5e0))) AS wt FROM t JOIN g ON g.r BETWEEN t.r * 2 AND t.r * 2 + 1 AND g.c BETWEEN t.c * 2 AND t.c * 2 + 1)
    SELECT r, c, round(sum(z * wt) / sum(wt), 4) AS z FROM k GROUP BY r, c"""
)
def align_bilinear(spark, sf):
    x = grid(spark, sf)
    s = spec(x)
    return keyed(align.align(x, s, s.coarser(2), "z").where("z is not null"), "z", places=4)


@query(f"WITH {GRID}, t AS (SELECT g.*, f.i AS factor FROM g, (VALUES (2), (4), (8), (16)) f(i)) SELECT CAST(r // factor AS BIGINT) AS r, CAST(c // factor AS BIGINT) AS c, factor, round(avg(canopy), 4) AS canopy FROM t GROUP BY r // factor, c // factor, factor")
def overview_pyramid(spark, sf):
    x = align.pyramid(grid(spark, sf), "canopy")
    return x.select("r", "c", "factor", F.round("canopy", 4).alias("canopy"))


@query(f"WITH {GRID} SELECT CAST(r // 4 AS BIGINT) AS r, CAST(c // 4 AS BIGINT) AS c, zone FROM g WHERE r % 4 = 2 AND c % 4 = 2")
def overview_nearest(spark, sf):
    return align.overview(grid(spark, sf), 4, "zone", "nearest")


@query(f"WITH {GRID}, lim AS (SELECT max(r) AS h, max(c) AS w FROM g) SELECT a.i AS r, b.i AS c, coalesce(CASE WHEN g.noise THEN g.z END, -1e0) AS z FROM lim, range(0, h + 1) a(i), range(0, w + 1) b(i) LEFT JOIN g ON g.r = a.i AND g.c = b.i")
def align_fill(spark, sf):
    x = grid(spark, sf)
    s = spec(x)
    return align.align(x.where("noise"), s, s, "z", "nearest", fill=-1.0)


# Classifiers.


def _vote_cells(spark, sf):
    x = bands(spark, sf).withColumnRenamed("canopy", "canopy_pct")
    s = spec(x)
    return focal.whole_slope(x, s), s


_VOTES = f"""v AS (SELECT *, CASE WHEN F_pra > 0.1613 THEN 3 WHEN E_pra > 0.0087 THEN 2 WHEN E_pra > 0 THEN 1 ELSE 0 END AS v1, (E_pra > 0 OR F_pra > 0)::INT AS w1,
      CASE WHEN F_pra_size > 0.3086 THEN 3 WHEN E_pra_size > 0.0136 THEN 2 WHEN E_pra_size > 0 THEN 1 ELSE 0 END AS v2, (E_pra_size > 0 OR F_pra_size > 0)::INT AS w2,
      CASE WHEN F_travel_angle > 34.27 THEN 3 WHEN E_travel_angle > 24.005 THEN 2 WHEN E_travel_angle > 0 THEN 1 ELSE 0 END AS v3, (E_travel_angle > 0 OR F_travel_angle > 0)::INT AS w3,
      CASE WHEN F_rout_flux_area > 375.18 THEN 3 WHEN E_rout_flux_area > 10.299 THEN 2 WHEN E_rout_flux_area > 0 THEN 1 ELSE 0 END AS v4, (E_rout_flux_area > 0 OR F_rout_flux_area > 0)::INT AS w4,
      (coarse > 8.029)::INT + (coarse > 17.933)::INT + (coarse > 31.419)::INT AS v5, (gap > 0)::INT + (gap > 54.9)::INT + (gap > 100)::INT AS v6, 2 * (wood >= 30)::INT AS w6 FROM t),
    k AS (SELECT *, greatest(0, least(4, round_even((v1 * w1 + v2 * w2 + v3 * w3 + v4 * w4 + v5 + v6 * w6) / (w1 + w2 + w3 + w4 + 1 + w6)::DOUBLE, 0))) AS base,
      (greatest(0e0, least(1e0, (14e0 - coarse) / 14e0)) + greatest(0e0, least(1e0, (20e0 - s) / 20e0)) + greatest(0e0, least(1e0, canopy / 60e0)) + greatest(0e0, least(1e0, E_runout_prox / 200e0)) + greatest(0e0, least(1e0, (CASE WHEN E_pra_proximity < 0 THEN 10000e0 ELSE E_pra_proximity END) / 500e0))) / 5e0 AS score FROM v)
    SELECT r, c, CASE WHEN NOT ok THEN -1 WHEN score >= 0.6 THEN 0 ELSE greatest(base, (E_zdelta > 0)::INT, 2 * (F_zdelta > 0)::INT, 3 * (F_rout_flux_area >= 500)::INT, CASE WHEN s > 45 AND canopy <= 20 THEN 4 ELSE 0 END, CASE WHEN coarse >= 45 THEN 4 WHEN coarse >= 40 THEN 3 ELSE 0 END) END::TINYINT AS class FROM k"""


def _context(width: int = 15) -> str:
    """Means of slope and canopy over mirrored windows, and gap areas."""
    k = width // 2
    at = lambda v, n: f"CASE WHEN {v} < 0 THEN -1 - ({v}) WHEN {v} >= {n} THEN 2 * {n} - 1 - ({v}) ELSE {v} END"
    return (
        f"lim AS (SELECT max(r) + 1 AS h, max(c) + 1 AS w FROM g), d AS (SELECT a.i AS dr, b.i AS dc FROM range(-{k}, {k + 1}) a(i), range(-{k}, {k + 1}) b(i)), "
        f"pp AS (SELECT g.id, {at('g.r + dr', 'h')} AS pr, {at('g.c + dc', 'w')} AS pc FROM g, d, lim), st AS (SELECT id, r, c, coalesce(trunc(slope), 0e0) AS s, slope IS NOT NULL AS ok, canopy FROM sl), "
        f"ctx AS (SELECT pp.id, sum(coalesce(n.s, 0e0)) / {width * width}e0 AS coarse, sum(coalesce(n.canopy, 0e0)) / {width * width}e0 AS wood FROM pp LEFT JOIN st n ON n.r = pr AND n.c = pc GROUP BY pp.id)"
    )


@query(
    f"""WITH RECURSIVE {BANDS}, {SLOPE}, {_context()}, m AS (SELECT id, r, c FROM st WHERE canopy <= 30 AND ok), e AS (SELECT a.id AS a, b.id AS b FROM m a JOIN m b ON {_EIGHT}),
    cc(id, label) USING KEY (id) AS (SELECT id, id FROM m UNION (SELECT e.a, min(x.label) FROM cc x JOIN e ON e.b = x.id JOIN recurring.cc y ON y.id = e.a WHERE x.label < y.label GROUP BY e.a)),
    gp AS (SELECT cc.id, least(100e0, n * {AREA!r}e0 / 10000e0) AS gap FROM cc JOIN (SELECT label, count(*) AS n FROM cc GROUP BY label) q ON q.label = cc.label),
    t AS (SELECT b.*, st.s, st.ok, coarse, wood, coalesce(gap, 0e0) AS gap FROM b JOIN st ON st.id = b.id JOIN ctx ON ctx.id = b.id LEFT JOIN gp ON gp.id = b.id), {_VOTES}"""
)
def classify_votes(spark, sf):
    x, s = _vote_cells(spark, sf)
    return classify.classify_votes(x, s).select("r", "c", F.coalesce("ates", F.lit(-1).cast("tinyint")).alias("class"))


@query(
    f"""WITH {BANDS}, {SLOPE}, t AS (SELECT b.*, coalesce(trunc(slope), 0) AS s, slope IS NOT NULL AS ok, (b.id % 400) / 10e0 AS coarse, (b.id % 130)::DOUBLE AS gap, (b.id % 70)::DOUBLE AS wood FROM b JOIN sl ON sl.id = b.id), {_VOTES}"""
)
def classify_votes_prepared(spark, sf):
    """Votes, floors and ceiling over given context bands."""
    x, s = _vote_cells(spark, sf)
    x = x.withColumns(
        {
            "coarse_slope": (F.col("id") % 400) / 10.0, "gap_area_ha": (F.col("id") % 130).cast("double"), "coarse_canopy": (F.col("id") % 70).cast("double"),
            "slope": F.coalesce(F.col("slope").cast("double"), F.lit(0.0)),
        }
    )
    return classify.classify_votes(x, s, prepared=True).select("r", "c", F.coalesce("ates", F.lit(-1).cast("tinyint")).alias("class"))


def _legacy(spark, sf):
    x, s = _vote_cells(spark, sf)
    x = focal.box_mean(x.withColumn("_s", F.coalesce(F.col("slope").cast("double"), F.lit(0.0))), s, "_s", 5, "nearest", "slope_smooth")
    x = x.withColumns(
        {
            "E_alpha_zdelta": V.angle_score(F.col("E_zdelta"), F.col("E_travel_angle")), "F_alpha_zdelta": V.angle_score(F.col("F_zdelta"), F.col("F_travel_angle")),
            "E_flux_area": V.flux_area(F.col("E_rout_flux_area"), AREA, F.col("E_travel_angle")), "F_flux_area": V.flux_area(F.col("F_rout_flux_area"), AREA, F.col("F_travel_angle")),
            "E_release": (F.col("E_pra") >= 0.3).cast("int"),
        }
    )
    return classify.exposure(x)


_LEGACY = f"""WITH {BANDS}, {SLOPE}, lim AS (SELECT max(r) AS h, max(c) AS w FROM g), st AS (SELECT r, c, coalesce(trunc(slope), 0e0) AS s, slope IS NOT NULL AS ok FROM sl),
    dd AS (SELECT a.i AS dr, b.i AS dc FROM range(-2, 3) a(i), range(-2, 3) b(i)), pp AS (SELECT st.r, st.c, greatest(0, least(h, st.r + dr)) AS pr, greatest(0, least(w, st.c + dc)) AS pc FROM st, dd, lim),
    sm AS (SELECT pp.r, pp.c, sum(coalesce(n.s, 0e0)) / 25e0 AS smooth FROM pp LEFT JOIN st n ON n.r = pr AND n.c = pc GROUP BY pp.r, pp.c),
    q AS (SELECT b.*, st.s, st.ok, smooth, trunc((greatest(0e0, least(100e0, E_zdelta / 270e0 * 100e0)) + greatest(0e0, least(100e0, E_travel_angle / 90e0 * 100e0))) / 2e0) AS ea,
      trunc((greatest(0e0, least(100e0, F_zdelta / 270e0 * 100e0)) + greatest(0e0, least(100e0, F_travel_angle / 90e0 * 100e0))) / 2e0) AS fa,
      CASE WHEN E_travel_angle < 25 THEN 0 ELSE E_rout_flux_area * {AREA!r}e0 END AS ef, CASE WHEN F_travel_angle < 25 THEN 0 ELSE F_rout_flux_area * {AREA!r}e0 END AS ff
      FROM b JOIN st ON st.r = b.r AND st.c = b.c JOIN sm ON sm.r = b.r AND sm.c = b.c),
    x AS (SELECT *, CASE WHEN fa >= 75 THEN 3 WHEN fa >= 30 THEN 2 WHEN ea >= 1 THEN 1 ELSE 0 END AS az, CASE WHEN ff > 3000 THEN 3 WHEN ff > 500 THEN 2 WHEN ef > 0 THEN 1 ELSE 0 END AS rf, (E_runout_prox < 25)::INT AS prox FROM q)"""


@query(
    f"""{_LEGACY}, k AS (SELECT *, greatest(CASE WHEN smooth > 45 THEN 4 WHEN s > 32 THEN 3 WHEN s > 25 THEN 2 WHEN s > 15 THEN 1 ELSE 0 END, az, rf, prox) + CASE WHEN canopy <= 20 THEN 10 WHEN canopy <= 60 THEN 20 WHEN canopy <= 85 THEN 30 ELSE 40 END + CASE WHEN E_pra >= 0.3 THEN 100 ELSE 0 END AS key FROM x)
    SELECT r, c, CASE WHEN ok THEN CASE WHEN F_travel_angle >= 60 THEN 4 WHEN canopy > 85 AND v = 4 THEN 3 ELSE v END ELSE -1 END::TINYINT AS class FROM k LEFT JOIN {_LUT} ON l.k = key"""
)
def classify_legacy_slope(spark, sf):
    return classify.classify_slope(_legacy(spark, sf)).select("r", "c", F.coalesce("ates", F.lit(-1).cast("tinyint")).alias("class"))


@query(
    f"""{_LEGACY} SELECT r, c, CASE WHEN ok THEN CASE WHEN F_travel_angle >= 60 THEN 4 WHEN smooth > 45 THEN CASE WHEN canopy > 20 THEN 3 ELSE 4 END
    ELSE greatest(CASE WHEN F_pra >= 0.6 THEN 3 WHEN F_pra >= 0.25 THEN 2 ELSE 0 END, (E_pra >= 0.05)::INT, az, rf, prox) END ELSE -1 END::TINYINT AS class FROM x"""
)
def classify_legacy_pra(spark, sf):
    return classify.classify_release(_legacy(spark, sf)).select("r", "c", F.coalesce("ates", F.lit(-1).cast("tinyint")).alias("class"))


# Presentation.


def _palette_sql(p: P.Palette, x: str, i: int) -> str:
    cases = f"WHEN {x} <= {p.stops[0][0]!r} THEN {p.stops[0][i + 1]}"
    for lo, hi, a, b in p.segments():
        cases += f" WHEN {x} <= {hi!r} THEN floor({a[i]} + ({x} - {lo!r}) / {hi - lo!r} * {b[i] - a[i]} + 0.5)"
    return f"CAST(CASE WHEN {x} IS NULL THEN {p.nothing[i]} {cases} ELSE {p.stops[-1][i + 1]} END AS INTEGER)"


@query(f"WITH {GRID} SELECT r, c, {', '.join(_palette_sql(P.CANOPY, 'round(canopy, 3)', i) + ' AS ' + n for i, n in enumerate(('red', 'green', 'blue', 'alpha')))} FROM g")
def palette_continuous(spark, sf):
    x = grid(spark, sf).withColumn("p", P.colour(F.round("canopy", 3), P.CANOPY))
    return x.select("r", "c", "p.*")


@query(
    f"WITH {GRID}, p(v, red, green, blue, alpha) AS (VALUES {', '.join(f'({int(s[0])}, {s[1]}, {s[2]}, {s[3]}, {s[4]})' for s in P.CLASSES.stops)}) SELECT r, c, coalesce(red, 0) AS red, coalesce(green, 0) AS green, coalesce(blue, 0) AS blue, coalesce(alpha, 0) AS alpha FROM g LEFT JOIN p ON v = zone % 6"
)
def palette_categorical(spark, sf):
    x = grid(spark, sf).withColumn("p", P.colour(F.col("zone") % 6, P.CLASSES, categorical=True))
    return x.select("r", "c", "p.*")


@query(
    f"""WITH {GRID}, p(v, red, green, blue, alpha) AS (VALUES {', '.join(f'({int(s[0])}, {s[1]}, {s[2]}, {s[3]}, {s[4]})' for s in P.CLASSES.stops)}), lim AS (SELECT max(r) + 1 AS h, max(c) + 1 AS w FROM g),
    px AS (SELECT f, a.i AS r, b.i AS c FROM lim, (VALUES (1), (2), (4), (8), (16)) l(f), range(0, h) a(i), range(0, w) b(i) WHERE a.i * f < h AND b.i * f < w)
    SELECT f AS factor, px.r, px.c, coalesce(red, 0) AS red, coalesce(green, 0) AS green, coalesce(blue, 0) AS blue, coalesce(alpha, 0) AS alpha
    FROM px LEFT JOIN g ON g.r = px.r * f + f // 2 AND g.c = px.c * f + f // 2 LEFT JOIN p ON v = zone % 6"""
)
def image_overviews(spark, sf):
    """Class colours written as an image for map viewers; every pixel of it and
    of its overviews, read back from the file."""
    x = grid(spark, sf)
    got = imagery.write_image(palette_categorical(spark, sf), spec(x), f"{scratch_path(spark, 'image')}.tif")
    levels = [imagery.read_image(spark, got, k).withColumn("factor", F.lit(f)) for k, f in enumerate((1, *imagery.FACTORS))]
    return reduce(DataFrame.unionByName, levels)


@query(f"WITH {GRID}, {SLOPE}, b AS (SELECT r, c, z, zone, noise FROM g) SELECT r, c, {_rounded('z')} AS z, {_rounded('slope')} AS slope, CASE WHEN noise THEN zone END AS noisy_zone FROM b LEFT JOIN (SELECT r, c, slope FROM sl) s USING (r, c)")
def band_stack(spark, sf):
    """Bands stored by tile and joined without a shuffle between them, one of
    them with holes."""
    x = grid(spark, sf)
    with Stack(x.select("r", "c", "z"), spec(x)) as bands:
        bands.add(focal.slope(x, FLAT).select("r", "c", "slope"))
        bands.add(x.where("noise").select("r", "c", F.col("zone").alias("noisy_zone")))
        return keyed(bands.joined(), "z", "slope", "noisy_zone")


# Memberships, zones and products of the workflow that stand for themselves.


_RUGGED = f"""u AS (SELECT r, c, sin(radians(slope)) * sin(radians(coalesce({_ASPECT}, 0e0))) AS x, sin(radians(slope)) * cos(radians(coalesce({_ASPECT}, 0e0))) AS y, cos(radians(slope)) AS w FROM sl),
    m AS (SELECT t.r, t.c, sum(n.x) AS x, sum(n.y) AS y, sum(n.w) AS w, count(n.x) AS k FROM u t JOIN u n ON n.r BETWEEN t.r - 1 AND t.r + 1 AND n.c BETWEEN t.c - 1 AND t.c + 1 GROUP BY t.r, t.c),
    q AS (SELECT r, c, CASE WHEN k = 9 THEN 1e0 - sqrt(x * x + y * y + w * w) / 9e0 ELSE 0e0 END AS v FROM m)"""


@query(f"WITH {GRID}, {SLOPE}, {_RUGGED} SELECT r, c, {_rounded('CASE WHEN v > 0.01 THEN 0e0 ELSE 1e0 / (1e0 + pow((v + 0.007e0) / 0.01e0, 10e0)) END')} AS m FROM q")
def membership_ruggedness(spark, sf):
    x = focal.ruggedness(focal.aspect(focal.slope(grid(spark, sf), FLAT), FLAT))
    return keyed(x.withColumn("m", fuzzy.ruggedness_membership("ruggedness")), "m")


@query(f"WITH {GRID}, {SLOPE} SELECT r, c, {_rounded('coalesce(CASE WHEN slope < 40 THEN 1e0 / (1e0 + pow((slope - 40e0) / 9e0, 6e0)) ELSE 1e0 / (1e0 + pow((slope - 40e0) / 14e0, 4e0)) END, 0e0)')} AS m FROM sl")
def slope_one_sided(spark, sf):
    return keyed(focal.slope(grid(spark, sf), FLAT).withColumn("m", fuzzy.slope_membership("slope", 14, 3, 40, a_low=9, b_high=2)), "m")


@query(f"WITH {GRID} SELECT r, c, CASE WHEN f IS NULL THEN 'unknown' WHEN f >= 0.7 THEN 'alpine' WHEN f <= 0.3 THEN 'below_treeline' ELSE 'treeline' END AS band FROM (SELECT r, c, CASE WHEN noise THEN canopy / 100e0 END AS f FROM g)")
def band_labels(spark, sf):
    return grid(spark, sf).select("r", "c", V.band_label(F.when(F.col("noise"), F.col("canopy") / 100.0)).alias("band"))


@query(f"WITH {GRID} SELECT CAST(zone AS BIGINT) AS zone, count(*) AS n, round(avg(canopy), 4) AS mean FROM g GROUP BY zone")
def region_means(spark, sf):
    return zonal.region_means(grid(spark, sf), "zone", "canopy").select(F.col("zone").cast("long").alias("zone"), "n", F.round("mean", 4).alias("mean"))


@query(
    f"""WITH {GRID}, {SLOPE}, {_RUGGED}, t AS (SELECT sl.zone, sl.z, v, (1500 + sl.zone * 20)::DOUBLE AS tl FROM sl JOIN q ON q.r = sl.r AND q.c = sl.c),
    a AS (SELECT zone, avg(v) AS rm, median(tl) AS tl, avg((z > tl)::INT) AS f FROM t GROUP BY zone)
    SELECT zone, round(rm, 4) AS rugg_mean, round(tl, 0) AS treeline_m, round(f, 2) AS above_tl_frac, CASE WHEN f >= 0.7 THEN 'alpine' WHEN f <= 0.3 THEN 'below_treeline' ELSE 'treeline' END AS band FROM a"""
)
def zonal_treeline_bands(spark, sf):
    x, s = _zoned(spark, sf)
    x = focal.ruggedness(x).withColumn("treeline", 1500.0 + F.col("zone") * 20.0)
    return zonal.zonal_metrics(x, s, "zone").select("zone", "rugg_mean", "treeline_m", "above_tl_frac", "band")


@query(
    f"""WITH {GRID}, p AS (SELECT zone, quantile_cont(z, 0.95) AS q, count(z) AS n FROM g WHERE canopy >= 30 AND zone < 20 GROUP BY zone)
    SELECT r, c, {_rounded('CASE WHEN n >= 500 THEN q END', 4)} AS treeline FROM g LEFT JOIN p ON p.zone = g.zone"""
)
def treeline_per_region(spark, sf):
    x = grid(spark, sf)
    zones = x.where("zone < 20").select("r", "c", F.lpad(F.col("zone").cast("string"), 2, "0").alias("name"))
    return keyed(zonal.treelines(x, zones), "treeline", places=4)


@query(
    f"""WITH {GRID}, t(name, range, grp, tl, n) AS (SELECT 'z' || zone, 'r' || zone % 4, 'g' || zone % 2, zone * 10e0, zone * 12e0 FROM (SELECT DISTINCT zone FROM g)),
    a AS (SELECT range, median(tl) AS v FROM t WHERE n >= 150 GROUP BY range), b AS (SELECT grp, median(tl) AS v FROM t WHERE n >= 150 GROUP BY grp)
    SELECT r, c, {_rounded('coalesce(CASE WHEN n >= 150 THEN tl END, a.v, b.v)', 4)} AS treeline FROM g LEFT JOIN t ON t.name = 'z' || zone LEFT JOIN a ON a.range = t.range LEFT JOIN b ON b.grp = t.grp"""
)
def treeline_from_table(spark, sf):
    x = grid(spark, sf)
    k = F.col("zone")
    text = lambda p, v: F.concat(F.lit(p), v.cast("string"))
    table = x.select("zone").distinct().select(
        text("z", k).alias("name"), text("r", k % 4).alias("range"), text("g", k % 2).alias("group"), (k * 10.0).alias("treeline"), (k * 12.0).alias("n_forest_kpx")
    )
    return keyed(zonal.treelines(x, x.select("r", "c", text("z", k).alias("name")), table), "treeline", places=4)


@query(f"WITH {GRID}, a AS (SELECT zone, count(*) * {AREA!r}e0 AS a FROM g GROUP BY zone) SELECT count(*) AS zones, round(sum(a), 1) AS area_m2, count(CASE WHEN a > 30000 THEN 1 END) AS above_least, count(CASE WHEN a > 250000 THEN 1 END) AS above_cap FROM a")
def zone_counts(spark, sf):
    x = grid(spark, sf)
    got = zonal.kind_counts(x.withColumnRenamed("zone", "label"), GridSpec(WIDTH, 0, CELL), {"above_least": 30000.0, "above_cap": 250000.0})
    return got.withColumn("area_m2", F.round("area_m2", 1))


@query(f"WITH {GRID}, e AS (SELECT zone, min(r) AS r0, min(c) AS c0 FROM g GROUP BY zone) SELECT r, c, CAST(g.zone AS BIGINT) AS label FROM g JOIN e ON e.zone = g.zone WHERE (r - r0) % 4 = 0 AND (c - c0) % 4 = 0")
def marker_grid(spark, sf):
    return segment.grid_markers(grid(spark, sf).select("r", "c", F.col("zone").cast("long").alias("label")), 4)


@query(
    f"""WITH {GRID}, {SLOPE}, {_step_sql_all()}, p AS (SELECT r, c, {_PRA} AS pra FROM sl), e AS (SELECT min(curvature) AS cl, max(curvature) AS ch, min(z) AS zl, max(z) AS zh FROM k5), t AS (SELECT max(pra) AS top FROM p)
    SELECT k5.r, k5.c, round((1e0 - least(1e0, greatest(0e0, pra / greatest(top, 1e-12)))) * 5e0 + abs((curvature - cl) / (ch - cl + 1e-8)) * 2.5e0 + abs(sin(radians(math_aspect))) + (z - zl) / (zh - zl + 1e-8), 3) + 0e0 AS cost
    FROM k5 JOIN p ON p.r = k5.r AND p.c = k5.c CROSS JOIN e CROSS JOIN t"""
)
def cost_surface(spark, sf):
    return keyed(segment.cost_surface(_released(spark, sf), segment.SegmentParams()), "cost", places=3)


@query(
    f"""WITH {GRID}, f AS (SELECT r, c FROM g WHERE canopy > 30), d AS (SELECT g.r, g.c, min((g.r - f.r) * (g.r - f.r) + (g.c - f.c) * (g.c - f.c)) AS d2 FROM g, f WHERE canopy <= 30 GROUP BY g.r, g.c)
    SELECT g.r, g.c, {_rounded('CASE WHEN d2 IS NULL THEN 0e0 ELSE least(500e0, 2e0 * 21.34e0 * sqrt(d2)) END', 4)} AS gap_width FROM g LEFT JOIN d ON d.r = g.r AND d.c = g.c"""
)
def gap_width(spark, sf):
    x = grid(spark, sf).withColumnRenamed("canopy", "canopy_pct").withColumn("valid", F.lit(True))
    return keyed(regions.gap_metrics(x, spec(x)), "gap_width", places=4)


@query(
    _labels_sql(
        "canopy <= 30 AND NOT noise", _FOUR,
        "SELECT g.r, g.c, (SELECT max(id) FROM g WHERE noise) + label + 1 AS label FROM cc JOIN g ON g.id = cc.id",
    )
)
def uncovered_labels(spark, sf):
    x = grid(spark, sf)
    return regions.uncovered(x.where("canopy <= 30"), x.where("noise").select("r", "c", F.col("id").alias("label")), spec(x))


@query(
    f"""WITH {GRID}, k AS (SELECT r, c, CASE WHEN noise THEN z END AS z, CASE WHEN zone > 3 THEN canopy END AS canopy, zone FROM g)
    SELECT r, c, {_rounded('z', 4)} AS z, {_rounded('canopy', 4)} AS canopy FROM k WHERE zone <> 4"""
)
def align_and_clip(spark, sf):
    x = grid(spark, sf)
    s = spec(x)
    dem = x.select("r", "c", F.when(F.col("noise"), F.col("z")).otherwise(F.when(F.col("zone") > 9, 0.0).otherwise(-9999.0)).alias("z"))
    trees = x.select("r", "c", F.when(F.col("zone") > 3, F.col("canopy")).otherwise(-9999.0).alias("canopy"))
    return keyed(align.align_and_clip(dem, s, trees, s, x.where("zone <> 4")), "z", "canopy", places=4)


@query(f"WITH {GRID} SELECT r, c, {_rounded('z', 4)} AS z FROM g WHERE r BETWEEN 3 AND 40 AND c BETWEEN 20 AND 99")
def raster_window(spark, sf):
    """A tiled raster, written and read by window."""
    path = scratch_path(spark, "raster")
    tables.write_raster(grid(spark, sf).select("r", "c", "z"), path, 32)
    return keyed(tables.read_window(spark, path, 3, 41, 20, 100, 32), "z", places=4)


@query(f"WITH {GRID} SELECT r, c, (c >= 10 AND c < 60 AND r >= 5 AND r < 12) AND NOT (c >= 20 AND c < 30 AND r >= 6 AND r < 9) AS inside, CASE WHEN (c >= 10 AND c < 60 AND r >= 5 AND r < 12) AND NOT (c >= 20 AND c < 30 AND r >= 6 AND r < 9) THEN 'ring' END AS name FROM g")
def polygon_layer(spark, sf):
    """Cells of a polygon with a hole, given as text."""
    ring = lambda r0, r1, c0, c1: "(" + ", ".join(f"{c * CELL} {-r * CELL}" for r, c in ((r0, c0), (r0, c1), (r1, c1), (r1, c0), (r0, c0))) + ")"
    path = scratch_path(spark, "layer")
    spark.createDataFrame([("ring", f"POLYGON ({ring(5, 12, 10, 60)}, {ring(6, 9, 20, 30)})"), ("none", None)], "name string, wkt string").write.parquet(path)
    x = grid(spark, sf)
    got = vectors.burn(x, spec(x), vectors.read_layer(spark, path))
    return x.select("r", "c").join(got, ["r", "c"], "left").select("r", "c", F.col("name").isNotNull().alias("inside"), "name")


_FLUX = P.parse(P.FLUX_RAMP)


@query(f"WITH {BANDS} SELECT r, c, {', '.join(_palette_sql(_FLUX, 'round(F_rout_flux_area * 100, 2)', i) + ' AS ' + n for i, n in enumerate(('red', 'green', 'blue', 'alpha')))} FROM b")
def palette_log_ramp(spark, sf):
    """Colours by a ramp that is even in the logarithm and in perceived colour."""
    return bands(spark, sf).withColumn("p", P.colour(rounded(F.col("F_rout_flux_area") * 100, 2), _FLUX)).select("r", "c", "p.*")


@query(
    f"""{_LEGACY}, w AS (SELECT *, zone % 5 AS wind FROM x), k AS (SELECT *, greatest(CASE WHEN smooth > 45 THEN 4 WHEN s > 30 THEN 3 WHEN s > 22 THEN 2 WHEN s > 15 THEN 1 ELSE 0 END, az, rf, prox, wind) + CASE WHEN canopy <= 10 THEN 10 WHEN canopy <= 50 THEN 20 WHEN canopy <= 80 THEN 30 ELSE 40 END + CASE WHEN E_pra >= 0.3 THEN 100 ELSE 0 END AS key FROM w)
    SELECT r, c, CASE WHEN ok THEN CASE WHEN F_travel_angle >= 55 THEN 4 WHEN canopy > 80 AND v = 4 THEN 3 ELSE v END ELSE -1 END::TINYINT AS class FROM k LEFT JOIN {_LUT} ON l.k = key"""
)
def classify_dispatch(spark, sf):
    """The older model through the dispatch, with other cuts and wind deposits."""
    x = _legacy(spark, sf).withColumn("wind_class", F.col("zone") % 5)
    got = classify.classify(x, FLAT, "legacy", "slope", {"sat": (15, 22, 30, 45), "trees": (10, 50, 80), "overhead": 55.0})
    return got.select("r", "c", F.coalesce("ates", F.lit(-1).cast("tinyint")).alias("class"))


# Kernels without SQL.


@query()
def start_zones(spark, sf):
    x = _released(spark, sf).withColumn("mask", (F.col("pra") >= 0.25).cast("int"))
    return segment.segment(x, spec(x))


@query()
def runout(spark, sf):
    x = _released(spark, sf)
    x = x.withColumn("go", (F.col("pra") >= 0.25).cast("int"))
    return flow.runout(x, GridSpec.of(x, CELL), "go", flow.FlowParams(alpha=30.0))
