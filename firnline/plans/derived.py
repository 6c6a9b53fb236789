"""A grid and its bands, derived from the driver tables: one cell per order.

r, c from the dense order key on a grid 120 cells wide; elevation and canopy
from position and price; runout-like bands from the order's lines; the zone is
the customer's nation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firnline.grid import GridSpec, workers_see

WIDTH = 120
CELL = 21.34


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    workers_see(spark)
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice")
    k = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey")
    r, c = F.floor(F.col("o_orderkey") / WIDTH), F.col("o_orderkey") % WIDTH
    x = o.join(k, F.col("o_custkey") == F.col("c_custkey"))
    return x.select(
        F.col("o_orderkey").alias("id"),
        r.alias("r"),
        c.alias("c"),
        (F.lit(1500.0) + 160.0 * F.sin(r / 9.0) + 120.0 * F.cos(c / 11.0) + F.col("o_totalprice") / 20000.0).alias("z"),
        F.greatest(F.lit(0.0), F.least(F.lit(100.0), 50.0 + 70.0 * F.sin(r / 13.0) * F.cos(c / 7.0))).alias("canopy"),
        F.col("c_nationkey").alias("zone"),
        (F.col("o_totalprice") < 250000).alias("noise"),
    )


def spec(cells: DataFrame) -> GridSpec:
    return GridSpec.of(cells, CELL)


def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid with runout-like bands of both scenarios; orders without lines
    have zeros."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_quantity", "l_extendedprice", "l_discount")
    g = li.groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("_q"), F.round(F.sum("l_extendedprice"), 2).alias("_p"), F.count(F.lit(1)).cast("double").alias("_n"), F.max("l_discount").alias("_d")
    )
    x = grid(spark, sf_dir).join(g, F.col("id") == F.col("l_orderkey"), "left")
    q, p, n, d = (F.coalesce(v, F.lit(0.0)) for v in ("_q", "_p", "_n", "_d"))
    return x.select(
        "id", "r", "c", "z", "canopy", "zone",
        q.alias("E_zdelta"), F.greatest(F.lit(0.0), q - 100.0).alias("F_zdelta"),
        F.least(F.lit(60.0), q / 4.0).alias("E_travel_angle"), F.least(F.lit(65.0), q / 5.0 + n).alias("F_travel_angle"),
        (p / 1000.0).alias("E_rout_flux_area"), (p / 400.0).alias("F_rout_flux_area"),
        F.least(F.lit(1.0), n / 10.0).alias("E_pra"), F.least(F.lit(1.0), d * 4.0).alias("F_pra"),
        (q / 1000.0).alias("E_pra_size"), (q / 500.0).alias("F_pra_size"),
        F.greatest(F.lit(0.0), 300.0 - 2.0 * q).alias("E_runout_prox"), (500.0 - q).alias("E_pra_proximity"),
    )


#: The same two tables, as common table expressions for DuckDB.
GRID = f"""g AS (SELECT o_orderkey AS id, CAST(o_orderkey // {WIDTH} AS BIGINT) AS r, CAST(o_orderkey % {WIDTH} AS BIGINT) AS c,
    1500e0 + 160e0 * sin((o_orderkey // {WIDTH}) / 9e0) + 120e0 * cos((o_orderkey % {WIDTH}) / 11e0) + o_totalprice / 20000e0 AS z,
    greatest(0e0, least(100e0, 50e0 + 70e0 * sin((o_orderkey // {WIDTH}) / 13e0) * cos((o_orderkey % {WIDTH}) / 7e0))) AS canopy,
    c_nationkey AS zone, o_totalprice < 250000 AS noise
    FROM orders JOIN customer ON o_custkey = c_custkey)"""
BANDS = f"""{GRID}, li AS (SELECT l_orderkey, sum(l_quantity) AS q, round(sum(l_extendedprice), 2) AS p, CAST(count(*) AS DOUBLE) AS n, max(l_discount) AS d
    FROM lineitem GROUP BY l_orderkey),
b AS (SELECT g.*, coalesce(q, 0) AS E_zdelta, greatest(0e0, coalesce(q, 0) - 100e0) AS F_zdelta,
    least(60e0, coalesce(q, 0) / 4e0) AS E_travel_angle, least(65e0, coalesce(q, 0) / 5e0 + coalesce(n, 0)) AS F_travel_angle,
    coalesce(p, 0) / 1000e0 AS E_rout_flux_area, coalesce(p, 0) / 400e0 AS F_rout_flux_area,
    least(1e0, coalesce(n, 0) / 10e0) AS E_pra, least(1e0, coalesce(d, 0) * 4e0) AS F_pra,
    coalesce(q, 0) / 1000e0 AS E_pra_size, coalesce(q, 0) / 500e0 AS F_pra_size,
    greatest(0e0, 300e0 - 2e0 * coalesce(q, 0)) AS E_runout_prox, 500e0 - coalesce(q, 0) AS E_pra_proximity
    FROM g LEFT JOIN li ON l_orderkey = id)"""
#: All eight neighbours, by joins; NULL where there is none.
AROUND = "n8 AS (SELECT g.*, " + ", ".join(f"{n}.z AS {n}" for n in ("nw", "n", "ne", "w", "e", "sw", "s", "se")) + " FROM g " + " ".join(
    f"LEFT JOIN g {n} ON {n}.r = g.r + {dr} AND {n}.c = g.c + {dc}"
    for n, dr, dc in (("nw", -1, -1), ("n", -1, 0), ("ne", -1, 1), ("w", 0, -1), ("e", 0, 1), ("sw", 1, -1), ("s", 1, 0), ("se", 1, 1))
) + ")"
_GX = "((ne + 2e0 * e + se) - (nw + 2e0 * w + sw)) / (8e0 * 21.34e0)"
_GY = "((sw + 2e0 * s + se) - (nw + 2e0 * n + ne)) / (8e0 * 21.34e0)"
SLOPE = f"{AROUND}, sl AS (SELECT *, {_GX} AS gx, {_GY} AS gy, degrees(atan(sqrt(pow({_GX}, 2) + pow({_GY}, 2)))) AS slope FROM n8)"
