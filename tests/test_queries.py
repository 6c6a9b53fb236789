"""Every terrain query against its SQL in DuckDB; kernels without SQL against
what must hold of their results, or (tests/test_runout.py) a naive version."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from firnline.plans.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def rows(df):
    """Rows by their exact values first; numbers of floating point apart."""
    df = df[sorted(df.columns)].astype(object)
    out = []
    for r in df.itertuples(index=False):
        plain = [None if v is None or v is pd.NA or v != v else v for v in r]
        out.append((tuple(str(int(v)) if isinstance(v, (int, bool)) else v for v in plain if not isinstance(v, float)), tuple(v for v in plain if isinstance(v, float))))
    return sorted(out, key=lambda x: (repr(x[0]), len(x[1]), [round(v, 2) for v in x[1]]))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, sf, con, name):
    got, want = QUERIES[name](spark, sf).toPandas(), con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(whole(got)), rows(whole(want))
    assert len(a) == len(b)
    # The last of the places that both sides round to may differ.
    off = [(x, y) for x, y in zip(a, b, strict=True) if x[0] != y[0] or len(x[1]) != len(y[1]) or any(abs(p - q) > 2e-4 + 1e-9 * abs(q) for p, q in zip(x[1], y[1], strict=True))]
    assert not off, off[:3]


def whole(df):
    """Integers that pandas made floating point, as some are missing, as such."""
    for c in df.columns:
        if df[c].dtype.kind == "f" and (df[c].dropna() % 1 == 0).all() and not c.endswith(("_mean", "_max", "_min", "area_m2")):
            df[c] = df[c].astype("Int64")
    return df


def test_ramp_rounds_as_its_sql(spark, tmp_path):
    """Prices whose quarter lies at half a cent, beside a change of colour."""
    prices = [446.54, 543.06, 551.3, 569.42, 585.3, 1045.62, 1209.86, 1252.34, 1271.62, 1803.38, 2130.74]
    made = {
        "customer": pd.DataFrame({"c_custkey": [0], "c_nationkey": [0]}),
        "orders": pd.DataFrame({"o_orderkey": range(len(prices)), "o_custkey": 0, "o_totalprice": prices}),
        "lineitem": pd.DataFrame({"l_orderkey": range(len(prices)), "l_quantity": 1.0, "l_extendedprice": prices, "l_discount": 0.0}),
    }
    c = duckdb.connect()
    for name, df in made.items():
        df.to_parquet(tmp_path / f"{name}.parquet")
        c.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet'")
    got = [tuple(r) for r in QUERIES["palette_log_ramp"](spark, str(tmp_path)).collect()]
    want = c.execute(ORACLES["palette_log_ramp"]).fetchall()
    assert sorted(got) == sorted(want)


def test_only_kernels_have_no_sql():
    assert set(QUERIES) - set(ORACLES) == {"region_outlines", "start_zones", "runout"}


def test_outlines_hold_their_cells(spark, sf):
    """Every outline's rings, by the shoelace formula, enclose the region's area."""
    from firnline.operators import regions
    from firnline.plans.queries import CELL, GridSpec, grid
    from firnline.sources.vectors import rings_of_wkt

    x = grid(spark, sf)
    got, _ = regions.polygonize(x.withColumn("v", F.when(F.col("canopy") <= 30, 1)), GridSpec.of(x, CELL), "v")
    area = {r.label: r.area_m2 for r in got.collect()}
    found = {r.label: rings_of_wkt(r.wkt) for r in QUERIES["region_outlines"](spark, sf).collect()}
    assert set(found) == set(area)
    for label, rings in found.items():
        assert all(ring[0] == ring[-1] for ring in rings)
        assert abs(sum(ax * by - bx * ay for ring in rings for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False)) / 2) == pytest.approx(area[label])


def test_start_zones_are_whole(spark, sf):
    """Zones cover the opened and closed mask once; each is connected, and one
    below the merging threshold touches no other."""
    from firnline.operators import focal, regions
    from firnline.plans.queries import CELL, GridSpec, _released

    x = _released(spark, sf)
    s = GridSpec.of(x, CELL)
    zones = QUERIES["start_zones"](spark, sf).cache()
    mask = focal.closing(focal.opening(x.withColumn("mask", (F.col("pra") >= 0.25).cast("int")), "mask"), "mask").where("mask = 1").select("r", "c")
    assert zones.select("r", "c").exceptAll(mask).count() == mask.exceptAll(zones.select("r", "c")).count() == 0
    parts = regions.connected(zones, s, "label", 8).select("value", F.col("label").alias("part")).distinct().groupBy("value").count()
    assert parts.where("count > 1").count() == 0
    small = zones.groupBy("label").count().where(F.col("count") * s.cell_area < 5000.0).select("label")
    assert regions.adjacency(zones).join(small, F.col("label").isin(F.col("a"), F.col("b"))).count() == 0
