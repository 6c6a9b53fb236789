"""Bands joined by bucket: no exchange between them, and nothing left behind."""

import re

import pytest
from pyspark.sql import functions as F

from firnline.grid import GridSpec
from firnline.operators import distance
from firnline.operators.stack import SETTINGS, Stack, joins_by_bucket

SPEC = GridSpec(70, 40)


def cells(spark):
    return spark.range(70 * 40).select(F.floor(F.col("id") / 70).cast("int").alias("r"), (F.col("id") % 70).alias("c"), F.col("id").alias("z")).repartition(7)


def exchanges(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"\b\w*Exchange\b", text), re.findall(r"\bSort \[", text)


def test_no_exchange_between_bands(spark):
    x = cells(spark)
    before = {k: spark.conf.get(k) for k in SETTINGS}
    with Stack(x, SPEC, tile=16, buckets=5) as bands:
        bands.add(x.where("z % 3 = 0").select("c", "r", (F.col("z") * 2).alias("twice")))
        bands.add(x.where("c > 60").select("r", "c", F.col("z").cast("string").alias("tail"), F.lit(1).alias("one")))
        with joins_by_bucket(spark):
            plan = bands.plan()
            assert exchanges(plan) == ([], [])  # nor are they sorted again
            assert exchanges(plan.select("r", "c", "one")) == ([], [])
        got = {(q.r, q.c): (q.z, q.twice, q.tail, q.one) for q in bands.joined().collect()}
        part = bands.joined("tail")
        assert part.columns == ["r", "c", "tail"] and part.where("tail is not null").count() == 40 * 9
        names = list(bands.names)
    assert got == {(k // 70, k % 70): (k, 2 * k if k % 3 == 0 else None, str(k) if k % 70 > 60 else None, 1 if k % 70 > 60 else None) for k in range(2800)}
    assert not [n for n in names if spark.catalog.tableExists(n)]
    assert {k: spark.conf.get(k) for k in SETTINGS} == before


def test_names_clash_and_empty_tables(spark):
    x = cells(spark)
    with Stack(x, SPEC, tile=16) as bands:
        for name in ("z", "Z", "tr"):
            with pytest.raises(ValueError, match="names"):
                bands.add(x.select("r", "c", F.col("z").alias(name)))
        bands.add(x.limit(0).select("r", "c", F.col("z").alias("none.at all")))
        got = bands.joined()
        assert got.columns == ["r", "c", "z", "none.at all"] and got.count() == 2800 and got.where("`none.at all` is not null").count() == 0
    with Stack(x.limit(0), SPEC) as bands:
        bands.add(x.select("r", "c", F.col("z").alias("y")))
        assert bands.joined().count() == 0


def test_distances_of_every_cell(spark):
    places = spark.createDataFrame([(3, 5), (3, 5), (39, 69), (0, 0)], "r int, c int")
    got = {(q.r, q.c): q.d for q in distance.distances(spark, places, SPEC, "d").collect()}
    at = {(3, 5), (39, 69), (0, 0)}
    assert len(got) == 2800
    assert all(abs(d - min(((r - p) ** 2 + (c - q) ** 2) ** 0.5 for p, q in at)) < 1e-9 for (r, c), d in got.items())
    none = distance.distances(spark, places.limit(0), SPEC, "d")
    assert none.count() == 2800 and none.where("d is not null").count() == 0
