"""Joins on hot keys, ranks, small tables and scopes of scratch tables."""


import numpy as np
import pytest
from pyspark.sql import functions as F

from firnline.llm import common


def test_hot_keys_are_joined_like_others(spark):
    common.prepare(spark)
    rng = np.random.default_rng(0)
    keys = [7] * 3000 + [8] * 700 + rng.integers(100, 900, 2000).tolist() + [None] * 400
    many = spark.createDataFrame([(None if k is None else int(k), i, f"v{i}") for i, k in enumerate(keys)], "key long, id long, v string")
    few = spark.createDataFrame([(k, k * 10) for k in [7, 8, *range(100, 500)]], "key long, w long")
    for how in ("inner", "left"):
        got = common.join_hot(many, few, "key", how, "id")
        want = many.join(few, "key", how)
        assert got.columns == want.columns
        key = lambda r: (r.id, r.w or -1)
        assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
    usual = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in usual}
    for k, v in usual.items():
        spark.conf.set(k, v)
    try:
        parts = common.join_hot(many, few, "key", by="id").withColumn("p", F.spark_partition_id()).where("key = 7").groupBy("p").count().collect()
        assert len(parts) > 1 and max(r["count"] for r in parts) < 3000  # one key, several tasks
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    text = many.selectExpr("cast(v as binary) AS key", "id")
    assert common.join_hot(text, text.selectExpr("key", "id AS w").limit(50), "key", "inner", "id").count() == 50


def test_ranks_and_sums_before(spark):
    common.prepare(spark)
    df = spark.createDataFrame([(i % 3, None if i % 5 == 0 else i) for i in range(1000)], "k long, n long")
    got = common.ordered(df, ["k", "n"], ("n",), places=True).orderBy("rank").collect()
    at = 0
    for i, r in enumerate(got):
        assert (r["rank"], r.before_n) == (i, at)
        at += r.n or 0
    assert [r.k for r in got] == sorted(r.k for r in got) and len({(r["_pid"], r["_idx"]) for r in got}) == 1000
    assert common.ordered(df.limit(0), ["k"]).count() == 0


def test_small_tables(spark):
    got = common.small_table(spark, [(1, None, b"x"), (None, "b", None)], "a int, b string, c binary")
    assert [tuple(r) for r in got.collect()] == [(1, None, bytearray(b"x")), (None, "b", None)]
    assert common.small_table(spark, [], "a int").count() == 0


def test_scopes_of_scratch_tables_are_told_apart(spark):
    """An inner scope whose tables are all of the outer one's leaves the outer open."""

    def outer():
        first, inner = common.recording(lambda: common.materialize(spark.range(3), "inner"))
        later = common.materialize(spark.range(4), "later")
        common.release(spark, inner)
        return later

    later, made = common.recording(outer)
    assert len(made) == 2 and later.count() == 4
    common.release(spark, made)
    assert made == [] and not common._RECORDED


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Session:
        class conf:  # noqa: N801
            @staticmethod
            def get(key, default=None):
                return default

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session)
