"""Faults found by readers of earlier versions, each with the case that showed
it."""

import numpy as np
from pyspark.sql import functions as F

from firnline.llm import common, fingerprints, sharding, topk
from firnline.llm.common import prepare, read_table


def test_edits_move_no_other_border():
    words = [f"word{i % 611}x{i % 7}" for i in range(2000)]  # no full stop in it
    text = " ".join(words)
    like = lambda t: fingerprints.likeness(fingerprints.Tree(text.encode()), fingerprints.Tree(t.encode()))
    assert like("front " + text) > 0.97
    assert like(" ".join(words[:1000] + ["new"] + words[1000:])) > 0.97
    assert like(" ".join(words[:1000] + words[1001:])) > 0.97
    assert like(text + " end") > 0.97 and like(text) == 1.0
    assert 0.6 < like(" ".join(words[:1500] + words[:500])) < 0.85


def test_queries_of_one_id_are_answered_apart(spark):
    prepare(spark)
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=32).tolist()) for i in range(60)] + [(60, [1.0] * 32)] * 5
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(7, rows[3][1]), (7, rows[4][1]), (7, rows[4][1])], "vec_id long, embedding array<double>")
    bits = {i: np.array(v) > 0 for i, v in rows}
    want = []
    for q in (3, 4):  # the third query row repeats the second
        near = sorted(((int((bits[q] != (np.array(v) > 0)).sum()), i) for i, v in rows))[:4]
        want += [(7, k + 1, i, d) for k, (d, i) in enumerate(near)]
    got = [tuple(r) for r in topk.nearest(vectors, asked, 4, shard_rows=9).collect()]
    assert sorted(got) == sorted(want)


def test_an_id_of_many_rows_is_spread_over_shards(spark):
    prepare(spark)
    vectors = spark.createDataFrame([(1, [1.0] * 16)] * 300 + [(2, [-1.0] * 16)], "vec_id long, embedding array<double>")
    got = topk.nearest(vectors, vectors.where("vec_id = 2"), 3, shard_rows=50).collect()
    assert [(r.rank, r.vec_id, r.distance) for r in sorted(got, key=lambda r: r.rank)] == [(1, 2, 0), (2, 1, 16), (3, 1, 16)]


def test_files_without_moving_rows_stay(spark, sf):
    docs = read_table(spark, sf, "documents")
    old = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 16, F.lit(0))
    layout = sharding.reshard(docs, old, 24)
    rows = layout.rows().select("size", "old_shard", "shard", "slot").toPandas()
    assert layout.kept > 0 and len(rows) == docs.count()
    assert (rows.groupby("shard").slot.agg(lambda s: sorted(s) == list(range(len(s))))).all()
    stayed = layout.stayed.select("old_shard", "shard").toPandas()
    assert len(stayed) and (stayed.old_shard == stayed.shard).all()


class Session:
    """A session whose checkpoint folder is set to `path`."""

    def __init__(self, spark, path):
        self.sparkContext, self.conf, self.path = spark.sparkContext, self, path

    def get(self, key, default=None):
        return self.path if key == "spark.checkpoint.dir" else default


def test_a_path_without_scheme_is_of_the_default_file_system(spark, tmp_path):
    assert common.shared_dir(Session(spark, str(tmp_path))) == f"file:{tmp_path}"
    assert common.shared_dir(Session(spark, "hdfs://a/b/")) == "hdfs://a/b"
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    hadoop.set("fs.viewfs.mounttable.other.link./x", f"file://{tmp_path}")
    fs = hadoop.get("fs.defaultFS")
    hadoop.set("fs.defaultFS", "viewfs://other/")
    try:
        assert common.shared_dir(Session(spark, "/x")) == "viewfs://other/x"  # not a folder of each machine
    finally:
        hadoop.set("fs.defaultFS", fs)


def test_without_a_setting_local_runs_have_one_folder_of_their_own(spark):
    bare = Session(spark, None)
    assert common.shared_dir(bare) == common.shared_dir(bare) and common.shared_dir(bare).startswith("file://")
