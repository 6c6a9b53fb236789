"""A corpus pipeline of four stages: toxic documents go, one document of each
group of near duplicates stays, sources are mixed to target weights, and the
mix is packed into sequences.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and
reread as the next one's docs before that is called.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from firnline.llm import mixing, ngram_join, packing, toxicity
from firnline.llm.common import prepare, read_table, recording, release, scratch_path

_BEFORE: list[str] = []  # scratch tables of the last stage


def _stage(spark: SparkSession, make) -> DataFrame:
    """make()'s result; the stage before has been written, so its scratch goes."""
    prepare(spark)
    release(spark, _BEFORE)
    out, made = recording(make)
    _BEFORE.extend(made)
    return out


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _stage(spark, lambda: toxicity.reject_toxic(docs, read_table(spark, sf_dir, "labels")))


def dedupe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _stage(spark, lambda: ngram_join.keep_one(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _stage(spark, lambda: mixing.mixed_documents(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _stage(spark, lambda: packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"), 1, 4096), 4096))


STAGES = [("toxicity", clean), ("ngram_join", dedupe), ("mixing", mix), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = read_table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = scratch_path(spark, name)
        out.write.parquet(path)
        release(spark, last)  # what this stage has read
        last.append(path)
        docs = spark.read.schema(out.schema).parquet(path)
    release(spark, _BEFORE)
    return docs
