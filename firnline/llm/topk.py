"""Exact top-k search in Hamming space by incremental multi-index hashing.

A vector's binary code has one bit per coordinate: whether it is above zero.
The code is cut into 16-bit segments with a table each. A query reads, at
radius 0, 1, 2, ..., all table entries whose segment differs from its own in
that many bits and verifies them; after radius r every code within
segments * (r + 1) - 1 bits has been seen, so the search ends when the k-th
verified distance is no larger.

Index rows are dealt by a hash of their id into shards, whose tables are built
once and written to the shared folder. Queries travel: a task reads a stream of
queries for one shard, whose files it maps, and hands on k rows per query,
which are merged by distance and id. Nothing depends on how often a vector
occurs.

Defined results: rows with a null vector or id are neither found nor searched
for; null coordinates count as not above zero; vectors shorter than the
longest are padded with zeros; ties are broken by id; repeated rows of one id
are found each; with fewer than k rows all are found; extra columns are
ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from firnline.llm.common import partitions, scratch_path, small_table
from firnline.llm.lm import Shared

SEGMENT = 16
SHARD_ROWS = 1_000_000


@lru_cache
def _masks(radius: int) -> np.ndarray:
    every = np.arange(1 << SEGMENT, dtype=np.uint16)
    return every[np.bitwise_count(every) == radius]


class Tables:
    """Multi-index tables over codes (rows of uint16 segments): for each
    segment, the rows by its value, and where each value's begin."""

    def __init__(self, codes: np.ndarray, order: list[np.ndarray], start: list[np.ndarray]):
        self.codes, self.order, self.start = codes, order, start

    @classmethod
    def of(cls, codes: np.ndarray) -> Tables:
        order = [np.argsort(codes[:, s], kind="stable").astype("<u4") for s in range(codes.shape[1])]
        start = [np.append(0, np.cumsum(np.bincount(codes[:, s], minlength=1 << SEGMENT))).astype("<u4") for s in range(codes.shape[1])]
        return cls(codes, order, start)

    def put(self, files: Shared, name: str) -> None:
        files.put(f"{name}.codes", self.codes.astype("<u2"))
        for s, (order, start) in enumerate(zip(self.order, self.start, strict=True)):
            files.put(f"{name}.order{s}", order)
            files.put(f"{name}.start{s}", start)

    @classmethod
    def get(cls, files: Shared, name: str, segments: int) -> Tables:
        codes = files.get(f"{name}.codes", "<u2").reshape(-1, segments)
        return cls(codes, *([files.get(f"{name}.{kind}{s}", "<u4") for s in range(segments)] for kind in ("order", "start")))

    def search(self, query: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and distances of the k nearest codes, ties by id."""
        n, m = self.codes.shape
        seen = np.zeros(n, dtype=bool)
        found, far = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for radius in range(SEGMENT + 1):
            fresh = []
            for s in range(m):
                v = (query[s] ^ _masks(radius)).astype(np.int64)
                a = self.start[s][v].astype(np.int64)
                size = self.start[s][v + 1].astype(np.int64) - a
                a, size = a[size > 0], size[size > 0]
                at = np.repeat(a - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                fresh.append(self.order[s][at])
            new = np.concatenate(fresh)
            new = np.unique(new[~seen[new]])
            seen[new] = True
            found = np.append(found, new)
            far = np.append(far, np.bitwise_count(self.codes[new] ^ query).sum(axis=1).astype(np.int64))
            if len(found) >= k:
                best = np.lexsort((ids[found], far))[:k]
                found, far = found[best], far[best]
                if far[-1] <= m * (radius + 1) - 1:
                    break
        best = np.lexsort((ids[found], far))[:k]
        return found[best], far[best]


def coded(vectors: DataFrame, id_column: str, vector_column: str, bits: int) -> DataFrame:
    wide = -(-bits // SEGMENT) * SEGMENT

    def run(batches):
        for b in batches:
            n = pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
            above = pc.fill_null(b.column(1).flatten(), 0.0).to_numpy(zero_copy_only=False) > 0
            x = np.zeros((len(n), wide), dtype=bool)
            x[np.repeat(np.arange(len(n)), n), np.arange(len(above)) - np.repeat(np.cumsum(n) - n, n)] = above
            codes = pa.Array.from_buffers(pa.binary(wide // 8), len(n), [None, pa.py_buffer(np.packbits(x, axis=1).tobytes())])
            yield pa.RecordBatch.from_arrays([b.column(0), codes.cast(pa.binary())], names=["id", "code"])

    return (
        vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v"))
        .where("id is not null and v is not null")
        .mapInArrow(run, "id long, code binary")
    )


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding", shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """query_id, rank (from 1), the found row's id and its distance."""
    spark = vectors.sparkSession
    rows, bits = vectors.agg(F.count(F.lit(1)), F.max(F.size(vector_column))).first()
    if not bits or bits < 0:
        return small_table(spark, [], f"query_id long, rank int, {id_column} long, distance int")
    shards, segments = -(-rows // shard_rows), -(-bits // SEGMENT)
    path = scratch_path(spark, "tables")

    def codes(column) -> np.ndarray:
        return np.frombuffer(b"".join(column), dtype="<u2").reshape(-1, segments)

    def build(pdf):
        files, s = Shared(path), int(pdf.s.iloc[0])
        files.put(f"{s}.ids", pdf.id.to_numpy().astype("<i8"))
        Tables.of(codes(pdf.code)).put(files, str(s))
        return pd.DataFrame({"s": [s]})

    # Rows are dealt out in turn: equal ids, however many, go to all shards.
    index = coded(vectors, id_column, vector_column, bits).withColumn("s", F.pmod(F.monotonically_increasing_id(), F.lit(shards)))
    held = {r.s for r in index.groupBy("s").applyInPandas(build, "s long").collect()}  # one row per shard
    asked = coded(queries, id_column, vector_column, bits).distinct()
    asked = asked.withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))).repartition(partitions(spark), "s", "id").sortWithinPartitions("s")

    def search(batches):
        files, now, tables, ids = Shared(path), None, None, None
        for b in batches:
            out, asking = ([], [], []), []
            query, code, shard = (b.column(i).to_pylist() for i in range(3))
            for q, c, bits_of, s in zip(query, codes(code), code, shard, strict=True):
                if s not in held:
                    continue
                if s != now:
                    now, tables, ids = s, Tables.get(files, str(s), segments), files.get(f"{s}.ids", "<i8")
                at, far = tables.search(c, ids, k)
                for o, v in zip(out, (np.full(len(at), q), ids[at], far), strict=True):
                    o.append(v)
                asking += [bits_of] * len(at)
            if asking:
                cols = [np.concatenate(o) for o in out]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(asking, pa.binary()), pa.array(cols[1]), pa.array(cols[2].astype(np.int32))], names=["query_id", "code", "id", "distance"])

    near = asked.mapInArrow(search, "query_id long, code binary, id long, distance int")
    rank = F.row_number().over(Window.partitionBy("query_id", "code").orderBy("distance", "id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_column), "distance")
