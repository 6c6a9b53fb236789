"""Resharding by minimum-cost flow: from old shard sizes and new capacities,
the block transfers that move the fewest bytes, then a rewrite.

Old shards are sources of flow, new shards sinks; keeping a byte is free,
moving one costs 1. The flow has one node per shard, so its size doesn't
depend on the data. Documents then follow the flow: each old shard's rows, in
hash order, are cut at the flow's running totals; rounds of smallest-first
corrections, from files that change anyway where they suffice, bring sizes
within a small document of the capacities.

The layout before is a table of files, each a run of rows in (shard, hash)
order. A file all of whose rows stay is kept as it is; only the others are
rewritten. Where rows went is a table of segments (file, first and last place
in it, shard, first slot), a few per file, cut and corrected row.

Defined results: a null text has 8 bytes and the checksum of an empty one;
rows with equal doc_id, equal text included, are separate rows, told apart by
their place in their file; a null old shard is shard 0; an empty table gives no
rows; extra columns travel with their rows, but for those named like the
layout's own (size, old_shard, shard, slot), which it replaces.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firnline.llm.common import materialize, ordered, partitions, scratch_path, small_table


def min_cost_flow(n: int, arcs: list[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """Flow on each arc (from, to, capacity, cost) of a maximum flow of least
    cost, by successive shortest paths with potentials (costs >= 0)."""
    to, cap, cost, out = [], [], [], [[] for _ in range(n)]
    for a, b, c, w in arcs:
        for u, v, k, x in ((a, b, c, w), (b, a, 0, -w)):
            out[u].append(len(to))
            to.append(v)
            cap.append(k)
            cost.append(x)
    rise = [0] * n
    while True:
        far, via, heap = [None] * n, [-1] * n, [(0, source)]
        far[source] = 0
        while heap:
            d, u = heapq.heappop(heap)
            if d > far[u]:
                continue
            for e in out[u]:
                if cap[e] > 0:
                    x = d + cost[e] + rise[u] - rise[to[e]]
                    if far[to[e]] is None or x < far[to[e]]:
                        far[to[e]], via[to[e]] = x, e
                        heapq.heappush(heap, (x, to[e]))
        if far[sink] is None:
            return [cap[2 * i + 1] for i in range(len(arcs))]
        for v in range(n):
            rise[v] += far[v] if far[v] is not None else far[sink]
        push, v = None, sink
        while v != source:
            e = via[v]
            push = cap[e] if push is None else min(push, cap[e])
            v = to[e ^ 1]
        v = sink
        while v != source:
            e = via[v]
            cap[e] -= push
            cap[e ^ 1] += push
            v = to[e ^ 1]


def plan_transfers(old: dict[int, int], new: dict[int, int]) -> dict[int, list[tuple[int, int]]]:
    """Per old shard, (new shard, bytes) with the fewest bytes moved. The new
    capacities must sum to at least the old sizes."""
    rows, cols = sorted(old), sorted(new)
    n = len(rows) + len(cols) + 2
    a, b = n - 2, n - 1
    arcs = [(a, i, old[r], 0) for i, r in enumerate(rows)]
    arcs += [(len(rows) + j, b, new[c], 0) for j, c in enumerate(cols)]
    first = len(arcs)
    arcs += [(i, len(rows) + j, old[r], int(r != c)) for i, r in enumerate(rows) for j, c in enumerate(cols)]
    flow = min_cost_flow(n, arcs, a, b)[first:]
    plan = {r: [(c, flow[i * len(cols) + j]) for j, c in enumerate(cols) if flow[i * len(cols) + j]] for i, r in enumerate(rows)}
    for r in rows:  # what stays comes first
        plan[r].sort(key=lambda x: (x[0] != r, x[0]))
    return plan


def even(total: int, shards: int) -> dict[int, int]:
    return {s: total // shards + (s < total % shards) for s in range(shards)}


def _starts(rows: DataFrame, key: str) -> dict[int, tuple[int, int]]:
    """Per shard: its bytes, and the bytes before it."""
    return {int(r[0]): (int(r[1]), int(r[2])) for r in rows.groupBy(key).agg(F.sum("size"), F.min("before_size")).collect()}  # one row per shard


def _cut(rows: DataFrame, key: str, plan: dict[int, list[tuple[int, int]]], first: dict[int, int], whole: bool) -> DataFrame:
    """Give each row the new shard in whose part of its old shard its middle
    lies (whole: the part it lies inside of, so that no part takes more than
    its bytes); other rows keep their shard."""
    parts = [(r, first[r] + at, first[r] + at + n, c) for r, moves in plan.items() for at, n, c in _running(moves)]
    table = small_table(rows.sparkSession, parts, f"{key} int, _lo long, _hi long, _to int")
    cut = table.groupBy(key).agg(F.collect_list(F.struct("_lo", "_hi", "_to")).alias("_parts"))  # shards x shards
    lo = F.col("before_size") if whole else F.col("before_size") + F.col("size") / 2
    hi = F.col("before_size") + F.col("size") if whole else lo
    inside = (lambda p: (lo >= p["_lo"]) & (hi <= p["_hi"])) if whole else (lambda p: (lo > p["_lo"]) & (lo <= p["_hi"]))
    hit = F.get(F.filter("_parts", inside), F.lit(0))
    return rows.join(F.broadcast(cut), key, "left").withColumn("shard", F.coalesce(hit["_to"], F.col(key).cast("int"))).drop("_parts")


def _running(moves):
    at = 0
    for c, n in moves:
        yield at, n, c
        at += n


OWN = ("size", "old_shard", "shard", "slot")
FILES = 8  # of an old shard
SEGMENTS = 2_000_000  # sent to every task up to here, at 32 bytes each; beyond, joined


class Layout:
    """Shards as files: `rows()` reads them all, in no order. kept and
    rewritten: the numbers of files that stayed and that didn't."""

    def __init__(self, stayed: DataFrame, written: DataFrame, kept: int, rewritten: int):
        self.stayed, self.written, self.kept, self.rewritten = stayed, written, kept, rewritten

    def rows(self) -> DataFrame:
        return self.stayed.unionByName(self.written).select("_row.*", "size", "old_shard", "shard", "slot")


def reshard(docs: DataFrame, old_shard, shards: int = 24, corrections: int = 2, segments: int = SEGMENTS) -> Layout:
    """Rows of docs with size, old_shard, shard and slot (gapless from 0 in its
    shard) under the law `bytes`: shards of nearly equal bytes, and as few
    bytes moved from old_shard (a column of ints) as that allows."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    before = docs.select(
        F.struct(*[c for c in docs.columns if c not in OWN]).alias("_row"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("_crc"),
        F.coalesce(old_shard.cast("int"), F.lit(0)).alias("old_shard"),
    )
    doc = F.col("_row.doc_id").cast("long")
    count = before.agg(F.countDistinct("old_shard")).first()[0]
    # Files so small that most hold rows of one old shard and lie on one side of a cut: those stay.
    files = ordered(before, ["old_shard", F.xxhash64(doc, "_crc"), doc, "_crc"], ("size",), "layout", places=True, files=FILES * count)
    files = files.withColumnsRenamed({"_pid": "_file", "_idx": "_place"})
    rows = files.select(doc.alias("doc_id"), "size", "_crc", "old_shard", "_file", "_place", "before_size")
    at = _starts(rows, "old_shard")
    goal = even(sum(n for n, _ in at.values()), shards)
    plan = plan_transfers({s: n for s, (n, _) in at.items()}, goal)
    rows = _cut(rows, "old_shard", plan, {s: b for s, (_, b) in at.items()}, False).drop("before_size")
    for i in range(corrections):
        rows = materialize(rows, f"cut{i}")
        changes = rows.groupBy("_file").agg(F.max((F.col("shard") != F.col("old_shard")).cast("int")).alias("_fixed"))  # a row per file
        rows = rows.join(F.broadcast(changes), "_file").withColumnRenamed("shard", "_at")
        # Rows of files that change anyway, smallest first: a correction stops short by less than its next row.
        rows = ordered(rows, ["_at", F.col("_fixed").desc(), "size", "doc_id", "_crc", "_file", "_place"], ("size",), f"correct{i}").drop("_fixed", "rank")
        at = _starts(rows, "_at")
        now = {s: 0 for s in range(shards)} | {s: n for s, (n, _) in at.items()}
        moves = {s: [x for x in m if x[0] != s] for s, m in plan_transfers(now, goal).items()}
        rows = _cut(rows, "_at", moves, {s: at[s][1] if s in at else 0 for s in now}, True).drop("before_size", "_at")
    return _rewrite(files.drop("before_size", "rank"), segmented(rows), segments)


def segmented(rows: DataFrame) -> DataFrame:
    """Runs of rows of one shard in each file: _file, _lo, _hi (places), shard,
    _base (the first one's slot) and whether the file changes."""
    spark = rows.sparkSession

    def runs(batches):
        held = None  # an open run: file, first, last, shard, changes
        for b in batches:
            p, i, s, o = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns)
            if not len(p):
                continue
            first = np.flatnonzero(np.append(True, (p[1:] != p[:-1]) | (s[1:] != s[:-1])))
            last = np.append(first[1:], len(p)) - 1
            now = [p[first], i[first], i[last], s[first], np.maximum.reduceat((s != o).astype(np.int64), first)]
            if held is not None:
                if held[0] == now[0][0] and held[3] == now[3][0]:
                    now[1][0], now[4][0] = held[1], max(held[4], now[4][0])
                else:
                    now = [np.append(h, x) for h, x in zip(held, now, strict=True)]
            held = [int(x[-1]) for x in now]
            yield pa.RecordBatch.from_arrays([pa.array(x[:-1]) for x in now], names=["_file", "_lo", "_hi", "shard", "_moved"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in held], names=["_file", "_lo", "_hi", "shard", "_moved"])

    x = rows.select("_file", "_place", "shard", "old_shard").repartition(partitions(spark), "_file").sortWithinPartitions("_file", "_place")
    x = x.mapInArrow(runs, "_file long, _lo long, _hi long, shard long, _moved long").withColumn("_n", F.col("_hi") - F.col("_lo") + 1)
    x = ordered(x, ["shard", "_file", "_lo"], ("_n",), "segments")
    first = x.groupBy("shard").agg(F.min("before__n").alias("_first"))  # a row per shard
    change = x.groupBy("_file").agg(F.max("_moved").alias("_changed"))  # a row per file
    x = x.join(F.broadcast(first), "shard").join(F.broadcast(change), "_file")
    return materialize(x.select("_file", "_lo", "_hi", "shard", (F.col("before__n") - F.col("_first")).alias("_base"), "_changed"), "segments")


def _placed(files: DataFrame, found: DataFrame, most: int) -> DataFrame:
    """files' rows with shard and slot, by the segments of found."""
    spark = files.sparkSession
    names = [c for c in files.columns if c not in ("_file", "_place", "_crc")]
    n = found.count()
    if n > most:
        each = found.select(F.col("_file").alias("_p"), "_lo", "shard", "_base", F.explode(F.sequence("_lo", "_hi")).alias("_i"))
        rows = files.join(each, (files._file == each._p) & (files._place == each._i))
        return rows.select(*names, F.col("shard").cast("int").alias("shard"), (F.col("_base") + F.col("_i") - F.col("_lo")).alias("slot"))
    table = np.array([tuple(r) for r in found.select("_file", "_lo", "shard", "_base").collect()], dtype=np.int64).reshape(-1, 4)
    shared = spark.sparkContext.broadcast(table[np.lexsort((table[:, 1], table[:, 0]))])

    def place(batches):
        where = shared.value
        key = where[:, 0] << 40 | where[:, 1]  # a file has fewer than 2**40 rows
        for b in batches:
            at = b.schema.names.index
            pid, idx = (b.column(at(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("_file", "_place"))
            i = np.searchsorted(key, pid << 40 | idx, side="right") - 1
            cols = [b.column(at(c)) for c in names] + [pa.array(where[i, 2].astype(np.int32)), pa.array(where[i, 3] + idx - where[i, 1])]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "shard", "slot"])

    schema = T.StructType([*(files.schema[c] for c in names), T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    return files.mapInArrow(place, schema)


def _rewrite(files: DataFrame, found: DataFrame, most: int) -> Layout:
    spark = files.sparkSession
    state = dict(found.groupBy("_file").agg(F.max("_changed")).collect())  # a row per file
    changed, same = sorted(p for p, c in state.items() if c), sorted(p for p, c in state.items() if not c)
    stayed = _placed(files.where(F.col("_file").isin(same)), found.where("_changed = 0"), most)
    moved = _placed(files.where(F.col("_file").isin(changed)), found.where("_changed = 1"), most)
    path = scratch_path(spark, "shards")
    moved.write.option("compression", "zstd").partitionBy("shard").parquet(path)
    return Layout(stayed, spark.read.schema(moved.schema).parquet(path), len(same), len(changed))


def assign(docs: DataFrame, old_shard, shards: int = 24, corrections: int = 2) -> DataFrame:
    """doc_id, size, old_shard, shard and slot of every row of the new layout."""
    return reshard(docs, old_shard, shards, corrections).rows().select("doc_id", "size", "old_shard", "shard", "slot")
