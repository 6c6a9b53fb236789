"""Best-fit packing of token pieces into sequences, in bulk-synchronous
rounds.

A round sorts the pieces still without a place and the gaps of the open
sequences together, longest first, by a distributed range sort. A sweep down
that order gives each piece its successor, the least gap that holds it: gaps
wait on a stack, a piece takes its top. Where pieces want the same gap, the
first by rank gets it, the next takes the gap below on the stack. Each task
sweeps its own range; what pieces and gaps it leaves over meet those of other
tasks by their counts alone, of which the driver sees two per task. Then gaps
shrink by what they took, and rounds repeat until all pieces are placed.

Longer pieces go first: a round takes those of over half the longest one's
length, or all once none is longer than a SANDth of the capacity. A gap
offers a place for each time the longest piece of the round that any open gap
holds goes into it, so that many short pieces fill it in one round. Pieces longer
than every gap open new sequences: as many as their tokens fill, or as pieces
of over half the capacity need.

Defined results: a null or empty text is its end token alone; a document over
the capacity is cut, others never; rows with equal doc_id are separate
documents; an empty table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from firnline.llm.common import give_back, materialize, partitions, regrouped, small_table
from firnline.llm.tokens import Encoder


SAND = 20


def pieces(docs: DataFrame, path: str, end_id: int, capacity: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces."""

    def cut(batches):
        enc = Encoder.get(path)
        for b in regrouped(batches, 1):
            out = [[], [], [], [], []]
            end = np.uint32(end_id).tobytes()
            for doc, ids in zip(b.column(0).to_pylist(), enc.encode(b.column(1).to_pylist()), strict=True):
                ids += end
                for p, at in enumerate(range(0, len(ids), 4 * capacity)):
                    x = ids[at : at + 4 * capacity]
                    for o, v in zip(out, (doc, p, at // 4, len(x) // 4, zlib.crc32(x)), strict=True):
                        o.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:])],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )
        give_back()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        cut, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def bracketed(gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a row of gaps (True) and pieces (False), longest first: for each piece
    the place of the gap it takes, or -1; and the places of the gaps left. A
    piece takes the last gap before it that no piece between has taken."""
    depth = np.cumsum(np.where(gap, 1, -1))
    least = np.minimum.accumulate(np.append(0, depth))[:-1]
    alone = ~gap & (depth < least)  # no gap is left before it
    use = np.flatnonzero(~alone)
    level = depth[use] + ~gap[use]
    order = use[np.argsort(level, kind="stable")]
    level = np.sort(level, kind="stable")
    # Gaps and pieces take turns within a level: each piece follows its gap.
    follows = np.append(False, level[1:] == level[:-1]) & ~gap[order]
    taken = np.full(len(gap), -1)
    at = np.flatnonzero(follows)
    taken[order[at]] = order[at - 1]
    left = gap.copy()
    left[order[at - 1]] = False
    return taken, np.flatnonzero(left)


SWEPT = "id long, length long, seq long, gap long, slot long, part int, nth long, is_gap boolean"


def _sweep(pieces: DataFrame, slots: DataFrame) -> DataFrame:
    """Pieces with the slot they got in their own task; pieces and gaps left
    over there, numbered by `nth` in each task (`part`)."""
    names = [f.split()[0] for f in SWEPT.split(", ")]
    kinds = [pa.int64()] * 5 + [pa.int32(), pa.int64(), pa.bool_()]
    rows = pieces.select(F.col("length").alias("key"), F.lit(1).alias("kind"), "id", F.lit(0).cast("long").alias("slot")).unionByName(
        slots.select(F.col("gap").alias("key"), F.lit(0).alias("kind"), F.col("seq").alias("id"), "slot")
    )
    order = [F.col("key").desc(), "kind", "id", "slot"]

    def run(batches):
        part, short = TaskContext.get().partitionId(), 0
        stack = np.zeros((0, 3), dtype=np.int64)  # gap, seq, slot

        def out(n, piece=None, place=None, nth=None, is_gap=False):
            cols = [None, None] if piece is None else [piece[:, 1], piece[:, 0]]
            cols += [None, None, None] if place is None else [place[:, 1], place[:, 0], place[:, 2]]
            cols += [np.full(n, part), nth, np.full(n, is_gap)]
            return pa.RecordBatch.from_arrays([pa.nulls(n, k) if c is None else pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

        for b in batches:
            key, kind, id, slot = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns)
            both = np.vstack([stack, np.stack([key, id, slot], axis=1)])
            gap = np.append(np.ones(len(stack), dtype=bool), kind == 0)
            taken, left = bracketed(gap)
            got = np.flatnonzero(taken >= 0)
            yield out(len(got), both[got], both[taken[got]])
            none = np.flatnonzero(~gap & (taken < 0))
            yield out(len(none), both[none], None, short + np.arange(len(none)))
            short += len(none)
            stack = both[left]
        for lo in range(0, len(stack), 1 << 16):
            some = stack[lo : lo + (1 << 16)]
            yield out(len(some), None, some, lo + np.arange(len(some)), True)

    x = rows.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    return materialize(x.mapInArrow(run, SWEPT), "swept")


def reconciled(left: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """left: (task, pieces, gaps) left over, by task. Rows (task, first piece,
    end piece, task of the gaps, gap of the first piece); later pieces take the
    gaps below it in turn."""
    stack, out = [], []
    for task, pieces, gaps in sorted(left):
        at = 0
        while at < pieces and stack:
            other, n = stack.pop()
            k = min(n, pieces - at)
            out.append((task, at, at + k, other, n - 1))
            if n > k:
                stack.append((other, n - k))
            at += k
        if gaps:
            stack.append((task, gaps))
    return out


def _matched(pieces: DataFrame, slots: DataFrame) -> DataFrame:
    """id, length of all pieces, with the seq, gap and slot each one takes in
    this round, or nulls."""
    spark = pieces.sparkSession
    swept = _sweep(pieces, slots)
    over = swept.where("nth is not null").groupBy("part").agg(F.count(F.when(~F.col("is_gap"), 1)), F.count(F.when(F.col("is_gap"), 1)))
    meet = small_table(spark, reconciled([tuple(r) for r in over.collect()]), "_part int, _lo long, _hi long, _of int, _top long")  # two rows a task
    waiting = swept.where("nth is not null and not is_gap")
    here = (waiting.part == meet._part) & (waiting.nth >= meet._lo) & (waiting.nth < meet._hi)
    wants = waiting.join(F.broadcast(meet), here, "left").select("id", "length", "_of", (F.col("_top") - (F.col("nth") - F.col("_lo"))).alias("_nth"))
    free = swept.where("is_gap").select("seq", "gap", "slot", F.col("part").alias("_of"), F.col("nth").alias("_nth"))
    met = wants.join(free, ["_of", "_nth"], "left").select("id", "length", "seq", "gap", "slot")
    return swept.where("nth is null").select("id", "length", "seq", "gap", "slot").unionByName(met)


def pack(cut: DataFrame, capacity: int = 4096) -> DataFrame:
    """Adds sequence_id and offset to pieces with a `length` of 1..capacity."""
    spark = cut.sparkSession
    cut = materialize(cut.withColumn("_id", F.monotonically_increasing_id()), "cut")  # numbers are written once
    left = cut.select(F.col("_id").alias("id"), F.col("length").cast("long").alias("length"))
    gaps = small_table(spark, [], "seq long, gap long")
    placed, made = [], 0
    length = F.col("length")
    while True:
        sizes = left.select(length.alias("size"), F.lit(1).alias("n")).unionByName(gaps.select(F.col("gap").alias("size"), F.lit(0).alias("n")))
        found = sizes.groupBy("size").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("all")).collect()  # at most `capacity` rows
        many = {r["size"]: r["n"] for r in found if r["n"]}  # pieces by length
        if not many:
            break
        widest, longest = max((r["size"] for r in found if r["all"] > r["n"]), default=0), max(many)
        # Of the pieces not longer than this, none goes in this round.
        short = longest // 2 if longest > capacity // SAND else 0
        least = min(x for x in many if x > short)
        longest_held = max((x for x in many if short < x <= widest), default=1)
        over = {x: n for x, n in many.items() if x > widest}
        new = max(-(-sum(x * n for x, n in over.items()) // capacity), sum(n for x, n in over.items() if x > capacity // 2))
        fresh = spark.range(new).select((F.col("id") + made).alias("seq"), F.lit(capacity).cast("long").alias("gap"))
        made += new
        # A gap offers as many places as surely hold the longest piece it can get.
        most = F.when(F.col("gap") > widest, F.lit(longest)).otherwise(F.lit(longest_held))
        gaps = gaps.unionByName(fresh)
        places = gaps.where(F.col("gap") >= least).withColumn("slot", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(1), F.floor(F.col("gap") / most)))))
        round_ = materialize(_matched(left.where(length > short), places), "round")
        got = round_.where("seq is not null")
        before = F.sum("length").over(Window.partitionBy("seq").orderBy("slot")) - F.col("length")  # at most `capacity` rows each
        placed.append(got.select(F.col("id").alias("_id"), F.col("seq").alias("sequence_id"), (capacity - F.col("gap") + before).alias("offset")))
        left = left.where(length <= short).unionByName(round_.where("seq is null").select("id", "length"))
        used = got.groupBy("seq").agg(F.sum("length").alias("_used"))
        gaps = gaps.join(used, "seq", "left").select("seq", (F.col("gap") - F.coalesce("_used", F.lit(0))).alias("gap")).where("gap > 0")
        gaps = materialize(gaps, "gaps")
    if not placed:
        return cut.select(*[c for c in cut.columns if c != "_id"], F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    where = placed[0]
    for p in placed[1:]:
        where = where.unionByName(p)
    return cut.join(where, "_id").drop("_id")
