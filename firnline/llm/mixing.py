"""Mixing sources to target weights with a low-discrepancy schedule.

Each source's documents are shuffled by a hash and laid end to end; that word
stream is cut into blocks of equal length. Slot k of the mix maps the golden
ratio point frac(k * phi), in 64-bit arithmetic, through the cumulative target weights to a source;
the r-th slot of a source takes its r-th block, starting over after the last.
Every prefix of the mix thus holds the sources in nearly their target shares.

Defined results: a null text has size 0 and is kept with taken 0; a null
source is a source of its own, after all others; repeated rows (equal doc_id)
are separate documents; an empty table gives an empty mix; extra columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firnline.llm.common import materialize, ordered, small_table

GOLDEN = np.uint64(0x9E3779B97F4A7C15)  # the golden ratio's fraction, in 64-bit steps: exact for any number of slots
BLOCK_WORDS = 64


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size: the number of words of the whole text."""
    words = F.regexp_count(F.col("text").cast("string"), F.lit(r"[^\x20\x09-\x0D]+"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(words, F.lit(0)).cast("long").alias("size"))


def targets(sizes: list[tuple[str | None, int]], weights=(3, 1, 2), share: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """Target words per source. Sources in code point order, null last, weigh
    `weights` in turn and share `share` times all words; a source gets at most
    `most` times its own words, and what it can't take goes to the others by
    weight until none is above."""
    named = sorted(sizes, key=lambda x: (x[0] is None, (x[0] or "").encode()))
    left, out = share * sum(n for _, n in named), {}
    open_ = {s: (weights[i % len(weights)], n) for i, (s, n) in enumerate(named)}
    while open_:
        unit = left / sum(w for w, _ in open_.values())
        full = [s for s, (w, n) in open_.items() if w * unit > most * n]
        for s in full or list(open_):
            w, n = open_.pop(s)
            out[s] = most * n if full else w * unit
            if full:
                left -= out[s]
        if not full:
            break
    return out


def mix(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0, block_words: int = BLOCK_WORDS, seed: int = 7) -> dict[str, DataFrame]:
    """Returns `documents` (doc_id, source, size, source_size, target, first
    word in its source's stream), `schedule` (slot, source, nth, block, words)
    and `pieces` (slot, doc_id, source, from_word, words): the mix itself.

    Sources are few (one target each is held by the driver); all else is
    distributed: blocks are joined on (source, block), never on source alone."""
    spark = docs.sparkSession
    rows = ordered(
        materialize(sized(docs), "sized").withColumn("_h", F.xxhash64(F.lit(seed), F.col("doc_id"))),
        [F.col("source").asc_nulls_last(), F.col("_h"), F.col("doc_id"), F.col("size")],
        ("size",),
        "mix",
    )
    groups = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("before_size").alias("_first"))
    found = [(r[0], int(r[1]), int(r[2])) for r in groups.collect()]
    goal = targets([(s, n) for s, n, _ in found], weights, share, most)
    goal = {s: float(t) for s, t in goal.items()}
    named = sorted(found, key=lambda x: (x[0] is None, (x[0] or "").encode()))
    info = small_table(spark, 
        [(i, s, n, first, goal[s], int(goal[s] + 0.5), -(-n // block_words)) for i, (s, n, first) in enumerate(named)],
        "_s int, source string, source_size long, _first long, target double, _words long, _blocks long",
    )
    known = rows.join(F.broadcast(info), rows.source.eqNullSafe(info.source)).select(
        rows.doc_id, rows.source, "size", "source_size", "target", "_s", (F.col("before_size") - F.col("_first")).alias("first_word"), rows["rank"].alias("_row")
    )

    # The slots: low-discrepancy points through the cumulative weights.
    def slots_for(words: int, size: int) -> int:
        """Whole passes over a source, then blocks of the next."""
        return words // size * -(-size // block_words) + -(-(words % size) // block_words) if size else 0

    need = np.array([slots_for(int(goal[s] + 0.5), n) for s, n, _ in named], dtype=np.int64)
    total = int(need.sum())
    ends = [(int(e) << 64) // max(total, 1) for e in np.cumsum(need)]
    edges = np.array([min(e, (1 << 64) - 1) for e in ends], dtype=np.uint64)

    def draw(batches):
        for b in batches:
            k = b.column(0).to_numpy().astype(np.uint64)
            at = np.searchsorted(edges, (k + np.uint64(1)) * GOLDEN, side="right").clip(0, len(edges) - 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at.astype(np.int32))], names=["slot", "_s"])

    if total:
        slots = spark.range(total).withColumnRenamed("id", "slot").mapInArrow(draw, "slot long, _s int")
        drawn = dict(slots.groupBy("_s").count().collect())
        short = [(total + i, s) for i, s in enumerate(s for s in range(len(named)) for _ in range(int(need[s]) - drawn.get(s, 0)))]
        if short:  # the points' discrepancy, a few slots per source
            slots = slots.unionByName(small_table(spark, short, "slot long, _s int"))
        ranked = ordered(slots, [F.col("_s"), F.col("slot")], (), "slots")
        start, at = [], 0
        for s in range(len(named)):
            start.append((s, at))
            at += drawn.get(s, 0) + max(0, int(need[s]) - drawn.get(s, 0))
        first = small_table(spark, start, "_s int, _at long")
        ranked = ranked.join(F.broadcast(first), "_s").withColumn("nth", F.col("rank") - F.col("_at"))
    else:
        ranked = small_table(spark, [], "slot long, _s int, rank long, nth long")
    blocks = F.col("_blocks")
    length = F.least(F.lit(block_words), F.col("source_size") - F.pmod(F.col("nth"), blocks) * block_words)
    # What the slots of a source before this one take: whole passes, then blocks.
    taken = F.floor(F.col("nth") / blocks) * F.col("source_size") + F.pmod(F.col("nth"), blocks) * block_words
    schedule = (
        ranked.join(F.broadcast(info), "_s")
        .where(F.col("_blocks") > 0)
        .withColumn("block", F.pmod("nth", blocks))
        .withColumn("words", F.least(length, F.col("_words") - taken))
        .where((F.col("words") > 0) & (F.col("nth") < 2 * blocks))
        .select("slot", "source", "_s", "nth", "block", "words")
    )
    inside = known.where(F.col("size") > 0).select(
        "*",
        F.explode(
            F.sequence(F.floor(F.col("first_word") / block_words), F.floor((F.col("first_word") + F.col("size") - 1) / block_words))
        ).alias("block"),
    )
    lo = F.greatest(F.col("first_word"), F.col("block") * block_words)
    hi = F.least(F.col("first_word") + F.col("size"), F.col("block") * block_words + F.col("words"))
    pieces = (
        inside.drop("source")
        .join(schedule, ["_s", "block"])
        .select("slot", "doc_id", "_row", "source", (lo - F.col("first_word")).alias("from_word"), (hi - lo).alias("words"))
        .where(F.col("words") > 0)
    )
    return {"documents": known, "schedule": schedule, "pieces": pieces}


def mixed_counts(parts: dict[str, DataFrame]) -> DataFrame:
    """Words that the mix takes from each document."""
    taken = parts["pieces"].groupBy("_row").agg(F.sum("words").alias("taken"))
    return (
        parts["documents"]
        .join(taken, "_row", "left")
        .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "source", "_row")
    )


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """docs as the mix takes them: each row as many times as it is taken (0, 1
    or 2), to the nearest whole document; documents without words stay once.
    Rows with equal doc_id get the mean of theirs."""
    counts = mixed_counts(mix(docs, **how))
    each = F.when(F.col("size") == 0, 1.0).otherwise(F.col("taken") / F.greatest("size", F.lit(1)))
    copies = counts.groupBy(F.col("doc_id").alias("_id")).agg(F.round(F.avg(each)).cast("int").alias("_copies")).where("_copies > 0")
    copies = materialize(copies, "copies")
    rows = docs.select(F.struct(*docs.columns).alias("_row"))  # whatever its columns are called
    joined = rows.join(copies, F.col("_row.doc_id").cast("long").eqNullSafe(F.col("_id")))
    return joined.withColumn("_nth", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_row.*")
