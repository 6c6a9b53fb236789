"""Audit of how filters interact: what each of five filters removes, in every
order in which they can be applied.

Copies are found by partition refinement. All texts are one class, split by
length in code points, then by hashes of successive blocks (64 code points,
then eight times as many as so far); after each split classes of one row are
dropped, and only survivors go on, as numbers without texts. The whole texts of
what is left are compared; a class in which hashes hid different texts is told
apart by the texts themselves. Then masks of failed conditions are counted per
part, and the orders are worked out from at most 32 counts a part.

Defined results: a null text is empty; a null lang is the part ''; rows without
doc_id come after all others: they fail E if a row with an id has their text,
and never make others fail; equal doc_ids don't make each other fail. Of several
labels of a doc_id a 1 counts. No documents: no rows. Other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firnline.llm.common import join_hot, materialize, prepare, recording, release

FILTERS = "ABCDE"
BIT = {f: 1 << i for i, f in enumerate(FILTERS)}
FIRST, GROWTH, LEVELS = 64, 8, 10  # block borders: 64, 512, 4096, ... beyond any string's length
SEEN_BITS = 24  # of the filter that spares texts the way to the comparison: 2 MB at most


def blocks(text: Column, n: Column) -> Column:
    """Hashes of successive blocks of a text of n code points."""
    edges = [0, *(FIRST * GROWTH**k for k in range(LEVELS - 1)), 1 << 31]
    pairs = [(lo, min(hi, (1 << 31) - 1) - lo) for lo, hi in zip(edges, edges[1:], strict=False) if lo < (1 << 31) - 1]
    return F.array_compact(F.array(*[F.when(n > lo, F.xxhash64(F.lit(k), F.substr(text, F.lit(lo + 1), F.lit(size)))) for k, (lo, size) in enumerate(pairs)]))


def failed(text: Column, words: Column, n: Column) -> Column:
    """Bits of the failed conditions A to D."""
    n_words = F.size(words).cast("long")
    upper = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    tests = {"A": n_words < 100, "B": 100 * F.size(F.array_distinct(words)).cast("long") < 80 * n_words, "C": 100 * upper > 10 * n.cast("long"), "D": text.rlike("[#$%&*|]")}
    return sum(F.when(t, BIT[f]).otherwise(0) for f, t in tests.items())


def _texts(docs: DataFrame) -> DataFrame:
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return x.withColumn("n", F.length("text"))


def _key(level: int, bits: int) -> Column:
    """The class of a row after `level` blocks."""
    return F.shiftrightunsigned(F.xxhash64(F.col("n"), F.slice("blocks", 1, level)), 64 - bits)


def refine(rows: DataFrame, bits: int = 64) -> DataFrame:
    """rows (n, blocks and others; a written table) in classes of at least two
    that length and all block hashes leave together, with `key`, their class."""
    spark, x, level, old = rows.sparkSession, rows, 0, []
    while True:
        x = x.withColumn("key", _key(level, bits))
        counts = x.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("key")
        made, paths = recording(lambda x=x, counts=counts: materialize(join_hot(x, counts, "key", by="doc_id"), "classes"))
        release(spark, old)
        old = paths
        longest = made.agg(F.max(F.size("blocks"))).first()[0]
        if longest is None or level >= longest:
            return made
        x, level = made.drop("key"), level + 1


def _seen(classes: DataFrame, column: str = "key") -> tuple[DataFrame, Column, Column]:
    """A bitmap of the classes (its size is bounded by SEEN_BITS), the number
    of the bitmap's block in which a key falls, and the test of its bit."""
    place = lambda: F.col(column).bitwiseAND((1 << SEEN_BITS) - 1)
    maps = classes.select(F.shiftright(place(), 15).alias("_block"), place().bitwiseAND(32767).alias("_bit")).groupBy("_block").agg(F.bitmap_construct_agg("_bit").alias("_map"))
    byte = F.conv(F.hex(F.substr("_map", (F.shiftright(place().bitwiseAND(32767), 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    return F.broadcast(maps), F.shiftright(place(), 15), (F.floor(byte / F.pow(F.lit(2), place().bitwiseAND(7))) % 2) == 1


def copies(docs: DataFrame, rows: DataFrame, bits: int = 64) -> DataFrame:
    """Of rows (a written table of doc_id, n, blocks and others, one for each
    of docs' rows) those whose text a smaller doc_id has, with `first_id`, the
    least one."""
    classes = refine(rows, bits)
    keys = materialize(classes.select("key").distinct(), "keys")
    maps, block, there = _seen(keys)
    x = docs.withColumn("blocks", blocks(F.col("text"), F.col("n"))).withColumn("key", _key(LEVELS, bits)).withColumn("_block", block)
    texts = x.join(maps, "_block").where(there).drop("_block", "_map").join(keys, "key", "left_semi")
    same = texts.groupBy("key", "text").agg(F.min("doc_id").alias("first_id"))  # whole texts are compared here
    same = materialize(same.groupBy("key").agg(F.count(F.lit(1)).alias("texts"), F.min("first_id").alias("first_id")), "compared")
    later = F.col("first_id").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("first_id")))
    # refine leaves only keys of the whole text, so one text is one key.
    out = join_hot(classes, same.where("texts = 1").select("key", "first_id"), "key", by="doc_id").where(later)
    mixed = same.where("texts > 1").select("key")
    if mixed.limit(1).count():  # one hash, several texts: rows go with their texts
        held = materialize(texts.join(mixed, "key", "left_semi").select(*[c for c in rows.columns if c in texts.columns], "key", "text"), "mixed")
        each = held.groupBy("key", "text").agg(F.min("doc_id").alias("first_id"))
        more = held.join(each, ["key", "text"]).where(later)
        out = out.unionByName(more.select(*out.columns))
    return out


def audit(docs: DataFrame, labels: DataFrame, bits: int = 64) -> DataFrame:
    """One row per part, order of the filters and step."""
    prepare(docs.sparkSession)
    x = _texts(docs)
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    x = x.withColumn("_words", words).withColumn("mask", failed(F.col("text"), F.col("_words"), F.col("n"))).drop("_words")
    rows = materialize(x.select("doc_id", "part", "mask", "n", blocks(F.col("text"), F.col("n")).alias("blocks")), "masks")
    found = materialize(copies(x, rows, bits).select("doc_id", "part", "mask"), "copies")
    # A copy moves from its mask to that with E.
    moves = F.array(F.struct(F.col("mask"), F.lit(-1).alias("times")), F.struct((F.col("mask") + BIT["E"]).alias("mask"), F.lit(1).alias("times")))
    moved = found.withColumn("_m", F.explode(moves)).select("doc_id", "part", "_m.mask", "_m.times")
    all_rows = rows.select("doc_id", "part", "mask", F.lit(1).alias("times")).unionByName(moved)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").where(F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("bad"))
    zero = F.lit(0).cast("long")
    marked = join_hot(all_rows.where(F.col("doc_id").isNotNull()), known, "doc_id", by="part")
    counts = all_rows.groupBy("part", "mask").agg(F.sum("times").alias("n"), zero.alias("good"), zero.alias("bad"))
    lost = marked.groupBy("part", "mask").agg(zero.alias("n"), F.sum(F.col("times") * F.coalesce("good", zero)).alias("good"), F.sum(F.col("times") * F.coalesce("bad", zero)).alias("bad"))
    sums = counts.unionByName(lost).groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "bad")])
    return orders(sums)


def orders(counts: DataFrame) -> DataFrame:
    """counts (part, mask, n, good, bad) to a row per part, order and step."""
    x = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "bad")).alias("_counts"))  # 32 masks at most
    x = x.withColumn("filter_order", F.explode(F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])))
    x = x.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bits = lambda letters: sum(F.when(F.contains(letters, F.lit(f)), b).otherwise(0) for f, b in BIT.items())
    x = x.withColumn("_own", bits(F.substr("filter_order", F.col("step"), F.lit(1)))).withColumn("_before", bits(F.substr("filter_order", F.lit(1), F.col("step") - 1)))
    own, before, zero = F.col("_own"), F.col("_before"), F.lit(0).cast("long")

    def total(test, value=lambda c: c.n):
        return F.aggregate(F.filter("_counts", test), zero, lambda s, c: s + value(c))

    fails = lambda c, b: c.mask.bitwiseAND(b) != 0
    here = lambda c: fails(c, own) & ~fails(c, before)
    share = lambda c: c.n * F.floor(F.lit(120) / F.bit_count(c.mask))  # noqa: E731  of the orders, those in which it comes first of the failed ones
    return x.select(
        "part",
        "filter_order",
        "step",
        total(lambda c: ~fails(c, own + before)).alias("kept"),
        total(here).alias("removed"),
        total(lambda c: fails(c, own) & fails(c, before)).alias("redundant"),
        total(lambda c: c.mask == own).alias("unique_fails"),
        total(here, lambda c: c.good).alias("good_lost"),
        total(here, lambda c: c.bad).alias("toxic_lost"),
        total(lambda c: fails(c, own), share).alias("shapley"),
    )
