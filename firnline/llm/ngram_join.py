"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of five-word shingles. Equal texts form a class at once and
only its least doc_id (the representative) goes on. MinHash bands put
representatives into buckets. Each bucket's members are compared with its
least member first, so that a bucket of copies costs as many comparisons as it
has members. Those alike (similarity of 0.45 not ruled out) join its group;
those not surely close to it (0.65) are compared with one another, in tiles,
and join where 0.8 isn't ruled out. A pair of similarity 0.8 or more can't
consist of one that is surely close and one that isn't alike, so every similar
pair that shares a bucket shares a group. Inside a group all pairs are compared
in tiles. A comparison reads MinHash values a chunk at a time, and a pair is
dropped when the posterior probability that its similarity reaches the
threshold falls below the tolerance; within groups, what survives is verified
on the shingle sets themselves. A tile reports, per document, how many
documents it is linked to, and a spanning forest of the links, so no group
emits all its pairs.

Keys that many rows share (a text's copies, a bucket's least member, the centre
of a group) are split over tasks wherever rows are joined on them.

Defined results: words are `[^\\x20\\x09-\\x0D]+`; a text of one to four words is
one shingle; null and empty texts form one class without links to others;
repeated rows of one doc_id are documents of their own in counts and one row in
the result; rows without a doc_id are one row of the result, and count as
copies of a text but link no others; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firnline.llm.common import give_back, hashed, join_hot, materialize, mixed, partitions, parts_of, recording, release, text_bytes, words

SHINGLE = 5
THRESHOLD = 0.8
ROWS, BANDS = 6, 42
HASHES = ROWS * BANDS
CHUNK = 28
TOLERANCE = 1e-4
TILE, TILE_BYTES = 1024, 4 << 20  # a tile has no more documents, and shingles and signatures of about so many bytes
NEAR, CLOSE = 0.45, 0.65  # alike and surely close; NEAR <= threshold + CLOSE - 1
FILTER_BITS = 25  # a fixed 4 MB of hashes, whatever the number of documents
_A = np.random.default_rng(20).integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = np.random.default_rng(21).integers(0, 2**32, HASHES, dtype=np.uint32)


def shingle_hashes(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of every text's shingles in a row (repeats included), and
    the number of them per text."""
    code, dictionary, n = words(texts)
    h = hashed(dictionary)[code] if len(code) else np.zeros(0, np.uint64)
    lengths = np.where(n == 0, 0, np.maximum(n - size + 1, 1))
    starts = np.cumsum(n) - n
    out = np.empty(int(lengths.sum()), dtype=np.uint64)
    place = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(len(out))
    ends = np.repeat(starts + n, lengths)
    acc = np.zeros(len(out), dtype=np.uint64)
    for k in range(size):
        at = place + k
        inside = at < ends
        acc = mixed(acc * np.uint64(0x9E3779B97F4A7C15) + np.where(inside, h[np.minimum(at, max(len(h) - 1, 0))] if len(h) else 0, np.uint64(k + 1)))
    out[:] = acc
    return out, lengths


def signatures(shingles: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """MinHash values, one row of HASHES per text, of which the lower 16 bits are
    kept: others' are equal once in 65,536 (texts without shingles: all ones)."""
    sig = np.full((len(lengths), HASHES), 0xFFFFFFFF, dtype=np.uint32)
    has = np.flatnonzero(lengths)
    ends = np.cumsum(lengths)
    # A few texts at a time, so that the values stay in cache.
    for part in parts_of(lengths[has].tolist(), 1 << 15):
        rows = has[part]
        lo, hi = int(ends[rows[0]] - lengths[rows[0]]), int(ends[rows[-1]])
        x = (shingles[lo:hi] >> np.uint64(32)).astype(np.uint32)
        at = (ends[rows] - lengths[rows] - lo).astype(np.int64)
        y = np.empty_like(x)
        for k in range(HASHES):
            np.multiply(x, _A[k], out=y)
            y += _B[k]
            y ^= y >> np.uint32(15)
            sig[rows, k] = np.minimum.reduceat(y, at)
    return sig.astype(np.uint16)


@lru_cache
def needed_matches(threshold: float, tolerance: float = TOLERANCE) -> tuple[int, ...]:
    """For 1, 2, ... chunks of MinHash values: the least number of equal ones at
    which P(similarity >= threshold | matches) is not below the tolerance, for a
    uniform prior on [0, 1] (the posterior is Beta(m + 1, n - m + 1))."""
    out = []
    for n in range(CHUNK, HASHES + 1, CHUNK):
        # P(Beta(m+1, n-m+1) >= t) = P(Binomial(n+1, t) <= m)
        total, m = 0.0, 0
        for i in range(n + 1):
            total += math.comb(n + 1, i) * threshold**i * (1 - threshold) ** (n + 1 - i)
            m = i
            if total >= tolerance:
                break
        out.append(m)
    return tuple(out)


@lru_cache
def close_matches(threshold: float, tolerance: float = TOLERANCE) -> int:
    """The least number of equal values, of all, at which P(similarity <
    threshold | matches) is below the tolerance."""
    for m in range(HASHES + 1):
        # P(Beta(m+1, n-m+1) < t) = P(Binomial(n+1, t) > m)
        if math.fsum(math.comb(HASHES + 1, i) * threshold**i * (1 - threshold) ** (HASHES + 1 - i) for i in range(m + 1, HASHES + 2)) < tolerance:
            return m
    return HASHES + 1


def surviving(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Places of the pairs (i, j) of signature rows that no chunk drops."""
    alive, hits = np.arange(len(i)), np.zeros(len(i), dtype=np.int64)
    for k, least in enumerate(needed_matches(threshold)):
        s = slice(k * CHUNK, (k + 1) * CHUNK)
        for lo in range(0, len(alive), 1 << 15):
            part = alive[lo : lo + (1 << 15)]
            hits[part] += (a[i[part], s] == b[j[part], s]).sum(axis=1)
        alive = alive[hits[alive] >= least]
        if not len(alive):
            break
    return alive


def jaccard_pairs(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact similarities of pairs of sorted sets. Many pairs of a few sets: by
    products of 0/1 matrices over the shingles, a block of columns at a time."""
    if not len(i):
        return np.zeros(0)
    size = np.array([len(s) for s in sets])
    if len(i) < 8 * len(sets):
        same = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist(), strict=True)])
    else:
        which = np.repeat(np.arange(len(sets)), size)
        _, column = np.unique(np.concatenate(sets), return_inverse=True)
        order = np.argsort(column, kind="stable")
        which, column = which[order], column[order]
        both = np.zeros((len(sets), len(sets)), dtype=np.float32)
        last = int(column[-1]) + 1
        for lo in range(0, last, 4096):
            a, z = np.searchsorted(column, (lo, lo + 4096))
            x = np.zeros((len(sets), min(4096, last - lo)), dtype=np.float32)
            x[which[a:z], column[a:z] - lo] = 1
            both += x @ x.T
        same = np.rint(both[i, j]).astype(np.int64)
    return same / np.maximum(size[i] + size[j] - same, 1)


def _describe(docs: DataFrame) -> DataFrame:
    """doc_id, text hash, signature and number of shingles of every document."""

    def run(batches):
        import xxhash

        for b in batches:
            texts = text_bytes(b.column(1))
            for part in parts_of([len(t) for t in texts], 2 << 20):
                some = texts[part]
                shingles, n = shingle_hashes(some)
                sig = signatures(shingles, n)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(part.start, len(some)),
                        pa.array([xxhash.xxh3_128_digest(t) for t in some], pa.binary()),
                        pa.array([r.tobytes() if t.strip() else None for r, t in zip(sig, some, strict=True)], pa.binary()),
                        pa.array(n, pa.int64()),
                    ],
                    names=["doc_id", "hash", "sig", "size"],
                )
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, hash binary, sig binary, size long"
    )


def _bands(reps: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype=np.uint16).reshape(-1, BANDS, ROWS)
            key = np.zeros(sig.shape[:2], dtype=np.uint64)
            for r in range(ROWS):
                key = mixed(key * np.uint64(31) + sig[:, :, r])
            key = mixed(key + np.arange(BANDS, dtype=np.uint64))
            ids = np.repeat(b.column(0).to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(ids)], names=["bucket", "rep"])

    return reps.select("rep", "sig").mapInArrow(run, "bucket long, rep long")


def _alike(edges: DataFrame, reps: DataFrame) -> DataFrame:
    """edges (a, b) with whether their signatures leave a similarity of NEAR
    possible, and whether they make one of CLOSE sure."""

    def run(batches):
        for b in batches:
            ok, sure = np.zeros(b.num_rows, dtype=bool), np.zeros(b.num_rows, dtype=bool)
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), dtype=np.uint16).reshape(-1, HASHES) for i in (2, 3))
                every = np.arange(b.num_rows)
                ok[surviving(x, y, every, every, NEAR)] = True
                sure = (x == y).sum(axis=1) >= close_matches(CLOSE)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ok), pa.array(sure)], names=["a", "b", "ok", "sure"])

    x = reps.select(F.col("rep").alias("a"), F.col("sig").alias("sa"))
    y = reps.select(F.col("rep").alias("b"), F.col("sig").alias("sb"))
    both = join_hot(edges, y, "b", by="a").join(x, "a")  # a bucket's least member may have many others
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long, ok boolean, sure boolean")


def _alike_within(buckets: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) that join, within each bucket, all members that signatures
    leave a chance to be similar: all pairs compared, a forest of them given."""
    sizes = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    x = join_hot(buckets, sizes, "bucket").withColumn("tiles", F.ceil(F.col("_n") / TILE))
    x = x.withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles"))).join(reps.select("rep", "sig"), "rep")
    x = x.withColumn("p", F.explode(_pairs_of_tiles())).select(F.col("bucket").alias("key"), "p.i", "p.j", "tile", "rep", "sig")

    def run(batches):
        for columns, starts in _whole_groups(batches):
            _, ti, tj, tile, rep, sig = columns
            sig = np.frombuffer(b"".join(sig), dtype=np.uint16).reshape(-1, HASHES)
            i, j = _pairs(np.array(tile), np.array(ti), np.array(tj), starts)
            alive = surviving(sig, sig, i, j, threshold)
            a, b = _forest(np.array(rep), i[alive], j[alive])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return _by_group(x).mapInArrow(run, "a long, b long")


def _pairs_of_tiles():
    """The pairs (i, j) of tiles that a member's own tile is in."""
    return F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1),
        lambda t: F.struct(F.least(t, F.col("tile")).alias("i"), F.greatest(t, F.col("tile")).alias("j")),
    )


def _by_group(x: DataFrame) -> DataFrame:
    return x.repartition(partitions(x.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j", "rep")


def _whole_groups(batches, rows: int = 1024):
    """Columns of some rows of a sorted stream, and where their groups (by the
    first three columns; the fifth is the document) start; a group, at most two
    tiles, is never cut."""
    held: list[list] | None = None

    def cuts(columns):
        key = np.array(columns[:3], dtype=np.int64)
        return np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0)))

    last = None
    for b in batches:
        new = [c.to_pylist() for c in b.columns]
        seen = list(zip(new[0], new[1], new[2], new[4], strict=True))
        again = [x == y for x, y in zip([last, *seen], seen, strict=False)]  # rows of one doc_id
        last = seen[-1] if seen else last
        if any(again):
            new = [[v for v, z in zip(c, again, strict=True) if not z] for c in new]
        held = new if held is None else [x + y for x, y in zip(held, new, strict=True)]
        if len(held[0]) >= rows:
            starts = cuts(held)
            if len(starts) > 1:
                end = int(starts[-1])
                yield [c[:end] for c in held], starts
                held = [c[end:] for c in held]
    if held and held[0]:
        yield held, np.append(cuts(held), len(held[0]))


def _pairs(tile: np.ndarray, ti: np.ndarray, tj: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows within each group: inside its one tile, or across its two."""
    out_i, out_j = [], []
    for a, z in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if z - a == 2 and ti[a] == tj[a]:
            out_i.append(np.array([a]))
            out_j.append(np.array([a + 1]))
        elif z - a > 1:
            i, j = np.triu_indices(z - a, 1)
            if ti[a] != tj[a]:
                across = tile[a + i] != tile[a + j]
                i, j = i[across], j[across]
            out_i.append(a + i)
            out_j.append(a + j)
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (none, none)


def _forest(rep: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For linked rows i, j: (rep, least rep of its tree), without the roots."""
    _, at = np.unique(rep, return_inverse=True)
    ids = np.unique(rep)
    i, j = at[i], at[j]
    root = np.arange(len(ids))
    while len(i):
        a, b = root[i], root[j]
        differ = a != b
        if not differ.any():
            break
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    moved = np.flatnonzero(root != np.arange(len(ids)))
    return ids[moved], ids[root[moved]]


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, root (the least node it is connected with) of an edge list (a, b).
    Each round hangs every node's neighbours under the least of them, which
    halves paths; rounds are written to the shared folder."""
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    pairs, last = materialize(pairs, name), None
    while True:
        # Each node's larger neighbours go under the least of it and its neighbours.
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = join_hot(both.where("b > a"), least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(large, name)
        # Then its smaller neighbours, and itself, under the least of those.
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        again = join_hot(large, small, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        now = materialize(again.select("e.*").where("a <> b").distinct(), name)
        # Done when a round leaves the edges as they were.
        mark = now.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))"), F.expr("bit_xor(xxhash64(b, a, 1))")).first()
        changed, last, pairs = mark != last, mark, now
        if not changed:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _place(column):
    return F.pmod(F.xxhash64(column), F.lit(1 << FILTER_BITS))


def _filter(ids: DataFrame):
    """A bit for each hash of an id, of a fixed number of bits: keeps most other
    rows out of a join. The join decides."""
    spark, width = ids.sparkSession, 1 << 16

    def run(batches):
        blocks: dict[int, np.ndarray] = {}
        for b in batches:
            at = b.column(0).to_numpy()
            for k in np.unique(at // width).tolist():
                blocks.setdefault(k, np.zeros(width, dtype=bool))[at[at // width == k] % width] = True
        if blocks:
            yield pa.RecordBatch.from_arrays([pa.array(list(blocks)), pa.array([np.packbits(x).tobytes() for x in blocks.values()], pa.binary())], names=["block", "bits"])

    at = ids.select(_place("rep").alias("at")).distinct().repartition(partitions(spark), F.floor(F.col("at") / width))
    bits = np.zeros((1 << FILTER_BITS) // 8, dtype=np.uint8)
    for r in at.mapInArrow(run, "block long, bits binary").collect():  # all bits, 4 MB
        bits[r.block * width // 8 : (r.block + 1) * width // 8] = np.frombuffer(r.bits, dtype=np.uint8)
    return spark.sparkContext.broadcast(bits)


def _tiles(docs: DataFrame, members: DataFrame) -> DataFrame:
    """Rows (comp, i, j) of documents with their shingle sets: one for each pair
    of tiles that the document's tile is in."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    wanted = _filter(members)

    def among(batches):
        bits = wanted.value
        for b in batches:
            at = b.column(0).to_numpy()
            yield b.select([1, 2]).filter(pa.array((bits[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)))

    texts = texts.select(_place("doc_id").alias("at"), "doc_id", "text").mapInArrow(among, "doc_id long, text string")
    found = texts.join(members, texts.doc_id == members.rep).select("rep", "text", "comp", "tile", "tiles", "docs")

    def run(batches):
        for b in batches:
            raw = text_bytes(b.column(1))
            for part in parts_of([len(t) for t in raw], 2 << 20):
                sh, n = shingle_hashes(raw[part])
                sig = signatures(sh, n)
                sets = [np.unique(x).tobytes() for x in np.split(sh, np.cumsum(n)[:-1])]
                k = len(sets)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(b.column(c).slice(part.start, k) for c in (0, 2, 3, 4, 5)),
                        pa.array([s.tobytes() for s in sig], pa.binary()),
                        pa.array(sets, pa.binary()),
                    ],
                    names=["rep", "comp", "tile", "tiles", "docs", "sig", "shingles"],
                )
        give_back()

    rows = found.mapInArrow(run, "rep long, comp long, tile long, tiles long, docs long, sig binary, shingles binary")
    return rows.withColumn("p", F.explode(_pairs_of_tiles())).select(F.col("comp").alias("key"), "p.i", "p.j", "tile", "rep", "docs", "sig", "shingles")


def _compare(batches, threshold: float):
    """All links within a tile or between two: per document, how many documents
    and texts it is linked to, and per tree of links, its members."""
    for columns, starts in _whole_groups(batches):
        _, ti, tj, tile, rep, docs, sig, shingles = columns
        rep, docs, sets = np.array(rep), np.array(docs), [np.frombuffer(x, dtype=np.uint64) for x in shingles]
        sig = np.frombuffer(b"".join(sig), dtype=np.uint16).reshape(-1, HASHES)
        i, j = _pairs(np.array(tile), np.array(ti), np.array(tj), starts)
        alive = surviving(sig, sig, i, j, threshold)
        i, j = i[alive], j[alive]
        link = np.zeros(len(i), dtype=bool)
        cuts = np.searchsorted(i, starts)  # i ascends by group
        for g in np.flatnonzero(np.diff(cuts)):
            part, lo = slice(cuts[g], cuts[g + 1]), starts[g]
            link[part] = jaccard_pairs(sets[lo : starts[g + 1]], i[part] - lo, j[part] - lo) >= threshold
        i, j = i[link], j[link]
        n = np.bincount(i, docs[j], len(rep)) + np.bincount(j, docs[i], len(rep))
        other = np.bincount(i, minlength=len(rep)) + np.bincount(j, minlength=len(rep))
        keep = np.flatnonzero(other > 0)
        a, b = _forest(rep, i, j)
        nothing = pa.nulls(len(keep), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.append(rep[keep], a)),
                pa.concat_arrays([nothing, pa.array(b, pa.int64())]),
                pa.array(np.append(n[keep].astype(np.int64), np.zeros(len(a), np.int64))),
                pa.array(np.append(other[keep].astype(np.int64), np.zeros(len(a), np.int64))),
            ],
            names=["rep", "to", "links", "texts"],
        )
    give_back()


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, class_id (the least doc_id it is linked
    with, directly or through others), rep_id (the least doc_id of its text),
    n_links (documents of similarity >= threshold to it, copies included) and
    n_texts (other texts of that similarity)."""
    spark = docs.sparkSession
    seen, described = recording(lambda: materialize(_describe(docs), "described"))
    # A text with many copies is spread over tasks; one without needs no join.
    classes = seen.groupBy("hash").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("docs")).where("docs > 1")
    members = join_hot(seen.select("doc_id", "hash"), classes, "hash", "left", "doc_id").select(
        "doc_id", F.coalesce("rep", "doc_id").alias("rep"), F.coalesce("docs", F.lit(1).cast("long")).alias("docs")
    )
    members = materialize(members, "classes")
    reps = (
        seen.join(members.where("doc_id = rep").select("doc_id", "docs").dropDuplicates(["doc_id"]), "doc_id")
        .where("sig is not null")
        .select(F.col("doc_id").alias("rep"), "docs", "sig", "size")
        .dropDuplicates(["rep"])
    )
    reps = materialize(reps, "reps")
    release(spark, described)
    # Groups that hold every similar pair.
    bands, banded = recording(lambda: materialize(_bands(reps), "bands"))
    shared = bands.groupBy("bucket").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    left = materialize(join_hot(bands, shared.select("bucket", "hub"), "bucket").where("rep <> hub"), "buckets")
    release(spark, banded)
    edges = materialize(left.select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct(), "edges")
    judged = materialize(_alike(edges, reps), "judged")
    apart = left.join(judged.where("not sure").select(F.col("a").alias("rep"), F.col("b").alias("hub")), ["rep", "hub"]).select("bucket", "rep")
    near = judged.where("ok").select("a", "b").unionByName(_alike_within(materialize(apart, "apart"), reps, threshold))
    groups = components(near, "groups")
    groups = materialize(groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct()).join(reps.select(F.col("rep").alias("node"), "docs", "size"), "node"), "grouped")
    sizes = groups.groupBy("root").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col("size") * 8 + 2 * HASHES).alias("_bytes"))
    sizes = sizes.select("root", F.greatest(F.ceil(F.col("_n") / TILE), F.ceil(F.col("_bytes") / TILE_BYTES)).alias("tiles"))
    placed = join_hot(groups, sizes, "root", by="node").select(
        F.col("node").alias("rep"), F.col("root").alias("comp"), "tiles", F.pmod(F.xxhash64("node"), F.col("tiles")).alias("tile"), "docs"
    )
    placed = materialize(placed, "placed")
    links = _by_group(_tiles(docs, placed)).mapInArrow(lambda b: _compare(b, threshold), "rep long, to long, links long, texts long")
    links = materialize(links, "links")
    roots = components(links.where("to is not null").select(F.col("rep").alias("a"), F.col("to").alias("b")), "linked")
    counted = links.groupBy("rep").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    of_rep = counted.join(roots, counted.rep == roots.node, "left").select("rep", "links", "texts", F.coalesce("root", "rep").alias("class_id"))
    out = join_hot(members, of_rep, "rep", "left", "doc_id")
    return out.groupBy("doc_id").agg(
        F.min(F.coalesce("class_id", "rep")).alias("class_id"),
        F.min("rep").alias("rep_id"),
        F.max(F.coalesce("links", F.lit(0)) + F.col("docs") - 1).alias("n_links"),
        F.max(F.coalesce("texts", F.lit(0))).alias("n_texts"),
    )


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with the least doc_id of their class; of rows with equal
    doc_id, all stay or none. Rows without doc_id stay."""
    one = near_duplicates(docs, threshold).where("doc_id <> class_id").select("doc_id")
    return docs.join(materialize(one, "copies"), "doc_id", "left_anti").select(*docs.columns)
