"""Product codes of vectors, trained and assigned in exact integers.

Components become floor(scale * x); a vector is cut into equal consecutive
parts, each with a codebook of its own. A part's nearest entry is found by
Exponion search: from the entry it had before, at distance u, only entries
within 2u of that entry can be as near (triangle inequality), and these stand
first in the entry's list of neighbours sorted by distance. Squared integers
keep the comparison exact: (gap between entries)^2 <= 4 u^2.

Each round reads vectors with their codes, writes them with new codes, and adds
up sums per part, entry and place in the tasks and then in Spark: the driver
gets one number per codebook component, whatever the number of vectors.

Defined results: vectors that are null, empty, or hold null or non-finite
components are dropped; all others must have one length, which the parts must
divide, and components whose squares fit 64 bits, else ValueError. Repeated
rows are vectors of their own; null ids come last where ids are ordered; equal
ids are ordered by their vectors. With fewer vectors than entries, a codebook
has an entry per vector. No vectors: no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firnline.llm.common import join_hot, materialize, prepare, recording, release, small_table


def as_integers(vectors: DataFrame, scale: int = 4096) -> DataFrame:
    """vec_id, label and `ints`, floor(scale * component), of the vectors kept."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    x = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), v.alias("embedding"))
    x = x.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~bad)
    return x.select("vec_id", "label", F.transform("embedding", lambda y: F.floor(y * float(scale))).alias("ints"))


def nearest(x: np.ndarray, start: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each row of x its nearest entry (ties: the lower index) and squared
    distance, starting at entry `start`; and how many distances were computed."""
    gaps = ((book[:, None] - book[None]) ** 2).sum(axis=2)
    ranked = gaps.copy()
    np.fill_diagonal(ranked, -1)  # itself first, whatever else has its place
    near = np.argsort(ranked, axis=1, kind="stable")[:, 1:]
    own = ((x - book[start]) ** 2).sum(axis=1)
    best, code, rows, counted = own.copy(), start.astype(np.int64), np.arange(len(x)), len(x)
    for rank in range(near.shape[1]):
        at = start[rows]
        j = near[at, rank]
        inside = gaps[at, j] <= 4 * own[rows]  # the list is sorted: who leaves has nothing more to see
        rows, j = rows[inside], j[inside]
        if not len(rows):
            break
        d = ((x[rows] - book[j]) ** 2).sum(axis=1)
        counted += len(rows)
        better = (d < best[rows]) | ((d == best[rows]) & (j < code[rows]))
        best[rows[better]], code[rows[better]] = d[better], j[better]
    return code, best, counted


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def assign(coded: DataFrame, books: np.ndarray) -> DataFrame:
    """coded (vec_id, label, ints, code) with the codes of these codebooks
    (parts x entries x places), searched from the codes it has, and `error`."""
    parts, _, places = books.shape
    fields = "vec_id long, label string, ints array<int>, code binary, error long"

    def run(batches):
        for b in batches:
            x = _matrix(b.column("ints"), parts * places)
            had = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(len(x), parts)
            codes, error = np.empty((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for p in range(parts):
                codes[:, p], d, _ = nearest(x[:, p * places : (p + 1) * places], had[:, p], books[p])
                error += d
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), b.column("label"), b.column("ints").cast(pa.list_(pa.int32())), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)],
                names=["vec_id", "label", "ints", "code", "error"],
            )

    return coded.select("vec_id", "label", "ints", "code").mapInArrow(run, fields)


def _means(coded: DataFrame, books: np.ndarray) -> np.ndarray:
    """Componentwise floor(sum / count) of each entry's parts; unused entries
    stay. A task sends one row per part, entry and place."""
    parts, entries, places = books.shape

    def run(batches):
        sums, counts = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for b in batches:
            x = _matrix(b.column("ints"), parts * places)
            code = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(len(x), parts)
            for p in range(parts):
                np.add.at(sums[p], code[:, p], x[:, p * places : (p + 1) * places])
                counts[p] += np.bincount(code[:, p], minlength=entries)
        p, e, i = (a.ravel() for a in np.indices(books.shape))
        some = counts[p, e] > 0
        yield pa.RecordBatch.from_arrays([pa.array(a[some]) for a in (p, e, i, sums.ravel(), counts[p, e])], names=["p", "e", "i", "s", "n"])

    got = coded.select("ints", "code").mapInArrow(run, "p long, e long, i long, s long, n long").groupBy("p", "e", "i").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    out = books.copy()
    for p, e, i, s, n in got.collect():  # as many rows as the codebooks have components
        out[p, e, i] = s // n
    return out


def train(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> tuple[np.ndarray, DataFrame]:
    """The codebooks after all rounds, and vec_id, label, ints, code (a byte
    per part), error of every kept vector under them, a written table."""
    prepare(vectors.sparkSession)
    if not 0 < entries <= 256:
        raise ValueError("an entry's index must fit a byte")
    x = as_integers(vectors, scale)
    size = x.agg(F.min(F.size("ints")), F.max(F.size("ints")), F.max(F.greatest(F.array_max("ints"), -F.array_min("ints")))).first()
    if size[0] is None:
        return np.zeros((parts, 0, 0), np.int64), x.select("vec_id", "label", F.col("ints").cast("array<int>"), F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error"))
    if size[0] != size[1] or size[0] % parts:
        raise ValueError(f"vectors of {size[0]} to {size[1]} components can't be cut into {parts} equal parts")
    if size[2] >= 1 << 31 or 16 * size[0] * int(size[2]) ** 2 >= 1 << 63:
        raise ValueError("a component's square is too large for exact distances in 64 bits")
    first = x.orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(entries).collect()
    books = np.array([r.ints for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2)
    coded, last = x.withColumn("code", F.lit(bytes(parts))), []
    for k in range(rounds + 1):
        coded, made = recording(lambda coded=coded, books=books: materialize(assign(coded, books), "codes"))
        release(vectors.sparkSession, last)
        last = made
        if k < rounds:
            books = _means(coded, books)
    return books, coded


def compressed(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """vec_id, code in hex, error, label_error (errors summed over equal
    labels, nulls together) and a hash of all final codebook components."""
    books, coded = train(vectors, parts, entries, rounds, scale)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    key = F.when(F.col("label").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), "label"))
    rows = coded.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", key.alias("_label"))
    sums = rows.groupBy("_label").agg(F.sum("error").alias("label_error"))
    return join_hot(rows, sums, "_label", by="vec_id").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def codebook_table(spark, books: np.ndarray) -> DataFrame:
    """part, entry, components: the codebooks as a table."""
    return small_table(spark, [(p, e, books[p, e].tolist()) for p in range(books.shape[0]) for e in range(books.shape[1])], "part int, entry int, components array<long>")
