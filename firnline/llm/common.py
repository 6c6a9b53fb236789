"""What the text operators share: scratch tables in the cluster's shared
folder, distributed ranks and running sums, and fast tokenising."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

_RECORDED: list[list[str]] = []
_OWN: dict[str, str] = {}  # by application: the folder of runs without a setting


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package, bound their Arrow batches by
    bytes, so that very long texts don't pile up in one batch, and let shuffle
    files go when the query that wrote them ends: steps pass written tables."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "2m")
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A
    temporary one is made only where that is unset and driver and executors are
    one process (local runs and tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId  # the setting can't be changed while an application runs
        path = _OWN.setdefault(app, "") or "file://" + tempfile.mkdtemp(prefix="shared-")
        _OWN[app] = path
    if "://" not in path:  # of the default file system: workers that open it themselves must know which
        found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        path = found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(found).toString()
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    for made in _RECORDED:
        made.append(path)
    return path


def recording(make) -> tuple:
    """make()'s result and the scratch tables it made, for `release`."""
    made: list[str] = []
    _RECORDED.append(made)
    try:
        return make(), made
    finally:
        _RECORDED[:] = [x for x in _RECORDED if x is not made]  # lists of the same paths are equal


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete these scratch tables: call it when every result that reads them
    has been written."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while paths:
        path = jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(conf).delete(path, True)


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of a few rows of the driver's. By Arrow, it needs no Python
    workers beside those of the queries."""
    kind = T.StructType.fromDDL(schema)
    columns = {f.name: pa.array([r[i] for r in rows], to_arrow_type(f.dataType)) for i, f in enumerate(kind.fields)}
    return spark.createDataFrame(pa.table(columns), kind)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and
    a lost executor costs only a re-read."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_hot(many: DataFrame, few: DataFrame, key: str, how: str = "inner", by: str | None = None) -> DataFrame:
    """many joined with few, which has one row per key. Of the most frequent
    keys, four per task, which bounds what is broadcast, those in more than 256
    rows of many are split over tasks by a hash of column `by`. many is read
    twice: it should be a written table."""
    spark, n = many.sparkSession, 4 * partitions(many.sparkSession)
    top = many.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.col("_n").desc(), key).limit(n)
    top = [(bytes(r[0]) if isinstance(r[0], bytearray) else r[0], r[1]) for r in top.where("_n > 256").collect()]
    each = max(256, sum(x for _, x in top) // n)
    hot = F.broadcast(small_table(spark, [(k, -(-x // each)) for k, x in top], f"_hot {dict(many.dtypes)[key]}, _salts int"))
    salts = F.when(F.col(key).isNull(), n).otherwise(F.coalesce("_salts", F.lit(1)))  # rows without a key are spread, too
    salt = F.pmod(F.xxhash64(by or next(c for c in many.columns if c != key)), salts).cast("int")
    left = many.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_salt", salt).drop("_hot", "_salts")
    right = few.join(hot, F.col(key) == F.col("_hot"), "left")
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_hot", "_salts")
    return left.join(right, [key, "_salt"], how).drop("_salt")


def ordered(df: DataFrame, keys: list, sums: tuple[str, ...] = (), name: str = "ordered", places: bool = False, files: int = 0) -> DataFrame:
    """Rank all rows by keys, in at least `files` files: adds `rank` (from 0) and, for each column in
    sums, `before_<column>`, the sum over all rows before it; with places, also
    `_pid` and `_idx`, the row's file of the sorted table and its place there.

    A range sort spreads equal leading keys over tasks, each task counts its
    own rows, and only one total per partition reaches the driver. The sorted
    rows are written once, so ranks and totals come from the same rows."""
    spark = df.sparkSession
    schema = T.StructType(
        [*df.schema.fields, T.StructField("_pid", T.IntegerType()), T.StructField("_idx", T.LongType())]
        + [T.StructField(f"_sum_{c}", T.LongType()) for c in sums]
    )

    def number(batches):
        pid, n, base = TaskContext.get().partitionId(), 0, dict.fromkeys(sums, 0)
        for b in batches:
            cols = [b.column(i) for i in range(b.num_columns)]
            cols += [pa.array(np.full(b.num_rows, pid, dtype=np.int32)), pa.array(np.arange(n, n + b.num_rows))]
            n += b.num_rows
            for c in sums:
                v = pc.fill_null(b.column(b.schema.names.index(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                run = np.cumsum(v) + base[c]
                cols.append(pa.array(run - v))
                if len(run):
                    base[c] = int(run[-1])
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    x = df.repartitionByRange(max(partitions(spark), files), *keys).sortWithinPartitions(*keys).mapInArrow(number, schema)
    x = materialize(x, name)
    totals = x.groupBy("_pid").agg(
        (F.max("_idx") + 1).alias("n"), *[F.max(F.col(f"_sum_{c}") + F.coalesce(F.col(c), F.lit(0))).alias(c) for c in sums]
    )
    start, rows = [0] * (1 + len(sums)), []
    for r in sorted(totals.collect()):  # one row per partition
        rows.append((r[0], *start))
        start = [a + b for a, b in zip(start, r[1:], strict=True)]
    fields = "_pid int, _n0 long" + "".join(f", _b{i} long" for i in range(len(sums)))
    at = small_table(spark, rows, fields)
    x = x.join(F.broadcast(at), "_pid")
    return x.select(
        *df.columns,
        *(["_pid", "_idx"] if places else []),
        (F.col("_n0") + F.col("_idx")).alias("rank"),
        *[(F.col(f"_b{i}") + F.col(f"_sum_{c}")).alias(f"before_{c}") for i, c in enumerate(sums)],
    )


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(texts: list[bytes]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Tokens `[^\\x20\\x09-\\x0D]+` of many texts: for each token its place in
    a dictionary, the dictionary, and for each text its number of tokens."""
    column = pa.array(texts, pa.large_binary())
    column = pa.Array.from_buffers(pa.large_string(), len(column), column.buffers())  # cut at bytes; they needn't be valid
    parts = pc.ascii_split_whitespace(column)
    flat, ends = parts.values, parts.offsets.to_numpy()
    some = pc.greater(pc.binary_length(flat), 0)  # blanks at a text's ends cut off empty parts
    lengths = np.diff(np.append(0, np.cumsum(some.to_numpy(zero_copy_only=False)))[ends])
    coded = flat.filter(some).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), _binary(coded.dictionary), lengths


def _binary(strings: pa.Array) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(strings), strings.buffers(), offset=strings.offset)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers spread over all numbers of 64 bits, one to one."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def hashed(dictionary: pa.Array, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte strings: the sum of what each byte at its place is
    spread to, and the length."""
    column = dictionary.cast(pa.large_binary())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint64)
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    start, size = ends[:-1] - ends[0], np.diff(ends)
    place = (np.arange(len(data)) - np.repeat(start, size)).astype(np.uint64)
    each = mixed((place << np.uint64(8) | data) + np.uint64((0x9E3779B97F4A7C15 * (2 * seed + 1)) & (2**64 - 1)))
    out, some = np.zeros(n, np.uint64), np.flatnonzero(size)
    out[some] = np.add.reduceat(each, start[some]) if len(some) else 0
    return mixed(out + size.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))


def text_bytes(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def parts_of(sizes: list[int], most: int) -> list[slice]:
    """Runs of neighbours whose sizes sum to at most `most` (a single larger
    one stands alone): bounded working memory without cutting a text."""
    out, lo, total = [], 0, 0
    for i, s in enumerate(sizes):
        if i > lo and total + s > most:
            out.append(slice(lo, i))
            lo, total = i, 0
        total += s
    if len(sizes) > lo:
        out.append(slice(lo, len(sizes)))
    return out


def regrouped(batches, column: int, most: int = 4 << 20):
    """Neighbouring batches joined until their texts reach `most` bytes."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += pc.sum(pc.binary_length(b.column(column))).as_py() or 0
        if size >= most:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def give_back() -> None:
    """Return freed memory to the system: workers live on after a stage, and
    others work beside them."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library
