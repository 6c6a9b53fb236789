"""Interpolated modified Kneser-Ney n-gram model, counted in Spark, kept as
sorted arrays that workers map into memory.

A word is its hash; its id is its place in the sorted array of all hashes. An
n-gram is its context, the id of the n-gram without its last word, and its last
word's id; its id is its place in the sorted array of all n-grams of its order.
So order k is counted with the files of order k - 1, in one pass over the
texts: a map side that merges what a task has seen, and a reduce side by range
of (context, word), in which frequent contexts are split by word. Each order's
range also hands to the order below, by its ranges, in how many contexts each
shorter n-gram occurs, as lower orders count contexts, not occurrences (but for
n-grams at a text's beginning, before which nothing stands).

Files of a range of order k: last words (w), where each context's begin (p),
counts up to 255 (c) with those beyond (o), and for each context the sum of its
counts and how many are 1, 2 and more (s), with those beyond 255 (t). Only a
few rows per range reach the driver. Files are written to the shared folder
under a temporary name and renamed, so a repeated task leaves the same file.

Defined results: a null text is an empty one, whose only token is its end;
rows with equal doc_id are separate texts; a null doc_id is in no held-out
part; with no training text every probability is uniform; extra columns are
ignored.
"""

from __future__ import annotations

import os
import struct
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from firnline.llm.common import give_back, hashed, materialize, partitions, recording, release, scratch_path, text_bytes, words

END = b" "  # holds a blank, so no word equals it
ORDER = 3
PART_BYTES = 4 << 20
MERGE_TOKENS = 2_000_000
HELD_BYTES = 256 << 20  # of files on a store that can't be mapped, a worker holds so many bytes


# Sorted integer runs, compressed: differences by byte planes.


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    import zstandard

    z = zstandard.ZstdCompressor(level=1)
    planes = np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T
    many = counts.astype("<u8").view(np.uint8).reshape(-1, 8).T
    blobs = [z.compress(np.ascontiguousarray(p).tobytes()) for p in (*planes, *many)]
    return struct.pack("<Q16I", len(keys), *map(len, blobs)) + b"".join(blobs)


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    z = zstandard.ZstdDecompressor()
    n, *sizes = struct.unpack_from("<Q16I", data)
    at, planes = 72, []
    for s in sizes:
        planes.append(np.frombuffer(z.decompress(data[at : at + s], max_output_size=max(n, 1)), dtype=np.uint8))
        at += s
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    keys = np.cumsum(np.stack(planes[:8], axis=1).copy().view("<u8").ravel(), dtype=np.uint64)
    return keys, np.stack(planes[8:], axis=1).copy().view("<u8").ravel()


def merged(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One sorted run; counts of equal keys are added."""
    if not runs:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    keys, counts = np.concatenate([k for k, _ in runs]), np.concatenate([c for _, c in runs])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first).astype(np.uint64) if len(keys) else counts


class Shared:
    """Arrays as files in the shared folder: mapped, or where the store can't be
    mapped, read whole when needed."""

    def __init__(self, path: str):
        self.path, self.held = path, {}

    def _local(self) -> str | None:
        return self.path[5:].replace("//", "/", 1) if self.path.startswith("file:") else None if "://" in self.path else self.path

    def put(self, name: str, array: np.ndarray) -> None:
        if local := self._local():
            os.makedirs(local, exist_ok=True)
            part = f"{local}/.{name}.{uuid.uuid4().hex}"
            array.tofile(part)
            os.replace(part, f"{local}/{name}")
            return
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(self.path)
        store.create_dir(path, recursive=True)
        part = f"{path}/.{name}.{uuid.uuid4().hex}"
        with store.open_output_stream(part) as out:
            out.write(array.tobytes())
        store.move(part, f"{path}/{name}")

    def get(self, name: str, kind: str) -> np.ndarray:
        if name in self.held:
            return self.held[name]
        if local := self._local():
            path = f"{local}/{name}"
            out = np.asarray(np.memmap(path, dtype=kind, mode="r")) if os.path.getsize(path) else np.zeros(0, dtype=kind)
        else:
            from pyarrow import fs

            store, path = fs.FileSystem.from_uri(self.path)
            with store.open_input_stream(f"{path}/{name}") as x:
                out = np.frombuffer(x.read(), dtype=kind)
            while self.held and sum(x.nbytes for x in self.held.values()) + out.nbytes > HELD_BYTES:
                self.held.pop(next(iter(self.held)))
        self.held[name] = out
        return out


def lowered(texts: list[bytes]) -> list[bytes]:
    return [t.lower() for t in texts]  # bytes.lower changes A-Z only


def _parts(batches):
    """(doc_id, texts, is training) in parts of bounded size."""
    ids, texts, train, size = [], [], [], 0
    for b in batches:
        for i, t, x in zip(b.column(0).to_pylist(), text_bytes(b.column(1)), b.column(2).to_pylist(), strict=True):
            ids.append(i)
            texts.append(t)
            train.append(x)
            size += len(t)
            if size >= PART_BYTES:
                yield ids, lowered(texts), train
                ids, texts, train, size = [], [], [], 0
    if ids:
        yield ids, lowered(texts), train


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Each text's words and its end, as places in a dictionary whose last entry
    is the end; and the number of tokens per text."""
    code, dictionary, n = words(texts)
    dictionary = pa.concat_arrays([dictionary, pa.array([END], pa.large_binary())])
    out = np.full(len(code) + len(n), len(dictionary) - 1, dtype=np.int64)
    keep = np.ones(len(out), dtype=bool)
    keep[np.cumsum(n + 1) - 1] = False
    out[keep] = code
    return out, dictionary, n + 1


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(40)) * np.uint64(n)) >> np.uint64(24)


class Words:
    """The vocabulary: sorted hashes by range; a word's id is its place."""

    def __init__(self, files: Shared, starts: list[int]):
        self.files, self.starts = files, starts
        self.hashes = [files.get(f"word-{i}.h", "<u8") if starts[i + 1] > starts[i] else None for i in range(len(starts) - 1)]

    def ids(self, h: np.ndarray) -> np.ndarray:
        order = np.argsort(h)
        s, out = h[order], np.full(len(h), -1, dtype=np.int64)
        cuts = np.searchsorted(_bucket(s, len(self.hashes)), np.arange(len(self.hashes) + 1))
        for i in np.flatnonzero(np.diff(cuts)):
            known, part = self.hashes[i], s[cuts[i] : cuts[i + 1]]
            if known is not None:
                at = np.searchsorted(known, part).clip(0, len(known) - 1)
                out[order[cuts[i] : cuts[i + 1]]] = np.where(known[at] == part, at + self.starts[i], -1)
        return out

    def gather(self, name: str, kind: str, ids: np.ndarray, width: int = 1) -> np.ndarray:
        """Rows of per-range arrays by id; ids of -1 give zeros."""
        order = np.argsort(ids)
        s, out = ids[order], np.zeros((len(ids), width), dtype=kind)
        cuts = np.searchsorted(s, self.starts)
        for i in np.flatnonzero(np.diff(cuts)):
            data = self.files.get(name.format(i), kind).reshape(-1, width)
            out[order[cuts[i] : cuts[i + 1]]] = data[s[cuts[i] : cuts[i + 1]] - self.starts[i]]
        return out


def _discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from counts of counts 1 to 4."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    d = [k - (k + 1) * y * b / a if a and b else 0.5 * k for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(min(max(x, 0.05), k) for k, x in zip((1, 2, 3), d, strict=True))


STEP = 2  # places to cut at are known to a STEP * partitions'th of all tokens


def _wide(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of counts as bytes, and the rows with larger ones beside their place."""
    big = np.flatnonzero((counts >= 255).any(axis=1))
    return np.minimum(counts, 255).astype("u1"), np.column_stack([big, counts[big]]).astype("<u8")


def _whole(small: np.ndarray, beyond: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows `at` of what _wide made."""
    out = small[at].astype(np.int64)
    big = np.flatnonzero((out == 255).any(axis=1))
    if len(big):
        out[big] = beyond[np.searchsorted(beyond[:, 0], at[big].astype(np.uint64)), 1:].astype(np.int64)
    return out


def _sums(counts: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of runs of counts: sum, and how many are 1, 2 and more."""
    c = counts.astype(np.int64)
    if not len(first):
        return np.zeros((0, 4), np.int64)
    return np.column_stack([np.add.reduceat(x.astype(np.int64), first) for x in (c, c == 1, c == 2, c >= 3)])


class Grams:
    """N-grams of one order: ranges of (context, word) keys, cut at splits.

    base: the id of each range's first n-gram; tail: the id of the first one
    at a text's beginning; edges: sums of contexts that lie in several ranges."""

    def __init__(self, files: Shared, order: int, wide: int, splits: np.ndarray):
        self.files, self.order, self.wide, self.splits = files, order, wide, splits
        self.base, self.tail, self.edges, self.discounts = [], 0, {}, (0.0, 0.0, 0.0)

    def _get(self, i: int, what: str, kind: str, columns: int = 0) -> np.ndarray:
        x = self.files.get(f"g{self.order}-{i}.{what}", kind)
        return x.reshape(-1, columns) if columns else x

    def ranges(self, keys: np.ndarray) -> np.ndarray:
        return np.append(np.append(0, np.searchsorted(keys, self.splits)), len(keys))

    def put(self, i: int, keys: np.ndarray, counts: np.ndarray) -> None:
        wide = np.uint64(self.wide)
        ctx = keys // wide
        lo = int(ctx[0]) if len(keys) else 0
        starts = np.searchsorted(ctx, np.arange(lo, int(ctx[-1]) + 2 if len(keys) else lo + 1, dtype=np.uint64))
        self.files.put(f"g{self.order}-{i}.p", np.append(np.uint64(lo), starts.astype("<u8")).astype("<u8"))
        self.files.put(f"g{self.order}-{i}.w", (keys % wide).astype("<u4" if self.wide < 1 << 32 else "<u8"))
        self.put_counts(i, counts)

    def put_counts(self, i: int, counts: np.ndarray) -> None:
        small, beyond = _wide(counts.astype(np.int64)[:, None])
        self.files.put(f"g{self.order}-{i}.c", small)
        self.files.put(f"g{self.order}-{i}.o", beyond)

    def put_sums(self, i: int, counts: np.ndarray) -> list[tuple]:
        """Store each context's sums. Returns those of the range's first and
        last context, which other ranges may hold parts of, and how many
        n-grams have count 1 to 4."""
        p = self._get(i, "p", "<u8")
        lo, starts = int(p[0]), p[1:].astype(np.int64)
        has = np.flatnonzero(np.diff(starts))
        each = np.zeros((max(len(starts) - 1, 0), 4), dtype=np.int64)
        each[has] = _sums(counts, starts[has])
        small, beyond = _wide(each)
        self.files.put(f"g{self.order}-{i}.s", small)
        self.files.put(f"g{self.order}-{i}.t", beyond)
        rows = [("counts", i, 0, np.array([(counts == k).sum() for k in (1, 2, 3, 4)], dtype="<i8").tobytes())]
        return rows + [("edge", i, lo + e, each[e].astype("<i8").tobytes()) for e in dict.fromkeys((0, len(each) - 1)) if len(each)]

    def words_of(self, i: int) -> np.ndarray:
        return self._get(i, "w", "<u4" if self.wide < 1 << 32 else "<u8")

    def contexts_of(self, i: int) -> np.ndarray:
        p = self._get(i, "p", "<u8")
        return np.repeat(int(p[0]) + np.arange(len(p) - 2), np.diff(p[1:].astype(np.int64)))

    def find(self, ctx: np.ndarray, word: np.ndarray, counts: bool = True):
        """Ids (-1: none) of n-grams given by context and word ids (-1: unknown);
        with counts, also their discounted shares of their contexts, and what
        the contexts leave to the order below (0 and 1 where a context has none)."""
        ids = np.full(len(ctx), -1, dtype=np.int64)
        wide = np.uint64(self.wide)
        ok = np.flatnonzero(ctx >= 0)
        # No n-gram ends with the beginning's id: it stands for unknown words.
        last = np.where(word[ok] < 0, self.wide - 1, word[ok]).astype(np.uint64)
        keys, back = np.unique(ctx[ok].astype(np.uint64) * wide + last, return_inverse=True)
        id_, n = np.full(len(keys), -1, dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
        of, last = keys // wide, keys % wide
        cuts = self.ranges(keys)
        for i in np.flatnonzero(np.diff(cuts)).tolist():
            p, w = self._get(i, "p", "<u8"), self.words_of(i)
            c, v = of[cuts[i] : cuts[i + 1]].astype(np.int64) - int(p[0]), last[cuts[i] : cuts[i + 1]].astype(w.dtype)
            inside = np.flatnonzero((c >= 0) & (c < len(p) - 2))
            lo, hi = p[1 + c[inside]].astype(np.int64), p[2 + c[inside]].astype(np.int64)
            end, v = hi.copy(), v[inside]
            open_ = np.flatnonzero(lo < hi)  # binary search in each context's words
            while len(open_):
                mid = (lo[open_] + hi[open_]) >> 1
                less = w[mid] < v[open_]
                lo[open_[less]] = mid[less] + 1
                hi[open_[~less]] = mid[~less]
                open_ = open_[lo[open_] < hi[open_]]
            hit = np.flatnonzero(lo < end)
            hit = hit[w[lo[hit]] == v[hit]]
            at, place = cuts[i] + inside[hit], lo[hit]
            id_[at] = (self.base[i] if self.base else 0) + place
            if counts:
                n[at] = _whole(self._get(i, "c", "u1", 1), self._get(i, "o", "<u8", 2), place)[:, 0]
        ids[ok] = id_[back]
        if not counts:
            return ids
        first = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
        # Once for each n-gram and each context, not for each token.
        total, *many = self.sums(of[first].astype(np.int64)).T
        free = sum(x * m for x, m in zip(self.discounts, many, strict=True))
        some, times = np.maximum(total, 1), np.diff(np.append(first, len(of)))
        left = np.repeat(np.where(total > 0, free / some, 1.0), times)
        d = np.array([0.0, *self.discounts])
        own = np.where(np.repeat(total > 0, times), np.maximum(n - d[np.minimum(n, 3)], 0) / np.repeat(some, times), 0.0)
        share, rest = np.zeros(len(ctx)), np.ones(len(ctx))
        share[ok], rest[ok] = own[back], left[back]
        return ids, share, rest

    def sums(self, some: np.ndarray) -> np.ndarray:
        """Sums of contexts, given by sorted ids."""
        out = np.zeros((len(some), 4), dtype=np.int64)
        cuts = self.ranges(some.astype(np.uint64) * np.uint64(self.wide) + np.uint64(self.wide - 1))
        for i in np.flatnonzero(np.diff(cuts)).tolist():
            p = self._get(i, "p", "<u8")
            at = some[cuts[i] : cuts[i + 1]] - int(p[0])
            ok = np.flatnonzero((at >= 0) & (at < len(p) - 2))
            out[cuts[i] + ok] = _whole(self._get(i, "s", "u1", 4), self._get(i, "t", "<u8", 5), at[ok])
        known = np.array(sorted(self.edges), dtype=np.int64)
        if len(known) and len(some):
            at = np.searchsorted(known, some).clip(0, len(known) - 1)
            for j in np.flatnonzero(known[at] == some).tolist():
                out[j] = self.edges[int(some[j])]
        return out

    def parts(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Contexts and last words of n-grams given by sorted ids."""
        ctx, word = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        cuts = np.append(np.searchsorted(ids, self.base), len(ids))
        for i in np.flatnonzero(np.diff(cuts)).tolist():
            p, at = self._get(i, "p", "<u8"), ids[cuts[i] : cuts[i + 1]] - self.base[i]
            ctx[cuts[i] : cuts[i + 1]] = int(p[0]) + np.searchsorted(p[1:], at.astype(np.uint64), side="right") - 1
            word[cuts[i] : cuts[i + 1]] = self.words_of(i)[at]
        return ctx, word


class Model:
    """What a worker needs to score: file names and a few numbers."""

    def __init__(self, path: str, starts: list[int], total: int, order: int = ORDER):
        self.path, self.starts, self.total, self.order = path, starts, total, order
        self.size, self.mass, self.rest, self.d1 = starts[-1], 0, 1.0, (0.0, 0.0, 0.0)
        self.grams: list[Grams] = []  # orders 2 and up

    def open(self) -> Model:
        self.files = Shared(self.path)
        self.words = Words(self.files, self.starts)
        for g in self.grams:
            g.files = self.files
        return self

    def suffix(self, order: int, ids: np.ndarray) -> np.ndarray:
        """Ids of n-grams (sorted ids) without their first word."""
        if order == 2:
            return self.grams[0].parts(ids)[1]
        ctx, word = self.grams[order - 2].parts(ids)
        some, back = np.unique(ctx, return_inverse=True)
        return self.grams[order - 3].find(self.suffix(order - 1, some)[back], word, counts=False)

    def history(self, ids: np.ndarray, first: np.ndarray, order: int):
        """For each token the id of the context that an n-gram of this order
        has there, or -1; with all lower ones. first: where texts begin."""
        begin = np.full(len(ids), self.size, dtype=np.int64)
        before = lambda x, start: np.where(first, start, np.append(-1, x[:-1]))
        out, now = [before(ids, begin)], ids
        for k in range(2, order):
            now = self.grams[k - 2].find(out[-1], ids, counts=False)
            out.append(before(now, -1))
        return out

    def score(self, texts: list[bytes]):
        """Per text: tokens, known tokens, log10 base and log10 model scores."""
        code, dictionary, n = _tokens(texts)
        of_word = self.words.ids(hashed(dictionary))
        count = self.words.gather("word-{}.c", "<u8", of_word)[:, 0].astype(np.float64)
        base = np.log10((count + 0.5) / (self.total + 0.5 * (self.size + 1)))
        p = np.full(len(of_word), self.rest / (self.size + 1))
        if self.size:
            seen = self.words.gather("cont-{}", "<u8", of_word)[:, 0].astype(np.int64)
            p += np.maximum(seen - np.array([0.0, *self.d1])[np.minimum(seen, 3)], 0) / self.mass
        p, ids = p[code], of_word[code]
        first = np.zeros(len(code), dtype=bool)
        at = np.append(0, np.cumsum(n)[:-1])
        first[at] = True
        ctx = np.where(first, self.size, np.append(-1, ids[:-1]))
        for g in self.grams:
            id_, share, rest = g.find(ctx, ids)
            p = share + rest * p
            ctx = np.where(first, -1, np.append(-1, id_[:-1]))
        known = np.add.reduceat((count[code] > 0).astype(np.int64), at)
        return n, known, np.add.reduceat(base[code], at), np.add.reduceat(np.log10(p), at)


def _table(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["kind", "bucket", "place", "data"])


ROWS = "kind string, bucket int, place long, data binary"


def _dealt(keys: np.ndarray, counts: np.ndarray, cuts: np.ndarray):
    for i in np.flatnonzero(np.diff(cuts)).tolist():
        a, z = cuts[i], cuts[i + 1]
        yield i, pack(keys[a:z], counts[a:z])


def _blobs(dealt):
    for i, data in dealt:
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([data], pa.binary())], names=["bucket", "data"])


def _reduced(dealt: DataFrame, ranges: int, keep, schema: str) -> DataFrame:
    """keep(range, its blobs) -> table, of each range in a task of its own."""
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches):
        held, data = None, []
        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if held is not None and i != held:
                    yield pa.RecordBatch.from_pandas(keep(held, data), arrow, preserve_index=False)
                    data = []
                held = i
                data.append(x)
        if held is not None:
            yield pa.RecordBatch.from_pandas(keep(held, data), arrow, preserve_index=False)
        give_back()

    return dealt.select("bucket", "data").repartitionById(ranges, "bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


def _training(batches):
    for _, texts, use in _parts(batches):
        texts = [t for t, x in zip(texts, use, strict=True) if x]
        if texts:
            yield _tokens(texts)


def _count_words(docs: DataFrame, path: str, n: int, order: int) -> tuple[Model, list]:
    """Words and their counts by range of hashes; a model without n-grams, and
    the most frequent words (range, place, count)."""

    def count(batches):
        runs, held = [], 0
        for code, dictionary, _ in _training(batches):
            runs.append(merged([(hashed(dictionary), np.bincount(code, minlength=len(dictionary)))]))
            held += len(runs[-1][0])
            if held > MERGE_TOKENS:
                runs, held = [merged(runs)], 0
        keys, counts = merged(runs)
        yield from _blobs(_dealt(keys, counts, np.searchsorted(_bucket(keys, n), np.arange(n + 1))))
        give_back()

    def keep(i, data):
        keys, counts = merged([unpack(x) for x in data])
        keys, counts = keys[counts > 0], counts[counts > 0]
        files = Shared(path)
        files.put(f"word-{i}.h", keys.astype("<u8"))
        files.put(f"word-{i}.c", counts.astype("<u8"))
        top = np.argsort(-counts.astype(np.int64), kind="stable")[:32]
        rows = [(i, -1, len(keys), int(counts.sum(dtype=np.int64))), *((i, int(p), 0, int(counts[p])) for p in top)]
        return pd.DataFrame(rows, columns=["bucket", "place", "words", "tokens"])

    schema = "bucket int, place long, words long, tokens long"
    found = _reduced(docs.mapInArrow(count, "bucket int, data binary"), n, keep, schema).collect()  # 33 rows per range
    per = {r.bucket: r for r in found if r.place < 0}
    starts = np.cumsum([0, *(per[i].words if i in per else 0 for i in range(n))]).tolist()
    model = Model(path, starts, sum(r.tokens for r in per.values()), order)
    return model, [(starts[r.bucket] + r.place, r.tokens) for r in found if r.place >= 0]


def _even(after: list[tuple[int, int, int]], share: int) -> list[int]:
    """Contexts to cut behind, so that about a share of the tokens is between."""
    out, held = [], 0
    for context, tokens, _ in after:
        held += tokens
        if held >= share:
            out.append(context + 1)
            held = 0
    return out


def _splits(contexts: int, wide: int, cuts: list[int], hot: list[tuple[int, int]], step: int) -> np.ndarray:
    """Keys that cut (context, word) into ranges: at the given contexts, and
    contexts with more tokens than a step into equal parts of their words."""
    if (contexts + 1) * wide >= 1 << 64:
        raise ValueError("too many n-grams for 64-bit keys")
    out = {c * wide for c in cuts}
    for c, tokens in hot:
        m = -(-tokens // step)
        if m > 1:
            out |= {c * wide + k * wide // m for k in range(m)} | {(c + 1) * wide}
    return np.array(sorted(out - {0}), dtype=np.uint64)


def _count_grams(docs: DataFrame, model: Model, splits: np.ndarray, step: int) -> tuple[DataFrame, list[tuple[int, int]]]:
    """Count the next order. Adds it to the model; returns the counts that go
    to the order below, and some contexts of the next order: id, tokens that
    follow it and those since the one before, and those that follow it."""
    wide, order, last = model.size + 1, len(model.grams) + 2, len(model.grams) + 2 == model.order
    grams = Grams(Shared(model.path), order, wide, splits)
    lower = model.grams[-1].splits if model.grams else None

    def count(batches):
        model.open()
        runs, held = [], 0
        for code, dictionary, lengths in _training(batches):
            ids = model.words.ids(hashed(dictionary))[code]
            first = np.zeros(len(ids), dtype=bool)
            first[np.append(0, np.cumsum(lengths)[:-1])] = True
            ctx = model.history(ids, first, order)[-1]
            ok = ctx >= 0
            keys = np.sort(ctx[ok].astype(np.uint64) * np.uint64(wide) + ids[ok].astype(np.uint64))
            at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
            runs.append((keys[at], np.diff(np.append(at, len(keys))).astype(np.uint32)))
            held += len(at)
            if held > MERGE_TOKENS:
                keys, counts = merged(runs)
                yield from _blobs(_dealt(keys, counts, grams.ranges(keys)))
                runs, held = [], 0
        keys, counts = merged(runs)
        yield from _blobs(_dealt(keys, counts, grams.ranges(keys)))
        give_back()

    def keep(i, data):
        keys, counts = merged([unpack(x) for x in data])
        grams.put(i, keys, counts)
        ctx, word = keys // np.uint64(wide), keys % np.uint64(wide)
        rows = [("size", i, len(keys), b""), ("tail", i, int((ctx < (model.size if order == 2 else model.grams[-1].tail)).sum()), b"")]
        if last:
            rows += grams.put_sums(i, counts)
        else:
            # Where the tokens that follow an n-gram add up to a step, and n-grams with more.
            sums = np.cumsum(counts.astype(np.int64))
            at = np.unique(np.append(np.searchsorted(sums, np.arange(step, int(sums[-1]) + 1, step)), len(sums) - 1))
            rows += [("sum", i, a, struct.pack("<qq", int(sums[a] - before), int(counts[a]))) for a, before in zip(at.tolist(), [0, *sums[at[:-1]].tolist()], strict=True)]
        # In how many contexts each shorter n-gram occurs.
        if order == 2:
            shorter, seen = np.unique(word, return_counts=True)
            cuts = np.searchsorted(shorter, model.starts)
        else:
            model.open()
            some, back = np.unique(ctx.astype(np.int64), return_inverse=True)
            shorter = np.sort(model.suffix(order - 1, some)[back].astype(np.uint64) * np.uint64(wide) + word)
            at = np.flatnonzero(np.append(True, shorter[1:] != shorter[:-1]))
            shorter, seen = shorter[at], np.diff(np.append(at, len(shorter)))
            cuts = np.append(np.append(0, np.searchsorted(shorter, lower)), len(shorter))
        return _table(rows + [("lower", j, 0, data) for j, data in _dealt(shorter, seen.astype(np.uint64), cuts)])

    counted = materialize(_reduced(docs.mapInArrow(count, "bucket int, data binary"), len(splits) + 1, keep, ROWS), f"lm-{order}")
    facts = counted.where("kind <> 'lower'").orderBy("bucket", "place").collect()  # a few rows per range
    sizes = {r.bucket: r.place for r in facts if r.kind == "size"}
    for i in range(len(splits) + 1):
        if i not in sizes:
            grams.put(i, np.zeros(0, np.uint64), np.zeros(0, np.int64))
            if last:
                grams.put_sums(i, np.zeros(0, np.int64))
    grams.base = np.cumsum([0, *(sizes.get(i, 0) for i in range(len(splits) + 1))]).tolist()[:-1]
    grams.tail = sum(r.place for r in facts if r.kind == "tail")
    model.grams.append(grams)
    if last:
        _finish(grams, facts)
    after = [(grams.base[r.bucket] + r.place, *struct.unpack("<qq", r.data)) for r in facts if r.kind == "sum"]
    return counted, after


def _finish(grams: Grams, facts: list) -> None:
    """Discounts, and sums of ranges' first and last contexts, from their rows."""
    many = np.zeros(4, np.int64)
    edges: dict[int, list[np.ndarray]] = {}
    for r in facts:
        if r.kind == "counts":
            many += np.frombuffer(r.data, "<i8")
        elif r.kind == "edge":
            edges.setdefault(r.place, []).append(np.frombuffer(r.data, "<i8"))
    grams.discounts = _discounts(many.tolist())
    grams.edges = {c: np.sum(x, axis=0) for c, x in edges.items()}


def _lower_grams(counted: DataFrame, model: Model, grams: Grams) -> None:
    """Counts of an order below the last: in how many contexts an n-gram occurs,
    or how often, where a text begins with it."""
    first = model.size if grams.order == 2 else model.grams[grams.order - 3].tail

    def keep(i, data):
        model.open()
        words_, ctx = np.asarray(grams.words_of(i)).astype(np.uint64), grams.contexts_of(i).astype(np.uint64)
        mine = ctx * np.uint64(grams.wide) + words_
        keys, seen = merged([unpack(x) for x in data if len(x)])
        counts = _whole(grams._get(i, "c", "u1", 1), grams._get(i, "o", "<u8", 2), np.arange(len(mine)))[:, 0]
        begins = ctx >= np.uint64(first)
        counts[~begins] = 0
        counts[np.searchsorted(mine, keys)] = np.where(begins[np.searchsorted(mine, keys)], counts[np.searchsorted(mine, keys)], seen.astype(np.int64))
        grams.put_counts(i, counts)
        return _table(grams.put_sums(i, counts))

    every = counted.sparkSession.range(len(grams.splits) + 1).select(F.col("id").cast("int").alias("bucket"), F.lit(b"").alias("data"))
    rows = counted.where("kind = 'lower'").select("bucket", "data").unionByName(every)
    _finish(grams, _reduced(rows, len(grams.splits) + 1, keep, ROWS).orderBy("bucket", "place").collect())


def _lower_words(counted: DataFrame, model: Model) -> None:
    """In how many contexts each word occurs."""
    path, starts = model.path, model.starts

    def keep(i, data):
        seen = np.zeros(starts[i + 1] - starts[i], dtype="<u8")
        for x in data:
            if len(x):
                keys, values = unpack(x)
                seen[keys.astype(np.int64) - starts[i]] += values
        Shared(path).put(f"cont-{i}", seen)
        return pd.DataFrame([(int(seen.sum()), *(int((seen == k).sum()) for k in (1, 2, 3, 4)), int((seen >= 3).sum()))], columns=["mass", "n1", "n2", "n3", "n4", "more"])

    every = counted.sparkSession.range(len(starts) - 1).select(F.col("id").cast("int").alias("bucket"), F.lit(b"").alias("data"))
    rows = counted.where("kind = 'lower'").select("bucket", "data").unionByName(every)
    sums = _reduced(rows, len(starts) - 1, keep, "mass long, n1 long, n2 long, n3 long, n4 long, more long")
    x = sums.agg(*[F.sum(c).alias(c) for c in sums.columns]).first()
    model.mass, model.d1 = int(x.mass), _discounts([x.n1, x.n2, x.n3, x.n4])
    model.rest = (model.d1[0] * x.n1 + model.d1[1] * x.n2 + model.d1[2] * x.more) / model.mass


def train(docs: DataFrame, order: int = ORDER) -> Model:
    """Fit on the rows of docs (doc_id, text, training boolean) that are for
    training. All counts cover all of them. order: 2 or more."""
    spark = docs.sparkSession
    path = scratch_path(spark, "lm")
    n = max(8, partitions(spark))
    model, hot = _count_words(docs, path, n, order)
    if not model.size:
        return model
    wide, share = model.size + 1, -(-model.total // n)
    cuts = [k * model.size // n for k in range(1, n)] + [model.size]
    splits = _splits(model.size, wide, cuts, [*hot, (model.size, model.total // 8)], share)
    for k in range(2, order + 1):
        (counted, after), made = recording(lambda s=splits: _count_grams(docs, model, s, -(-share // STEP)))
        if k == 2:
            _lower_words(counted, model)
        else:
            _lower_grams(counted, model, model.grams[k - 3])
        release(spark, made)
        if k < order:
            contexts = model.grams[-1].base[-1] + after[-1][0] + 1
            splits = _splits(contexts, wide, _even(after, share), [(c, own) for c, _, own in after], share)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity of
    every row of docs (doc_id, text, training)."""
    names = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]

    def run(batches):
        model.open()
        for ids, texts, _ in _parts(batches):
            n, known, base, p = model.score(texts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(n), pa.array(known), pa.array(np.full(len(n), model.total)), pa.array(base), pa.array(p), pa.array(10 ** (-p / n))],
                names=names,
            )
        give_back()

    return docs.mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def split_training(docs: DataFrame, folds: int = 5, out: int = 1) -> DataFrame:
    """doc_id, text and whether the row is for training: crc32 of doc_id, as
    text, modulo folds is not `out`."""
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds, F.lit(out - 1))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (fold != out).alias("training"))


def held_out_scores(docs: DataFrame, order: int = ORDER) -> DataFrame:
    rows = split_training(docs)
    out = score(rows, train(rows, order))
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5, F.lit(0))
    return out.select("doc_id", (fold == 1).alias("held_out"), *out.columns[1:])
