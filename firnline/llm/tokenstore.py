"""Token files: every document's ids, compressed by a Re-Pair grammar, readable
at random.

A shard is a run of documents in order. Re-Pair replaces frequent neighbouring
ids by a new nonterminal, again and again; here each round replaces many pairs
at once (those that occur most, no pair overlapping an earlier replacement),
until no pair is frequent.
A shard's bytes hold the rules, each nonterminal's expansion length, the
sequence, and each document's first symbol and first id; documents never share
a symbol, so any document, or any range of its ids through the expansion
lengths, is decoded without the rest.

File format (little-endian): magic b"RPG1"; uint32 terminals (ids are below
it), rules, symbols, documents; uint32[rules][2] the rules; uint64[rules] the
expansion lengths; uint32[symbols] the sequence; int64[documents] doc ids;
uint8[documents] 1 where the doc id is null; uint64[documents+1] first symbol;
uint64[documents+1] first id.

Defined results: null and empty texts are the end id alone; rows with equal
doc_id are separate documents, in the order of their texts' crc32; an empty
table gives no files; extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firnline.llm.common import give_back, partitions, regrouped, scratch_path, small_table
from firnline.llm.tokens import Encoder

SHARD_IDS = 1 << 20
PAIRS_PER_ROUND = 8192
_SLOTS = 1 << 18
_MIX = np.uint32(0x9E3779B1)


def _slot(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    h = left * _MIX
    h ^= right * np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(15)
    return h & np.uint32(_SLOTS - 1)


def _frequent(seq: np.ndarray, slot: np.ndarray, top: np.ndarray, least: int):
    """Of the pairs in slots `top`, those that occur `least` times: their
    places, which pair is at each, and the pairs. Most slots hold one pair
    nearly alone; only the others' pairs are sorted."""
    number = np.full(_SLOTS + 1, -1, dtype=np.int32)
    number[top] = np.arange(len(top))
    nth = number[slot]
    hit = np.flatnonzero(nth >= 0)
    nth = nth[hit].astype(np.int64)
    key = seq[hit].astype(np.uint64) << np.uint64(32) | seq[hit + 1]
    one = np.zeros(len(top), dtype=np.uint64)
    one[nth] = key
    other = np.flatnonzero(key != one[nth])
    more, which = np.unique(key[other], return_inverse=True)
    nth[other] = len(top) + which
    keys, n = np.append(one, more), np.bincount(nth, minlength=len(top) + len(more))
    best = np.flatnonzero(n >= least)
    number = np.full(len(keys), -1)
    number[best] = np.arange(len(best))
    nth = number[nth]
    use = nth >= 0
    return hit[use], nth[use], np.stack([keys[best] >> np.uint64(32), keys[best] & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32)


def compress(ids: np.ndarray, starts: np.ndarray, terminals: int, least: int = 16):
    """Re-Pair on ids, no pair crossing a document start, until no pair occurs
    `least` times. Returns the rules, the sequence and the documents' first
    symbols."""
    seq = ids.astype(np.uint32)
    first = np.zeros(len(seq) + 1, dtype=bool)
    first[starts] = True
    first[len(seq)] = True
    slot = _slot(seq[:-1], seq[1:]).astype(np.uint32)
    rules = []
    while len(seq) > 1:
        slot[np.flatnonzero(first[1 : len(seq)])] = _SLOTS  # across two documents
        counts = np.bincount(slot, minlength=_SLOTS + 1)[:_SLOTS]
        often = np.flatnonzero(counts >= least)
        top = often if len(often) <= PAIRS_PER_ROUND else often[np.argpartition(counts[often], -PAIRS_PER_ROUND)[-PAIRS_PER_ROUND:]]
        hit, nth, pair = _frequent(seq, slot, top, least)
        if not len(pair):  # the fullest slots hold rare pairs only: look into all
            hit, nth, pair = _frequent(seq, slot, often, least)
            if not len(pair):
                break
        # In a run of overlapping places, every other one, from the first.
        new_run = np.ones(len(hit), dtype=bool)
        new_run[1:] = hit[1:] != hit[:-1] + 1
        order = np.arange(len(hit))
        odd = (order - np.maximum.accumulate(np.where(new_run, order, 0))) & 1
        hit, nth = hit[odd == 0], nth[odd == 0]
        seq[hit] = (terminals + len(rules)) + nth.astype(np.uint32)
        keep = np.ones(len(seq), dtype=bool)
        keep[hit + 1] = False
        rules += pair.tolist()
        seq, first = seq[keep], first[np.append(keep, True)]
        # Only pairs with a new symbol have another slot now.
        slot = np.append(slot, np.uint32(0))[keep][:-1]
        new = hit - np.arange(len(hit))
        changed = np.concatenate([new[new < len(slot)], new[new > 0] - 1])
        slot[changed] = _slot(seq[changed], seq[changed + 1])
    every = np.append(starts, len(ids))
    return np.array(rules, dtype=np.uint32).reshape(-1, 2), seq, np.flatnonzero(first)[np.searchsorted(np.unique(every), every)]


def rule_lengths(rules: np.ndarray, terminals: int) -> np.ndarray:
    n = np.ones(len(rules), dtype=np.uint64)
    for i, (a, b) in enumerate(rules.tolist()):
        n[i] = (1 if a < terminals else int(n[a - terminals])) + (1 if b < terminals else int(n[b - terminals]))
    return n


def pack_shard(docs: list[int | None], streams: list[bytes], terminals: int) -> bytes:
    ends = np.cumsum([0, *(len(s) // 4 for s in streams)]).astype(np.uint64)
    ids = np.frombuffer(b"".join(streams), dtype="<u4")
    rules, seq, first = compress(ids, ends[:-1].astype(np.int64), terminals)
    return b"".join(
        [
            b"RPG1",
            struct.pack("<4I", terminals, len(rules), len(seq), len(docs)),
            rules.astype("<u4").tobytes(),
            rule_lengths(rules, terminals).astype("<u8").tobytes(),
            seq.astype("<u4").tobytes(),
            np.array([d or 0 for d in docs], dtype="<i8").tobytes(),
            np.array([d is None for d in docs], dtype="u1").tobytes(),
            first.astype("<u8").tobytes(),
            ends.astype("<u8").tobytes(),
        ]
    )


class Shard:
    """One shard's bytes, decoded by document or by a range of its ids."""

    def __init__(self, data: bytes):
        if data[:4] != b"RPG1":
            raise ValueError("not a token shard")
        self.terminals, rules, symbols, docs = struct.unpack_from("<4I", data, 4)
        at = 20

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, dtype=kind, count=n, offset=at)
            at += out.nbytes
            return out

        self.rules = take("<u4", 2 * rules).reshape(-1, 2)
        self.lengths = take("<u8", rules)
        self.sequence = take("<u4", symbols)
        doc_ids, null = take("<i8", docs), take("u1", docs)
        self.doc_ids = [None if z else d for d, z in zip(doc_ids.tolist(), null.tolist(), strict=True)]
        self._pool = None
        self.first_symbol = take("<u8", docs + 1)
        self.first_id = take("<u8", docs + 1)

    def _expansions(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rules in a row, and each one's start. A rule's parts are
        ids or earlier rules, so a pass resolves all rules of one height."""
        start = np.append(0, np.cumsum(self.lengths.astype(np.int64)))
        out, done = np.zeros(int(start[-1]), dtype=np.uint32), np.zeros(len(self.rules) + 1, dtype=bool)
        size = np.append(self.lengths.astype(np.int64), 1)
        part = np.where(self.rules >= self.terminals, self.rules.astype(np.int64) - self.terminals, len(self.rules))  # the last stands for an id
        done[-1] = True
        todo = np.arange(len(self.rules))
        while len(todo):
            ready = done[part[todo, 0]] & done[part[todo, 1]]
            now, todo = todo[ready], todo[~ready]
            if not len(now):
                raise ValueError("a rule refers to itself")
            at = start[now]
            for side in (0, 1):
                symbol, of = self.rules[now, side], part[now, side]
                plain = of == len(self.rules)
                out[at[plain]] = symbol[plain]
                n = size[of[~plain]]
                step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                out[np.repeat(at[~plain], n) + step] = out[np.repeat(start[of[~plain]], n) + step]
                at = at + size[of]
            done[now] = True
        return out, start

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """Ids of a run of symbols."""
        if self._pool is None:
            self._pool = self._expansions()
        pool, start = self._pool
        symbols = symbols.astype(np.uint32)
        big = np.flatnonzero(symbols >= self.terminals)
        rule = symbols[big] - self.terminals
        n = np.ones(len(symbols), dtype=np.int64)
        n[big] = self.lengths[rule].astype(np.int64)
        ends = np.cumsum(n)
        out = np.repeat(symbols, n)
        m = n[big]
        step = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
        out[np.repeat(ends[big] - m, m) + step] = pool[np.repeat(start[rule], m) + step]
        return out

    def document(self, i: int) -> np.ndarray:
        return self.expand(self.sequence[int(self.first_symbol[i]) : int(self.first_symbol[i + 1])])

    def ids(self, i: int, lo: int, hi: int) -> np.ndarray:
        """Ids lo..hi of document i; only symbols that meet the range expand."""
        part = self.sequence[int(self.first_symbol[i]) : int(self.first_symbol[i + 1])]
        size = np.ones(len(part), dtype=np.int64)
        big = part >= self.terminals
        size[big] = self.lengths[part[big] - self.terminals].astype(np.int64)
        ends = np.cumsum(size)
        a = int(np.searchsorted(ends, lo, side="right"))
        b = int(np.searchsorted(ends, hi, side="left")) + 1
        skip = lo - (int(ends[a - 1]) if a else 0)
        return self.expand(part[a:b])[skip : skip + hi - lo]


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None, shard_ids: int = SHARD_IDS) -> str:
    """Encode all documents, in doc_id order, into shard files under path (one
    row of the written table per shard: its place and its bytes)."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "tokens")

    def shards(batches):
        enc = Encoder.get(tokenizer)
        terminals = max(enc.tokenizer.get_vocab_size(), end_id + 1)
        end = np.array([end_id], dtype="<u4").tobytes()
        pid, nth, before, names, streams, held = TaskContext.get().partitionId(), 0, 0, [], [], 0

        def flush():
            nonlocal nth, before, names, streams, held
            row = (pid, nth, before, held, pack_shard(names, streams, terminals))
            nth, before, names, streams, held = nth + 1, before + held, [], [], 0
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=["part", "shard", "before", "n_ids", "data"]
            )

        for b in regrouped(batches, 1):
            for doc, ids in zip(b.column(0).to_pylist(), enc.encode(b.column(1).to_pylist()), strict=True):
                n = len(ids) // 4 + 1
                if held and held + n > shard_ids:
                    yield flush()
                names.append(doc)
                streams.append(ids + end)
                held += n
        if held:
            yield flush()
        give_back()

    (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .withColumn("_c", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
        .repartitionByRange(partitions(spark), "doc_id", "_c")
        .sortWithinPartitions("doc_id", "_c")
        .select("doc_id", "text")
        .mapInArrow(shards, "part int, shard long, before long, n_ids long, data binary")
        .write.option("compression", "zstd")
        .parquet(path)
    )
    return path


def read_tokens(spark: SparkSession, path: str, checksum: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian uint32) of every document;
    with checksum, ids_crc32 in place of ids."""
    files = spark.read.schema("part int, shard long, before long, n_ids long, data binary").parquet(path)
    at, rows = 0, []
    for part, n in sorted(files.groupBy("part").agg(F.sum("n_ids")).collect()):  # one row per partition
        rows.append((part, at))
        at += n
    first = small_table(spark, rows, "part int, _first long")
    last = "ids_crc32 long" if checksum else "ids binary"

    def decode(batches):
        for b in batches:
            for base, before, data in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                s = Shard(data)
                starts = s.first_id.astype(np.int64)
                every = memoryview(s.expand(s.sequence).astype("<u4").tobytes())
                each = (every[4 * a : 4 * z] for a, z in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True))
                got = pa.array([zlib.crc32(x) for x in each], pa.int64()) if checksum else pa.array([bytes(x) for x in each], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s.doc_ids, pa.int64()), pa.array(starts[:-1] + base + before), pa.array(np.diff(starts)), got],
                    names=["doc_id", "start", "n_tokens", last.split()[0]],
                )
        give_back()

    return files.join(F.broadcast(first), "part").select("_first", "before", "data").mapInArrow(decode, f"doc_id long, start long, n_tokens long, {last}")


def stored(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write the token files, read them back, and report each document's place
    and checksum."""
    return read_tokens(docs.sparkSession, write_tokens(docs, tokenizer, end_id), checksum=True)
