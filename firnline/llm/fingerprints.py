"""Document fingerprints: a Merkle tree over sections, paragraphs and clauses.

Leaves are clauses: words up to one whose hash ends a clause (one in CLAUSE), or
to a sentence's or line's end; in a text's first HEAD bytes, single words;
longer leaves are cut where their own bytes say so, so none exceeds LEAF bytes
in any script. A
paragraph ends with its line, or after a sentence end whose leaf hash says so,
and hashes its leaves; a section, which ends after a paragraph whose hash says
so, hashes its paragraphs; the root hashes the sections and the text. Borders
depend on what stands at them alone, so edits move no other border.

The fingerprint holds all levels. Two are compared from their roots down:
equal roots are equal texts, an equal section or paragraph counts whole and
isn't entered, and only within differing branches are leaves compared, which
locates the edits and gives the likeness.

Defined results: a null text is an empty one; with equal doc_ids, the next
document is the one next in the order of text checksums; a single document is
its own next one; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firnline.llm.common import partitions, small_table

CLAUSE, LEAF, HEAD = 6, 128, 64
HASH = 5  # bytes of a leaf's, paragraph's or section's hash
# A sentence ends after . ! ? or their wide forms, with blanks behind, or with the line.
_SENTENCE = re.compile(rb"(?:[^.!?\n\xe3\xef]++|\xe3(?!\x80\x82)|\xef(?!\xbc[\x81\x9f]))*+(?:(?:[.!?]|\xe3\x80\x82|\xef\xbc[\x81\x9f])++[ \t]*+\n?|\n|$)")
_ONE_WORD = re.compile(rb"\s*+\S++|\s++")
_WORD = re.compile(rb"\S++\s*+|\s++")


def _hash(data: bytes, size: int = HASH) -> bytes:
    return hashlib.blake2b(data, digest_size=size).digest()


def _by_content(run: bytes) -> list[bytes]:
    """A long run cut after bytes where a hash of the last four says so, 8 to
    LEAF bytes apart."""
    x = np.frombuffer(run, dtype=np.uint8).astype(np.uint32)
    mixed = x.copy()
    for k in (1, 2, 3):
        mixed[k:] += x[:-k] * np.uint32(257**k)
    mixed = (mixed * np.uint32(0x9E3779B1)) >> np.uint32(28)
    out, lo = [], 0
    for at in [*(np.flatnonzero(mixed == 0) + 1).tolist(), len(run)]:
        if at - lo < 8 and at < len(run):
            continue
        while at - lo > LEAF:
            out.append(run[lo : lo + LEAF])
            lo += LEAF
        if at > lo:
            out.append(run[lo:at])
        lo = at
    return out


def _clauses(text: bytes):
    """(leaf, whether it ends a sentence, whether it ends its line)."""
    cut = text.find(b" ", HEAD, 2 * HEAD)
    cut = min(len(text), HEAD) if cut < 0 else cut
    pieces = [(w, False) for w in _ONE_WORD.findall(text[:cut])]  # the first words, so that short texts have several leaves
    for s in _SENTENCE.findall(text, cut):
        if len(s) <= 40:
            if s:
                pieces.append((s, True))
        else:
            held: list[bytes] = []
            for w in _WORD.findall(s):
                held.append(w)
                if zlib.crc32(w) % CLAUSE == 0:  # a word ends a clause wherever it stands
                    pieces.append((b"".join(held), False))
                    held = []
            if held:
                pieces.append((b"".join(held), True))
            else:
                pieces[-1] = (pieces[-1][0], True)
    for piece, ends in pieces:
        if len(piece) <= LEAF:
            yield piece, ends, piece.endswith(b"\n")
        else:
            parts = _by_content(piece)
            for x in parts[:-1]:
                yield x, False, False
            yield parts[-1], ends, piece.endswith(b"\n")


class Tree:
    """leaves: (hash, bytes); paragraphs and sections: (hash, first, end) of
    the level below."""

    __slots__ = ("leaves", "paragraphs", "root", "sections")

    def __init__(self, text: bytes):
        leaves, paragraphs, sections = [], [], []
        below, section, lo, first = [], [], 0, 0
        for leaf, sentence, line in _clauses(text):
            h = _hash(leaf)
            leaves.append((h, len(leaf)))
            below.append(h)
            if line or sentence and h[0] % 8 == 0:
                p = _hash(b"".join(below))
                paragraphs.append((p, lo, len(leaves)))
                below, lo = [], len(leaves)
                section.append(p)
                if p[0] % 4 == 0:
                    sections.append((_hash(b"".join(section)), first, len(paragraphs)))
                    section, first = [], len(paragraphs)
        if below:
            paragraphs.append((_hash(b"".join(below)), lo, len(leaves)))
            section.append(paragraphs[-1][0])
        if section:
            sections.append((_hash(b"".join(section)), first, len(paragraphs)))
        self.leaves, self.paragraphs, self.sections = leaves, paragraphs, sections
        # The root binds the text itself as well: the other hashes are short.
        self.root = _hash(b"".join(h for h, _, _ in sections) + hashlib.blake2b(text, digest_size=32).digest(), 16)

    def fingerprint(self) -> str:
        """The root, and from the sections down each node's hash, how many nodes
        are below it, and each leaf's size."""
        level = lambda nodes: b"".join(h + (z - a).to_bytes(4, "little") for h, a, z in nodes)
        counts = len(self.sections).to_bytes(4, "little") + len(self.paragraphs).to_bytes(4, "little")
        body = counts + level(self.sections) + level(self.paragraphs) + b"".join(h + bytes([n - 1]) for h, n in self.leaves)
        return f"{self.root.hex()}:{base64.b64encode(body).decode()}"

    @classmethod
    def of(cls, fingerprint: str) -> Tree:
        """The tree that a fingerprint holds."""
        root, _, body = fingerprint.partition(":")
        raw, at, wide = base64.b64decode(body), 8, HASH + 4
        out = cls.__new__(cls)
        out.root = bytes.fromhex(root)

        def level(n: int) -> list[tuple[bytes, int, int]]:
            nonlocal at
            nodes, first = [], 0
            for i in range(at, at + n * wide, wide):
                end = first + int.from_bytes(raw[i + HASH : i + wide], "little")
                nodes.append((raw[i : i + HASH], first, end))
                first = end
            at += n * wide
            return nodes

        out.sections = level(int.from_bytes(raw[:4], "little"))
        out.paragraphs = level(int.from_bytes(raw[4:8], "little"))
        out.leaves = [(raw[i : i + HASH], raw[i + HASH] + 1) for i in range(at, len(raw), HASH + 1)]
        return out


def _differing(a: list, b: list, within_a: list[tuple[int, int]], within_b: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Places, within the given ranges, of nodes of a and of b that have no
    equal node on the other side; equal ones are paired off in order."""
    out = []
    seen = [Counter(x[i][0] for lo, hi in r for i in range(lo, hi)) for x, r in ((a, within_a), (b, within_b))]
    for x, r, other in ((a, within_a, seen[1]), (b, within_b, seen[0])):
        left, mine = dict(other), []
        for lo, hi in r:
            for i in range(lo, hi):
                h = x[i][0]
                if left.get(h, 0):
                    left[h] -= 1
                else:
                    mine.append(i)
        out.append(mine)
    return out[0], out[1]


def differences(a: Tree, b: Tree) -> tuple[list[int], list[int]]:
    """Leaves of a and of b in which they differ, from the roots down: what is
    below an equal section or paragraph isn't looked at."""
    if a.root == b.root:
        return [], []
    x, y = _differing(a.sections, b.sections, [(0, len(a.sections))], [(0, len(b.sections))])
    x, y = _differing(a.paragraphs, b.paragraphs, [a.sections[i][1:] for i in x], [b.sections[i][1:] for i in y])
    return _differing(a.leaves, b.leaves, [a.paragraphs[i][1:] for i in x], [b.paragraphs[i][1:] for i in y])


def likeness(a: Tree, b: Tree) -> float:
    """Bytes outside differing leaves over the larger text's bytes; 1 for equal
    roots only. Depends on the fingerprints alone."""
    if a.root == b.root:
        return 1.0
    x, y = differences(a, b)
    n, m = sum(n for _, n in a.leaves), sum(n for _, n in b.leaves)
    same = min(n - sum(a.leaves[i][1] for i in x), m - sum(b.leaves[i][1] for i in y))
    return min(same / max(n, m, 1), 0.999999)


def edits(a: Tree, b: Tree) -> list[tuple[int, int]]:
    """Byte ranges of a's text that b's doesn't have, from the fingerprints."""
    starts = np.cumsum([0, *(n for _, n in a.leaves)]).tolist()
    out: list[tuple[int, int]] = []
    for i in differences(a, b)[0]:
        if out and out[-1][1] == starts[i]:
            out[-1] = (out[-1][0], starts[i + 1])
        else:
            out.append((starts[i], starts[i + 1]))
    return out


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the next text's first."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_next(docs: DataFrame, schema: str, make) -> DataFrame:
    """make(iterator of (doc_id, text, next text)) over all documents in doc_id
    order. Rows are dealt by ranges of doc_id; each range also gets the first
    document of the next one (the last range: of the first), so a text is sent
    once, but for one per range."""
    spark = docs.sparkSession
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("_k"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    n = 3 * partitions(spark)  # ranges, a task each
    cuts = rows.agg(F.percentile_approx("_k", [i / n for i in range(1, n)], 20 * n)).first()[0] or []
    cuts = sorted(set(cuts))

    def part(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([bisect.bisect_right(cuts, k) for k in b.column(0).to_pylist()], pa.int32()), b.column(0)], names=["_p", "_k"])

    heads = rows.select("_k").mapInArrow(part, "_p int, _k long").groupBy("_p").agg(F.min("_k")).collect()  # one row per range
    heads = sorted((int(p), int(k)) for p, k in heads)
    if not heads:
        return small_table(spark, [], schema)
    goes = {k: heads[i - 1][0] for i, (_, k) in enumerate(heads)}  # a head also ends the range before

    def deal(batches):
        for b in batches:
            ks = b.column(0).to_pylist()
            extra = [i for i, k in enumerate(ks) if k in goes]
            ps = [bisect.bisect_right(cuts, k) for k in ks] + [goes[ks[i]] for i in extra]
            take = pa.array([*range(len(ks)), *extra])
            last = pa.array([False] * len(ks) + [True] * len(extra))
            yield pa.RecordBatch.from_arrays([pa.array(ps, pa.int32()), last, *(b.column(i).take(take) for i in range(3))], names=["_p", "_last", "_k", "doc_id", "text"])

    dealt = (
        rows.mapInArrow(deal, "_p int, _last boolean, _k long, doc_id long, text string")
        .withColumn("_c", F.crc32(F.col("text").cast("binary")))
        .repartitionById(len(cuts) + 1, "_p")
        .sortWithinPartitions("_p", "_last", "_k", "_c")
        .select("_p", "_last", "doc_id", "text")
    )

    def pairs(batches):
        held = None
        done = False
        for b in batches:
            for p, last, doc, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held is not None and held[0] == p:
                    if not done:
                        yield held[1], held[2], text
                else:
                    done = False
                if last:
                    done = True  # only the first of the next range counts
                held = (p, doc, text)

    def run(batches):
        yield from make(pairs(batches))

    return dealt.mapInArrow(run, schema)


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    names = [f.split()[0] for f in FIELDS.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    types = [kinds[f.split()[1]] for f in FIELDS.split(", ")]

    def make(rows):
        out, size, kept = [], 0, (None, None)
        for doc, text, following in rows:
            tree = kept[1] if kept[0] is text else Tree(text.encode())
            after = Tree(following.encode())
            kept = (following, after)
            changed = edited(text, following)
            other = Tree(changed.encode())
            a, b = tree.fingerprint(), other.fingerprint()
            out.append((doc, len(text), hashlib.sha256(changed.encode()).hexdigest(), a, b, likeness(tree, other), likeness(tree, after)))
            size += len(a) + len(b)
            if size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return with_next(docs, FIELDS, make)
