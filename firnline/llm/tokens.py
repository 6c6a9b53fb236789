"""Encoding with public tokenizers, with each distinct word encoded once per
worker.

Byte-level BPE with the usual pattern starts a new pre-token at every blank
that a non-blank follows, and at every run of line feeds between two words; the
lower-casing BPE drops all white space. So the ids of a text are the ids of its
chunks, cut there, in a row. A chunk that is a Latin word with marks after it
is separate pre-tokens, the word and the marks;
a per-worker memory of words, bounded in bytes, replaces most calls of the
library. When it is full, words met in one part of texts only are forgotten
first.
"""

from __future__ import annotations

import re
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from firnline.llm.common import parts_of

MEMORY_BYTES = 24 << 20  # what a worker keeps: words, their ids and places
PART_BYTES = 4 << 20  # texts encoded at a time
MARKS_KEPT = 4096


def pack_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


_CHUNK_START = re.compile(r" (?=\S)")
# White space in Unicode, and that without line feeds.
_WHITE = r"\t\n\x0B\f\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_IN_LINE = _WHITE.replace(r"\n", "")
#: White space that is neither one blank nor a run of line feeds between words.
_ODD = rf"^[{_WHITE}]|[{_WHITE}]$| [{_WHITE}]|[{_IN_LINE}]\n|\n[{_IN_LINE}]"
#: A Latin word whose lower case has the same letters, one by one, perhaps a
#: line feed before it, and ASCII marks after it.
_PLAIN = r"^(?P<word>\n?[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{17F}]+)(?P<marks>[!-/:-@\[-`{-~]*)$"


def _spread(start: np.ndarray, size: np.ndarray, pool: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """pool[start[i] : start[i] + size[i]] for all i in a row, and their ends."""
    ends = np.cumsum(size)
    return pool[np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)], ends


class Encoder:
    _made: dict[str, Encoder] = {}

    @classmethod
    def get(cls, path: str) -> Encoder:
        """One encoder per worker process and file."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        # Byte-level files keep the blank, as a letter, in front of a word.
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.blanks = not any(t.endswith("</w>") for t in vocabulary)
        # Byte-level files write each byte as a letter: itself where it can be seen.
        seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(seen)]
        self.letters = {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.marks: dict[str, list[int]] = {"": []}
        self._hold(pa.array([], pa.large_string()), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4"), np.zeros(0, np.int32))

    def _hold(self, vocabulary, start, size, pool, met) -> None:
        self.vocabulary, self.start, self.size, self.pool, self.met = vocabulary, start, size, pool, met

    def held_bytes(self) -> int:
        return self.vocabulary.nbytes + self.start.nbytes + self.size.nbytes + self.pool.nbytes + self.met.nbytes

    def _forget(self) -> None:
        """Keep the words met in most parts of texts, up to half the bound."""
        order = np.argsort(-self.met, kind="stable")
        order = order[self.met[order] > 1]
        each = self.held_bytes() / max(len(self.met), 1)
        keep = np.sort(order[: int(MEMORY_BYTES / 2 / max(each, 1))])
        pool, ends = _spread(self.start[keep], self.size[keep], self.pool)
        self._hold(self.vocabulary.take(pa.array(keep)), ends - self.size[keep], self.size[keep], pool, self.met[keep] // 2)

    def _raw(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str], plain: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words in a row, and their numbers: plain words
        straight by the library's model, others by its whole pipeline."""
        tokenize, letters, start = self.tokenizer.model.tokenize, self.letters, "Ġ" if self.blanks else ""
        feed = self._raw(["\n"])[0]
        rest = [i for i, p in enumerate(plain) if not p]
        other: dict[int, list[int]] = {}
        for lo in range(0, len(rest), 4096):
            some = rest[lo : lo + 4096]
            other.update(zip(some, self._raw([" " + words[i] if self.blanks and words[i][:1] != "\n" else words[i] for i in some]), strict=True))
        flat: list[int] = []
        size = []
        for i, word in enumerate(words):
            if plain[i]:
                fed = word[0] == "\n"
                if fed:
                    word = word[1:]
                    flat += feed
                if not word.isascii():
                    word = "".join([letters[b] for b in word.encode()])
                got = tokenize(word if fed else start + word)
                flat += [t.id for t in got]
                size.append(len(got) + len(feed) * fed)
            else:
                flat += other[i]
                size.append(len(other[i]))
        return np.array(flat, dtype="<u4"), np.array(size, dtype=np.int64)

    def _split(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """All texts' chunks in a row, and each text's end among them."""
        if not self.blanks:
            parts = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " "), " ")
            return parts.values, parts.offsets.to_numpy()[1:]
        column = pa.array(texts, pa.large_string())
        strange = pc.match_substring_regex(column, _ODD)
        odd = np.flatnonzero(strange.to_numpy(zero_copy_only=False)).tolist()
        plain = pc.replace_substring_regex(column, r"(\n+)", r" \1")  # a run of line feeds starts a chunk
        parts = pc.split_pattern(plain, " ")
        if odd:  # there a blank before a blank starts no chunk, and line feeds don't
            pieces, lo = [], 0
            for i in odd:
                pieces += [parts.slice(lo, i - lo), pa.array([_CHUNK_START.split(texts[i])], parts.type)]
                lo = i + 1
            parts = pa.concat_arrays([*pieces, parts.slice(lo)])
        return parts.flatten(), np.cumsum(pc.list_value_length(parts).to_numpy())

    def _known(self, words: pa.Array, plain: pa.Array) -> np.ndarray:
        """Places of distinct words in the memory, learned now if need be."""
        if self.held_bytes() > MEMORY_BYTES:
            self._forget()
        out = pc.fill_null(pc.index_in(words, value_set=self.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = out < 0
        self.met[out[~new]] += 1
        if new.any():
            mask = pa.array(new)
            unseen = words.filter(mask)
            ids, size = self._learn(unseen.to_pylist(), plain.filter(mask).to_pylist())
            out[new] = len(self.vocabulary) + np.arange(len(unseen))
            self._hold(
                pa.concat_arrays([self.vocabulary, unseen]),
                np.append(self.start, len(self.pool) + np.cumsum(size) - size),
                np.append(self.size, size),
                np.append(self.pool, ids),
                np.append(self.met, np.ones(len(size), np.int32)),
            )
        return out

    def _marks(self, marks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct marks in a row, and their numbers."""
        if len(self.marks) > MARKS_KEPT:
            self.marks = {"": []}
        new = [m for m in marks if m not in self.marks]
        self.marks.update(zip(new, self._raw(new), strict=True))
        ids = [self.marks[m] for m in marks]
        return np.array([i for x in ids for i in x], dtype="<u4"), np.array(list(map(len, ids)), dtype=np.int64)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        out: list[bytes] = []
        for part in parts_of([len(t or "") for t in texts], PART_BYTES):
            out += self._encode([t or "" for t in texts[part]])
        return out

    def _chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A pool of ids, and each distinct chunk's start and number in it."""
        found = pc.extract_regex(chunks, _PLAIN)
        plain, word, marks = pc.is_valid(found), pc.struct_field(found, 0), pc.struct_field(found, 1)
        word = pc.if_else(plain, word if self.blanks else pc.utf8_lower(word), chunks).dictionary_encode()
        marks = pc.if_else(plain, marks, "").dictionary_encode()
        of_word, of_mark = (x.indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in (word, marks))
        first = np.zeros(len(word.dictionary), dtype=np.int64)
        first[of_word[::-1]] = np.arange(len(of_word) - 1, -1, -1)
        place = self._known(word.dictionary, plain.take(pa.array(first)))[of_word]
        mark_ids, mark_size = self._marks(marks.dictionary.to_pylist())
        mark_start = len(self.pool) + np.cumsum(mark_size) - mark_size
        start, size = np.empty(2 * len(place), np.int64), np.empty(2 * len(place), np.int64)
        start[::2], size[::2] = self.start[place], self.size[place]
        start[1::2], size[1::2] = mark_start[of_mark], mark_size[of_mark]
        pool, ends = _spread(start, size, np.append(self.pool, mark_ids))
        many = size[::2] + size[1::2]
        return pool, ends[1::2] - many, many

    def _encode(self, texts: list[str]) -> list[bytes]:
        flat, ends = self._split(texts)
        coded = flat.dictionary_encode()
        at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        pool, start, size = self._chunks(coded.dictionary)
        if self.blanks:  # a text's first chunk has no blank before it
            first = np.append(0, ends[:-1])
            heads = self._raw(flat.take(pa.array(first)).to_pylist())
            many = np.fromiter(map(len, heads), dtype=np.int64, count=len(heads))
            at[first] = len(start) + np.arange(len(texts))
            start = np.append(start, len(pool) + np.cumsum(many) - many)
            pool, size = np.append(pool, np.array([i for h in heads for i in h], dtype="<u4")), np.append(size, many)
        ids, stop = _spread(start[at], size[at], pool)
        data = ids.tobytes()
        cuts = [0, *(4 * np.where(ends > 0, stop[ends - 1], 0)).tolist()]
        return [data[a:z] for a, z in zip(cuts, cuts[1:], strict=False)]
