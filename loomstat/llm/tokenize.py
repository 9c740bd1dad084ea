"""Byte-level BPE over whole columns with a public vocabulary.

Texts are cut into words by the vocabulary's pattern. Each distinct word is encoded once per
worker: the bytes of new words are laid out in padded matrices, one per length bucket. In every
round each row merges its leftmost pair of minimum rank; pairs are looked up in an
open-addressed hash table, merged columns are closed up and finished rows leave the matrix.
Words too long for a matrix take the same steps through a heap. The ids of a batch are
then gathered from the pool of encoded words by index arithmetic.

The vocabulary file is read on the driver and travels with the tasks (under 1 MB; checked).
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Larger vocabulary files are refused: they would not suit being sent with every task.
MAX_VOCABULARY_BYTES = 16 << 20
#: Words in a worker's pool before it starts afresh.
POOL_WORDS = 1_000_000
#: Bytes of words that are laid out at once.
MATRIX_CELLS = 4_000_000
BUCKETS = (2, 4, 6, 8, 10, 12, 16, 20, 24, 32, 48, 64, 96, 128, 192, 256)

# Fixed value: the pattern that splits text before the merges, with the white space of Unicode.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
_NONE = np.iinfo(np.int32).max
_ODD = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """Hash table of (left id, right id) -> merged id."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray) -> None:
        bits = max(4, int(np.ceil(np.log2(max(1, len(left)) * 4))))
        self.mask = np.int64((1 << bits) - 1)
        self.shift = np.uint64(64 - bits)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, _NONE, np.int32)
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        slots, todo = self._slots(keys), np.arange(len(keys))
        self.probes = 1
        while len(todo):
            free = self.keys[slots[todo]] == -1
            _, first = np.unique(slots[todo][free], return_index=True)
            put = todo[free][first]
            self.keys[slots[put]], self.values[slots[put]] = keys[put], merged[put]
            todo = todo[self.keys[slots[todo]] != keys[todo]]
            slots[todo] = (slots[todo] + 1) & self.mask
            self.probes += 1

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * _ODD) >> self.shift).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged ids, or a value above all ids where the pair doesn't merge."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        slots = self._slots(keys)
        there = self.keys[slots]
        out = np.where(there == keys, self.values[slots], _NONE)
        todo = np.flatnonzero((there != keys) & (there != -1))
        while len(todo):
            slots[todo] = (slots[todo] + 1) & self.mask
            there = self.keys[slots[todo]]
            hit = there == keys[todo]
            out[todo[hit]] = self.values[slots[todo[hit]]]
            todo = todo[~hit & (there != -1)]
        return out


class Encoder:
    """Encodes texts with the ranks of one vocabulary file (base64 token and rank per line)."""

    def __init__(self, vocabulary: bytes) -> None:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a = ranks.get(token[:k])
                if a is not None and (b := ranks.get(token[k:])) is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        self.pairs = PairTable(np.array(left, np.int64), np.array(right, np.int64), np.array(merged, np.int32))
        self.words = regex.compile(PATTERN).findall
        self._fresh()

    def _fresh(self) -> None:
        self.known: dict[str, int] = {}
        self.pool = np.empty(1 << 16, np.int32)
        self.used = 0
        self.starts = np.empty(1 << 14, np.int64)
        self.lengths = np.empty(1 << 14, np.int32)

    def _matrix(self, rows: list[bytes]) -> list[np.ndarray]:
        """The ids of words of similar length."""
        n, width = len(rows), max(map(len, rows))
        size = np.array([len(r) for r in rows])
        flat = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), np.uint8).reshape(n, width)
        ids = np.where(np.arange(width) < size[:, None], self.byte_ids[flat], -1).astype(np.int32)
        ranks = np.full((n, width), _NONE, np.int32)
        here = np.arange(width - 1) < size[:, None] - 1
        ranks[:, :-1][here] = self.pairs.look_up(ids[:, :-1][here], ids[:, 1:][here])
        out: list[np.ndarray] = [None] * n  # type: ignore[list-item]
        live = np.arange(n)
        while len(live):
            at = ranks.argmin(axis=1)  # the leftmost of the smallest
            best = ranks[np.arange(len(live)), at]
            over = best == _NONE
            for k in np.flatnonzero(over):
                out[live[k]] = ids[k, : size[k]].copy()
            if over.any():
                keep = ~over
                live, ids, ranks, size, at, best = live[keep], ids[keep], ranks[keep], size[keep], at[keep], best[keep]
                if not len(live):
                    break
                width = int(size.max())
                ids, ranks = ids[:, :width], ranks[:, :width]
            row = np.arange(len(live))
            ids[row, at] = best
            # close the gap behind the merged pair
            take = np.minimum(np.arange(width) + (np.arange(width) > at[:, None]), width - 1)
            ids = np.take_along_axis(ids, take, axis=1)
            ranks = np.take_along_axis(ranks, take, axis=1)
            size = size - 1
            past = np.arange(width) >= size[:, None] - 1
            ranks[past] = _NONE
            for first in (at - 1, at):
                good = (first >= 0) & (first + 1 < size)
                r, c = row[good], first[good]
                ranks[r, c] = self.pairs.look_up(ids[r, c], ids[r, c + 1])
        return out

    def _long(self, word: bytes) -> np.ndarray:
        """One long word: the same merges in the same order, through a heap of (rank, place)."""
        ids = self.byte_ids[np.frombuffer(word, np.uint8)]
        ranks = self.pairs.look_up(ids[:-1], ids[1:])
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        there = np.flatnonzero(ranks != _NONE)
        heap = list(zip(ranks[there].tolist(), there.tolist(), strict=True))
        heapq.heapify(heap)
        now: list[int] = ids.tolist()
        rank: list[int] = [*ranks.tolist(), _NONE]
        gone = [False] * n

        def pair(k: int) -> None:
            j = after[k]
            rank[k] = _NONE if j >= n else self._one(now[k], now[j])
            if rank[k] != _NONE:
                heapq.heappush(heap, (rank[k], k))

        while heap:
            r, k = heapq.heappop(heap)
            if gone[k] or rank[k] != r:
                continue
            j = after[k]
            now[k], gone[j], after[k] = r, True, after[j]
            if after[k] < n:
                before[after[k]] = k
            pair(k)
            if before[k] >= 0:
                pair(before[k])
        return np.array([x for x, g in zip(now, gone, strict=True) if not g], np.int32)

    def _one(self, a: int, b: int) -> int:
        key = (a << 32) | b
        slot = ((key * int(_ODD)) & 0xFFFFFFFFFFFFFFFF) >> int(self.pairs.shift)
        keys, mask = self.pairs.keys, int(self.pairs.mask)
        while (there := int(keys[slot])) != -1:
            if there == key:
                return int(self.pairs.values[slot])
            slot = (slot + 1) & mask
        return _NONE

    def _learn(self, words: Sequence[str]) -> None:
        raw = [w.encode("utf-8", "replace") for w in words]
        order = sorted(range(len(raw)), key=lambda k: len(raw[k]))
        out: list[np.ndarray] = [None] * len(raw)  # type: ignore[list-item]
        low, k = 0, 0
        for top in (1, *BUCKETS):
            while k < len(order) and len(raw[order[k]]) <= top:
                k += 1
            step = max(1, MATRIX_CELLS // top)
            for at in range(low, k, step):
                part = order[at : min(k, at + step)]
                if top == 1:
                    done = [self.byte_ids[np.frombuffer(raw[i], np.uint8)] for i in part]
                else:
                    done = self._matrix([raw[i] for i in part])
                for i, ids in zip(part, done, strict=True):
                    out[i] = ids
            low = k
        for i in order[k:]:
            out[i] = self._long(raw[i])
        lengths = np.array([len(x) for x in out], np.int32)
        total, first = int(lengths.sum()), len(self.known)
        while self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty(len(self.pool), np.int32)])
        while first + len(words) > len(self.starts):
            self.starts = np.concatenate([self.starts, np.empty(len(self.starts), np.int64)])
            self.lengths = np.concatenate([self.lengths, np.empty(len(self.lengths), np.int32)])
        self.pool[self.used : self.used + total] = np.concatenate(out) if out else np.empty(0, np.int32)
        self.starts[first : first + len(words)] = self.used + np.cumsum(lengths) - lengths
        self.lengths[first : first + len(words)] = lengths
        self.used += total
        self.known.update(zip(words, range(first, first + len(words)), strict=True))

    def _look_up(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The pool index of every word, and where each text's words begin."""
        words: list[str] = []
        bounds = np.zeros(len(texts) + 1, np.int64)
        for k, text in enumerate(texts):
            if text:
                words += self.words(text)
            bounds[k + 1] = len(words)
        distinct = set(words)
        new = distinct - self.known.keys()
        if len(self.known) + len(new) > POOL_WORDS:
            self._fresh()
            new = distinct
        if new:
            self._learn(sorted(new))
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words)), bounds

    def encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """``(offsets, ids)``: the ids of text k are ``ids[offsets[k]:offsets[k + 1]]``; NULL and '' have none."""
        index, bounds = self._look_up(texts)
        lengths = self.lengths[index].astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.pool[np.repeat(self.starts[index] - ends[:-1], lengths) + np.arange(ends[-1])]
        return ends[bounds], ids

    def count(self, texts: Sequence[str | None]) -> np.ndarray:
        """Tokens of each text."""
        index, bounds = self._look_up(texts)
        ends = np.concatenate([[0], np.cumsum(self.lengths[index], dtype=np.int64)])
        return np.diff(ends[bounds])


_encoders: dict[str, Encoder] = {}


def encoder(vocabulary: bytes) -> Encoder:
    """This process's encoder of a vocabulary; made once."""
    key = hashlib.sha256(vocabulary).hexdigest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(vocabulary)
    return _encoders[key]


def read_vocabulary(path: str = DEFAULT_VOCABULARY) -> bytes:
    with open(path, "rb") as file:
        data = file.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    return data


def slices(batch: pa.RecordBatch, column: str, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``size`` bytes of ``column`` each, one row at least."""
    if batch.num_rows == 0:
        return
    lengths = np.diff(np.asarray(_offsets(batch.column(column))))
    group = (np.cumsum(lengths) // size).astype(np.int64)
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def _offsets(column: pa.Array) -> np.ndarray:
    size = np.int64 if pa.types.is_large_string(column.type) else np.int32
    buffer = np.frombuffer(column.buffers()[1], size)
    return buffer[column.offset : column.offset + len(column) + 1].astype(np.int64)


def encode_column(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``key`` and ``ids``: the token ids of ``text`` without special tokens, one row per row.

    NULL, empty and unmatched texts have the empty list; strings that look like special tokens are ordinary
    text. Repeated keys give repeated rows. No shuffle; other columns are not looked at.
    """
    ranks = read_vocabulary(vocabulary)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(ranks)
        for batch in batches:
            for part in slices(batch, text):
                offsets, ids = own.encode(part.column(text).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(key), lists], [key, "ids"])

    rows = df.select(key, text)
    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(encode, f"`{key}` {kind}, ids array<int>")
