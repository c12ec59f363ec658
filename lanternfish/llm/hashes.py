"""Hashing in numpy, shared by operators that scan whole texts in tasks, and key blocks they hand to a shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import BLANKS

_FACTOR = 0x9FB21C651E98DF25
_STEP = np.uint64(0xD1B54A32D192ED03)

#: Bytes of text that are looked at together; a longer text is cut where its caller allows.
SLICE = 1 << 21


def spread(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values: shifts and odd multipliers, one to one."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xE9846AF9B1A615D)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E6D62D06F6A9A9B)
    return x ^ (x >> np.uint64(32))


def joined(columns: list[np.ndarray]) -> np.ndarray:
    """One value for each row of several columns."""
    out = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        out = spread(out * _STEP + c)
    return out


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Ascending with the keys, so that sorted keys fall into runs."""
    return ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of the runs of equal sorted keys."""
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    return first, np.diff(np.append(first, len(keys)))


def slices(batches: Iterator[pa.RecordBatch], cut, limit: int = SLICE) -> Iterator[list[tuple]]:
    """Rows of which the last column is a text, some megabytes at a time. cut(text, limit): where a longer text may be cut,
    or None; its pieces come as rows of their own."""
    held, size = [], 0
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns):
            text = row[-1] or ""
            while len(text) > limit and (at := cut(text, limit)) is not None:
                held.append((*row[:-1], text[:at]))
                text, size = text[at:], size + 4 * at
                if size >= limit:
                    yield held
                    held, size = [], 0
            held.append((*row[:-1], text))
            size += len(text)
            if size >= limit:
                yield held
                held, size = [], 0
    if held:
        yield held


_KINDS = {ord(b): 1 for b in BLANKS}


def kinds(blanks: str, separators: str = "") -> np.ndarray:
    """Kind of every byte: 0 of a word, 1 blank, 2 separator."""
    out = np.zeros(256, np.uint8)
    for c in blanks:
        out[ord(c)] = 1
    for c in separators:
        out[ord(c)] = 2
    return out


_powers = np.ones(1, np.uint64)


def _powers_upto(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n + n // 2, _FACTOR, np.uint64))), dtype=np.uint64)
    return _powers


class Words:
    """Words of texts, A-Z lower-cased: their places in `bytes`, hashes, and numbers of text and piece."""

    def __init__(self, texts: list[str], kind: np.ndarray):
        raw = [t.encode() for t in texts]
        data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8).copy()
        data[(data >= 65) & (data <= 90)] += 32
        self.bytes, of = data, kind[data]
        inside = of == 0
        edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
        self.starts, self.ends = edges[::2], edges[1::2]
        lengths = self.ends - self.starts
        first = np.cumsum(lengths) - lengths
        offset = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
        values = (data[inside].astype(np.uint64) + np.uint64(1)) * _powers_upto(int(lengths.max(initial=0)) + 1)[offset]
        sums = np.add.reduceat(values, first) if len(first) else np.empty(0, np.uint64)
        self.hashes = spread(sums + lengths.astype(np.uint64) * _STEP)
        ends_of_texts = np.cumsum([len(r) + 1 for r in raw])
        self.text = np.searchsorted(ends_of_texts, self.starts, side="right")
        self.piece = np.cumsum(of == 2, dtype=np.int32)[self.starts] if (kind == 2).any() else self.text

    def __len__(self) -> int:
        return len(self.starts)

    def spelled(self, k: int) -> bytes:
        return self.bytes[self.starts[k] : self.ends[k]].tobytes()
