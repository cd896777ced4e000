"""Words of whole batches as numpy arrays: where they start and end, and 64-bit hashes of words and of runs of words."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard

#: Separators of the two word rules: ASCII white space; all ASCII but letters and digits.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BLOCK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_OF_BYTE = mix(np.arange(1, 257, dtype=np.uint64))


@lru_cache(4)
def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, np.uint64(base))
    p[0] = 1
    return np.multiply.accumulate(p)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column without nulls, not copied."""
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return held[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose text is about `most` bytes, at least one row each. A column `zip` is unpacked to `text`."""
    for batch in batches:
        if not batch.num_rows:
            continue
        if column not in batch.schema.names:
            yield from _unpacked(batch, column, most)
            continue
        _, offsets = flat(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of `most` bytes or somewhat more, at least one row each."""
    held, size = [], 0
    for b in pieces(batches, most=most):
        held.append(b)
        size += b.nbytes
        if size >= most:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _unpacked(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    open_, texts, size, at = zstandard.ZstdDecompressor().decompress, [], 0, 0
    for i, x in enumerate(batch.column("zip").to_pylist()):
        texts.append(open_(x))
        size += len(texts[-1])
        if size >= most or i == batch.num_rows - 1:
            part = batch.slice(at, i + 1 - at)
            yield part.drop_columns(["zip"]).append_column(column, pa.array(texts, pa.binary()).cast(pa.string()))
            texts, size, at = [], 0, i + 1


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; the spans are in order and don't overlap."""
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(out):
        origin = start[at]
        stop = max(at + 1, int(np.searchsorted(end, origin + _BLOCK, "right")))
        part = data[origin : end[stop - 1]]
        size = max(_BLOCK, 1 << (len(part) - 1).bit_length())
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_OF_BYTE[part] * _powers(int(_BASE), size)[: len(part)], out=sums[1:])
        s, e = start[at:stop] - origin, end[at:stop] - origin
        out[at:stop] = (sums[e] - sums[s]) * _powers(int(_INVERSE), size)[s] + (e - s).astype(np.uint64)
        at = stop
    return mix(out)


def gather(values: np.ndarray, offsets: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenation of the lists values[offsets[i]:offsets[i + 1]] for i in index, and its offsets."""
    lengths = np.diff(offsets)[index]
    ends = np.zeros(len(index) + 1, np.int64)
    np.cumsum(lengths, out=ends[1:])
    at = np.repeat(offsets[index] - ends[:-1], lengths)
    at += np.arange(len(at))
    return values[at], ends


class Words:
    """Words of a column of texts: `start`, `end` (byte offsets), `first` (index of each text's first word, and the total)."""

    def __init__(self, column: pa.Array, separators: np.ndarray = SPACE, lower: bool = False):
        data, offsets = flat(column)
        self.data = LOWER[data] if lower else data
        n = len(data)
        inside = ~separators[self.data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.empty(n, bool)
        before[:1], before[1:] = False, inside[:-1]
        self.start = np.flatnonzero(inside & (~before | edge[:n]))
        after = np.empty(n, bool)
        after[-1:], after[:-1] = False, inside[1:]
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.first)

    def of(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end)

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()

    def span(self, i: int, j: int) -> bytes:
        """Bytes from word i to before word j of the same text."""
        return self.data[self.start[i] : self.end[j - 1]].tobytes() if j > i else b""


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on; positions with fewer than n words after them are left out."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out, done, power, step = None, 0, hashes, _STEP
    width = 1
    while True:
        if n & width:
            if out is None:
                out, done = power, width
            else:
                m = len(hashes) - done - width + 1
                out = out[:m] + np.uint64(pow(int(_STEP), done, 1 << 64)) * power[done : done + m]
                done += width
        width *= 2
        if width > n:
            return mix(out[: len(hashes) - n + 1])
        half = width // 2
        step = np.uint64(pow(int(_STEP), half, 1 << 64))
        power = power[: len(power) - half] + step * power[half:]


def inner(first: np.ndarray, n: int) -> np.ndarray:
    """For all positions up to the last with n words after it: whether those n words are of one text."""
    total = int(first[-1])
    ok = np.ones(max(0, total - n + 1), bool)
    for k in range(1, n):
        at = first[1:-1] - k
        at = at[(at >= 0) & (at < len(ok))]
        ok[at] = False
    return ok


def span_cover(starts: np.ndarray, length: np.ndarray | int, n: int) -> np.ndarray:
    """Which of n positions lie in any of the spans."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + length, n), -1)
    return np.cumsum(step[:n]) > 0
