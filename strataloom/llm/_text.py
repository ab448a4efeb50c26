"""Vectorised text primitives shared by the corpus operators.

Texts arrive as Arrow string arrays; everything here works on their UTF-8
buffers with numpy, so no Python object is made per word.  Words and word
windows are represented by 64-bit polynomial fingerprints with a final mix.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are handled at once (a longer text is handled alone).
CHUNK_BYTES = 1 << 20

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = np.uint64(0x9E3779B97F4A7C15)
_BI = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_A = np.uint64(0xD6E8FEB86659FD93)
_AI = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))

#: Separators of the word rule [^\x20\x09-\x0D]+.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Separators of the word rule [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (after lower-casing).
NON_ALNUM = np.zeros(256, bool)
NON_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
#: Lower-cases A-Z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_POWERS: dict[str, np.ndarray] = {}


def _powers(kind: str, base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and grown on demand."""
    have = _POWERS.get(kind)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if size <= 4 * CHUNK_BYTES:
            _POWERS[kind] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[offs[0] : offs[-1]]
    return data, offs - offs[0]


def chunks(batches, text: str = "text", most: int = CHUNK_BYTES):
    """Slices of record batches that hold at most `most` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(text)
        size = np.asarray(pc.fill_null(pc.binary_length(col), 0), np.int64)
        ends = np.cumsum(size)
        at = 0
        while at < len(size):
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(at, to - at)
            at = to


class Words:
    """The words of a chunk of texts: byte spans, owning row, fingerprint."""

    __slots__ = ("data", "offs", "start", "end", "row", "first", "count", "hash")

    def __init__(self, column: pa.Array, separators: np.ndarray = SPACES, fold: np.ndarray | None = None):
        self.data, self.offs = buffers(column)
        data, offs = self.data, self.offs
        if fold is not None:
            data = self.data = fold[data]
        n = len(data)
        sep = separators[data]
        edge = np.zeros(n + 1, bool)
        edge[offs] = True
        before = np.empty(n, bool)
        before[1:] = sep[:-1]
        before[:1] = True
        before |= edge[:n]
        after = np.empty(n, bool)
        after[:-1] = sep[1:]
        after[-1:] = True
        after |= edge[1:]
        inside = ~sep
        self.start = np.flatnonzero(inside & before)
        self.end = np.flatnonzero(inside & after) + 1
        bounds = np.searchsorted(self.start, offs)
        self.first = bounds[:-1]
        self.count = np.diff(bounds)
        self.row = np.repeat(np.arange(len(offs) - 1), self.count)
        self.hash = span_hash(data, self.start, self.end)

    def rows(self):
        return len(self.offs) - 1


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Fingerprints of byte spans."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers("b", _B, len(data)), out=total[1:])
    h = (total[end] - total[start]) * _powers("bi", _BI, len(data) + 1)[start]
    return mix(h + (end - start).astype(np.uint64) * _A)


def window_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of n consecutive entries, by start (len(h)-n+1 of them)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _powers("a", _A, len(h)), out=total[1:])
    return mix((total[n:] - total[: len(h) - n + 1]) * _powers("ai", _AI, len(h))[: len(h) - n + 1] + np.uint64(n))


def window_ok(row: np.ndarray, n: int) -> np.ndarray:
    """Whether the window that starts at each word stays within one row."""
    return row[n - 1 :] == row[: len(row) - n + 1] if len(row) >= n else np.zeros(0, bool)


def cover(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    """Mask over `total` words of those within n of a start."""
    delta = np.zeros(total + 1, np.int32)
    np.add.at(delta, starts, 1)
    np.add.at(delta, np.minimum(starts + n, total), -1)
    return np.cumsum(delta[:-1]) > 0


def row_sums(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sum of values between consecutive offsets."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost minimum in each window of `width` entries."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best = np.arange(len(values))
    have = 1
    while have < width:
        step = min(have, width - have)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(values[right] < values[left], right, left)
        have += step
    return best[:n]
