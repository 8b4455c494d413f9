"""Vectorised hashes of the words of a batch of texts, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

ODD = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """At least n powers of an odd multiplier modulo 2**64."""
    global _POWERS
    if len(_POWERS) < n:
        size = max(4096, 2 * n)
        steps = np.full(size, 0x100000001B3 | 1, np.uint64)
        steps[0] = 1
        _POWERS = np.multiply.accumulate(steps)
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose high and low bits depend on all bits of its input."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(texts: list[bytes | None], size: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have about ``size`` bytes together, or a single longer text."""
    first = total = 0
    for i, t in enumerate(texts):
        n = len(t or b"")
        if i > first and total + n > size:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(texts):
        yield first, len(texts)


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of texts: row, start and end in the joined buffer, 64-bit hash."""

    def __init__(self, texts: list[bytes | None], lower: bool = False):
        joined = b" ".join(t or b"" for t in texts) + b" "
        buf = np.frombuffer(joined, np.uint8)
        if lower:
            buf = np.where((buf >= 65) & (buf <= 90), buf | 32, buf).astype(np.uint8)
        self.buf = buf
        inside = ~((buf == 32) | ((buf >= 9) & (buf <= 13)))
        edges = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=np.int8(0)))
        self.start, self.end = edges[::2], edges[1::2]
        lengths = np.array([len(t or b"") for t in texts], np.int64) + 1
        self.row_start = np.cumsum(lengths) - lengths
        self.row = np.searchsorted(self.row_start, self.start, "right") - 1
        #: First word of each row, and the number of all words.
        self.first = np.searchsorted(self.start, np.append(self.row_start, len(buf)))
        n = self.end - self.start
        if len(n):
            at = np.cumsum(n) - n
            offset = np.arange(n.sum()) - np.repeat(at, n)
            parts = (buf[inside].astype(np.uint64) + np.uint64(1)) * powers(int(n.max()))[offset]
            self.hash = mix(np.add.reduceat(parts, at) + n.astype(np.uint64))
        else:
            self.hash = np.zeros(0, np.uint64)


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams of a sequence of hashes."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = mix(out * ODD + h[k : len(h) - n + 1 + k])
    return out


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of consecutive, non-empty spans buf[start[i]:end[i]] (end[i] == start[i + 1])."""
    n = end - start
    if not len(n):
        return np.zeros(0, np.uint64)
    at = start - start[0]
    offset = np.arange(n.sum()) - np.repeat(at, n)
    parts = (buf[start[0] : end[-1]].astype(np.uint64) + np.uint64(1)) * powers(int(n.max()))[offset]
    return mix(np.add.reduceat(parts, at) + n.astype(np.uint64))


def to_varint(x: np.ndarray) -> bytes:
    """Numbers under 2**35, seven bits to a byte, the last byte of each without the high bit."""
    x = x.astype(np.uint64)
    out = np.zeros((len(x), 5), np.uint8)
    n = np.ones(len(x), np.int64)
    for k in range(1, 5):
        n += x >= np.uint64(1 << 7 * k)
    for k in range(5):
        out[:, k] = (x >> np.uint64(7 * k)).astype(np.uint8) & 127 | np.where(n > k + 1, 128, 0).astype(np.uint8)
    return out[np.arange(5) < n[:, None]].tobytes()


def from_varint(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.zeros(0, np.int64)
    ends = np.flatnonzero(b < 128)
    starts = np.append(0, ends[:-1] + 1)
    shift = 7 * (np.arange(len(b)) - np.repeat(starts, ends - starts + 1))
    return np.add.reduceat((b & 127).astype(np.int64) << shift, starts)


def flat_ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (n[0] numbers), start[1], ..."""
    return np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)
