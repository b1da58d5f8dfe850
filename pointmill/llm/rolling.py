"""Hashes of words and word runs, computed on whole Arrow buffers with numpy.

Polynomial prefix sums modulo 2^64 with an odd base give the hash of any run as
a difference times an inverse power, so that every word of a batch, and every
run of a given length, costs a few vector operations.  All values go through a
64-bit finaliser.  They depend on the bytes alone, not on process or machine.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U = np.uint64
_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: White space as ``[\x20\x09-\x0D]``.
SPACE = np.array([c == 32 or 9 <= c <= 13 for c in range(256)])
#: Everything but letters, digits and non-ASCII bytes; and the same bytes with A-Z lower-cased.
SIGN = np.array([not (c >= 128 or 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122) for c in range(256)])
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_RUN_BYTES = 1 << 19
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size, made = max(n, _RUN_BYTES), []
        for b in (base, pow(base, -1, 1 << 64)):
            out = np.full(size, b, U)
            out[0] = 1
            made.append(np.multiply.accumulate(out))
        have = _powers[base] = (made[0], made[1])
    return have[0][:n], have[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class Words(NamedTuple):
    """The words of some documents: their hashes, and the number of words before each document and after the last."""

    hashes: np.ndarray
    bounds: np.ndarray
    prefix: np.ndarray

    def runs(self, length: int) -> np.ndarray:
        """The hash of ``length`` words from each word on, also across documents; ``length`` - 1 fewer than words."""
        n = len(self.hashes) - length + 1
        if n <= 0:
            return np.zeros(0, U)
        return mixed((self.prefix[length:] - self.prefix[:n]) * _power(_WORD_BASE, n)[1])

    def between(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hash of the words from begin to end, for each pair."""
        return mixed((self.prefix[end] - self.prefix[begin]) * _power(_WORD_BASE, len(self.hashes) + 1)[1][begin] + (end - begin).astype(U))

    def within(self, length: int) -> np.ndarray:
        """The words at which ``length`` words of one document start."""
        n = max(0, len(self.hashes) - length + 1)
        last = np.repeat(self.bounds[1:], np.diff(self.bounds))[:n]
        return np.flatnonzero(np.arange(n) + length <= last)


def words(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE) -> Words:
    """Words of documents that follow each other in ``data``, from offsets[0] = 0 on."""
    n = int(offsets[-1])
    if n == 0:
        return Words(np.zeros(0, U), np.zeros(len(offsets), np.int64), np.zeros(1, U))
    data = data[:n]
    space = gap[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    before[0] = after[-1] = True
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    before[inner] = True
    after[inner - 1] = True
    begin, end = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    power, inverse = _power(_BYTE_BASE, n)
    sums = np.zeros(n + 1, U)
    np.cumsum((data.astype(U) + U(1)) * power, out=sums[1:])
    hashes = mixed((sums[end] - sums[begin]) * inverse[begin])
    prefix = np.zeros(len(hashes) + 1, U)
    np.cumsum(hashes * _power(_WORD_BASE, len(hashes))[0], out=prefix[1:])
    return Words(hashes, np.searchsorted(begin, offsets), prefix)


def smallest(values: np.ndarray, span: int) -> np.ndarray:
    """The smallest of ``span`` values from each on."""
    if len(values) < span:
        return values[:0]
    width = 1
    while 2 * width <= span:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    if rest := span - width:
        values = np.minimum(values[:-rest], values[rest:])
    return values


def text_runs(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Documents in runs of about half a megabyte: first row, bytes, and offsets from 0; nulls are empty."""
    column = pa.array([], pa.string()) if len(column) == 0 else column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if n == 0:
        return
    _, raw, body = column.buffers()
    offsets = np.frombuffer(raw, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _RUN_BYTES, "right")) - 1)
        yield at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end
