"""Sketches over a fixed number of cells, merged by Spark and shared as bitmaps.

A task reduces its keys to the cells they fall in; the cells are dealt out by
range and added up, range by range, in arrays of a fixed size; what comes back
to the driver, and goes to the executors, is one bit per cell.  The number of
cells is bounded (``MOST_BITS``), so neither depends on the corpus.  Where the
corpus outgrows the cells, more keys than needed pass; none is lost.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

U = np.uint64
MOST_BITS, LEAST_BITS, RANGES = 27, 16, 64
SENT = "part int, many boolean, cells binary"
_ROWS = (U(1), U(0x9FB21C651E98DF25))


def bits_for(keys: int) -> int:
    """Cells, as a power of two, for about so many keys."""
    return min(MOST_BITS, max(LEAST_BITS, int(keys).bit_length() + 1))


def cells_of(keys: np.ndarray, bits: int) -> np.ndarray:
    """The cells of each key, a row for each of the sketch's hash functions."""
    return np.stack([((keys * m) >> U(64 - bits)).astype(np.int64) + (i << bits) for i, m in enumerate(_ROWS)])


def sent(keys: np.ndarray, bits: int, many: bool = False) -> Iterator[tuple[int, bool, bytes]]:
    """A task's keys as rows for ``merged``; with ``many`` one occurrence fills a cell."""
    if not len(keys):
        return
    cells, counts = np.unique(cells_of(keys, bits).ravel(), return_counts=True)
    size = (len(_ROWS) << bits) // RANGES
    full = (counts > 1) | many
    for kind in (False, True):
        own = cells[full == kind]
        cuts = np.searchsorted(own, np.arange(RANGES + 1) * size)
        for part in range(RANGES):
            if cuts[part] < cuts[part + 1]:
                local = own[cuts[part] : cuts[part + 1]] - part * size
                yield part, kind, zlib.compress(np.diff(local, prepend=0).astype("<u4").tobytes(), 1)


def sent_batch(rows: Iterator[tuple[int, bool, bytes]]) -> pa.RecordBatch:
    """Those rows as a batch of schema ``SENT``."""
    columns = list(zip(*rows)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.bool_(), pa.binary()))], ["part", "many", "cells"])


class Filter:
    """The cells that two keys or more fall in, by the smaller of the counts of a key's cells."""

    def __init__(self, bits: int, shared: Broadcast) -> None:
        self.bits, self.shared = bits, shared

    def passes(self, keys: np.ndarray) -> np.ndarray:
        """Whether each key is counted at least twice."""
        found = np.ones(len(keys), bool)
        bitmap = np.frombuffer(self.shared.value, np.uint8)
        for row in cells_of(keys, self.bits):
            found &= (bitmap[row >> 3] >> (7 - (row & 7)).astype(np.uint8)) & 1 == 1
        return found


def merged(rows: DataFrame, bits: int) -> Filter:
    """Add up the tasks' rows; at most 2^28 bits reach the driver."""
    size = (len(_ROWS) << bits) // RANGES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, many, cells in zip(*(batch.column(k) for k in range(3))):
                own = counts.setdefault(part.as_py(), np.zeros(size, np.uint8))
                local = np.cumsum(np.frombuffer(zlib.decompress(cells.as_py()), "<u4").astype(np.int64))
                own[local] = 2 if many.as_py() else np.minimum(own[local] + 1, 2)
        for part, own in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(own > 1).tobytes()], pa.binary())], ["part", "bitmap"])

    found = rows.repartition(RANGES, "part").mapInArrow(run, "part int, bitmap binary").collect()
    bitmap = bytearray((len(_ROWS) << bits) // 8)
    for part, own in found:
        bitmap[part * len(own) : (part + 1) * len(own)] = own
    return Filter(bits, rows.sparkSession.sparkContext.broadcast(bytes(bitmap)))
