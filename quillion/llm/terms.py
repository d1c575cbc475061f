"""Words of many texts at once: Arrow numbers the distinct ones, numpy does the rest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import flat_bytes, release

SLICE = 2_500_000  # bytes of text worked on at a time
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def small_batches(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """Batches of at most :data:`SLICE` bytes of the column ``text``, or of one row."""
    for batch in batches:
        _, ends = flat_bytes(batch.column(text))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to
    release()


class Runs:
    """The runs of bytes for which ``inside`` (by byte) holds, A-Z in lower case; none reaches
    from one text into the next. ``words`` are the distinct ones, ``code`` has each run's number
    among them, ``row`` its text, ``start`` its place in ``raw``."""

    def __init__(self, column: pa.Array, inside: np.ndarray):
        self.raw, ends = flat_bytes(column)
        n, flags = len(self.raw), inside[self.raw]
        edge = np.zeros(n + 1, bool)
        edge[ends] = True
        begins, stops = flags.copy(), flags.copy()
        begins[1:] &= ~flags[:-1] | edge[1:n]
        stops[:-1] &= ~flags[1:] | edge[1:n]
        self.start = np.flatnonzero(begins)
        sizes = np.flatnonzero(stops) + 1 - self.start
        self.row = np.searchsorted(ends, self.start, side="right") - 1
        offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
        data = np.ascontiguousarray(LOWER[self.raw[flags]])
        coded = pa.Array.from_buffers(pa.string(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        self.words = coded.dictionary
        self.code = coded.indices.to_numpy().astype(np.int64)


def numbered(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct values of a column and each row's number among them; null counts as empty."""
    coded = column.cast(pa.string()).fill_null("").dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64)
