"""Tokenizing by tables of distinct chunks.

Where no token can cross a chunk's border, a text's ids are its chunks' ids in order.  Each batch of texts is cut
into chunks, the distinct chunks that the worker's table lacks are segmented once, all together, and ids are joined
back by position.  The table is a few flat arrays: keys and values one after another, and the keys' hashes in order.
Keys found by their hash are compared, so equal hashes do no harm.  A table that grows too large loses its older half;
what is forgotten is segmented again, which costs time but changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tessera.llm import textnp

#: Entries of a worker's table, beside those of one batch; some 70 bytes each.
TABLE_SIZE = 1_000_000


def hashes(keys: pa.LargeBinaryArray) -> np.ndarray:
    """64-bit hashes of keys, none of which is empty."""
    if not len(keys):
        return np.zeros(0, np.uint64)
    edges = np.frombuffer(keys.buffers()[1], np.int64)[keys.offset : keys.offset + len(keys) + 1]
    data = np.frombuffer(keys.buffers()[2], np.uint8)[edges[0] : edges[-1]]
    starts, sizes = edges[:-1] - edges[0], np.diff(edges)
    place = np.arange(len(data)) - np.repeat(starts, sizes)
    value = (data.astype(np.uint64) + np.uint64(1)) * textnp.powers(int(sizes.max()))[place]
    return textnp.mix(np.add.reduceat(value, starts) + sizes.astype(np.uint64))


class ChunkTable:
    """Maps chunks to values in *columns* columns, which *segment* makes from a list of distinct chunks."""

    def __init__(self, segment: Callable[[list[bytes]], list[list[bytes]]], columns: int = 1, size: int = TABLE_SIZE):
        self.segment, self.size = segment, size
        self.sorted, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.keys = pa.array([], pa.large_binary())
        self.columns = [self.keys] * columns

    def values(self, distinct: pa.LargeBinaryArray) -> list[pa.LargeBinaryArray]:
        """The columns of the values of distinct chunks, none of them empty, in order."""
        own = hashes(distinct)
        row = np.full(len(own), -1)
        if len(self.sorted):
            at = np.minimum(np.searchsorted(self.sorted, own), len(self.sorted) - 1)
            hit = np.flatnonzero(self.sorted[at] == own)
            found = self.rows[at[hit]]
            same = pc.equal(distinct.take(pa.array(hit)), self.keys.take(pa.array(found))).to_numpy(zero_copy_only=False)
            row[hit[same]] = found[same]
        lacking = np.flatnonzero(row < 0)
        if len(lacking):
            self._add(distinct.take(pa.array(lacking)), own[lacking])
            row[lacking] = len(self.keys) - len(lacking) + np.arange(len(lacking))
        out = [c.take(pa.array(row)) for c in self.columns]
        if len(self.keys) > self.size:
            self._forget()
        return out

    def _add(self, keys: pa.LargeBinaryArray, own: np.ndarray) -> None:
        made = self.segment(keys.to_pylist())
        rows = len(self.keys) + np.arange(len(keys))
        self.keys = pa.concat_arrays([self.keys, keys])
        self.columns = [pa.concat_arrays([c, pa.array(x, pa.large_binary())]) for c, x in zip(self.columns, made, strict=True)]
        order = np.argsort(own)
        at = np.searchsorted(self.sorted, own[order])
        self.sorted, self.rows = np.insert(self.sorted, at, own[order]), np.insert(self.rows, at, rows[order])

    def _forget(self) -> None:
        first = len(self.keys) - self.size // 2
        kept = pa.array(np.arange(first, len(self.keys)))
        self.keys, self.columns = self.keys.take(kept), [c.take(kept) for c in self.columns]
        stays = self.rows >= first
        self.sorted, self.rows = self.sorted[stays], self.rows[stays] - first
