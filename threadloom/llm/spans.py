"""Numpy views of Arrow text columns: bytes, words and rolling hashes.

Everything works on UTF-8 bytes. Word separators are ASCII, so words found in
bytes are the words of the text. A batch is cut into chunks of whole documents,
so working memory follows the chunk (or one very long document), never the batch.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(20_241).integers(1, 2**63, 256, dtype=np.uint64) * 2 + 1
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers of the hash base and of its inverse, modulo 2**64."""
    while len(_POWERS[0]) < n:
        have = len(_POWERS[0])
        for i, base in enumerate((_BASE, _INVERSE)):
            _POWERS[i] = np.concatenate([_POWERS[i], _POWERS[i] * np.uint64(pow(base, have, 1 << 64))])
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows and the offsets between rows; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def lower_latin(data: np.ndarray) -> np.ndarray:
    """Lower-case A-Z and the two-byte letters from U+00C0 to U+00DE."""
    out = data + (((data >= 65) & (data <= 90)) << 5).astype(np.uint8)
    if len(data) > 1:
        after = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:] += (after << 5).astype(np.uint8)
    return out


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return data + (((data >= 65) & (data <= 90)) << 5).astype(np.uint8)


@dataclass
class Chunk:
    """Some whole documents: rows ``first`` to ``first + n``, their bytes and offsets."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1

    def words(self, solid: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and document (in the chunk) of every word: runs of ``solid`` bytes, by default of non-blanks."""
        solid = ~_SPACE[self.data] if solid is None else solid
        size = len(solid)
        if not size:
            none = np.zeros(0, np.int64)
            return none, none, none
        edge = np.zeros(size + 1, bool)
        edge[self.offsets] = True
        start = solid.copy()
        start[1:] &= ~solid[:-1] | edge[1:size]
        end = solid.copy()
        end[:-1] &= ~solid[1:] | edge[1:size]
        starts = np.flatnonzero(start)
        return starts, np.flatnonzero(end) + 1, self.owner(starts)

    def owner(self, positions: np.ndarray) -> np.ndarray:
        """Document of each of the ascending positions."""
        return np.searchsorted(self.offsets, positions, side="right") - 1

    def prefix(self) -> np.ndarray:
        """Prefix sums from which ``span_hash`` takes the hash of any span."""
        out = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_TABLE[self.data] * _powers(len(self.data))[0][: len(self.data)], out=out[1:])
        return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span of bytes, the same wherever the span stands."""
    return mix((prefix[ends] - prefix[starts]) * _powers(len(prefix))[1][starts])


def chunks(data: np.ndarray, offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Runs of whole documents of at most ``limit`` bytes, or one longer document."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield Chunk(row, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row])
        row = stop


def per_document(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive ``bounds``; empty runs give 0."""
    total = np.zeros(len(values) + 1, np.int64 if values.dtype.kind in "bui" else np.float64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Rows per Arrow batch for the actions inside, for rows that are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)
