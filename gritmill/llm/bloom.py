"""Bloom filters over 64-bit hash pairs, built for each partition and merged over segments of the bit space.

``once = a | b`` and ``repeated = ra | rb | (a & b)`` form a commutative monoid, so the merge is a grouped fold.
A partition sends the positions it set, sorted and delta-coded; a merged segment is 512 KB. The whole filter is at
most `MAX_BITS` (128 MB): with more keys it would get less selective, never wrong, for there are no false negatives; who
has more keys takes several filters (see `formdup`).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

BITS_PER_KEY = 16
HASHES = 2
SEGMENT_BITS = 1 << 22
MAX_BITS = 1 << 30


class Filter(NamedTuple):
    """A merged filter as every task gets it."""

    bits: int
    segments: Broadcast

    def load(self) -> np.ndarray:
        out = np.zeros(self.bits // 8, np.uint8)
        for s, z in self.segments.value.items():
            out[s * SEGMENT_BITS // 8 : (s + 1) * SEGMENT_BITS // 8] = np.frombuffer(zlib.decompress(z), np.uint8)
        return out


def bits_for(n: int) -> int:
    return min(MAX_BITS, max(SEGMENT_BITS, 1 << (max(1, n) * BITS_PER_KEY - 1).bit_length()))


def positions(h: np.ndarray, bits: int) -> np.ndarray:
    """Rows of `h` hold two hashes; gives HASHES positions a row."""
    u = h.astype(np.uint64)
    return np.stack([(u[:, 0] + np.uint64(i) * (u[:, 1] | np.uint64(1))) & np.uint64(bits - 1) for i in range(HASHES)], axis=1).astype(np.int64)


def contains(bitmap: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    pos = positions(h, bits)
    return ((bitmap[pos >> 3] >> (7 - (pos & 7)).astype(np.uint8)) & 1).all(axis=1)


def pairs(b: pa.RecordBatch, cols: list[str]) -> np.ndarray:
    """The named columns as hash pairs; a single column is paired with a mix of itself."""
    first = b.column(cols[0]).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    if len(cols) > 1:
        return np.stack([first, b.column(cols[1]).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)], axis=1)
    return mixed(first)


def mixed(h: np.ndarray) -> np.ndarray:
    """Single hashes as pairs."""
    u = h.astype(np.uint64)
    u = (u ^ (u >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    v = (u ^ (u >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.stack([u, v ^ (v >> np.uint64(32))], axis=1).astype(np.int64)


def _pack(pos: np.ndarray) -> bytes:
    return zlib.compress(np.diff(pos, prepend=0).astype("<u4").tobytes(), 1)


def _unpack(b: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(b), dtype="<u4").astype(np.int64))


def merged(df: DataFrame, cols: list[str], n: int, repeated: bool) -> Filter:
    """The filter of the non-null hashes in `cols` that occur at all, or of those that occur repeatedly. `n`: about how many there are."""
    bits = bits_for(n)

    def partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [pairs(b, cols) for b in batches]
        if not sum(map(len, got)):
            return
        h, k = np.unique(np.concatenate(got), axis=0, return_counts=True)
        once, rep = np.unique(positions(h, bits)), np.unique(positions(h[k > 1], bits))
        cut = np.arange(0, bits + SEGMENT_BITS, SEGMENT_BITS)
        a, r = np.searchsorted(once, cut), np.searchsorted(rep, cut)
        rows = [(s, _pack(once[a[s] : a[s + 1]] - s * SEGMENT_BITS), _pack(rep[r[s] : r[s + 1]] - s * SEGMENT_BITS)) for s in range(len(cut) - 1) if a[s] < a[s + 1]]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], names=["seg", "once", "rep"])

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, rep = np.zeros(SEGMENT_BITS, bool), np.zeros(SEGMENT_BITS, bool)
        for b in batches:
            for o, r in zip(b.column("once").to_pylist(), b.column("rep").to_pylist()):
                pos = _unpack(o)
                rep[pos[once[pos]]] = True
                once[pos] = True
                rep[_unpack(r)] = True
        out = zlib.compress(np.packbits(rep if repeated else once).tobytes(), 1)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([out], pa.binary())], names=["seg", "bitmap"])

    parts = df.select(*cols).dropna().mapInArrow(partials, "seg int, once binary, rep binary")
    segments = {r.seg: r.bitmap for r in parts.groupBy("seg").applyInArrow(merge, "seg int, bitmap binary").collect()}  # MAX_BITS / 8 bytes at most
    return Filter(bits, df.sparkSession.sparkContext.broadcast(segments))


def flagged(df: DataFrame, cols: list[str], f: Filter, name: str) -> DataFrame:
    """`df` with the boolean column `name`: false for rows that are certainly not in the filter, and for null hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = f.load()
        for b in batches:
            null = b.column(cols[0]).is_null().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(contains(bitmap, pairs(b, cols), f.bits) & ~null)], names=[*b.schema.names, name])

    return df.mapInArrow(run, f"{', '.join(f'`{x}` {t}' for x, t in df.dtypes)}, {name} boolean")


def within(df: DataFrame, col: str, f: Filter) -> DataFrame:
    """The rows of `df` that may be in the filter; the others are dropped before any shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = f.load()
        for b in batches:
            keep = contains(bitmap, pairs(b, [col]), f.bits)
            if keep.any():
                yield b.filter(pa.array(keep))

    return df.mapInArrow(run, df.schema)
