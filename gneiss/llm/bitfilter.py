"""Bit tables of a fixed size that tell tasks what may be wanted: some false alarms, no misses.

Defined results: nulls may always be wanted; empty tables want nothing; repeated values count as one.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm import textvec as tv
from gneiss.llm.storage import released

BITS = 1 << 26
#: Bits of a hash that are exchanged to find repeated ones.
HASH_BITS = 40
_U = np.uint64


def _places(values: np.ndarray) -> np.ndarray:
    return (tv.mix(values.astype(np.int64).view(np.uint64)) % np.uint64(BITS)).astype(np.int64)


def build(values: DataFrame) -> bytes:
    """The table over the first column of ``values`` (long); its size does not depend on the rows."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, some = np.zeros(BITS // 8, dtype=np.uint8), False
        for batch in batches:
            at = _places(batch.column(0).drop_null().to_numpy())
            np.bitwise_or.at(table, at >> 3, np.uint8(128) >> (at & 7).astype(np.uint8))
            some |= len(at) > 0
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(table.tobytes(), 1)], pa.binary())], ["bits"])

    total = np.zeros(BITS // 8, dtype=np.uint8)
    for row in values.select(F.col(values.columns[0]).cast("long")).coalesce(8).mapInArrow(released(fold), "bits binary").toLocalIterator():
        total |= np.frombuffer(zlib.decompress(row["bits"]), np.uint8)
    return zlib.compress(total.tobytes(), 1)


class BitFilter:
    def __init__(self, packed: bytes) -> None:
        self.table = np.frombuffer(zlib.decompress(packed), np.uint8)

    def may_hold(self, column: pa.Array) -> np.ndarray:
        """False only for values that are surely not in the table; nulls may be."""
        at = _places(column.fill_null(0).to_numpy(zero_copy_only=False))
        hit = (self.table[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
        return hit | column.is_null().to_numpy(zero_copy_only=False)


def split(rows: DataFrame, column: str, packed: bytes, held: bool) -> DataFrame:
    """The rows whose ``column`` (long) may be in the table, or those where it surely is not."""
    at = rows.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = BitFilter(packed)
        for batch in batches:
            out = batch.filter(pa.array(bits.may_hold(batch.column(at)) == held))
            if out.num_rows:
                yield out

    return rows.mapInArrow(released(run), rows.schema)


def _packed(values: np.ndarray) -> bytes:
    """Ascending values of HASH_BITS bits, as bytes of their differences."""
    steps = np.diff(values, prepend=_U(0)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, : HASH_BITS // 8]
    return zlib.compress(np.ascontiguousarray(steps.T).tobytes(), 1)


def _unpacked(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(blob), np.uint8).reshape(HASH_BITS // 8, -1)
    wide = np.zeros((raw.shape[1], 8), dtype=np.uint8)
    wide[:, : HASH_BITS // 8] = raw.T
    return np.cumsum(wide.reshape(-1).view("<u8"), dtype=np.uint64)


def repeated(rows: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], parts: int, bits: int, held_limit: int = 400_000) -> bytes:
    """A table of 2 ** bits bits, by the first bits, of the 64-bit values that occur at least twice in all rows.

    Tasks exchange sorted runs of the first HASH_BITS bits by ranges; a task's own repeats are merged before that.
    """
    shift, low = _U(HASH_BITS - bits), _U(64 - HASH_BITS)

    def ranges(values: np.ndarray) -> np.ndarray:
        return ((values >> _U(HASH_BITS - 32)) * _U(parts) >> _U(32)).astype(np.int64)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def runs() -> pa.RecordBatch:
            values = np.sort(np.concatenate(held)) >> low
            heads = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
            twice = np.diff(np.append(heads, len(values))) > 1
            values = values[heads]
            bounds = np.searchsorted(ranges(values), np.arange(parts + 1))
            cut = list(zip(bounds[:-1], bounds[1:], strict=True))
            columns = [pa.array([_packed(values[a:b]) for a, b in cut], pa.binary()), pa.array([_packed(values[a:b][twice[a:b]]) for a, b in cut], pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array(np.arange(parts), pa.int32()), *columns], ["range", "once", "twice"])

        for batch in batches:
            for own in hashes(batch):
                held.append(own)
                size += len(own)
                if size >= held_limit:
                    yield runs()
                    held, size = [], 0
        if size:
            yield runs()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = [_unpacked(x.as_py()) for batch in batches for c in ("once", "twice") for x in batch.column(c)]
        if not values:
            return
        v = np.sort(np.concatenate(values))
        places = np.unique((v[1:][v[1:] == v[:-1]] >> shift).astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(np.diff(places, prepend=0).astype("<u4").tobytes(), 1)], pa.binary())], ["bits"])

    sent = rows.mapInArrow(released(send), "range int, once binary, twice binary")
    table = np.zeros(1 << bits, dtype=bool)
    for row in sent.repartitionById(parts, F.col("range")).mapInArrow(released(gather), "bits binary").toLocalIterator():
        table[np.cumsum(np.frombuffer(zlib.decompress(row["bits"]), "<u4"), dtype=np.int64)] = True
    return zlib.compress(np.packbits(table).tobytes(), 1)


class RepeatTable:
    """Tells values that may occur twice; built by ``repeated``."""

    def __init__(self, packed: bytes, bits: int) -> None:
        self.table, self.shift = np.frombuffer(zlib.decompress(packed), np.uint8), np.uint64(64 - bits)

    def may_repeat(self, values: np.ndarray) -> np.ndarray:
        at = (values >> self.shift).astype(np.int64)
        return (self.table[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
