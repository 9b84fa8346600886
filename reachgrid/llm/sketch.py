"""Count-min sketches of 64-bit keys, merged over all partitions.

Every task keeps the cells that its keys touch as sorted lists; the lists of a cell range are summed
in one place. What leaves the merge is one bit per cell and threshold, so the result's size is fixed
by ``cells`` and ``rows`` whatever the input is. Estimates never fall below the true count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame

from reachgrid.llm.words import mixed, pack, runs, unpack

RANGES = 64
#: Keys that a task holds before it lets its cell lists go.
HELD = 2_500_000
SALTS = (np.uint64(0), np.uint64(0x9E3779B97F4A7C15), np.uint64(0x3C6EF372FE94F82A))


def cells_of(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mixed(keys ^ SALTS[row]) >> np.uint64(64 - bits)).astype(np.uint32)


def _capped(cells: np.ndarray, most: int) -> np.ndarray:
    """Sorted cells, each at most ``most`` times."""
    cells = np.sort(cells)
    if len(cells) > most:
        keep = np.ones(len(cells), bool)
        keep[most:] = cells[most:] != cells[:-most]
        cells = cells[keep]
    return cells


@dataclass
class Sketch:
    """Bits of the merged cells: ``bits[row][threshold]`` says where the count reaches the threshold."""

    planes: list[list[np.ndarray]]
    bits: int

    def __getstate__(self) -> tuple:
        """Planes travel compressed; few bits are set until the cells fill up."""
        squeeze = zstandard.ZstdCompressor(1)
        return self.bits, [[squeeze.compress(p) for p in row] for row in self.planes]

    def __setstate__(self, state: tuple) -> None:
        self.bits, packed = state
        self.planes = [[np.frombuffer(zstandard.ZstdDecompressor().decompress(p), np.uint8) for p in row] for row in packed]

    def reaches(self, keys: np.ndarray, level: int = 0) -> np.ndarray:
        """Whether the estimate, the least count over the rows, reaches the level's threshold."""
        out = np.ones(len(keys), bool)
        for row, levels in enumerate(self.planes):
            cells = cells_of(keys, row, self.bits)
            out &= (levels[level][cells >> np.uint32(3)] >> (cells & np.uint32(7)).astype(np.uint8)) & 1 == 1
        return out


def merged(docs: DataFrame, keys_of: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], *, bits: int, rows: int,
           thresholds: tuple[int, ...]) -> Broadcast:
    """The sketch of all keys that ``keys_of`` yields from the batches of ``docs``, as a broadcast of fixed size."""
    if bits < RANGES.bit_length() + 2:
        raise ValueError("a cell range must fill whole bytes")
    most = max(thresholds)
    shift = bits - (RANGES.bit_length() - 1)
    part = pa.schema([("row", pa.int32()), ("cells", pa.int32()), ("list", pa.binary())])

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            keys = np.concatenate(held)
            for row in range(rows):
                cells = _capped(cells_of(keys, row, bits), most)
                cuts = np.searchsorted(cells, (np.arange(RANGES + 1, dtype=np.uint64) << np.uint64(shift)))
                yield pa.RecordBatch.from_arrays([pa.array([row] * RANGES, pa.int32()), pa.array(range(RANGES), pa.int32()), pa.array(
                    [pack(cells[cuts[i]:cuts[i + 1]]) for i in range(RANGES)], pa.binary())], schema=part)
        held, n = [], 0
        for keys in keys_of(batches):
            held.append(keys)
            n += len(keys)
            if n >= HELD:
                yield from out(held)
                held, n = [], 0
        if n:
            yield from out(held)

    size = 1 << shift

    def added(key: tuple, parts: pa.Table) -> pa.Table:
        counts = np.zeros(size, np.uint16)
        for data in parts.column("list"):
            cells = unpack(data.as_py(), "u4") & np.uint32(size - 1)
            first, k = runs(cells)
            at = cells[first]
            counts[at] = np.minimum(counts[at] + k, most)
        squeeze = zstandard.ZstdCompressor(1)
        planes = [squeeze.compress(np.packbits(counts >= t, bitorder="little").tobytes()) for t in thresholds]
        return pa.table({"row": pa.array([key[0].as_py()], pa.int32()), "cells": pa.array([key[1].as_py()], pa.int32()),
                         "planes": pa.array([planes], pa.list_(pa.binary()))})

    found = docs.mapInArrow(lists, "row int, cells int, list binary").groupBy("row", "cells").applyInArrow(
        added, "row int, cells int, planes array<binary>")
    planes = [[np.zeros(RANGES * size // 8, np.uint8) for _ in thresholds] for _ in range(rows)]
    for r in found.toLocalIterator():  # rows * RANGES results of fixed size
        at = r["cells"] * size // 8
        for level, plane in enumerate(r["planes"]):
            planes[r["row"]][level][at:at + size // 8] = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(plane)), np.uint8)
    return docs.sparkSession.sparkContext.broadcast(Sketch(planes, bits))
