"""Shuffled values of cells brought to the edges of a graph, in blocks: sums over edges for every shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachgrid.session import checkpoint

#: Modulus and multipliers of the shuffle; all products stay below 2^63.
PRIME, STEP, TURN, ROUND, SPREAD = 2_147_483_647, 7919, 104_729, 15_485_863, 48_271
#: Cells whose shuffled values are gathered in one group, cells whose edges are summed in one group, shuffles that travel together.
HOME, BLOCK, PACK = 4096, 16_384, 75
#: Values that a task sends on at once.
SENT = 4096
#: Cells of a home that one group hands on to blocks (a cell counts for every block); beyond that, one in so many of all.
ASKED, SHARE = 16_384, 1000


def _packed(*columns: np.ndarray) -> bytes:
    return pa.compress(b"".join(c.tobytes() for c in columns), codec="zstd", asbytes=True)


def _unpacked(data: pa.BinaryScalar, n: int, *kinds: str) -> list[np.ndarray]:
    raw = pa.decompress(data.as_buffer(), n * sum(np.dtype(k).itemsize for k in kinds), codec="zstd")
    starts = np.cumsum([0, *[n * np.dtype(k).itemsize for k in kinds]])
    return [np.frombuffer(raw, k, n, at) for k, at in zip(kinds, starts)]


def _drawn(fixed: np.ndarray, perm: np.ndarray, salt: int) -> np.ndarray:
    h = (fixed * STEP + perm * TURN + salt * ROUND) % PRIME
    return (h % 32_768 + 1) * (h // 32_768 + 1) % PRIME * SPREAD % PRIME


def sources(index: np.ndarray, perm: np.ndarray, n: int, seed: int = 42, rounds: int = 6) -> np.ndarray:
    """The rows that ``stats.shuffle_positions`` moves to ``index`` in shuffle ``perm``: its turns backwards."""
    a = int(np.ceil(np.sqrt(n)))
    b = -(-n // a)
    out, todo = np.empty(len(index), np.int64), np.arange(len(index))
    x = index.astype(np.int64)
    while len(todo):
        left, right, of = x // b, x % b, perm[todo].astype(np.int64)
        for r in reversed(range(rounds)):
            if r % 2 == 0:
                left = (left - _drawn(right, of, 64 * seed + r)) % a
            else:
                right = (right - _drawn(left, of, 64 * seed + r)) % b
        x = left * b + right
        settled = x < n
        out[todo[settled]] = x[settled]
        todo, x = todo[~settled], x[~settled]
    return out


def _sent(permutations: int, seed: int):
    """Values (idx, z, n) to the homes of the cells that get them, in every shuffle and in the map as it is (0)."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(at, SENT) for at in range(0, whole.num_rows, SENT)):
                idx, z = batch.column("idx").to_numpy().astype(np.int64), batch.column("z").to_numpy()
                perm = np.repeat(np.arange(1, permutations + 1), len(idx))
                to = sources(np.tile(idx, permutations), perm, batch.column("n")[0].as_py(), seed)
                to, perm = np.concatenate([idx, to]), np.concatenate([np.zeros(len(idx), np.int64), perm])
                home, cell = to // HOME, to % HOME
                order = np.argsort((home * (permutations + 1) + perm) * HOME + cell)
                home, cell, perm, z = home[order], cell[order].astype("<u2"), perm[order].astype("<u4"), z[order % len(idx)]
                homes, first = np.unique(home, return_index=True)
                ends = [*first[1:], len(home)]
                # Differences of sorted numbers are small, so they pack well; they wrap around, and so do their sums.
                data = [_packed(z[i:j], np.diff(perm[i:j], prepend=perm.dtype.type(0)), np.diff(cell[i:j], prepend=cell.dtype.type(0))) for i, j in zip(first, ends)]
                yield pa.RecordBatch.from_arrays([pa.array(homes), pa.array(ends - first), pa.array(data, pa.binary())], ["home", "n", "data"])
    return send


def _handed(permutations: int):
    """The shuffled values of a home's cells to the blocks that ask for them, a row for a block and pack."""
    def hand(key: tuple, sent: pa.Table, asked: pa.Table) -> pa.Table:
        values = np.zeros((HOME, permutations + 1))
        for n, data in zip(sent.column("n").to_pylist(), sent.column("data")):
            z, perm, cell = _unpacked(data, n, "<f8", "<u4", "<u2")
            values[np.cumsum(cell, dtype=cell.dtype), np.cumsum(perm, dtype=perm.dtype)] = z
        block, cell = asked.column("block").to_numpy(), asked.column("idx").to_numpy() % HOME
        order = np.lexsort((cell, block))
        blocks, first = np.unique(block[order], return_index=True)
        cells = np.split(cell[order], first[1:]) if len(blocks) else []
        packs = range(0, permutations + 1, PACK)
        return pa.table({"at": np.repeat(blocks, len(packs)), "of": np.tile(np.arange(len(packs)), len(blocks)), "home": np.full(len(blocks) * len(packs), key[0].as_py()),
                         "n": np.repeat(np.array([len(c) for c in cells], np.int64), len(packs)),
                         "cells": pa.array([_packed(c.astype("<u2")) for c in cells for _ in packs], pa.binary()),
                         "zs": pa.array([_packed(values[c, p:p + PACK]) for c in cells for p in packs], pa.binary())})
    return hand


def _summed(permutations: int):
    """Sums over a block's edges, one for each shuffle of a pack."""
    def add(key: tuple, values: pa.Table, edges: pa.Table) -> pa.Table:
        pack = key[1].as_py()
        width = min(PACK, permutations + 1 - pack * PACK)
        sizes = values.column("n").to_pylist()
        idx, zs, done = np.empty(sum(sizes), np.int64), np.empty((sum(sizes), width)), 0
        for home, n, cells, z in zip(values.column("home").to_pylist(), sizes, values.column("cells"), values.column("zs")):
            idx[done:done + n] = home * HOME + _unpacked(cells, n, "<u2")[0].astype(np.int64)
            zs[done:done + n] = _unpacked(z, n * width, "<f8")[0].reshape(n, width)
            done += n
        order = np.argsort(idx)
        at = [order[np.searchsorted(idx, edges.column(c).to_numpy(), sorter=order)] for c in ("i", "o")]
        total = np.zeros(width)
        for first in range(0, len(at[0]), 8192):
            total += np.einsum("ep,ep->p", zs[at[0][first:first + 8192]], zs[at[1][first:first + 8192]])
        return pa.table({"perm": np.arange(width) + pack * PACK, "cross": total})
    return add


def edge_sums(indexed: DataFrame, edges: DataFrame, permutations: int, seed: int = 42) -> DataFrame:
    """(perm, cross): sum over ``edges`` of the product of the values at both ends, in the map (perm 0) and each shuffle.

    indexed: (idx, z), idx being 0..n-1. edges: (i, o) in terms of idx. A value finds the cells that get it by the
    shuffle's inverse; a cell's values go once to every block of cells with an edge to it, packed by home and block. No
    table of values is joined: Spark knows nothing of the size that Python gives it, and would broadcast it. Homes that
    very many blocks ask for are dealt over groups; there are fewer than ``SHARE`` such, so their list may be broadcast.
    """
    spark = indexed.sparkSession
    rows = indexed.select("idx", F.coalesce("z", F.lit(0.0)).alias("z"), indexed.agg(F.count("*")).scalar().alias("n"))
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "idx")
    sent = rows.mapInArrow(_sent(permutations, seed), "home long, n long, data binary")
    blocked = checkpoint(edges.select("i", "o", F.floor(F.col("i") / BLOCK).alias("block")))
    asked = checkpoint(blocked.select("block", F.explode(F.array("i", "o")).alias("idx")).distinct()).withColumn("home", F.floor(F.col("idx") / HOME))
    asks = asked.groupBy("home").agg(F.count("*").alias("asks"))
    bound = F.greatest(F.lit(ASKED), F.ceil(asks.agg(F.sum("asks")).scalar() / SHARE))
    hot = F.broadcast(asks.where(F.col("asks") > bound).select("home", F.ceil(F.col("asks") / bound).cast("int").alias("parts")))
    dealt = sent.join(hot, "home", "left").select("home", "n", "data", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    wanted = asked.join(hot, "home", "left").select("home", "block", "idx", F.coalesce(F.pmod(F.xxhash64("block"), F.col("parts")), F.lit(0)).cast("int").alias("part"))
    here = dealt.groupBy("home", "part").cogroup(wanted.groupBy("home", "part")).applyInArrow(
        _handed(permutations), "at long, of long, home long, n long, cells binary, zs binary").groupBy("at", "of")
    packs = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(permutations // PACK).cast("bigint"))).alias("pack")
    sums = here.cogroup(blocked.select("*", packs).groupBy("block", "pack")).applyInArrow(_summed(permutations), "perm long, cross double")
    return sums.groupBy("perm").agg(F.sum("cross").alias("cross"))
