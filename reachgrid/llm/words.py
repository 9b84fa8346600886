"""Helpers shared by the Python-side operators: words of Arrow text columns, hashes, packed arrays."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task works on at a time.
BLOCK_BYTES = 6 << 20
#: Words are maximal runs of characters other than space and U+0009 to U+000D (Java and RE2 syntax).
WORD = r"[^\x20\x09-\x0D]+"
#: A NULL document id sorts behind every other.
NO_ID = np.iinfo(np.int64).max


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """doc_id, text (NULL: empty) and ``_key``, a hash of the text that tells repeated ids apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NO_ID))).alias("doc_id"),
                       text.alias("text"), F.xxhash64(text).alias("_key"))


def real_id() -> F.Column:
    return F.when(F.col("doc_id") < int(NO_ID), F.col("doc_id"))


def lower_ascii(text: F.Column) -> F.Column:
    """A-Z to a-z and nothing else; the faster ``lower`` says the same where a text is all ASCII."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, letters, letters.lower()))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def blocks(batches: Iterable[pa.RecordBatch], text: str = "text", size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows in pieces of about ``size`` bytes of text; a longer text is a piece of its own."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        ends = np.cumsum(pc.binary_length(batch.column(text)).to_numpy(zero_copy_only=False).astype(np.int64))
        start, done = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, done + size, "right")))
            yield batch.slice(start, stop - start)
            start, done = stop, int(ends[stop - 1])


@dataclass
class Words:
    """Word codes of some texts: text i has ``codes[starts[i]:starts[i + 1]]`` into ``vocabulary``."""

    codes: np.ndarray
    starts: np.ndarray
    vocabulary: pa.Array

    def hashes(self) -> np.ndarray:
        """64-bit hash of each vocabulary entry, the same in every process."""
        import pandas as pd  # 24 MB of a worker, which only those that hash words need
        return pd.util.hash_array(self.vocabulary.to_numpy(zero_copy_only=False), categorize=False)


def words_of(texts: pa.Array, *, lower: bool = False) -> Words:
    """Words of each text; ``lower`` maps A-Z to a-z and nothing else."""
    pieces = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat = pieces.flatten()
    real = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    before = np.concatenate(([0], np.cumsum(real)))
    ends = np.concatenate(([0], np.cumsum(pc.list_value_length(pieces).to_numpy(zero_copy_only=False)))).astype(np.int64)
    coded = flat.filter(pa.array(real)).dictionary_encode()
    return Words(coded.indices.to_numpy(), before[ends], coded.dictionary)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pack(values: np.ndarray) -> bytes:
    """Differences of the values, byte plane by byte plane, compressed; small for sorted values."""
    width = values.dtype.itemsize
    unsigned = values.view(f"u{width}")
    steps = np.diff(unsigned, prepend=unsigned.dtype.type(0))
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, width).T).tobytes())


def unpack(data: bytes, dtype: str) -> np.ndarray:
    kind = np.dtype(dtype)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    steps = np.ascontiguousarray(planes.reshape(kind.itemsize, -1).T).view(f"u{kind.itemsize}").ravel()
    return np.cumsum(steps, dtype=steps.dtype).view(kind)


def pack_plain(values: np.ndarray) -> bytes:
    """Byte planes of the values, compressed; for values in no order."""
    width = values.dtype.itemsize
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, width).T).tobytes())


def unpack_plain(data: bytes, dtype: str) -> np.ndarray:
    kind = np.dtype(dtype)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(kind.itemsize, -1).T).view(kind).ravel()


def text_ids(starts: np.ndarray) -> np.ndarray:
    """The text number of each position."""
    return np.repeat(np.arange(len(starts) - 1), np.diff(starts))


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each run of equal values in a sorted array, and the length of each run."""
    first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(values)))


def frame(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
