"""Removal of word sequences that an earlier document already has.

A window is ``width`` consecutive words of one document. First every window is counted in a
count-min sketch, merged over all partitions. The estimate never falls below the true count, so a
window estimated once occurs once and needs no further look. The second pass groups the others
exactly, by 96 bits of two polynomial hashes of the words, and finds the smallest document of each.

A task settles what it can by itself: of the documents that share a window inside the task, all but
the smallest have found an earlier one. Only the smallest goes on, so a window that a third of all
documents share reaches its group once per task, not once per document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachgrid.llm import sketch
from reachgrid.llm.words import (NO_ID, Words, blocks, id_and_text, mixed, pack, pack_plain, real_id, runs, shuffle_partitions,
                                 text_ids, unpack, unpack_plain, words_of)

WIDTH = 50
#: Cells of a sketch row: 2 to this power. Two rows of one bit per cell are 128 MB, the size of the broadcast.
CELL_BITS = 29
#: Windows that a task holds before it sends them on.
HELD = 1_500_000
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))
MASK = (1 << 64) - 1


def window_keys(words: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start position of every window inside one text, and two hashes of its words."""
    n = len(words.codes)
    start = np.flatnonzero(np.arange(n) + width <= np.repeat(words.starts[1:], np.diff(words.starts)))
    hashes = words.hashes()[words.codes] if n else np.zeros(0, np.uint64)
    keys = []
    for base in BASES:
        power = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, base, np.uint64))))
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        back = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, inverse, np.uint64))))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(hashes ^ base) * power[:n])))
        keys.append(mixed((total[start + width] - total[start]) * back[start]))
    return start, keys[0], keys[1]


def _sketched(width: int):
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for block in blocks(batches):
            yield window_keys(words_of(block.column("text")), width)[1]
    return keys


PART = pa.schema([("bucket", pa.int64()), ("docs", pa.binary()), ("tags", pa.binary()), ("key", pa.binary()), ("more", pa.binary()),
                  ("doc", pa.binary()), ("pos", pa.binary())])


def _part(bucket: int, docs: np.ndarray, tags: np.ndarray, key, more, doc, pos) -> pa.RecordBatch:
    """One row; documents are numbered anew among those that it names."""
    used, doc = np.unique(doc, return_inverse=True) if len(doc) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    values = (bucket, pack(docs[used]), pack_plain(tags[used]), pack(key), pack_plain(more), pack_plain(doc.astype(np.uint32)),
              pack_plain(pos.astype(np.uint32)))
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, PART, strict=True)], schema=PART)


def _candidates(width: int, buckets: int, estimate):
    """Windows estimated repeated: settled ones under bucket -1 - k, the smallest document's under its bucket."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out() -> Iterator[pa.RecordBatch]:
            docs, tags = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            before = np.cumsum([0] + [len(h[0]) for h in held])
            key, more, pos = (np.concatenate([h[i] for h in held]) for i in (2, 3, 5))
            doc = np.concatenate([h[4] + b for h, b in zip(held, before, strict=False)])
            order = np.argsort(key, kind="stable")
            key, more, doc, pos = key[order], more[order], doc[order], pos[order]
            first, size = runs(key)
            least = np.repeat(np.minimum.reduceat(docs[doc], first), size) if len(key) else docs[doc]
            # Equal first hashes with unequal second ones go on, to be told apart in the group.
            same = np.repeat(np.minimum.reduceat(more, first) == np.maximum.reduceat(more, first), size) if len(key) else key == key
            settled = same & (docs[doc] > least)
            at = np.flatnonzero(settled)
            slot = docs[doc[at]] % buckets
            for k in np.flatnonzero(np.bincount(slot.astype(np.int64), minlength=buckets)):
                i = at[slot == k]
                yield _part(-1 - int(k), docs, tags, key[:0], more[:0], doc[i], pos[i])
            rest = np.flatnonzero(~settled)
            cuts = np.searchsorted(key[rest], np.array([(i << 64) // buckets for i in range(buckets)], np.uint64))
            for k, i in enumerate(np.split(rest, cuts[1:])):
                if len(i):
                    yield _part(k, docs, tags, key[i], more[i], doc[i], pos[i])

        n = 0
        for block in blocks(batches):
            words = words_of(block.column("text"))
            start, key, more = window_keys(words, width)
            keep = np.flatnonzero(estimate(key))
            start, key, more = start[keep], key[keep], (more[keep] >> np.uint64(32)).astype(np.uint32)
            doc = text_ids(words.starts)[start]
            held.append((block.column("doc_id").to_numpy(), block.column("_key").to_numpy(), key, more, doc, start - words.starts[doc]))
            n += len(keep)
            if n >= HELD:
                yield from out()
                held.clear()
                n = 0
        if held:
            yield from out()
    return send


FOUND = pa.schema([("slice", pa.int64()), ("docs", pa.binary()), ("tags", pa.binary()), ("doc", pa.binary()), ("pos", pa.binary())])


def _grouped(key: tuple, parts: pa.Table, slices: int) -> pa.Table:
    """Windows of one bucket that start in a smaller document too, packed into one row per slice of documents."""
    docs, tags, keys, mores, doc, pos = [], [], [], [], [], []
    n = 0
    for row in parts.to_pylist():
        ids = unpack(row["docs"], "i8")
        docs.append(ids)
        tags.append(unpack_plain(row["tags"], "i8"))
        keys.append(unpack(row["key"], "u8"))
        mores.append(unpack_plain(row["more"], "u4"))
        doc.append(unpack_plain(row["doc"], "u4").astype(np.int64) + n)
        pos.append(unpack_plain(row["pos"], "u4"))
        n += len(ids)
    docs, tags, doc, pos = map(np.concatenate, (docs, tags, doc, pos))
    if key[0].as_py() >= 0:
        keys, mores = np.concatenate(keys), np.concatenate(mores)
        order = np.lexsort((mores, keys))
        keys, mores, doc, pos = keys[order], mores[order], doc[order], pos[order]
        first = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (mores[1:] != mores[:-1]))))
        least = np.repeat(np.minimum.reduceat(docs[doc], first), np.diff(np.append(first, len(keys))))
        keep = docs[doc] > least
        doc, pos = doc[keep], pos[keep]
    out = []
    of = (mixed(docs[doc].view(np.uint64)) % np.uint64(slices)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    cuts = np.searchsorted(of[order], np.arange(slices + 1))
    for k in range(slices):
        at = order[cuts[k]:cuts[k + 1]]
        if len(at):
            used, own = np.unique(doc[at], return_inverse=True)
            out.append((k, pack(docs[used]), pack_plain(tags[used]), pack_plain(own.astype(np.uint32)), pack_plain(pos[at])))
    return pa.table([pa.array([r[i] for r in out], f.type) for i, f in enumerate(FOUND)], schema=FOUND)


def _by_document(key: tuple, parts: pa.Table) -> pa.Table:
    """One row per document of a slice: the sorted start positions of its repeated windows."""
    ids, tags, pos = [], [], []
    for row in parts.to_pylist():
        doc = unpack_plain(row["doc"], "u4")
        ids.append(unpack(row["docs"], "i8")[doc])
        tags.append(unpack_plain(row["tags"], "i8")[doc])
        pos.append(unpack_plain(row["pos"], "u4"))
    ids, tags, pos = map(np.concatenate, (ids, tags, pos))
    order = np.lexsort((pos, tags, ids))
    ids, tags, pos = ids[order], tags[order], pos[order]
    first = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1]))))
    return pa.table({"doc_id": pa.array(ids[first], pa.int64()), "_key": pa.array(tags[first], pa.int64()),
                     "starts": pa.array([pack(p) for p in np.split(pos, first[1:])], pa.binary())})


def repeated_windows(docs: DataFrame, *, width: int = WIDTH, cell_bits: int = CELL_BITS) -> DataFrame:
    """doc_id, _key and packed start positions of the windows that a smaller doc_id has too; one row per document that has any."""
    source = id_and_text(docs)
    buckets = slices = 2 * shuffle_partitions(docs.sparkSession)
    seen = sketch.merged(source.select("text"), _sketched(width), bits=cell_bits, rows=2, thresholds=(2,))
    names = ", ".join(f"{f.name} {'long' if f.name == 'bucket' else 'binary'}" for f in PART)
    sent = source.mapInArrow(_candidates(width, buckets, lambda keys: seen.value.reaches(keys)), names)
    found = sent.groupBy("bucket").applyInArrow(lambda key, parts: _grouped(key, parts, slices), "slice long, docs binary, tags binary, doc binary, pos binary")
    return found.groupBy("slice").applyInArrow(_by_document, "doc_id long, _key long, starts binary")


def _cut(width: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                words = row["text"].encode().split()
                gone = np.zeros(len(words) + 1, np.int64)
                if row["starts"]:
                    start = unpack(row["starts"], "u4")
                    np.add.at(gone, start, 1)
                    np.add.at(gone, np.minimum(start + np.uint32(width), len(words)), -1)
                covered = np.cumsum(gone)[:-1] > 0
                kept = b" ".join([w for w, c in zip(words, covered.tolist(), strict=True) if not c]) if covered.any() else b" ".join(words)
                out.append((row["doc_id"], len(words), int(covered.sum()), hashlib.sha256(kept).hexdigest(), kept.decode()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(
                (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])
    return cut


def remove_repeats(docs: DataFrame, *, width: int = WIDTH, cell_bits: int = CELL_BITS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text: every document without words covered by windows of earlier ones.

    A NULL or empty text has no words. Texts shorter than ``width`` words lose nothing. Rows that
    repeat a doc_id are one document as to "smaller doc_id" and are each returned; a NULL doc_id
    counts as larger than every other and comes back NULL. Other columns are ignored.
    """
    found = repeated_windows(docs, width=width, cell_bits=cell_bits)
    source = id_and_text(docs)
    joined = source.join(found, ["doc_id", "_key"], "left").select("doc_id", "text", "starts")
    out = joined.mapInArrow(_cut(width), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    return out.select(real_id().alias("doc_id"), "n_words", "n_removed", "kept_sha256", "kept_text")
