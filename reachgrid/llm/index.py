"""Token ids in sharded binary files with a minimal perfect hash index.

A shard is one row of the written table, and a row group by itself: raw little-endian 32-bit ids of consecutive
documents, and an index over their keys. The index is a hash-and-displace function: a key's bucket has a seed that sends
each of its keys to a slot of its own, with exactly as many slots as keys. Each slot stores a fingerprint of
the key, its id offset and its id count. So a lookup costs two hashes, one comparison and one slice, whatever the
shard's size, and foreign keys are refused by their fingerprint.
"""

from __future__ import annotations

import itertools
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reachgrid.llm.words import blocks, id_and_text, mixed, real_id
from reachgrid.session import checkpoint_folder

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
#: Ids of a shard, about.
SHARD_IDS = 2_000_000
#: Keys that share a seed, on average.
BUCKET_KEYS = 4
#: Pieces of text whose ids a worker keeps from block to block, in about 30 MB; the first ones met are mostly the frequent ones.
CACHED = 600_000
#: Bytes of text whose pieces are taken apart at once, and of pieces that the library encodes at once (it holds some 100 bytes an id).
TEXT_BYTES = 4 << 20
ENCODED_BYTES = 1 << 18
#: White space in front of a space: there a cut before the space could part what the tokenizer joins.
MARK = "\x01"
#: Places where a distinct piece is cut: behind a single line end, in front of white space, and between a letter and punctuation.
PARTS = (r"([!-~\p{L}]\n)([!-~\p{L}])", r"([!-~\p{L}])([ \n\t\r])", r"(\p{L})([.,;:!?|)\"\]])")
JOINED_SPACE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "


# -- minimal perfect hash ---------------------------------------------------------------------------------


def _slot(keys: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    return (mixed(keys + seeds.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(n)).astype(np.int64)


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(keys ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(buckets)).astype(np.int64)


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys ^ np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(32)).astype(np.uint32)


def build_hash(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seeds per bucket, and the slot of each of the distinct keys; slots are 0 to n - 1, each used once."""
    n = len(keys)
    buckets = max(1, -(-n // BUCKET_KEYS))
    seeds, slots = np.zeros(buckets, np.uint32), np.zeros(n, np.int64)
    taken = np.zeros(n, bool)
    of = _bucket(keys, buckets)
    order = np.argsort(of, kind="stable")
    sizes = np.bincount(of, minlength=buckets)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    tried = np.arange(256, dtype=np.uint32)
    for b in np.argsort(-sizes, kind="stable"):  # large buckets while there is room
        own = order[starts[b]:starts[b + 1]]
        if not len(own):
            break
        base = 0
        while True:
            at = _slot(keys[own][None, :], (tried + np.uint32(base))[:, None], n)
            free = ~taken[at].any(1)
            if len(own) > 1:
                ordered = np.sort(at, 1)
                free &= (ordered[:, 1:] != ordered[:, :-1]).all(1)
            hit = np.flatnonzero(free)
            if len(hit):
                seeds[b] = base + hit[0]
                slots[own] = at[hit[0]]
                taken[slots[own]] = True
                break
            base += 256
    return seeds, slots


def find(keys: np.ndarray, seeds: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """The slot of each key, -1 where the stored fingerprint is another key's."""
    if not len(prints):
        return np.full(len(keys), -1)
    slot = _slot(keys, seeds[_bucket(keys, len(seeds))], len(prints))
    return np.where(prints[slot] == fingerprints(keys), slot, -1)


# -- ids --------------------------------------------------------------------------------------------------


class Encoder:
    """Ids of texts by the tokenizers library, each distinct piece of text encoded once.

    A text is cut in front of its spaces, where the tokenizer's own first cut lies too, unless white space
    stands in front of a space; such texts are encoded whole. Distinct pieces are cut once more, between
    letters and punctuation and around line ends, which the tokenizer never joins either.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        #: Strings that the tokenizer takes as one token wherever they stand; a text or piece with one is not cut inside.
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.known = pa.array([], pa.string())
        self.ids, self.at = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        out, many = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)]
        for some in blocks([pa.RecordBatch.from_arrays([texts], ["text"])], size=ENCODED_BYTES):
            ids = [x.ids for x in self.tokenizer.encode_batch_fast(some.column(0).to_pylist(), add_special_tokens=False)]
            many.append(np.fromiter(map(len, ids), np.int64, len(ids)))
            out.append(np.fromiter(itertools.chain.from_iterable(ids), np.uint32, many[-1].sum()))
        return np.concatenate(out), np.cumsum(np.concatenate(many))

    def _parts(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces by way of their parts, and where each piece's begin."""
        marked = pieces
        for pattern in PARTS:
            marked = pc.replace_substring_regex(marked, pattern, r"\1" + MARK + r"\2")
        whole = pc.match_substring(pieces, MARK)
        for x in self.special:
            whole = pc.or_(whole, pc.match_substring(pieces, x))
        marked = pc.if_else(whole, pa.array([None], pa.string())[0], marked)
        parts = pc.split_pattern(marked, MARK)
        parts = pc.if_else(pc.is_null(parts), pa.ListArray.from_arrays(np.arange(len(pieces) + 1, dtype=np.int32), pieces), parts) if parts.null_count else parts
        count = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = parts.flatten().dictionary_encode()
        vocabulary = coded.dictionary
        # The kept pieces are looked up among these few and not the other way round, which would hash all the kept ones each time.
        met = pc.index_in(self.known, vocabulary).fill_null(-1).to_numpy(zero_copy_only=False)
        place = np.full(len(vocabulary), -1, np.int64)
        place[met[met >= 0]] = np.flatnonzero(met >= 0)
        missing = np.flatnonzero(place < 0)
        new = vocabulary.take(pa.array(missing))
        ids, at = self._encode(new)
        pool, pool_at = np.concatenate((self.ids, ids)), np.concatenate((self.at, at[1:] + self.at[-1]))
        place[missing] = len(self.known) + np.arange(len(missing))
        keep = min(len(new), CACHED - len(self.known))
        if keep > 0:
            self.known = pa.concat_arrays([self.known, new.slice(0, keep)])
            self.at = pool_at[:len(self.known) + 1].copy()
            self.ids = pool[:self.at[-1]].copy()
        place = place[coded.indices.to_numpy()]
        out, out_at = _gathered(pool, pool_at[place], pool_at[place + 1] - pool_at[place])
        return out, out_at[np.concatenate(([0], np.cumsum(count)))]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, END_ID behind each, and where each text's begin."""
        hard = pc.or_(pc.match_substring_regex(texts, JOINED_SPACE), pc.equal(texts, ""))
        for x in self.special:
            if " " in x:
                hard = pc.or_(hard, pc.match_substring(texts, x))
        hard = hard.to_numpy(zero_copy_only=False)
        pieces = pc.split_pattern(pc.if_else(pa.array(hard), "", texts), " ")
        first = np.concatenate(([0], np.cumsum(pc.list_value_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64))))
        spaced = np.ones(first[-1], bool)
        spaced[first[:-1]] = False
        coded = pc.binary_join_element_wise(pc.if_else(pa.array(spaced), " ", ""), pieces.flatten(), "").dictionary_encode()
        codes = coded.indices.to_numpy()
        ids, at = self._parts(coded.dictionary)
        whole, whole_at = self._encode(texts.filter(pa.array(hard)))
        pool = np.concatenate((ids, whole, np.array([END_ID], np.uint32)))
        where, many = at[codes], (at[1:] - at[:-1])[codes]
        # A text encoded whole has one empty piece, whose place its ids take.
        where[first[:-1][hard]], many[first[:-1][hard]] = whole_at[:-1] + len(ids), np.diff(whole_at)
        where, many = np.insert(where, first[1:], len(pool) - 1), np.insert(many, first[1:], 1)
        out, out_at = _gathered(pool, where, many)
        return out, out_at[first + np.arange(len(first))]


def _gathered(pool: np.ndarray, where: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices ``pool[where:where + many]`` one after another, and where each begins."""
    at = np.concatenate(([0], np.cumsum(many)))
    source = np.repeat(where - at[:-1], many)
    source += np.arange(at[-1])
    return pool[source], at


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


# -- shards -----------------------------------------------------------------------------------------------

SHARD = pa.schema([("task", pa.int64()), ("shard", pa.int64()), ("first_key", pa.int64()), ("last_key", pa.int64()), ("n_docs", pa.int64()),
                   ("n_ids", pa.int64()), ("payload", pa.binary()), ("keys", pa.binary()), ("copies", pa.binary()), ("seeds", pa.binary()),
                   ("prints", pa.binary()), ("offsets", pa.binary()), ("lengths", pa.binary())])

#: Parquet's writer looks at sizes every 100 rows by default, so that it would hold all shards of a task, and a reader get them all at once.
OWN_ROW_GROUP = {"parquet.block.size": "1", "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1",
                 "parquet.enable.dictionary": "false"}


def _hashed(keys: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """The 64-bit key that is looked up: of a document id and the number of its copy."""
    return mixed(keys.view(np.uint64)) + copies.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)


def _shards(path: str, size: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, shard = TaskContext.get().partitionId(), 0
        encode = encoder(path)
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            keys, copies, lengths = (np.concatenate([h[i] for h in held]) for i in (0, 1, 2))
            offsets = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.uint64)
            hashed = _hashed(keys, copies)
            seeds, slots = build_hash(hashed)
            prints, at, many = np.empty(len(keys), np.uint32), np.empty(len(keys), np.uint64), np.empty(len(keys), np.uint32)
            prints[slots], at[slots], many[slots] = fingerprints(hashed), offsets, lengths
            row = (task, shard, keys[0], keys[-1], len(keys), int(lengths.sum()), b"".join(h[3] for h in held), *(
                x.tobytes() for x in (keys, copies, seeds, prints, at, many)))
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, SHARD, strict=True)], schema=SHARD)
        n = 0
        for block in blocks(_numbered(batches), size=TEXT_BYTES):
            ids, at = encode(block.column("text"))
            keys, copies = block.column("doc_id").to_numpy(), block.column("copy").to_numpy().astype(np.uint32)
            start = 0
            pa.default_memory_pool().release_unused()  # what taking the texts apart took, before the next block or another step needs it
            while start < len(keys):
                stop = max(start + 1, int(np.searchsorted(at[1:], at[start] + size - n, "right")))
                stop = min(stop, len(keys))
                held.append((keys[start:stop], copies[start:stop], np.diff(at[start:stop + 1]), ids[at[start]:at[stop]].astype("<u4").tobytes()))
                n += int(at[stop] - at[start])
                start = stop
                if n >= size or start < len(keys):
                    yield out()
                    held.clear()
                    shard, n = shard + 1, 0
        if held:
            yield out()
    return write


def write_index(docs: DataFrame, tokenizer_path: str, *, shard_ids: int = SHARD_IDS, folder: str | None = None) -> str:
    """Write the shards of ``docs`` in doc_id order; the path of the table. NULL ids come last, NULL texts are empty.

    Rows that share a doc_id are copies 0, 1, ... of the key, in the order of their texts' hashes. Documents are
    dealt out by ranges of doc_id before they are encoded, so ids are never shuffled or sorted.
    """
    spark = docs.sparkSession
    path = folder or f"{checkpoint_folder(spark)}/{uuid.uuid4().hex}"
    rows = id_and_text(docs)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Ranges of one doc_id stay together, so copies are numbered inside their range.
    dealt = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "_key")
    names = ", ".join(f"{f.name} {'binary' if f.type == pa.binary() else 'long'}" for f in SHARD)
    written = dealt.mapInArrow(_shards(tokenizer_path, shard_ids), names).write.option("compression", "zstd")
    written.options(**OWN_ROW_GROUP).parquet(path)
    return path


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The number of each row among those of its doc_id; rows come sorted."""
    last, seen = None, 0
    for batch in batches:
        keys = batch.column("doc_id").to_numpy()
        if not len(keys):
            continue
        new = np.concatenate(([keys[0] != last], keys[1:] != keys[:-1]))
        at = np.arange(len(keys))
        since = at - np.maximum.accumulate(np.where(new, at, 0))
        head = np.cumsum(new) == 0  # rows that go on with the last batch's id
        copy = np.where(head, at + seen, since)
        last, seen = keys[-1], int(copy[-1]) + 1
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(copy, pa.int64())], names=["doc_id", "text", "copy"])


def _starts(shards: DataFrame) -> DataFrame:
    """task, shard and the ids of all shards before; tasks are added up first, so a window holds one task's shards or one row per task."""
    sizes = shards.select("task", "shard", "n_ids")
    tasks = sizes.groupBy("task").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = tasks.select("task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("task").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("_in", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(tasks, "task").select(
        "task", "shard", (F.col("_base") + F.col("_in")).alias("base"))


def _lookup(row: dict, keys: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which of the keys the shard has, their id offsets and counts."""
    prints, at, many = np.frombuffer(row["prints"], np.uint32), np.frombuffer(row["offsets"], np.uint64), np.frombuffer(row["lengths"], np.uint32)
    slot = find(_hashed(keys, copies), np.frombuffer(row["seeds"], np.uint32), prints)
    hit = np.flatnonzero(slot >= 0)
    return hit, at[slot[hit]].astype(np.int64), many[slot[hit]].astype(np.int64)


PLACE = pa.struct([("doc_id", pa.int64()), ("copy", pa.int64()), ("at", pa.int64()), ("n", pa.int64())])


def _places(task: pa.Array, shard: pa.Array, keys: pa.Array, copies: pa.Array, seeds: pa.Array, prints: pa.Array, offsets: pa.Array, lengths: pa.Array) -> pa.Array:
    """Where each document of a shard lies in its payload, by the shard's index."""
    found, ends = [], [0]
    for i in range(len(task)):
        row = {"seeds": seeds[i].as_py(), "prints": prints[i].as_py(), "offsets": offsets[i].as_py(), "lengths": lengths[i].as_py()}
        own, numbers = np.frombuffer(keys[i].as_py(), np.int64), np.frombuffer(copies[i].as_py(), np.uint32)
        hit, at, many = _lookup(row, own, numbers)
        if len(hit) != len(own):
            raise ValueError(f"shard {task[i]}-{shard[i]}: {len(own) - len(hit)} of its keys are not in its index")
        found.append(np.stack((own, numbers.astype(np.int64), at, many)))
        ends.append(ends[-1] + len(own))
    columns = np.concatenate(found, 1) if found else np.zeros((4, 0), np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(c) for c in columns], fields=list(PLACE)))


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, copy, start, n_tokens and ids_crc32 of every document, looked up and read in the written shards.

    Only the indexes go through Python; payloads are neither shuffled nor handed over. What is broadcast is one row of
    three numbers a shard.
    """
    shards = spark.read.parquet(path)
    rows = shards.join(F.broadcast(_starts(shards)), ["task", "shard"])
    places = F.arrow_udf(_places, "array<struct<doc_id: long, copy: long, at: long, n: long>>")
    rows = rows.select("base", "payload", places("task", "shard", "keys", "copies", "seeds", "prints", "offsets", "lengths").alias("places"))

    def digest(payload: Column, x: Column) -> Column:
        ids = F.substring(payload, (4 * x["at"] + 1).cast("int"), (4 * x["n"]).cast("int"))
        return F.struct(x["doc_id"].alias("doc_id"), x["copy"].alias("copy"), (x["at"] + F.col("base")).alias("start"),
                        x["n"].alias("n_tokens"), F.crc32(ids).alias("ids_crc32"))
    # As the one entry of an array the payload is taken out of its row once, not once for each document.
    digests = F.transform(F.array("payload"), lambda p: F.transform("places", lambda x: digest(p, x)))
    out = rows.select(F.explode(F.flatten(digests)).alias("x")).select("x.*")
    return out.withColumn("doc_id", real_id())


def read_documents(spark: SparkSession, path: str, keys: list[int]) -> DataFrame:
    """doc_id, copy and ids of the given documents; a list is for a few keys. Shards outside their range are not read."""
    wanted = np.array(sorted(set(keys)), np.int64)
    shards = spark.read.parquet(path)
    if len(wanted):
        shards = shards.where((F.col("last_key") >= int(wanted[0])) & (F.col("first_key") <= int(wanted[-1])))
    else:
        shards = shards.where(F.lit(False))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                near = wanted[(wanted >= row["first_key"]) & (wanted <= row["last_key"])]
                ids = np.frombuffer(row["payload"], "<u4")
                for copy in np.unique(np.frombuffer(row["copies"], np.uint32)).tolist() if len(near) else ():
                    hit, at, many = _lookup(row, near, np.full(len(near), copy, np.uint32))
                    yield pa.RecordBatch.from_arrays([pa.array(near[hit]), pa.array([copy] * len(hit), pa.int64()), pa.array(
                        [ids[a:a + n].astype(np.int64) for a, n in zip(at, many, strict=True)], pa.list_(pa.int64()))], names=["doc_id", "copy", "ids"])
    return shards.mapInArrow(fetch, "doc_id long, copy long, ids array<long>")
