"""Katz backoff scores: Good-Turing discounted counts of words and word pairs with exactly normalised backoff weights.

Texts become chunks of word numbers in a written table, bucketed by chunk. Whatever a chunk needs from the corpus it
asks for by sorted lists of 64-bit keys, one list per key range; a range adds up what all chunks sent and
answers each list in its own order. So a key that a third of all texts hold travels once per chunk, and no task
holds more than a chunk or a key range:

1. chunks send training counts of words and pairs; ranges store the counts and answer with the sums;
2. chunks turn sums into probabilities. Every pair has one owner among its chunks, who adds the pair's discounted mass and its
   second word's probability to the first word's sums; ranges store the backoff weights and answer with them;
3. chunks finish the scores of their texts.

A token's probability is looked up recursively: pair, else backoff weight times word, else backoff weight times the share
of unknown words. An end token closes each text, and the first token's context is the text's beginning.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachgrid.llm.words import blocks, id_and_text, mixed, pack, pack_plain, real_id, runs, shuffle_partitions, text_ids, unpack, unpack_plain, words_of
from reachgrid.session import checkpoint_folder

CHUNK_TOKENS = 1_500_000
#: Counts up to this are discounted.
DISCOUNTED = 5
BEGIN, END = np.uint64(0xB5297A4D3F84D5B5), np.uint64(0x68E31DA4E1A2C3B7)
WORD, PAIR = 0, 1


def held_out(doc_id: Column) -> Column:
    """Documents that the model does not learn from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(7)) == 2, F.lit(False))


# -- chunks ------------------------------------------------------------------------------------------------

CHUNK = pa.schema([("chunk", pa.int64()), ("docs", pa.binary()), ("held", pa.binary()), ("starts", pa.binary()), ("codes", pa.binary()), ("words", pa.binary())])
CHUNK_NAMES = "chunk long, docs binary, held binary, starts binary, codes binary, words binary"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, number = TaskContext.get().partitionId(), 0
    held: list[tuple] = []

    def out() -> pa.RecordBatch:
        vocabulary = np.sort(np.concatenate([h[4] for h in held]))
        vocabulary = vocabulary[runs(vocabulary)[0]]
        codes = np.concatenate([np.searchsorted(vocabulary, h[4]).astype(np.uint32)[h[3]] for h in held])
        sizes = np.concatenate([h[2] for h in held])
        values = ((task << 32) + number, pack_plain(np.concatenate([h[0] for h in held])), np.concatenate([h[1] for h in held]).tobytes(),
                  pack(np.concatenate(([0], np.cumsum(sizes)))), pack_plain(codes), pack(vocabulary))
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, CHUNK, strict=True)], schema=CHUNK)
    n = 0
    for block in blocks(batches):
        words = words_of(block.column("text"), lower=True)
        hashes = np.append(words.hashes(), END)
        codes = np.insert(words.codes.astype(np.int64), words.starts[1:], len(hashes) - 1)
        held.append((block.column("doc_id").to_numpy(), block.column("held").to_numpy(zero_copy_only=False), np.diff(words.starts) + 1, codes, hashes))
        n += len(codes)
        if n >= CHUNK_TOKENS:
            yield out()
            held.clear()
            number, n = number + 1, 0
    if held:
        yield out()


@dataclass
class Chunk:
    """A decoded chunk; position i holds word ``codes[i]`` after context ``before[i]`` (the vocabulary's size: the beginning)."""

    docs: np.ndarray
    held: np.ndarray
    starts: np.ndarray
    codes: np.ndarray
    words: np.ndarray

    def __init__(self, row: dict):
        self.docs, self.held = unpack_plain(row["docs"], "i8"), np.frombuffer(row["held"], bool)
        self.starts, self.words = unpack(row["starts"], "i8"), unpack(row["words"], "u8")
        self.codes = unpack_plain(row["codes"], "u4").astype(np.int64)
        self.before = np.concatenate(([0], self.codes[:-1]))
        self.before[self.starts[:-1]] = len(self.words)
        self.text = text_ids(self.starts)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs in the order of their keys, the keys, and the pair of each position."""
        base = len(self.words) + 1
        code = self.before * base + self.codes
        order = np.argsort(code, kind="stable")
        first, count = runs(code[order])
        pair = code[order[first]]
        hashes = np.append(self.words, BEGIN)
        key = mixed(mixed(hashes[pair // base]) + hashes[pair % base])
        by_key = np.argsort(key, kind="stable")
        rank = np.empty(len(pair), np.int64)
        rank[by_key] = np.arange(len(pair))
        at = np.empty(len(code), np.int64)
        at[order] = np.repeat(rank, count)
        return pair[by_key], key[by_key], at


# -- exchange ----------------------------------------------------------------------------------------------

ASK = pa.schema([("range", pa.int64()), ("chunk", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("sums", pa.binary())])
ASK_NAMES = "range long, chunk long, keys binary, counts binary, sums binary"


def _cuts(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Where each key range begins in sorted keys, and the end."""
    return np.append(np.searchsorted(keys, np.array([(i << 64) // ranges for i in range(ranges)], np.uint64)), len(keys))


def _each(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows one at a time, for rows of many megabytes."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def _asked(ranges: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _each(batch):
                chunk = Chunk(row)
                train = ~chunk.held[chunk.text]
                _, keys, at = chunk.pairs()
                for kind, k, n in ((WORD, chunk.words, np.bincount(chunk.codes[train], minlength=len(chunk.words))), (PAIR, keys, np.bincount(at[train], minlength=len(keys)))):
                    cuts = _cuts(k, ranges)
                    for i in np.flatnonzero(np.diff(cuts)):
                        part = slice(cuts[i], cuts[i + 1])
                        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(
                            (kind * ranges + i, row["chunk"], pack(k[part]), pack_plain(n[part].astype(np.uint32)), None), ASK, strict=True)], schema=ASK)
    return ask


COUNTED = "part string, kind long, range long, chunk long, keys binary, counts binary, owned binary, stats array<long>"


def _counted(ranges: int):
    """Sums of one key range: the stored table, an answer per chunk and the counts of counts."""
    def count(key: tuple, parts: pa.Table) -> pa.Table:
        where = key[0].as_py()
        kind = where // ranges
        rows = parts.sort_by("chunk").to_pylist()
        keys = [unpack(r["keys"], "u8") for r in rows]
        sizes = [len(k) for k in keys]
        keys, counts = np.concatenate(keys), np.concatenate([unpack_plain(r["counts"], "u4") for r in rows])
        order = np.argsort(keys, kind="stable")
        first, length = runs(keys[order])
        total = np.add.reduceat(counts[order].astype(np.int64), first)
        sums = np.empty(len(keys), np.int64)
        sums[order] = np.repeat(total, length)
        owned = np.zeros(len(keys), bool)
        owned[order[first]] = True
        out, at = [], 0
        for r, n in zip(rows, sizes, strict=True):
            out.append(("answer", kind, where % ranges, r["chunk"], None, pack_plain(sums[at:at + n]), np.packbits(owned[at:at + n]).tobytes(), None))
            at += n
        seen = total > 0
        stats = [int((total == r).sum()) for r in range(1, DISCOUNTED + 2)] + [int(total.sum()), int(seen.sum())]
        out.append(("counts", kind, where % ranges, None, pack(keys[order][first][seen]), pack_plain(total[seen].astype(np.uint32)), None, stats))
        types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
        names = ("part", "kind", "range", "chunk", "keys", "counts", "owned", "stats")
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=list(names))
    return count


# -- probabilities -----------------------------------------------------------------------------------------


def discounts(n: list[int]) -> np.ndarray:
    """Good-Turing factors for counts 0 to DISCOUNTED + 1, from the counts of counts; all higher counts have the last, 1.

    Where the counts of counts give none between 0 and 1, half an occurrence is taken off.
    """
    out = np.ones(DISCOUNTED + 2)
    top = (DISCOUNTED + 1) * n[DISCOUNTED] / n[0] if n[0] else 0.0
    for r in range(1, DISCOUNTED + 1):
        d = ((r + 1) * n[r] / (n[r - 1] * r) - top) / (1 - top) if n[r - 1] and top != 1 else -1.0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


@dataclass
class Constants:
    """What the whole corpus has in one number each."""

    words: np.ndarray
    pairs: np.ndarray
    total: int
    types: int
    texts: int
    unknown: float
    scale: float

    @staticmethod
    def of(word_stats: list[int], pair_stats: list[int], texts: int) -> Constants:
        words, pairs = discounts(word_stats), discounts(pair_stats)
        total, types = word_stats[-2], word_stats[-1]
        freed = sum((1 - words[r]) * r * word_stats[r - 1] for r in range(1, DISCOUNTED + 1))
        # Without discounted words one occurrence is added for the unknown ones.
        scale = 1.0 if freed > 0 else total / (total + 1.0)
        return Constants(words, pairs, total, types, texts, freed / total if freed > 0 else 1.0 / (total + 1.0), scale)

    def word(self, c: np.ndarray) -> np.ndarray:
        """Probability of words with count c; count 0: of all unknown words together."""
        known = self.scale * self.words[np.minimum(c, DISCOUNTED + 1)] * c / max(self.total, 1)
        return np.where(c > 0, known, self.unknown)


STATE = pa.schema([("kind", pa.string()), ("range", pa.int64()), ("chunk", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("sums", pa.binary()), ("wanted", pa.binary())])
STATE_NAMES = "kind string, range long, chunk long, keys binary, counts binary, sums binary, wanted binary"


def _packed(*arrays: np.ndarray) -> bytes:
    """Several arrays in one value."""
    out = [pack_plain(a) for a in arrays]
    return b"".join(len(x).to_bytes(4, "little") + x for x in out)


def _unpacked(data: bytes, *kinds: str) -> list[np.ndarray]:
    out, at = [], 0
    for kind in kinds:
        size = int.from_bytes(data[at:at + 4], "little")
        out.append(unpack_plain(data[at + 4:at + 4 + size], kind))
        at += 4 + size
    return out


def _scored(ranges: int, known: Constants):
    """Second look at a chunk: what is known of each text's score, and what the contexts still have to say."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _each(batch):
                chunk = Chunk(row)
                number, answers = row["chunk"], sorted(row["answers"], key=lambda a: (a["kind"], a["range"]))
                got: tuple[list, list] = ([], [])
                owned, base = [], len(chunk.words) + 1
                for a in answers:
                    got[a["kind"]].append(unpack_plain(a["counts"], "i8"))
                    if a["kind"] == PAIR:
                        owned.append(np.unpackbits(np.frombuffer(a["owned"], np.uint8), count=len(got[PAIR][-1])).astype(bool))
                words, pairs = map(np.concatenate, got)
                owned = np.concatenate(owned) & (pairs > 0)
                del row, answers, got
                pair, _, at = chunk.pairs()
                # Training occurrences of each context; the beginning has one per text.
                context = np.append(words, known.texts)
                context[np.searchsorted(chunk.words, END)] = 0
                word = known.word(words)
                own, follow = pair[owned] // base, pair[owned] % base
                mass = (1 - known.pairs[np.minimum(pairs[owned], DISCOUNTED + 1)]) * pairs[owned]
                freed, below = np.bincount(own, mass, base), np.bincount(own, word[follow], base)
                owner = np.bincount(own, minlength=base) > 0
                # A context with a discounted pair has mass to give away. Of others this is not known yet.
                gives = np.bincount(pair[(pairs > 0) & (pairs <= DISCOUNTED)] // base, minlength=base) > 0
                seen = pairs[at] > 0
                base_score = np.log10((words[chunk.codes] + 1.0) / (known.total + known.types + 1.0))
                with np.errstate(divide="ignore"):
                    direct = np.log10(known.pairs[np.minimum(pairs, DISCOUNTED + 1)] * pairs / np.maximum(context[pair // base], 1))
                score = np.where(seen, direct[at], np.log10(word)[chunk.codes])
                back, unsure = ~seen & (context[chunk.before] > 0), seen & ~gives[chunk.before]
                texts = len(chunk.docs)
                wanted = np.zeros(base, bool)
                wanted[chunk.before[back | unsure]] = True
                some = np.flatnonzero(wanted | owner)
                hashes = mixed(np.append(chunk.words, BEGIN))
                some = some[np.argsort(hashes[some], kind="stable")]
                cuts = _cuts(hashes[some], ranges)
                place = np.full(base, -1)
                asked = some[wanted[some]]
                place[asked] = np.arange(len(asked))
                later = []
                for which in (back, unsure):
                    code = np.sort(chunk.text[which] * len(asked) + place[chunk.before[which]]) if which.any() else np.zeros(0, np.int64)
                    first, count = runs(code)
                    later += [code[first] // max(len(asked), 1), code[first] % max(len(asked), 1), count]
                state = _packed(chunk.docs, chunk.held, np.diff(chunk.starts), np.bincount(chunk.text, words[chunk.codes] > 0, texts).astype(np.int64),
                                np.bincount(chunk.text, base_score, texts), np.bincount(chunk.text, score, texts), *(x.astype(np.uint32) for x in later))
                yield _row(STATE, "state", None, number, None, None, state, None)
                for i in np.flatnonzero(np.diff(cuts)):
                    part = some[cuts[i]:cuts[i + 1]]
                    yield _row(STATE, "ask", i, number, pack(hashes[part]), pack_plain(context[part]), _packed(freed[part], below[part]), np.packbits(wanted[part]).tobytes())
    return score


def _row(schema: pa.Schema, *values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)


BACKED = "part string, range long, chunk long, keys binary, alpha binary, scale binary"


def _backed(key: tuple, parts: pa.Table) -> pa.Table:
    """Backoff weights of one range of contexts: what seen pairs leave over what their second words leave."""
    rows = parts.sort_by("chunk").to_pylist()
    keys, counts = [unpack(r["keys"], "u8") for r in rows], np.concatenate([unpack_plain(r["counts"], "i8") for r in rows])
    sums = [_unpacked(r["sums"], "f8", "f8") for r in rows]
    sizes = [len(k) for k in keys]
    keys, freed, below = np.concatenate(keys), np.concatenate([s[0] for s in sums]), np.concatenate([s[1] for s in sums])
    order = np.argsort(keys, kind="stable")
    first, length = runs(keys[order])
    freed, below = np.add.reduceat(freed[order], first), np.add.reduceat(below[order], first)
    count = np.maximum(counts[order][first], 1)
    # A context whose pairs are all frequent gives nothing away; then one occurrence is added for what was not seen.
    scale = np.where(freed > 0, 1.0, count / (count + 1.0))
    left = np.where(freed > 0, freed / count, 1.0 / (count + 1.0))
    alpha = np.where(counts[order][first] > 0, left / np.maximum(1.0 - below, 1e-12), 1.0)
    out = [("weights", key[0].as_py(), None, pack(keys[order][first]), pack_plain(alpha), pack_plain(scale))]
    of = np.empty(len(keys), np.int64)
    of[order] = np.repeat(np.arange(len(first)), length)
    at = 0
    for r, n in zip(rows, sizes, strict=True):
        mine = of[at:at + n][np.unpackbits(np.frombuffer(r["wanted"], np.uint8), count=n).astype(bool)]
        out.append(("answer", key[0].as_py(), r["chunk"], None, pack_plain(alpha[mine]), pack_plain(scale[mine])))
        at += n
    types = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["part", "range", "chunk", "keys", "alpha", "scale"])


def _finished(known: Constants):
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                docs, held, tokens, n_known, base, score, *later = _unpacked(row["sums"], "i8", "?", "i8", "i8", "f8", "f8", *["u4"] * 6)
                answers = sorted(row["answers"] or (), key=lambda a: a["range"])
                for (text, place, count), name in ((later[:3], "alpha"), (later[3:], "scale")):
                    if len(text):
                        value = np.log10(np.concatenate([unpack_plain(a[name], "f8") for a in answers]))
                        score = score + np.bincount(text, value[place] * count, len(docs))
                yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(held), pa.array(tokens), pa.array(n_known), pa.array(np.full(len(docs), known.total)),
                                                  pa.array(base), pa.array(score)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    return finish


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    The model learns from the rows that ``held_out`` leaves. Scores are log10 probabilities of the whole text with its
    end token; ``base_score`` is the add-one word model over the same vocabulary and one unknown word. NULL
    and empty texts are an end token. Rows that repeat count and are returned each; a NULL doc_id
    is never held out. Other columns are ignored. Tables of counts and backoff weights stay in the checkpoint folder.
    """
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    ranges = 2 * n
    folder = f"{checkpoint_folder(spark)}/{uuid.uuid4().hex}"
    source = id_and_text(docs).select("doc_id", "text", held_out(real_id()).alias("held"))
    texts = int(source.where("not held").count())
    table = f"katz_{uuid.uuid4().hex}"
    source.mapInArrow(_chunks, CHUNK_NAMES).write.bucketBy(n, "chunk").option("path", f"{folder}/chunks").saveAsTable(table)
    chunks = spark.table(table)
    counted = chunks.mapInArrow(_asked(ranges), ASK_NAMES).groupBy("range").applyInArrow(_counted(ranges), COUNTED)
    counted.write.partitionBy("part").parquet(f"{folder}/counts")
    counts = spark.read.schema(counted.schema).parquet(f"{folder}/counts")
    stats = {r["kind"]: r["s"] for r in counts.where("part = 'counts'").groupBy("kind").agg(F.array(*[F.sum(F.col("stats")[i]) for i in range(DISCOUNTED + 3)]).alias("s")).collect()}
    none = [0] * (DISCOUNTED + 3)
    known = Constants.of(stats.get(WORD, none), stats.get(PAIR, none), texts) if stats.get(WORD, none)[-1] else Constants(
        np.ones(DISCOUNTED + 2), np.ones(DISCOUNTED + 2), 0, 0, texts, 1.0, 1.0)
    answers = counts.where("part = 'answer'").groupBy("chunk").agg(F.collect_list(F.struct("kind", "range", "counts", "owned")).alias("answers"))
    states = chunks.join(answers, "chunk").mapInArrow(_scored(ranges, known), STATE_NAMES)
    states.write.partitionBy("kind").parquet(f"{folder}/states")
    states = spark.read.schema(states.schema).parquet(f"{folder}/states")
    asked = states.where("kind = 'ask'").drop("kind")
    backed = asked.groupBy("range").applyInArrow(_backed, BACKED)
    backed.write.partitionBy("part").parquet(f"{folder}/weights")
    backed = spark.read.schema(backed.schema).parquet(f"{folder}/weights")
    answers = backed.where("part = 'answer'").groupBy("chunk").agg(F.collect_list(F.struct("range", "alpha", "scale")).alias("answers"))
    out = states.where("kind = 'state'").select("chunk", "sums").join(answers, "chunk", "left").mapInArrow(
        _finished(known), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumn("doc_id", real_id())
