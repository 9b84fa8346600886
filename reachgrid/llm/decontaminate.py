"""Benchmark decontamination by latent semantic retrieval.

Every text is a row of passages of ``2 * HALF`` words that overlap by half. Passages are TF-IDF vectors over
the benchmark's terms, with document frequencies counted over all passages. A randomised SVD of all passages
stacked with the benchmark's items, whose weight is that of the whole corpus, gives the latent space:
each round multiplies a narrow matrix with the term-by-term product, summed over all partitions. The space has
room for every item of a run and always holds them whole. Passages and items are compared by cosine there; what
a passage says outside the benchmark's terms only lengthens it.

Candidates are then read word by word: the longest common subsequence with the item inside a stretch of
about the item's length, the share of the item's rare words that stand there, and for paraphrases, which
keep less of the order, whether the item's answer (its last words) is there in full.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachgrid.llm.words import blocks, id_and_text, real_id, runs, words_of
from reachgrid.session import checkpoint_folder

HALF = 64
#: Words of an item that are matched at once; longer items are cut, and each part is looked for.
PART = HALF
#: Items that one run holds on every executor; a longer benchmark is worked off in blocks of so many.
ITEMS = 1000
RANK = 256
#: Directions of the latent space beside those of the parts; a block has at most RANK - SPARE parts.
SPARE = 32
#: Terms in more than this share of the passages carry no weight, but for the rarest KEPT of each item.
COMMON = 0.02
KEPT = 3
SEED = 20_26
LEAST_COSINE = 0.08
LEAST_ORDER, LEAST_RARE = 0.6, 0.5
#: Words that must stand in order whatever the shares are; shorter items must be there in full.
LEAST_MATCHED = 8
#: Items of fewer words say nothing and are not looked for.
LEAST_WORDS = 6
PARAPHRASE_ORDER, LEAST_ANSWER = 0.4, 0.9
TERM_BLOCK = 64


@dataclass
class Benchmark:
    """Parts of items as term numbers."""

    terms: pa.Array
    parts: list[np.ndarray]
    item: list[int]
    answer: list[np.ndarray]
    #: Term of each code of the coded texts, -1 at the end, and how codes are stored.
    place: np.ndarray | None = None
    kind: str = ""
    weight: np.ndarray | None = None
    #: Squared weight of a word outside the benchmark's terms.
    outside: float = 0.0
    space: np.ndarray | None = None
    latent: np.ndarray | None = None
    length: np.ndarray | None = None


def _cut(text: str | None) -> Iterator[str]:
    """Words of an item in parts of at most PART; none if it is too short to be looked for."""
    words = words_of(pa.array([text or ""], pa.string()), lower=True)
    if len(words.codes) >= LEAST_WORDS:
        for p in np.array_split(words.codes, -(-len(words.codes) // PART)):
            yield " ".join(words.vocabulary.take(pa.array(p)).to_pylist())


def _parts(block: list[tuple[int, str]]) -> Benchmark:
    words = words_of(pa.array([text for _, text in block], pa.string()))
    coded = words.codes.astype(np.int64)
    parts = [coded[a:b] for a, b in zip(words.starts[:-1], words.starts[1:], strict=True)]
    return Benchmark(words.vocabulary, parts, [i for i, _ in block], [p[-max(3, len(p) // 5):] for p in parts])


def _benchmarks(rows: Iterable, items: int, parts: int) -> Iterator[Benchmark]:
    """Blocks of at most ``items`` items and ``parts`` parts; an item of more parts goes on in the next block."""
    block, held, last = [], 0, None
    for at, r in enumerate(rows):
        for text in _cut(r["text"]):
            if len(block) == parts or (held == items and at != last):
                yield _parts(block)
                block, held, last = [], 0, None
            if at != last:
                held, last = held + 1, at
            block.append((r["item_id"], text))
    if block:
        yield _parts(block)


@dataclass
class Tokens:
    """Benchmark term (or -1) and half passage of each word of some texts."""

    term: np.ndarray
    half: np.ndarray
    starts: np.ndarray
    text_of: np.ndarray

    def entries(self, weight: np.ndarray | None, terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Half, term and count of what is in each half passage, by half and term; only weighted terms if weights are given."""
        at = self.term >= 0
        if weight is not None:
            at &= weight[self.term] > 0
        key = np.sort(self.half[at] * terms + self.term[at])
        first, count = runs(key)
        return key[first] // terms, key[first] % terms, count


def _vocabulary(rows: Iterable) -> pa.Array:
    """Words of all items."""
    return words_of(pa.array([r["text"] or "" for r in rows], pa.string()), lower=True).vocabulary


def _width(vocabulary: pa.Array) -> str:
    return "<i2" if len(vocabulary) < 1 << 15 else "<i4"


def _coded(docs: DataFrame, vocabulary: pa.Array) -> DataFrame:
    """doc_id, _key and code: the number in ``vocabulary`` (or -1) of each word of a text, a few bytes a word.

    Texts are taken apart once, whatever the number of blocks and passes.
    """
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = np.dtype(_width(vocabulary))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            words = words_of(block.column("text"), lower=True)
            place = pc.index_in(words.vocabulary, held.value).fill_null(-1).to_numpy(zero_copy_only=False).astype(kind)
            offsets = pa.array(words.starts * kind.itemsize, pa.int32())
            codes = pa.Array.from_buffers(pa.binary(), block.num_rows, [None, offsets.buffers()[1], pa.py_buffer(place[words.codes].tobytes())])
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), block.column("_key"), codes], names=["doc_id", "_key", "code"])
    names = "doc_id long, _key long, code binary"
    path = f"{checkpoint_folder(docs.sparkSession)}/{uuid.uuid4().hex}"
    docs.select("doc_id", "_key", "text").mapInArrow(code, names).write.parquet(path)
    held.destroy()  # what needed it is written
    return docs.sparkSession.read.schema(names).parquet(path)


def _tokens(codes: pa.Array, place: np.ndarray, kind: str) -> Tokens:
    """Words of coded texts; ``place`` holds the benchmark term of each code, and -1 at its end for code -1."""
    width = np.dtype(kind).itemsize
    size = pc.binary_length(codes).to_numpy(zero_copy_only=False).astype(np.int64) // width
    starts = np.concatenate(([0], np.cumsum(size)))
    if not starts[-1]:
        none = np.zeros(0, np.int64)
        return Tokens(none, none, starts, none)
    _, offsets, data = codes.buffers()
    first = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(codes.type) else np.int32)[codes.offset]
    term = place[np.frombuffer(data, kind, count=starts[-1], offset=first)]
    halves = -(-size // HALF)
    before = np.concatenate(([0], np.cumsum(halves)))
    within = np.arange(len(term)) - np.repeat(starts[:-1], size)
    return Tokens(term, np.repeat(before[:-1], size) + within // HALF, starts, np.repeat(np.arange(len(size)), halves))


def _blocks(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """Coded texts in pieces of about a million words."""
    return blocks(batches, "code", np.dtype(kind).itemsize << 20)


def _frequencies(docs: DataFrame, bench: Benchmark) -> tuple[np.ndarray, int]:
    """Half passages of all texts that hold each term, and their number."""
    n, kind = len(bench.terms), bench.kind
    place = docs.sparkSession.sparkContext.broadcast(bench.place)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, halves = np.zeros(n, np.int64), 0
        for block in _blocks(batches, kind):
            tokens = _tokens(block.column("code"), place.value, kind)
            found += np.bincount(tokens.entries(None, n)[1], minlength=n)
            halves += len(tokens.text_of)
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(found[at], halves), pa.int64())], names=["term", "n"])
    rows = docs.select("code").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # a row per benchmark term
    place.destroy()
    out = {r["term"]: r["n"] for r in rows}
    return np.array([out.get(i, 0) for i in range(n)], np.int64), out.get(-1, 0)


def _weigh(bench: Benchmark, found: np.ndarray, halves: int) -> None:
    idf = np.log((halves + 1.0) / (found + 1.0)) + 1e-3
    weight = np.where(found > COMMON * halves, 0.0, idf)
    for p in bench.parts:
        rare = np.unique(p)
        rare = rare[np.argsort(found[rare], kind="stable")[:KEPT]]
        weight[rare] = idf[rare]
    bench.weight = weight
    bench.outside = float(0.25 * weight.max() ** 2)


def _sums(key: np.ndarray, value: np.ndarray, of: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct of the sorted ``key``, and for each the sum of its entries' value times row ``of`` of ``rows``.

    A key is one vector by a small matrix; its entries' rows are never written out for all keys at once.
    """
    first, count = runs(key)
    out = np.empty((len(first), rows.shape[1]), rows.dtype)
    for i, (a, n) in enumerate(zip(first.tolist(), count.tolist(), strict=True)):
        np.dot(value[a:a + n], rows[of[a:a + n]], out=out[i])
    return key[first], out


def _rows(entries, weight: np.ndarray, space: np.ndarray, size: int = 20_000):
    """Half passages' vectors times ``space``, some at a time: halves, values, and the entries' half index, term and weight."""
    half, term, count = entries
    first, length = runs(half)
    start = 0
    while start < len(first):
        stop = max(start + 1, int(np.searchsorted(first, first[start] + size)))
        a, b = first[start], first[stop] if stop < len(first) else len(half)
        value = (count[a:b] * weight[term[a:b]]).astype(np.float32)
        yield *_sums(half[a:b], value, term[a:b], space), np.repeat(np.arange(stop - start), length[start:stop]), term[a:b], value
        start = stop


def _product(docs: DataFrame, bench: Benchmark, narrow: np.ndarray) -> np.ndarray:
    """Term-by-term product of all half passages times a narrow matrix, summed over partitions."""
    (n, k), kind = narrow.shape, bench.kind
    held = docs.sparkSession.sparkContext.broadcast((bench.place, bench.weight, narrow.astype(np.float32)))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, weight, space = held.value
        total = np.zeros((n, k), np.float32)
        for block in _blocks(batches, kind):
            for _, rows, at, term, value in _rows(_tokens(block.column("code"), place, kind).entries(weight, n), weight, space):
                order = np.argsort(term, kind="stable")
                terms, sums = _sums(term[order], value[order], at[order], rows)
                total[terms] += sums
        some = [i for i in range(0, n, TERM_BLOCK) if total[i:i + TERM_BLOCK].any()]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([total[i:i + TERM_BLOCK].tobytes() for i in some], pa.binary())], names=["first", "data"])

    def add(key: tuple, parts: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.float32).astype(np.float64) for x in parts.column("data"))
        return pa.table({"first": pa.array([key[0].as_py()], pa.int64()), "data": pa.array([total.tobytes()], pa.binary())})
    out = np.zeros((n, k))
    sums = docs.select("code").mapInArrow(multiply, "first long, data binary").groupBy("first").applyInArrow(add, "first long, data binary")
    for r in sums.toLocalIterator():  # benchmark terms x rank, whatever the corpus
        out[r["first"]:r["first"] + TERM_BLOCK] = np.frombuffer(bytes(r["data"]), np.float64).reshape(-1, k)
    held.destroy()
    return out


def _items(bench: Benchmark) -> np.ndarray:
    """Unit TF-IDF rows of the item parts."""
    rows = np.zeros((len(bench.parts), len(bench.terms)))
    for i, p in enumerate(bench.parts):
        np.add.at(rows[i], p, bench.weight[p])
    bench.length = np.linalg.norm(rows, axis=1)
    return rows / np.maximum(bench.length, 1e-12)[:, None]


def fit(docs: DataFrame, bench: Benchmark, *, rank: int = RANK, seed: int = SEED) -> None:
    """Weights and latent space of a benchmark over all passages of ``docs`` (code)."""
    found, halves = _frequencies(docs, bench)
    _weigh(bench, found, halves)
    items = _items(bench)
    n = len(bench.terms)
    k = min(max(rank, len(items)), n, len(items) + SPARE)
    share = float((found * bench.weight ** 2).sum()) / len(items)
    narrow = np.random.default_rng(seed).standard_normal((n, k))
    for first in (True, False):  # a range finder and one power round; the items' own directions are held in the space
        basis = np.linalg.qr(narrow if first else np.hstack((items.T, narrow)))[0][:, :k]
        narrow = _product(docs, bench, basis) + share * (items.T @ (items @ basis))
    small = basis.T @ narrow
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    bench.space = (basis @ vectors[:, ::-1][:, :k]).astype(np.float32)
    bench.latent = (items @ bench.space).astype(np.float32)


def _order_share(part: np.ndarray, masks: dict[int, int], words: np.ndarray) -> int:
    """Length of the longest common subsequence, one bit per word of the part."""
    full = (1 << len(part)) - 1
    s = full
    for w in words.tolist():
        m = masks.get(w)
        if m:
            u = s & m
            s = ((s + u) | (s - u)) & full
    return len(part) - s.bit_count()


def _masks(part: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(part.tolist()):
        out[w] = out.get(w, 0) | 1 << i
    return out


class _Reader:
    """Word-by-word comparison of one passage with one item part."""

    def __init__(self, bench: Benchmark):
        self.bench = bench
        self.masks = [_masks(p) for p in bench.parts]
        self.answers = [(a, _masks(a)) for a in bench.answer]
        self.mass = [(np.unique(p), bench.weight[np.unique(p)]) for p in bench.parts]

    def compare(self, i: int, words: np.ndarray) -> tuple[float, float, bool]:
        """Best share of the part in order inside a stretch of its length, answer's share there, and whether that is a match."""
        part = self.bench.parts[i]
        stretch = len(part) + len(part) // 2 + 8
        terms, mass = self.mass[i]
        best = (0.0, 0.0, False)
        for at in range(0, max(1, len(words) - stretch + len(part) // 2 + 1), max(1, len(part) // 2)):
            piece = words[at:at + stretch]
            matched = _order_share(part, self.masks[i], piece)
            order = matched / len(part)
            if order < PARAPHRASE_ORDER or order < best[0] or matched < min(len(part), LEAST_MATCHED):
                continue
            answer, masks = self.answers[i]
            said = _order_share(answer, masks, piece) / len(answer)
            rare = mass[np.isin(terms, piece)].sum() / max(mass.sum(), 1e-12)
            hit = rare >= LEAST_RARE and (order >= LEAST_ORDER or said >= LEAST_ANSWER)
            best = max(best, (order, said, bool(hit)), key=lambda x: (x[2], x[0]))
        return best


def _search(held):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench: Benchmark = held.value
        reader, n = _Reader(bench), len(bench.terms)
        for block in _blocks(batches, bench.kind):
            tokens = _tokens(block.column("code"), bench.place, bench.kind)
            halves = len(tokens.text_of)
            if not halves:
                continue
            entries = tokens.entries(bench.weight, n)
            squares = np.zeros(halves)
            np.add.at(squares, entries[0], (entries[2] * bench.weight[entries[1]]) ** 2)
            squares += bench.outside * np.bincount(tokens.half[(tokens.term < 0)], minlength=halves)
            latent = np.zeros((halves, bench.space.shape[1]), np.float32)
            for half, rows, *_ in _rows(entries, bench.weight, bench.space):
                latent[half] = rows
            # A passage is a half and the next one of the same text.
            pair = np.concatenate((tokens.text_of[1:] == tokens.text_of[:-1], [False]))
            latent[pair] += latent[1:][pair[:-1]]
            squares[pair] += squares[1:][pair[:-1]]
            live = np.flatnonzero(latent.any(1))
            out = []
            first_word = np.searchsorted(tokens.half, np.arange(halves + 1))
            for some in np.array_split(live, max(1, len(live) // 4096)):
                cosine = (latent[some] @ bench.latent.T) / np.sqrt(np.maximum(squares[some], 1e-12))[:, None]
                for a, i in zip(*np.nonzero(cosine >= LEAST_COSINE), strict=True):
                    h = some[a]
                    order, said, hit = reader.compare(i, tokens.term[first_word[h]:first_word[h + 1 + pair[h]]])
                    if hit:
                        out.append((int(tokens.text_of[h]), bench.item[i], float(cosine[a, i]), order, said))
            ids, keys = block.column("doc_id").to_pylist(), block.column("_key").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in (
                ([ids[r[0]] for r in out], pa.int64()), ([keys[r[0]] for r in out], pa.int64()), *(([r[j] for r in out], t) for j, t in (
                    (1, pa.int64()), (2, pa.float64()), (3, pa.float64()), (4, pa.float64()))))], names=["doc_id", "_key", "item_id", "cosine", "order_share", "answer_share"])
    return search


NAMES = "doc_id long, _key long, item_id long, cosine double, order_share double, answer_share double"


def leaks(docs: DataFrame, benchmark: DataFrame, *, items: int = ITEMS, rank: int = RANK) -> DataFrame:
    """doc_id, item_id, cosine, order_share, answer_share and _key: one row per document and benchmark item found in it.

    NULL or empty texts hold nothing, items of fewer than LEAST_WORDS words are found nowhere, and an empty benchmark gives no
    rows. Rows that repeat are one pair; a NULL doc_id comes back NULL. Other columns are ignored. The
    benchmark is worked off in blocks by item_id, against all documents each time: of ``items`` items, or fewer
    if their parts are more than the latent space of ``rank`` has room for.
    """
    source = id_and_text(docs)
    spark = docs.sparkSession
    asked = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null").orderBy("item_id", "text")
    path = f"{checkpoint_folder(spark)}/{uuid.uuid4().hex}"
    spark.createDataFrame([], NAMES).write.parquet(path)
    rows = (*asked.toLocalIterator(),)
    coded, words = None, _vocabulary(rows)
    for bench in _benchmarks(rows, items, max(1, rank - SPARE)):
        coded = _coded(source, words) if coded is None else coded
        bench.kind, bench.place = _width(words), np.full(len(words) + 1, -1, np.int64)
        bench.place[pc.index_in(bench.terms, words).to_numpy(zero_copy_only=False)] = np.arange(len(bench.terms))
        fit(coded, bench, rank=rank)
        held = spark.sparkContext.broadcast(bench)
        coded.mapInArrow(_search(held), NAMES).write.mode("append").parquet(path)
        held.destroy()  # what needed it is written
    found = spark.read.schema(NAMES).parquet(path)
    best = found.groupBy("doc_id", "_key", "item_id").agg(F.max(F.struct("order_share", "answer_share", "cosine")).alias("x"))
    return best.select(real_id().alias("doc_id"), "item_id", "x.cosine", "x.order_share", "x.answer_share", "_key")


def without_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item is found."""
    bad = leaks(docs, benchmark, **options).select(F.col("doc_id").alias("_llm_bad_id"), F.col("_key").alias("_llm_bad_key")).distinct()
    keyed = docs.withColumn("_llm_key", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    out = keyed.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col("_llm_bad_id")) & (F.col("_llm_key") == F.col("_llm_bad_key")), "left_anti")
    return out.select(*docs.columns)
