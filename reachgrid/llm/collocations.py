"""Phrase collocations from one count of padded longest windows.

Each word of a piece starts one window of three lead columns, padded at the piece's end. Tasks sort and
merge the windows of some texts and deal them by language and first two words to ranges, packed; a range
adds its parts up. Since all windows of a word pair meet in one range, windows that stay below the least
count are folded there into their shorter prefix: nothing above the least count is lost by it, and what is
left is small. Spark's ROLLUP then sums windows over their prefixes, which gives the counts of phrases of
three words, two words and one, and all words of a language, without an explosion of its own for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reachgrid.llm.words import blocks, mixed, pack, pack_plain, runs, shuffle_partitions, unpack, unpack_plain
from reachgrid.session import checkpoint

LEAST_COUNT = 10
#: A phrase is dropped for a longer one that has at least this share of its occurrences, in percent.
COVERED = 50
TOP = 2000
#: Parts of a language that are ranked side by side first.
PARTS = 64
SCALE = 1_000_000
#: Words whose windows a task merges before it deals them, and bytes of text for a range to add up.
CHUNK_WORDS = 1_500_000
RANGE_BYTES = 8 << 20
#: Groups of ranges that first words are dealt to.
GROUPS = 8
#: Windows are sorted as one number where their codes fit below this.
WIDEST = 1 << 63
BREAKS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"
COLUMNS = ("lang", "w1", "w2", "w3")
COUNTED = pa.schema([("lang", pa.string()), ("w1", pa.string()), ("w2", pa.string()), ("w3", pa.string()), ("n", pa.int64())])
DEALT = "range int, langs array<string>, words binary, lang binary, w1 binary, w2 binary, w3 binary, n binary"
#: Kinds of bytes: of a word, between words, between pieces. All breaks are ASCII, so UTF-8 needs no decoding.
KIND = np.zeros(256, np.uint8)
KIND[list(BLANKS)] = 1
KIND[list(BREAKS)] = 2


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words of the texts, the text of each, and whether the next word follows in the same piece."""
    texts = pc.ascii_lower(texts).cast(pa.large_string())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0]:bounds[-1]]
    bounds = bounds - bounds[0]
    kind = KIND[data]
    inside = np.concatenate(([False], kind == 0, [False]))
    first = np.zeros(len(data) + 1, bool)
    first[bounds] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | first[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | first[1:])) + 1
    offsets = np.concatenate(([0], np.cumsum(ends - starts)))
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[kind == 0]))
    text = np.searchsorted(bounds, starts, "right") - 1
    piece = np.cumsum(kind == 2)[starts]
    follows = np.zeros(len(starts), bool)
    follows[:-1] = (piece[1:] == piece[:-1]) & (text[1:] == text[:-1])
    return words, text, follows


def _merged(lang: np.ndarray, w: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal windows added up (each counts once without ``n``), in order of language and words; ``w`` is 3 x windows, -1 for padding."""
    base = int(w.max(initial=-1)) + 2
    if (int(lang.max(initial=0)) + 1) * base ** 3 < WIDEST:
        key = lang.astype(np.int64)
        for x in w:
            key = key * base + (x + 1)
        if n is None:
            key, n = np.unique(key, return_counts=True)
        else:
            order = np.argsort(key)
            key, n = key[order], n[order]
            first, _ = runs(key)
            key, n = key[first], np.add.reduceat(n, first) if len(n) else n
        out = np.empty((3, len(key)), np.int32)
        for i in (2, 1, 0):
            key, out[i] = np.divmod(key, base)
        return key.astype(np.int32), out - 1, n.astype(np.int64)
    order = np.lexsort((w[2], w[1], w[0], lang))
    lang, w, n = lang[order], w[:, order], np.ones(len(lang), np.int64) if n is None else n[order]
    first = np.flatnonzero(_starts(lang, w))
    return lang[first], w[:, first], np.add.reduceat(n, first)


def _starts(lang: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Where language or words differ from the row before."""
    new = np.ones(len(lang), bool)
    new[1:] = (lang[1:] != lang[:-1]) | (w[:, 1:] != w[:, :-1]).any(axis=0)
    return new


def _hashes(strings: pa.Array) -> np.ndarray:
    return pd.util.hash_array(strings.to_numpy(zero_copy_only=False), categorize=False)


def _deal(held: list[tuple[pa.Array, pa.Array, np.ndarray]], ranges: int) -> Iterator[pa.RecordBatch]:
    """Merged windows of some words, one row for each range: its words once, and the windows as codes into them."""
    coded = pa.concat_arrays([h[0] for h in held]).dictionary_encode()
    langs = pa.concat_arrays([h[1] for h in held]).dictionary_encode()
    codes, follows = coded.indices.to_numpy().astype(np.int32), np.concatenate([h[2] for h in held])
    w = np.full((3, len(codes)), -1, np.int32)
    w[0] = codes
    two = np.flatnonzero(follows)
    w[1, two] = codes[two + 1]
    three = two[follows[two + 1]]
    w[2, three] = codes[three + 2]
    lang, w, n = _merged(langs.indices.to_numpy().astype(np.int32), w)
    word_hash = np.append(_hashes(coded.dictionary), np.uint64(0))  # the last one is that of the padding
    # The first word chooses among GROUPS, the second within: a word is in one of GROUPS ranges only, and a hot one is still spread.
    group = mixed(mixed(_hashes(langs.dictionary))[lang] ^ word_hash[w[0]]) % np.uint64(GROUPS)
    place = group * np.uint64(ranges // GROUPS) + mixed(word_hash[w[1]] + mixed(word_hash[w[0]])) % np.uint64(ranges // GROUPS)
    order = np.argsort(place, kind="stable")
    lang, w, n, place = lang[order], w[:, order], n[order], place[order]
    squeeze = zstandard.ZstdCompressor(1)
    out, size = [], 0
    local = np.full(len(coded.dictionary) + 1, -1, np.int32)
    for start, count in zip(*runs(place)):
        part = slice(start, start + count)
        used = np.unique(w[:, part])
        used = used[used >= 0]
        local[used] = np.arange(len(used))
        mine = np.ascontiguousarray(local[w[:, part]])  # the padding's code stays -1
        kinds, mine_lang = np.unique(lang[part], return_inverse=True)
        text = squeeze.compress("\n".join(coded.dictionary.take(pa.array(used)).to_pylist()).encode())
        out.append((int(place[start]), langs.dictionary.take(pa.array(kinds)).to_pylist(), text, pack(mine_lang.astype(np.int32)), pack(mine[0]),
                    pack_plain(mine[1]), pack_plain(mine[2]), pack_plain(n[part])))
        size += int(count)
        if size > CHUNK_WORDS // 8:
            yield _rows(out)
            out, size = [], 0
    if out:
        yield _rows(out)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.list_(pa.string()), *(pa.binary(),) * 6)
    names = ("range", "langs", "words", "lang", "w1", "w2", "w3", "n")
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=list(names))


def _added(parts: pa.Table, least_count: int) -> pa.Table:
    """Windows of a range with at least ``least_count`` occurrences; the others counted under their prefix, '' in place of words."""
    texts = [zstandard.ZstdDecompressor().decompress(x.as_py()).decode().split("\n") for x in parts.column("words")]
    kinds = [x.as_py() for x in parts.column("langs")]
    coded = pa.array([w for t in texts for w in t], pa.large_string()).dictionary_encode()
    langs = pa.array([k for t in kinds for k in t], pa.large_string()).dictionary_encode()
    word_code, lang_code = coded.indices.to_numpy(), langs.indices.to_numpy()
    lang, w, n, at, at_lang = [], [], [], 0, 0
    for i, (t, k) in enumerate(zip(texts, kinds)):
        own = np.append(word_code[at:at + len(t)], -1)  # -1 asks for the last entry, the padding
        w.append(np.stack([own[unpack(parts.column("w1")[i].as_py(), "i4")]] + [own[unpack_plain(parts.column(c)[i].as_py(), "i4")] for c in ("w2", "w3")]))
        lang.append(lang_code[at_lang:at_lang + len(k)][unpack(parts.column("lang")[i].as_py(), "i4")])
        n.append(unpack_plain(parts.column("n")[i].as_py(), "i8"))
        at, at_lang = at + len(t), at_lang + len(k)
    lang, w, n = _merged(np.concatenate(lang), np.concatenate(w, axis=1), np.concatenate(n))
    # All windows of a word pair are here, so what a range leaves of a pair below the count, no other range can lift above it.
    pairs, ones = (np.flatnonzero(_starts(lang, w[:k])) for k in (2, 1))
    triple = (n >= least_count) & (w[2] >= 0)
    whole = np.add.reduceat(n, pairs) if len(n) else n
    left = np.add.reduceat(np.where(triple, 0, n), pairs) if len(n) else n
    pair = (whole >= least_count) & (w[1, pairs] >= 0)
    rest = np.zeros(len(n), np.int64)
    rest[pairs] = np.where(pair, 0, left)
    rest = np.add.reduceat(rest, ones) if len(n) else rest
    pad = np.full(len(n), -1, np.int32)
    rows = ((np.flatnonzero(triple), 3, n[triple]), (pairs[pair], 2, left[pair]), (ones, 1, rest))
    at, n = np.concatenate([r[0] for r in rows]), np.concatenate([r[2] for r in rows])
    lang, w = lang[at], np.stack([np.concatenate([(w[i] if i < k else pad)[x] for x, k, _ in rows]) for i in range(3)])
    lang, w, n = lang[n > 0], w[:, n > 0], n[n > 0]
    names = pa.concat_arrays([coded.dictionary, pa.array([""], pa.large_string())])
    columns = [names.take(pa.array(np.where(x < 0, len(names) - 1, x))).cast(pa.string()) for x in w]
    return pa.Table.from_arrays([langs.dictionary.take(pa.array(lang)).cast(pa.string()), *columns, pa.array(n)], schema=COUNTED)


def windows(docs: DataFrame, *, least_count: int = LEAST_COUNT, range_bytes: int = RANGE_BYTES, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """lang, w1, w2, w3, n: counted windows, '' for padding and for words of windows below ``least_count``.

    Sums over prefixes are those of all windows for every prefix that reaches ``least_count``. A NULL lang is 'und'.
    """
    rows = docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    ranges = GROUPS * -(-max(shuffle_partitions(docs.sparkSession), -(-size // range_bytes)) // GROUPS)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for block in blocks(batches):
            words, text, follows = _words(block.column("text"))
            if not len(words):
                continue
            held.append((words, block.column("lang").take(pa.array(text)), follows))
            n += len(words)
            if n >= chunk_words:
                yield from _deal(held, ranges)
                held, n = [], 0
        if held:
            yield from _deal(held, ranges)

    parts = rows.mapInArrow(dealt, DEALT).repartition(ranges, "range")
    return parts.groupBy("range").applyInArrow(lambda parts: _added(parts, least_count), "lang string, w1 string, w2 string, w3 string, n long")


def phrase_counts(windows: DataFrame, *, least_count: int = LEAST_COUNT) -> DataFrame:
    """lang, w1, w2, w3, f, k: phrases of k words (1 to 3) with f occurrences, at least ``least_count``; k = 0 counts all words of a language."""
    sums = windows.rollup(*COLUMNS).agg(F.sum("n").alias("f"), F.grouping_id().alias("g"))
    k = F.when(F.col("g") == 0, 3).when(F.col("g") == 1, 2).when(F.col("g") == 3, 1).when(F.col("g") == 7, 0)
    last = F.when(F.col("g") == 0, F.col("w3")).when(F.col("g") == 1, F.col("w2")).otherwise("x")
    # A prefix that ends in padding is a shorter phrase's end, not a phrase.
    return sums.select(*COLUMNS, "f", k.alias("k")).where((last != "") & k.isNotNull() & ((k == 0) | (F.col("f") >= least_count)))


def cut_score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), exact for counts below 10^15; larger ones are an error, never rounded."""
    a, left, right = (x.cast("decimal(15,0)") for x in (a, left, right))
    return F.call_function("div", F.lit(SCALE).cast("decimal(7,0)") * (a * a), left * right)


def collocations(docs: DataFrame, *, least_count: int = LEAST_COUNT, covered: int = COVERED, top: int = TOP, range_bytes: int = RANGE_BYTES,
                 chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score, and cut (words in front of the cut) and words, the first ``top`` phrases of each language.

    NULL and empty texts have no words, rows that repeat count again, columns other than lang and text are ignored.
    Phrases that tie in score and count are ranked in byte order; of cuts that tie the first counts.
    """
    f = checkpoint(phrase_counts(windows(docs, least_count=least_count, range_bytes=range_bytes, chunk_words=chunk_words), least_count=least_count))
    n = f.where("k = 0").select("lang", F.col("f").alias("n"))
    one = f.where("k = 1").select("lang", "w1", "f")
    two = f.where("k = 2").select("lang", "w1", "w2", F.col("f").alias("a"))
    three = f.where("k = 3").select("lang", "w1", "w2", "w3", F.col("f").alias("a"))
    first, second, third = (one.select("lang", F.col("w1").alias(w), F.col("f").alias(c)) for w, c in (("w1", "f1"), ("w2", "f2"), ("w3", "f3")))
    longer = three.select("lang", "w1", "w2", "a").unionByName(three.select("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a"))
    longer = longer.groupBy("lang", "w1", "w2").agg(F.max("a").alias("longer"))
    pairs = two.join(longer, ["lang", "w1", "w2"], "left").where(100 * F.coalesce("longer", F.lit(0)) < covered * F.col("a"))
    pairs = pairs.join(first, ["lang", "w1"]).join(second, ["lang", "w2"]).select(
        "lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.lit(2).alias("words"), F.lit(1).alias("cut"), F.col("f1").alias("l"), F.col("f2").alias("r"),
        cut_score(F.col("a"), F.col("f1"), F.col("f2")).alias("score"))
    head = two.select("lang", "w1", "w2", F.col("a").alias("f12"))
    tail = two.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("f23"))
    triples = three.join(head, ["lang", "w1", "w2"]).join(tail, ["lang", "w2", "w3"]).join(first, ["lang", "w1"]).join(third, ["lang", "w3"])
    triples = triples.withColumns({"s1": cut_score(F.col("a"), F.col("f1"), F.col("f23")), "s2": cut_score(F.col("a"), F.col("f12"), F.col("f3"))})
    early = F.col("s1") <= F.col("s2")
    triples = triples.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", F.lit(3).alias("words"), F.when(early, 1).otherwise(2).alias("cut"),
                             F.when(early, F.col("f1")).otherwise(F.col("f12")).alias("l"), F.when(early, F.col("f23")).otherwise(F.col("f3")).alias("r"),
                             F.least("s1", "s2").alias("score"))
    order = (F.desc("score"), F.desc("a"), F.col("phrase"))
    # The first of a language are among the first of its parts, so no task sees more than PARTS * top rows of a language.
    dealt = pairs.unionByName(triples).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    first_of = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    best = first_of.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score", "cut", "words")
