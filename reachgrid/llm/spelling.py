"""Spelling variants: words one code point apart, found by tiles of code-point matrices.

Two words of at most m code points, one of exactly m, are one edit apart just when their common prefix and
suffix together reach m - 1. Then they also share their first or last m // 2 code points, and of what is
left again the first or last half: each word asks under four such keys for each m, and only words that share
a key are ever put side by side. Words under a key of many are cut into blocks and blocks meet in pairs, words
under keys of few share a tile; either way a tile is a bounded matrix, compared column by column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachgrid.llm.words import lower_ascii
from reachgrid.session import checkpoint

LETTERS = "a-zÀ-ÿ"
LEAST_CHARS = 6
LEAST_COUNT = 5
#: A form is at least this many times as frequent as its variant.
RATIO = 5
#: A run in so many, by its checksum, loses a code point.
DELETED = 199
#: Words of a block, and code points of a block of longer words.
BLOCK = 256
BLOCK_CHARS = BLOCK * 256
NEAR = pa.schema([("word", pa.string()), ("n", pa.int64()), ("near", pa.string()), ("near_n", pa.int64())])


def word_counts(docs: DataFrame, *, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, deleted: int = DELETED) -> DataFrame:
    """word and n: runs of letters in all texts, some with a code point deleted as their checksum says.

    A NULL text has no runs; a NULL doc_id counts as empty text in the checksum.
    """
    text = lower_ascii(F.coalesce(F.col("text"), F.lit("")))
    # Shorter runs cannot become long enough, so they are not even cut out.
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all(text, F.lit(f"[{LETTERS}]{{{least_chars},}}"), F.lit(0))).alias("run"))
    h = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
    marked = runs.select("run", h.alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    short = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    word = F.when(F.col("h") % deleted == 0, short).otherwise(F.col("run"))
    counts = marked.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counts.where((F.col("n") >= least_count) & (F.length("word") >= least_chars))


def _keyed(words: DataFrame) -> DataFrame:
    """word, n, m (length of the longer word of a pair) and key (what both share), eight rows a word."""
    length = F.length("word")
    sized = words.withColumn("m", F.explode(F.array(length, length + 1)))
    half = F.floor(F.col("m") / 2).cast("int")
    quarter = F.floor((F.col("m") - half) / 2).cast("int")
    w = F.col("word")

    def key(side: int, front: Column, back: Column) -> Column:
        return F.xxhash64(F.lit(side), F.col("m"), F.left(w, front), F.right(w, back))
    zero = F.lit(0)
    keys = F.array(key(0, half + quarter, zero), key(1, half, quarter), key(2, quarter, half), key(3, zero, half + quarter))
    return sized.select("word", "n", "m", F.explode(keys).alias("key"))


def tiles(words: DataFrame, *, block: int = BLOCK, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """m, tile, i, j and members (word, n, part): words to compare; with i < j, those of part i with those of part j.

    A tile has about ``block`` words, fewer where words are long, whatever the number of words under a key.
    """
    keyed = _keyed(words)
    full = F.count(F.when(F.length("word") == F.col("m"), 1))
    sizes = keyed.groupBy("m", "key").agg(F.count("*").alias("size"), full.alias("full")).where("size > 1 and full > 0").drop("full")
    room = F.greatest(F.lit(2), F.least(F.lit(block), F.floor(F.lit(block_chars) / F.col("m")))).cast("long")
    sizes = sizes.withColumn("room", room)
    rows = keyed.join(sizes, ["m", "key"])
    packed = sizes.where("size <= room").groupBy("m").agg(F.ceil(F.sum("size") / F.first("room")).alias("tiles"))
    few = rows.where("size <= room").join(packed, "m").select(
        "m", F.pmod(F.col("key"), F.col("tiles")).alias("tile"), F.lit(False).alias("alone"), F.lit(0).alias("i"), F.lit(0).alias("j"), "word", "n", F.lit(0).alias("part"))
    parts = F.ceil(F.col("size") / F.col("room")).cast("int")
    many = rows.where("size > room").withColumn("part", F.pmod(F.xxhash64("word"), parts).cast("int")).select(
        "m", F.col("key").alias("tile"), F.lit(True).alias("alone"), "word", "n", "part", F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
    many = many.select("m", "tile", "alone", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "word", "n", "part")
    return few.unionByName(many).groupBy("m", "tile", "alone", "i", "j").agg(F.collect_set(F.struct("word", "n", "part")).alias("members"))


def _matrices(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths and code points of the words, one row each, padded behind and padded in front."""
    lengths = np.fromiter(map(len, words), np.int32, len(words))
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    columns = np.arange(lengths.max(initial=0))
    front, back = (np.zeros((len(words), len(columns)), np.uint32) for _ in range(2))
    front[columns < lengths[:, None]] = flat
    back[columns >= len(columns) - lengths[:, None]] = flat
    return lengths, front, back


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For every row of ``a`` and of ``b``, the number of columns from the first that agree."""
    alive = np.ones((len(a), len(b)), bool)
    out = np.zeros(alive.shape, np.int32)
    for c in range(min(a.shape[1], b.shape[1])):
        alive &= a[:, c, None] == b[None, :, c]
        if not alive.any():
            break
        out += alive
    return out


def near_in_tile(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Indices of words of ``a`` and ``b`` that differ by exactly one inserted, deleted or replaced code point."""
    lengths, front, back = _matrices(a + b)
    k = len(a)
    la, lb = lengths[:k, None], lengths[None, k:]
    least, most = np.minimum(la, lb), np.maximum(la, lb)
    prefix = np.minimum(_shared(front[:k], front[k:]), least)
    suffix = np.minimum(_shared(back[:k, ::-1], back[k:, ::-1]), least)
    same = (prefix == la) & (la == lb)
    return np.nonzero((prefix + suffix >= most - 1) & (most - least <= 1) & ~same)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        i, j = (batch.column(c).to_numpy() for c in ("i", "j"))
        members = batch.column("members")
        for row in range(batch.num_rows):
            rows = members[row].values
            words, part = rows.field("word"), rows.field("part").to_numpy()
            n = rows.field("n").to_numpy()
            left, right = (np.arange(len(part)),) * 2 if i[row] == j[row] else (np.flatnonzero(part == i[row]), np.flatnonzero(part == j[row]))
            text = words.to_pylist()
            x, y = near_in_tile([text[k] for k in left], [text[k] for k in right])
            x, y = left[x], right[y]
            if i[row] != j[row]:
                x, y = np.concatenate((x, y)), np.concatenate((y, x))
            if len(x):
                yield pa.RecordBatch.from_arrays([words.take(pa.array(x)), pa.array(n[x]), words.take(pa.array(y)), pa.array(n[y])], schema=NEAR)


def near_pairs(words: DataFrame, *, block: int = BLOCK, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """word, n, near, near_n for all words one edit apart, each pair both ways and once."""
    found = tiles(words, block=block, block_chars=block_chars).select("i", "j", "members").mapInArrow(
        _compared, "word string, n long, near string, near_n long")
    return found.dropDuplicates(["word", "near"])


def _roots(forms: DataFrame, most: int, least_count: int, ratio: int) -> DataFrame:
    """word and root: the end of the chain of forms. Counts grow by ``ratio`` a step, so ``most`` bounds the chain's length."""
    roots = forms.select("word", F.col("form").alias("root"))
    steps = 1
    while least_count * ratio ** (steps + 1) <= most:
        roots = checkpoint(roots)
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        roots = roots.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root"))
        steps *= 2
    return roots


def variants(docs: DataFrame, *, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, ratio: int = RATIO, deleted: int = DELETED,
             block: int = BLOCK, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of ``docs`` that is long and frequent enough.

    Documents count as often as they stand in the table; rows may repeat, columns other than doc_id and text are
    ignored, and NULL or empty texts have no words. Of near words of one count the first in code-point order is the form.
    """
    if ratio < 2 or least_chars < 4 or least_count < 1:
        raise ValueError("a form is twice as frequent at least, words have four code points or more and occur")
    words = checkpoint(word_counts(docs, least_chars=least_chars, least_count=least_count, deleted=deleted))
    near = near_pairs(words, block=block, block_chars=block_chars)
    best = F.min(F.struct((-F.col("near_n")).alias("k"), F.col("near").alias("form")))
    found = checkpoint(near.groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("b")).select(
        "word", "n_near", F.when(-F.col("b.k") >= ratio * F.col("n"), F.struct(F.col("b.form").alias("form"), (-F.col("b.k")).alias("form_n"))).alias("f")))
    most = words.agg(F.max("n")).first()[0] or 0
    roots = _roots(found.where("f is not null").select("word", "f.form"), most, least_count, ratio)
    return words.join(found, "word", "left").join(roots, "word", "left").select(
        "word", "f.form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "f.form_n")
