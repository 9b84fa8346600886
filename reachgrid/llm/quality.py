"""Quality rules with cross-document line frequency, in DataFrame functions only.

Lines are normalised (white space collapsed, lower case) and hashed. For each host and line the documents
with distinct content are counted, so that copies of a document count once. A line is common when the
count reaches the limit, alone or in a block of lines that always stand together. Common lines are
removed, and a document left with too few words, or too small a share of them, is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachgrid.llm.words import WORD

GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Documents of a host, of distinct content, from which a line is common.
LINE_LIMIT = 12
#: Words, and share of the words, that a document must keep.
LEAST_WORDS = 20
LEAST_SHARE = 0.25
#: Copies of the common-line table, so that a line shared by a third of all documents is spread.
SALTS = 32
#: Position bits next to a word triple's hash; longer texts are sorted as pairs instead.
POSITION_BITS = 24


def _triples(words: Column, pair: bool) -> Column:
    """Each 3-word window's hash and position, sorted: packed into one long, or as a pair."""
    rest = F.slice(words, F.lit(3), F.greatest(F.size(words) - 2, F.lit(0)))

    def entry(third: Column, i: Column) -> Column:
        h = F.xxhash64(F.get(words, i), F.get(words, i + 1), third)
        if pair:
            return F.struct(h.alias("h"), i.alias("i"))
        return F.shiftleft(F.shiftright(h, POSITION_BITS), POSITION_BITS).bitwiseOR(i.cast("long"))
    return F.sort_array(F.transform(rest, entry))


def _repeated_starts(order: Column, words: Column, pair: bool) -> Column:
    """Positions of windows whose three words stand elsewhere too."""
    def place(x: Column) -> Column:
        return x["i"] if pair else x.bitwiseAND((1 << POSITION_BITS) - 1).cast("int")

    def mark(x: Column) -> Column:
        return x["h"] if pair else F.shiftright(x, POSITION_BITS)

    def same(x: Column, y: Column) -> Column:
        a, b = place(x), place(y)
        equal = mark(x) == mark(y)
        for k in range(3):
            equal = equal & (F.get(words, a + k) == F.get(words, b + k))
        return F.coalesce(equal, F.lit(False))

    found = F.transform(order, lambda x, k: F.when(same(x, F.get(order, k + 1)) | same(x, F.get(order, k - 1)), place(x)))
    return F.filter(found, lambda p: p.isNotNull())


def _normal(line: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(line, GAP, " ")))


def _rows(docs: DataFrame, host: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id"), F.col(host).alias("host"), text.alias("text"), F.xxhash64("doc_id", host, text).alias("_row"))


def base_counts(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, _row and the counts that one text gives by itself; one row per input row."""
    text = F.col("text")
    first = _rows(docs, host).select(
        "doc_id", "_row", F.array_remove(F.split(text, GAP), "").alias("words"),
        (F.length(text) - F.regexp_count(text, F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    words = F.col("words")
    small = F.size(words) < (1 << POSITION_BITS)
    second = first.select(
        "doc_id", "_row", "words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(small, _triples(words, False)).alias("order"), F.when(~small, _triples(words, True)).alias("pairs"))
    third = second.select(
        "doc_id", "_row", "word_chars", "n_symbols", "n_dup_lines", F.size("words").cast("long").alias("n_words"),
        F.when(F.size(words) < (1 << POSITION_BITS), _repeated_starts(F.col("order"), words, False))
        .otherwise(_repeated_starts(F.col("pairs"), words, True)).alias("starts"))
    covered = F.array_union(F.array_union(F.col("starts"), F.transform("starts", lambda p: p + 1)), F.transform("starts", lambda p: p + 2))
    # Filters on the counts stop at the generator; pushed below it, they would evaluate the arrays over and over.
    counts = F.struct("n_words", "word_chars", "n_symbols", "n_dup_lines", F.size(covered).cast("long").alias("n_repeat_words"))
    return third.select("doc_id", "_row", F.explode(F.array(counts)).alias("counts")).select("doc_id", "_row", "counts.*")


def document_lines(docs: DataFrame, host: str = "source") -> DataFrame:
    """_row, line (hash of host and normalised line), n (words) and content (hash of the document's distinct lines)."""
    cut = _rows(docs, host).select("_row", "host", F.filter(
        F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    hashed = cut.select("_row", "host", F.transform("lines", lambda x: F.struct(
        F.xxhash64(_normal(x)).alias("h"), F.regexp_count(x, F.lit(WORD)).alias("n"))).alias("lines"))
    # A row's entries carry one content; with the line itself taken out, contents differ just where they differ with it.
    near = hashed.select("_row", F.xxhash64(F.array_sort(F.array_distinct(F.col("lines")["h"]))).alias("content"), F.explode(F.transform(
        "lines", lambda x, i: F.struct(F.xxhash64("host", x["h"]).alias("line"), i.alias("at"), x["n"].alias("n")))).alias("x"))
    # Rows that repeat in full give the same entries; max keeps them from adding up.
    return (near.groupBy("_row", F.col("x.line").alias("line"), F.col("x.at").alias("at"))
            .agg(F.max("x.n").alias("n"), F.max("content").alias("content"))
            .groupBy("_row", "line").agg(F.sum("n").alias("n"), F.max("content").alias("content")))


def common_lines(lines: DataFrame, *, limit: int = LINE_LIMIT) -> DataFrame:
    """Lines of a host found in ``limit`` documents of distinct content or more."""
    return (lines.groupBy("line", "content").agg(F.count("*").alias("docs"))
            .groupBy("line").agg(F.count("*").alias("contents")).where(F.col("contents") >= limit).select("line"))


def removed_lines(docs: DataFrame, host: str = "source", *, limit: int = LINE_LIMIT) -> DataFrame:
    """_row, n_removed (words in common lines) and lines (their hashes) for documents that have any."""
    lines = document_lines(docs, host)
    common = common_lines(lines, limit=limit).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = lines.withColumn("salt", F.pmod(F.col("_row"), F.lit(SALTS)).cast("int"))
    return salted.join(common, ["line", "salt"], "left_semi").groupBy("_row").agg(
        F.sum("n").alias("n_removed"), F.collect_list("line").alias("lines"))


def judge(docs: DataFrame, host: str = "source", *, limit: int = LINE_LIMIT, least_words: int = LEAST_WORDS,
          least_share: float = LEAST_SHARE) -> DataFrame:
    """doc_id, the counts of one text, base_failed, n_removed_words and kept.

    NULL or empty texts have no words and fail. A NULL host is a host of its own. Rows that repeat in
    full count as one document in line counts and are each returned; other columns are ignored.
    """
    gone = removed_lines(docs, host, limit=limit).drop("lines")
    out = base_counts(docs, host).join(gone, "_row", "left").withColumn("n_removed_words", F.coalesce("n_removed", F.lit(0)).cast("long"))
    left = F.col("n_words") - F.col("n_removed_words")
    out = out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      (~F.col("base_failed") & (left >= least_words) & (left >= least_share * F.col("n_words"))).alias("kept"),
                      "n_removed_words", "_row")


def clean(docs: DataFrame, host: str = "source", *, limit: int = LINE_LIMIT, least_words: int = LEAST_WORDS,
          least_share: float = LEAST_SHARE) -> DataFrame:
    """The kept documents with their columns, common lines taken out of ``text`` (and ``n_chars`` counted anew, if there)."""
    # The aggregation also keeps the filter from being pushed into the array expressions, which would evaluate them many times.
    verdict = judge(docs, host, limit=limit, least_words=least_words, least_share=least_share)
    verdict = verdict.groupBy(F.col("_row").alias("_llm_kept_row")).agg(F.max("kept").alias("kept")).where("kept")
    gone = removed_lines(docs, host, limit=limit).select(F.col("_row").alias("_llm_gone_row"), F.col("lines").alias("_llm_gone_lines"))
    text = F.coalesce(F.col("text"), F.lit(""))
    row = F.xxhash64("doc_id", host, text)
    rows = docs.withColumn("_llm_row", row).join(verdict, F.col("_llm_row") == F.col("_llm_kept_row"), "left_semi")
    rows = rows.join(gone, F.col("_llm_row") == F.col("_llm_gone_row"), "left")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(
        F.col("_llm_gone_lines"), F.xxhash64(host, F.xxhash64(_normal(x))))), "\n")
    new = F.when(F.col("_llm_gone_lines").isNull(), F.col("text")).otherwise(kept)
    out = rows.withColumn("text", new)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_llm_gone_lines").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)
