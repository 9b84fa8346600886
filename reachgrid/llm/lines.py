"""Lines that many documents hold, dropped in all of them, as keep bitmaps; in DataFrame functions only.

Hashes of line keys are range-partitioned together with the document, sorted by document and position,
and the first occurrence of a key in a document is streamed off; counting these gives the documents of a
key however often one document repeats it, and a key in a third of all documents is dealt over many
ranges. The verdicts go back to positions, and positions to a run-length-compressed bitmap per document.
Texts take no part in any of this; they meet their bitmap only where somebody asks for the kept text.

Rows of one doc_id are one document in the counts; a row without doc_id is a document of its own, told
apart by its text. Each input row gets a bitmap, rows that repeat in full the same one. A NULL or empty
text is one empty line, which is never dropped. Other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reachgrid.llm.words import lower_ascii
from reachgrid.session import checkpoint

#: White space that is stripped from both ends of a line.
BLANK = " \t\n\x0b\x0c\r"
#: Documents from which a line is dropped, and code points that its key must have.
LEAST_DOCS = 10
LEAST_CHARS = 1
#: A key is heavy when it holds over one in so many of the occurrences of dropped keys; there are fewer of them than this.
HEAVY = 1000
KEY = ("h1", "h2")
ROW = ("_llm_id", "_llm_t1", "_llm_t2")


def _marked(docs: DataFrame) -> DataFrame:
    """Columns that tell rows apart: the id and two hashes of the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns({"_llm_id": F.col("doc_id"), "_llm_t1": F.xxhash64(text), "_llm_t2": F.xxhash64(F.lit(1), text)})


def line_keys(docs: DataFrame, *, least_chars: int = LEAST_CHARS) -> DataFrame:
    """_llm_id, _llm_t1, _llm_t2, h1, h2 (hash of the key) and pos of every line whose key is long enough."""
    low = lower_ascii(F.coalesce(F.col("text"), F.lit("")))
    lines = _marked(docs).select(*ROW, F.posexplode(F.split(low, "\n")).alias("pos", "line"))
    keys = lines.select(*ROW, "pos", F.btrim("line", F.lit(BLANK)).alias("key")).where(F.length("key") >= least_chars)
    return keys.select(*ROW, F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"), "pos")


def documents_of(keys: DataFrame) -> DataFrame:
    """h1, h2 and docs, the number of documents that hold the key."""
    nameless = F.col("_llm_id").isNull()
    dealt = keys.select("*", F.when(nameless, F.col("_llm_t1")).alias("n1"), F.when(nameless, F.col("_llm_t2")).alias("n2"))
    document = [*KEY, "_llm_id", "n1", "n2"]
    # A range partitioning by key and document is what the window asks for, so this is the only shuffle of single lines.
    ordered = Window.partitionBy(*document).orderBy("_llm_t1", "_llm_t2", "pos")
    first = dealt.repartitionByRange(*document).withColumn("k", F.row_number().over(ordered)).where("k = 1")
    return first.groupBy(*KEY).agg(F.count("*").alias("docs"))


def dropped_runs(docs: DataFrame, *, least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """_llm_id, _llm_t1, _llm_t2, n_dropped and runs (kept, dropped, kept, dropped, ...) of rows that lose a line."""
    keys = checkpoint(line_keys(docs, least_chars=least_chars))
    common = checkpoint(documents_of(keys).where(F.col("docs") >= least_docs))
    total = common.agg(F.sum("docs")).first()[0] or 0
    # Fewer than HEAVY keys can each hold over one in HEAVY of the total: a proven bound for the broadcast.
    heavy = F.broadcast(common.where(F.col("docs") * HEAVY > total).select(*KEY))
    light = common.where(F.col("docs") * HEAVY <= total).select(*KEY)
    gone = keys.join(heavy, [*KEY], "left_semi").unionByName(keys.join(heavy, [*KEY], "left_anti").join(light, [*KEY], "left_semi"))
    # Positions next to each other have one difference to their rank; repeated rows tie.
    rank = F.dense_rank().over(Window.partitionBy(*ROW).orderBy("pos"))
    runs = gone.withColumn("island", F.col("pos") - rank).groupBy(*ROW, "island").agg(
        F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"))
    before = F.coalesce(F.lag("end").over(Window.partitionBy(*ROW).orderBy("start")), F.lit(0))
    pairs = runs.select(*ROW, "start", F.array(F.col("start") - before, F.col("end") - F.col("start")).alias("pair"))
    return pairs.groupBy(*ROW).agg(F.sum(F.col("pair")[1]).cast("long").alias("n_dropped"),
                                   F.flatten(F.array_sort(F.collect_list(F.struct("start", "pair"))).getField("pair")).alias("runs"))


def keep_bitmaps(docs: DataFrame, *, least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """The rows of ``docs`` with n_lines, n_dropped and keep: lengths of the runs of kept and dropped lines in turn, kept first.

    A document with lines k k d k is [2, 1, 1]; a last kept run of no lines is left out. Columns of ``docs`` with
    these three names are replaced.
    """
    runs = dropped_runs(docs, least_docs=least_docs, least_chars=least_chars).select(
        *[F.col(c).alias(f"{c}_r") for c in ROW], F.col("n_dropped").alias("_llm_n"), F.col("runs").alias("_llm_runs"))
    same = [F.col(c).eqNullSafe(F.col(f"{c}_r")) for c in ROW]
    joined = _marked(docs.drop("n_lines", "n_dropped", "keep")).join(runs, same, "left")
    n_lines = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit("\n")) + 1
    out = joined.withColumns({"n_lines": n_lines.cast("long"), "n_dropped": F.coalesce("_llm_n", F.lit(0)).cast("long")})
    last = F.col("n_lines").cast("int") - F.aggregate(F.coalesce("_llm_runs", F.array().cast("array<int>")), F.lit(0), lambda s, x: s + x)
    keep = F.concat(F.coalesce("_llm_runs", F.array().cast("array<int>")), F.filter(F.array(last), lambda x: x > 0))
    return out.withColumn("keep", keep).drop(*ROW, *[f"{c}_r" for c in ROW], "_llm_n", "_llm_runs")


def kept_text(text: Column, keep: Column) -> Column:
    """The lines of ``text`` under the bitmap, joined by line ends; linear in the text."""
    bits = F.flatten(F.transform(keep, lambda n, i: F.array_repeat(i % 2 == 0, n)))
    lines = F.zip_with(F.split(F.coalesce(text, F.lit("")), "\n"), bits, lambda line, bit: F.when(bit, line))
    return F.array_join(lines, "\n")
