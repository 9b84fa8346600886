"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source's target is a whole number of complete epochs and a rest. The rest is drawn without
replacement: each document gets the key u ** (1 / quality), u from a hash of the document, and documents
are taken from the largest key down until their sizes sum up to the rest. The document at the border
gives only the words that are missing.

The prefix sum has two levels, so no source is sorted in one task: sizes are summed per (source, key
stretch), stretches are added up per source, and documents are
ordered one by one only inside their stretch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reachgrid.functions.scale import row_index
from reachgrid.llm.words import WORD
from reachgrid.session import checkpoint

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
#: Key stretches per source: a source of n documents has about n / STRETCHES in the one that is ordered.
STRETCHES = 4096


def quality(text: Column) -> Column:
    """Weight of a document: falls from 1 with its share of digits and symbols."""
    odd = F.regexp_count(text, F.lit(r"[0-9#*$%&|<>{}\\^~_=+@]"))
    return 1.0 / (1.0 + 10.0 * odd / (F.length(text) + 1))


def source_targets(totals: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """source, named, source_size and target for ``totals`` (source, named, source_size; one row per source).

    Weights repeat over the sources by code point, the NULL source last. A target stops at ``most`` times
    its source's size; what is cut off is shared out again by weight. Each round is one aggregation of the
    table of sources; only three sums reach the driver.
    """
    placed = row_index(totals, F.col("named").desc(), F.col("source"), name="place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    rows = checkpoint(placed.withColumn("weight", weight).withColumn("most", most * F.col("source_size").cast("double")))
    # The rate per unit of weight only grows from round to round, so a capped source stays capped.
    rate, capped = 0.0, -1
    while True:
        over = (F.col("most") < F.lit(rate) * F.col("weight"))
        total, fixed, weighing, n = rows.agg(F.sum("source_size"), F.sum(F.when(over, F.col("most")).otherwise(0.0)),
                                             F.sum(F.when(over, 0.0).otherwise(F.col("weight"))), F.count_if(over)).first()
        if n == capped or not weighing:
            break
        rate, capped = (float(total) - fixed) / weighing, n
    return rows.select("source", "named", "source_size", F.least(F.col("most"), F.lit(rate) * F.col("weight")).alias("target"))


def mix(docs: DataFrame, source: str = "source", *, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS, stretches: int = STRETCHES,
        whole_documents: bool = False, seed: int = 17) -> DataFrame:
    """Every row of ``docs`` as doc_id, source, size, source_size, target, epochs, taken and _row.

    ``taken`` is the number of words that the mix takes of the document, repeats counted. With
    ``whole_documents`` the document at the border is taken whole if at least half of it is wanted and
    else left out. NULL texts have size 0; a NULL source is one source, the last. Rows that repeat in full
    have equal keys and are told apart by nothing else, so they share one place in the order: each is
    taken in the same way as far as the budget goes. Reruns give the same result. Other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    row = F.xxhash64("doc_id", source, text)
    u = (F.pmod(F.xxhash64(row, F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    rows = docs.select(F.col("doc_id"), F.coalesce(F.col(source), F.lit("")).alias("source"), F.col(source).isNotNull().alias("named"),
                       F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.pow(u, 1.0 / quality(text)).alias("key"), row.alias("_row"))
    rows = checkpoint(rows.withColumn("stretch", F.floor((1.0 - F.col("key")) * stretches).cast("int")))
    same = ["source", "named"]
    parts = rows.groupBy(*same, "stretch").agg(F.sum("size").alias("part"))
    targets = source_targets(parts.groupBy(*same).agg(F.sum("part").alias("source_size")), weights=weights, most=most)
    along = Window.partitionBy(*same).orderBy("stretch").rowsBetween(Window.unboundedPreceding, 0)
    sums = parts.select(*same, "stretch", (F.sum("part").over(along) - F.col("part")).alias("before"), "part")
    per = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    known = sums.join(targets, same).withColumn("epochs", per).withColumn(
        "rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    # One row per (source, stretch), so the hot source's documents are dealt out over its stretches.
    inside = Window.partitionBy(*same, "stretch").orderBy(F.col("key").desc(), "_row").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.join(known, [*same, "stretch"]).withColumn("at", F.col("before") + F.sum("size").over(inside) - F.col("size"))
    left = F.col("rest") - F.col("at")
    more = F.when(left >= F.col("size") / 2, F.col("size")).otherwise(0) if whole_documents else F.greatest(F.lit(0), F.least("size", left))
    more = F.when(left > 0, more).otherwise(0).cast("long")
    return placed.select("doc_id", F.when(F.col("named"), F.col("source")).alias("source"), "size", "source_size", "target", "epochs",
                         (F.col("epochs") * F.col("size") + more).alias("taken"), "_row")


def repeated(docs: DataFrame, source: str = "source", **options) -> DataFrame:
    """The mix as documents: each row of ``docs`` as often as the mix takes it, the border document whole or not at all.

    Documents without words are in every epoch of their source.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    plan = mix(docs, source, whole_documents=True, **options)
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(F.greatest("epochs", F.lit(1))).cast("int")
    plan = plan.groupBy(F.col("_row").alias("_llm_taken_row")).agg(F.max(times).alias("_llm_times")).where("_llm_times > 0")
    keyed = docs.withColumn("_llm_row", F.xxhash64("doc_id", source, text))
    copies = keyed.join(plan, F.col("_llm_row") == F.col("_llm_taken_row")).withColumn("_llm_copy", F.explode(F.sequence(F.lit(1), F.col("_llm_times"))))
    return copies.select(*docs.columns)
