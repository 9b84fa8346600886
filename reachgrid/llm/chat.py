"""Conversations as training windows, in DataFrame functions only.

A conversation's turns become windows of about ``budget`` tokens (words and marks). Prefix sums of the
turns' tokens put turn-aligned spans into windows; every window begins with the system turn and repeats
up to ``history`` turns before its own. Repeated turns are masked, so that each assistant text is a
target exactly once.

Control strings inside roles and texts are escaped, so none of a template can be forged, and the escapes
are undone in reading.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reachgrid.llm.words import WORD

OPEN, CLOSE = "<|turn|>", "<|end|>"
#: Escapes, applied from top to bottom and undone from bottom to top. The escape character comes first.
ESCAPES = (("\\", "\\e"), ("<|", "\\c"), ("[INST]", "\\i"), ("[/INST]", "\\j"), ("<s>", "\\s"), ("</s>", "\\t"), ("<<SYS>>", "\\x"), ("<</SYS>>", "\\y"))
LINE = ("\n", "\\n")
BUDGET = 512
HISTORY = 2


def escape(text: Column, line: bool = False) -> Column:
    for plain, coded in (*ESCAPES, LINE) if line else ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column, line: bool = False) -> Column:
    for plain, coded in reversed((*ESCAPES, LINE) if line else ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def windows(turns: DataFrame, *, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row per window: conv_id, window, n_repeated, formatted and mask (struct array of start and end, in code points).

    ``turns`` has conv_id, turn, role and text; NULL roles and texts are empty. Turns are ordered by turn,
    then role, then text; repeated rows are repeated turns. Rows with a NULL conv_id form one conversation.
    A window takes the turns whose tokens end in one stretch of ``budget`` of the conversation's running
    total, so it exceeds the budget by less than its first turn, and turns are never cut.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    rows = turns.select("conv_id", F.struct(F.col("turn").alias("turn"), role.alias("role"), text.alias("text")).alias("t"),
                        (F.regexp_count(text, F.lit(WORD)) + 3).alias("tokens"))
    order = Window.partitionBy("conv_id").orderBy("t")
    first = F.col("first")
    placed = rows.select(
        "conv_id", "t", F.row_number().over(order).alias("no"),
        F.floor((F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1) / budget).cast("long").alias("stretch"),
        F.first("t").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("first"),
        F.when(F.lag("t", 1).over(order).isNull(), F.array().cast("array<struct<turn:bigint,role:string,text:string>>"))
        .otherwise(F.array_compact(F.array(*[F.lag("t", k).over(order) for k in range(history, 0, -1)]))).alias("before"))
    grouped = placed.groupBy("conv_id", "stretch").agg(
        F.array_sort(F.collect_list(F.struct("no", "t"))).alias("own"), F.min_by("before", "no").alias("before"),
        F.min("no").alias("no"), F.first("first").alias("first"))
    system = first["role"] == "system"
    own = F.transform("own", lambda x: F.struct(x["t"]["role"].alias("role"), x["t"]["text"].alias("text"), F.lit(True).alias("new")))

    def old(x: Column) -> Column:
        return F.struct(x["role"].alias("role"), x["text"].alias("text"), F.lit(False).alias("new"))
    # The lagged turns hold the first turn again when they reach back to it; then it is not put in front twice.
    reaches = F.col("no") - F.size("before") <= 1
    lead = F.when(system & ~reaches, F.array(first)).otherwise(F.slice(F.array(first), 1, 0))
    shown = grouped.select("conv_id", "stretch", F.concat(F.transform(F.concat(lead, F.col("before")), old), own).alias("turns"),
                           (F.size(lead) + F.size("before")).alias("n_repeated"))
    parts = shown.select("conv_id", "stretch", "n_repeated", F.transform("turns", lambda x: F.struct(
        F.concat(F.lit(OPEN), escape(x["role"], True), F.lit("\n")).alias("head"), escape(x["text"]).alias("body"),
        (x["new"] & (x["role"] == "assistant")).alias("target"))).alias("parts"))
    mask = F.aggregate("parts", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out")), lambda s, p: F.struct(
        (s["at"] + F.length(p["head"]) + F.length(p["body"]) + len(CLOSE)).alias("at"),
        F.when(p["target"], F.concat(s["out"], F.array(F.struct(
            (s["at"] + F.length(p["head"])).alias("start"), (s["at"] + F.length(p["head"]) + F.length(p["body"])).alias("end")))))
        .otherwise(s["out"]).alias("out")), lambda s: s["out"])
    return parts.select("conv_id", F.col("stretch").alias("window"), "n_repeated",
                        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "").alias("formatted"), mask.alias("mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role and text, each once, in order), targets (texts under the mask) and formatted_chars, from windows."""
    cut = F.filter(F.split(F.col("formatted"), r"\Q" + CLOSE + r"\E"), lambda x: x != "")

    def turn(x: Column) -> Column:
        body = F.substring(x, F.lit(len(OPEN) + 1), F.length(x))
        at = F.locate("\n", body)
        return F.struct(unescape(F.substring(body, F.lit(1), at - 1), True).alias("role"), unescape(F.substring(body, at + 1, F.length(body))).alias("text"))
    one = formatted.select("conv_id", "window", F.length("formatted").alias("chars"),
                           F.transform(F.slice(cut, F.col("n_repeated") + 1, F.size(cut)), turn).alias("turns"),
                           F.transform("mask", lambda m: unescape(F.substring(F.col("formatted"), m["start"] + 1, m["end"] - m["start"]))).alias("targets"))
    return one.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window", "turns", "targets"))).alias("all"), F.sum("chars").alias("formatted_chars")).select(
        "conv_id", F.flatten(F.transform("all", lambda x: x["turns"])).alias("turns"),
        F.flatten(F.transform("all", lambda x: x["targets"])).alias("targets"), "formatted_chars")


def digests(formatted: DataFrame) -> DataFrame:
    """What a reader of the windows sees of each conversation, as counts and hashes."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    targets = F.array_join("targets", "")
    return read_back(formatted).select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                                       F.length(targets).cast("long").alias("loss_chars"), F.sha2(targets, 256).alias("loss_sha256"),
                                       F.col("formatted_chars").cast("long").alias("formatted_chars"))
