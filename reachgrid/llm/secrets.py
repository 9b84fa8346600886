"""Secrets in texts, in DataFrame functions only: fixed patterns plus sliding-window entropy.

Pattern matches keep their place: ``split`` gives the text between matches, ``regexp_extract_all`` the
matches, and running sums of both lengths give each start in code points.

Long strings without white space are candidates. A window of ``WINDOW`` characters slides over each;
its Shannon entropy comes from counts that change by one character in and one out per step. The entropy is
held against the threshold of the candidate's character class. Words, identifiers, UUIDs, paths and
known placeholders are on the allow-list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed patterns of the three kinds, in their order.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
# The same runs, found faster: shorter ones cannot pass, and a run's own tail is shorter still.
LONG_ACCESS = r"AKIA[A-Z0-9]{16,}"
LONG_HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")

CANDIDATE = r"[A-Za-z0-9+/_=-]{24,}"
WINDOW = 20
#: Character class of a candidate: pattern that all of it fits, bits that some window must reach.
CLASSES = (("digits", r"[0-9]+", None), ("hex", r"[0-9A-Fa-f]+", 3.4), ("alphanumeric", r"[A-Za-z0-9]+", 3.7), ("base64", r"[A-Za-z0-9+/_=-]+", 3.8))
#: Candidates that are no secrets: letters only, words joined by - or _ or /, UUIDs, repeated single characters, placeholders.
ALLOWED = (r"^[A-Za-z]+$", r"^[A-Za-z]*([-_/=+][A-Za-z]*)+$", r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$", r"^(.)\1+$",
           r"(?i)(example|placeholder|changeme|your[-_]?(api)?[-_]?key|xxxxxx|123456789)")


def _spans(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """Array of (start, kind, end) of the leftmost matches, each after the last one's end."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.zip_with(F.split(text, pattern, -1), found, lambda a, b: F.struct(F.length(a).alias("gap"), F.coalesce(F.length(b), F.lit(0)).alias("size"), b.alias("found")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,kind:int,end:int,found:string>>").alias("out"))
    placed = F.aggregate(pieces, start, lambda s, p: F.struct(
        (s["at"] + p["gap"] + p["size"]).alias("at"),
        F.when(p["found"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(F.struct(
            (s["at"] + p["gap"]).alias("start"), F.lit(kind).alias("kind"), (s["at"] + p["gap"] + p["size"]).alias("end"),
            p["found"].alias("found"))))).alias("out")), lambda s: s["out"])
    spans = F.filter(placed, lambda x: keep(x["found"])) if keep else placed
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    bare = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    return F.when(text.rlike(pattern), bare).otherwise(none)


def _weigh(c: Column) -> Column:
    """c log2 c, 0 at 0."""
    return F.when(c > 0, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))


def _count(window: Column, ch: Column) -> Column:
    return F.length(window) - F.length(F.replace(window, ch, F.lit("")))


def most_entropy(s: Column, window: int = WINDOW) -> Column:
    """Largest Shannon entropy, in bits per character, of the windows of a string; 0 for shorter strings.

    With S the sum of c log2 c over the counts c, the entropy is log2(window) - S / window. A step takes
    one character out and one in, so S changes by the two characters' terms only.
    """
    first = F.substring(s, 1, window)
    total = F.aggregate(F.array_distinct(F.split(first, "")), F.lit(0.0), lambda acc, ch: acc + _weigh(_count(first, ch)))

    def step(acc: Column, i: Column) -> Column:
        held = F.substring(s, i + 1, F.lit(window - 1))  # what stays from the last window
        out, new = F.substring(s, i, F.lit(1)), F.substring(s, i + window, F.lit(1))
        a, b = _count(held, out), _count(held, new)
        now = acc["sum"] - _weigh(a + 1) + _weigh(a) - _weigh(b) + _weigh(b + 1)
        return F.struct(now.alias("sum"), F.least(acc["least"], now).alias("least"))
    steps = F.when(F.length(s) > window, F.sequence(F.lit(1), F.length(s) - window)).otherwise(F.array().cast("array<int>"))
    least = F.aggregate(steps, F.struct(total.alias("sum"), total.alias("least")), step, lambda acc: acc["least"])
    return F.when(F.length(s) >= window, F.log2(F.lit(float(window))) - least / window).otherwise(F.lit(0.0))


def looks_random(s: Column, window: int = WINDOW) -> Column:
    """Whether some window's entropy reaches the threshold of the string's character class, unless allow-listed."""
    allowed = F.lit(False)
    for p in ALLOWED:
        allowed = allowed | s.rlike(p)
    bits = None
    for _, p, least in CLASSES:
        fits, value = s.rlike(f"^{p}$"), F.lit(least).cast("double")
        bits = F.when(fits, value) if bits is None else bits.when(fits, value)
    mixed = s.rlike("[0-9]") & s.rlike("[A-Za-z]")
    return F.when(allowed | ~mixed, F.lit(False)).otherwise(F.coalesce(most_entropy(s, window) >= bits, F.lit(False)))


def _text_of(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(
        ":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy.

    Spans are ``kind:start:end`` by start, then kind; an assignment's span is the whole match. NULL and
    empty texts have none. Rows that repeat are each returned; other columns are ignored.
    """
    text = F.col("text")
    rows = docs.select(F.col("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    found = rows.select(
        "doc_id",
        _spans(text, ASSIGN, 0, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6).alias("assign"),
        _spans(text, LONG_ACCESS, 1).alias("access"), _spans(text, LONG_HEX, 2).alias("hex"),
        _spans(text, CANDIDATE, 3, looks_random).alias("entropy"))
    base = F.concat("assign", "access", "hex")
    inside = F.filter("entropy", lambda e: ~F.exists(base, lambda b: (b["start"] <= e["start"]) & (b["end"] >= e["end"])))
    return found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
                        F.sha2(_text_of(base), 256).alias("base_sha256"), _text_of(F.concat(base, inside)).alias("spans"),
                        F.size(inside).cast("long").alias("n_entropy"))
