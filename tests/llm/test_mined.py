"""Spelling variants, collocations and line dedup against brute force, with hot keys, ties, NULLs and repeats."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from reachgrid.llm import collocations, lines, queries, spelling

LOW = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def word_table(rows, least_chars=6, least_count=5):
    counts = Counter()
    for d, t, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= least_chars and n >= least_count}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def variants(counts, ratio=5):
    masks, near = defaultdict(set), defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            masks[w[:i] + "*" + w[i + 1:]].add(w)
            if w[:i] + w[i + 1:] in counts:
                near[w].add(w[:i] + w[i + 1:])
                near[w[:i] + w[i + 1:]].add(w)
    for group in masks.values():
        for w in group:
            near[w] |= group - {w}
    form = {w: f for w in counts if near[w] and counts[f := min(near[w], key=lambda x: (-counts[x], x))] >= ratio * counts[w]}
    out = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), counts.get(form.get(w))))
    return sorted(out)


@pytest.fixture(scope="module")
def misspelt(edges):
    """Words with variants in chains, ties, a hot word, accents, very long words, and many words that share most of their letters."""
    r, texts = random.Random(8), []
    for word, n in (("information", 700), ("informatino", 30), ("infomation", 90), ("infomatio", 10), ("nfomatio", 5), ("ünïcodé", 40), ("ünïcodè", 6), ("übercodé", 40),
                    ("aaaaaaa", 30), ("aaaaaa", 5), ("aaaaaaaa", 5), ("tiedword", 25), ("tiedwards", 25), ("tiedward", 5), ("x" * 3000, 25), ("x" * 1500 + "y" + "x" * 1499, 5), ("x" * 2999, 5)):
        texts += [word] * n
    texts += [f"stemstem{a}{b}" for a in "abcdefghij" for b in "abcdefghij" for _ in range(5 + (a == b == "a") * 30)]
    r.shuffle(texts)
    rows = [(i, " ".join(texts[i::40]).replace("information", "Information") + " ÉTÉxyz éTÉxyz", "s") for i in range(40)]
    return rows + rows[:2] + edges + [(900, "\n".join(t or "" for _, t, _ in edges), None)]


@pytest.mark.parametrize("block,chars", [(256, 65536), (4, 65536), (256, 30)])
def test_variants(spark, table, misspelt, block, chars):
    counts = word_table(misspelt)
    got = sorted(map(tuple, spelling.variants(table(misspelt), block=block, block_chars=chars).collect()))
    want = variants(counts)
    assert got == want and sum(x[1] is not None for x in want) > 5
    chain = {x[0]: x for x in want}
    assert chain["infomation"][1] == "information" and chain["infomatio"][2] == "information"


def test_variants_without_words(spark, table):
    assert spelling.variants(table([])).count() == 0
    assert spelling.variants(table([(1, None, None), (2, "", "a"), (None, "short words only", "b")])).count() == 0
    alone = spelling.variants(table([(i, "lonesome", "s") for i in range(5)])).collect()
    assert [(r.form, r.root, r.n_near) for r in alone] == [(None, "lonesome", 0)]
    with pytest.raises(ValueError):
        spelling.variants(table([]), ratio=1)


def test_a_tile_finds_single_edits_only():
    r = random.Random(5)
    words = sorted({"".join(r.choice("ab") for _ in range(r.randint(4, 7))) for _ in range(150)})
    got = set(zip(*spelling.near_in_tile(words, words), strict=True))
    assert got == {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if one_edit(a, b)}


def test_crowded_keys_are_cut_into_bounded_tiles(spark):
    words = [f"{'prefix' * 2}{a}{b}{c}" for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh"]
    table = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    made = spelling.tiles(table, block=32).select(F.size("members").alias("k")).agg(F.max("k"), F.count("*")).first()
    assert made[0] <= 4 * 32 and made[1] > 50  # 512 words under one key, tiles of two blocks of about 32
    pairs = spelling.near_pairs(table, block=32)
    assert pairs.count() == 512 * 21 == pairs.select("word", "near").distinct().count()


def phrases(rows, least=10, covered=50, top=2000):
    f, total = Counter(), Counter()
    for lang, t in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            f.update((lang or "und", *w[i:i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    longest, out = Counter(), []
    for p, n in f.items():
        if len(p) == 4 and n >= least:
            for q in (p[:3], (p[0], *p[2:])):
                longest[q] = max(longest[q], n)
    for p, a in f.items():
        if len(p) < 3 or a < least or 100 * longest[p] >= covered * a and longest[p]:
            continue
        score, k = min((1_000_000 * a * a // (f[p[:k + 1]] * f[(p[0], *p[k + 1:])]), k) for k in range(1, len(p) - 1))
        out.append((p[0], -score, -a, " ".join(p[1:]).encode(), f[p[:k + 1]], f[(p[0], *p[k + 1:])], total[p[0]]))
    ranked, seen = [], Counter()
    for lang, score, a, phrase, left, right, n in sorted(out):
        seen[lang] += 1
        if seen[lang] <= top:
            ranked.append((lang, seen[lang], phrase.decode(), -a, left, right, n, -score))
    return ranked


COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@pytest.mark.parametrize("top,chunk,range_bytes", [(2000, 1_500_000, 8 << 20), (7, 500, 1000)])
def test_collocations(spark, table, edges, top, chunk, range_bytes):
    r = random.Random(4)
    vocab = ["new", "York", "city", "the", "a|b", "é", "字", "it's", "\x85", "\x00z"]
    made = [(i, "".join(r.choice(vocab) + r.choice([" ", " ", " ", "\t ", ", ", ".\n", "\x0b", "  "]) for _ in range(300)) + " in New York City! " * 30, None) for i in range(12)]
    rows = edges + made + made[:2]
    docs = table(rows).withColumn("lang", F.when(F.col("doc_id") % 3 == 0, None).when(F.col("doc_id") % 3 == 1, "und").otherwise("l\nx"))
    pairs = [(None if d is None or d % 3 < 2 else "l\nx", t) for d, t, _ in rows]
    pairs = [("l\nx" if d is None else p, t) for (d, _, _), (p, t) in zip(rows, pairs, strict=True)]  # NULL % 3 is neither
    got = collocations.collocations(docs, top=top, chunk_words=chunk, range_bytes=range_bytes).select(*COLUMNS).orderBy("lang", "rank").collect()
    want = phrases(pairs, top=top)
    assert [tuple(x) for x in got] == want and len(want) > 10
    assert collocations.collocations(table([])).count() == 0
    assert collocations.collocations(table([(1, None, None), (2, " .\n", None)])).count() == 0


def test_cut_scores_are_exact(spark):
    r = random.Random(9)
    rows = [(999_999_999_999_999,) * 3, (10, 10, 10), (3_037_000_500, 9_000_000_000, 3_037_000_501)]
    for _ in range(300):
        a = r.randrange(10, 10 ** r.randint(2, 15))
        rows.append((a, r.randrange(a, 10 ** 15), r.randrange(a, 10 ** 15)))
    df = spark.createDataFrame(rows, "a long, l long, r long")
    got = df.select("a", "l", "r", collocations.cut_score(*map(F.col, "alr")).alias("s")).collect()
    assert all(x.s == 1_000_000 * x.a * x.a // (x.l * x.r) for x in got)


def test_folded_windows_keep_all_sums(spark, table, edges):
    docs = table(edges)
    few = collocations.windows(docs, least_count=10)
    every = collocations.windows(docs, least_count=1)
    count = lambda w: sorted(map(tuple, collocations.phrase_counts(w, least_count=10).collect()), key=repr)
    assert count(few) == count(every) and few.count() < every.count() / 3


def deduped(rows, least=10):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(LOW)
    found = defaultdict(set)
    for d, t, *_ in rows:
        for line in (t or "").split("\n"):
            found[key(line)].add(("none", t) if d is None else d)
    out = []
    for d, t, *_ in rows:
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if not key(x) or len(found[key(x)]) < least]
        out.append((d, len(all_lines), len(all_lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest(), "\n".join(kept)))
    return out


@pytest.fixture(scope="module")
def lined(edges):
    r = random.Random(6)
    menu = ["Home | About", "  read MORE\t", "ÉCOLE", "école", "\x0b\x0c", "", "Terms of use", "one", " "]
    rows = [(100 + i, "\n".join(r.choice(menu + [f"own line {i} {k}" for k in range(4)]) for _ in range(r.randint(0, 30))), "s") for i in range(40)]
    rows += [(500, "\n".join(["terms OF use", f"only {k}"][k % 2] for k in range(40000)), "long"), (501, "Terms of use\n" * 3000, "all gone")]
    rows += [(None, "terms of use\nnameless " + str(i), None) for i in range(3)] + [(9, "twice\ntwice", "s")] * 12 + [(None, "thrice", None)] * 12
    return edges + rows


def test_lines(spark, table, lined):
    made = lines.keep_bitmaps(table(lined))
    assert made.columns == [*table(lined).columns, "n_lines", "n_dropped", "keep"]
    got = made.withColumn("kept", lines.kept_text(F.col("text"), F.col("keep"))).collect()
    want = deduped(lined)
    form = lambda x: (x[0] if x[0] is not None else -1, *x[1:])
    assert sorted(form((r.doc_id, r.n_lines, r.n_dropped, r.kept)) for r in got) == sorted(form((d, n, k, t)) for d, n, k, _, t in want)
    for r in got:
        assert sum(r.keep) == r.n_lines and sum(r.keep[1::2]) == r.n_dropped and all(n > 0 for n in r.keep[1:])
    assert max(r.n_dropped for r in got) >= 20000
    assert lines.keep_bitmaps(table([])).count() == 0


def test_lines_by_share_of_heavy_keys_agree(spark, table, lined, monkeypatch):
    # with 1 no key is heavy, with 10^9 each is: both ways give the same rows
    runs = []
    for heavy in (1, 10 ** 9):
        monkeypatch.setattr(lines, "HEAVY", heavy)
        runs.append(sorted(map(repr, lines.dropped_runs(table(lined)).collect())))
    assert runs[0] == runs[1]


def test_queries_over_small_tables(spark, table, tmp_path, edges, lined, misspelt):
    """The registered queries themselves."""
    rows = lined + misspelt[:40]
    table(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["op13_line_dedup"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"] and set(dict(got.dtypes).values()) == {"bigint", "string"}
    assert Counter(map(tuple, got.collect())) == Counter(x[:4] for x in deduped(rows))
    got = queries.QUERIES["op11_spelling_variants"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == variants(word_table(rows))
    got = queries.QUERIES["op12_phrase_collocations"](spark, str(tmp_path))
    assert got.columns == list(COLUMNS)
    assert [tuple(x) for x in got.orderBy("rank").collect()] == phrases([("en", t) for _, t, _ in rows])


def test_windows_that_do_not_fit_in_one_number(monkeypatch):
    r = np.random.default_rng(3)
    lang, w, n = r.integers(0, 3, 5000), r.integers(-1, 6, (3, 5000)).astype(np.int32), r.integers(1, 9, 5000)
    for weights in (None, n):
        one = collocations._merged(lang, w, weights)
        with monkeypatch.context() as m:
            m.setattr(collocations, "WIDEST", 1)
            two = collocations._merged(lang, w, weights)
        assert all((x == y).all() for x, y in zip(one, two, strict=True)) and one[2].sum() == (5000 if weights is None else n.sum())


def test_words_by_bytes():
    import pyarrow as pa
    texts = ["", "One two", "a,b c\td", "x", " é字 y.", "", "z"]
    words, text, follows = collocations._words(pa.array(texts).slice(1))
    assert words.to_pylist() == ["one", "two", "a", "b", "c", "d", "x", "é字", "y", "z"]
    assert text.tolist() == [0, 0, 1, 1, 1, 1, 2, 3, 3, 5]
    assert np.flatnonzero(follows).tolist() == [0, 3, 4, 7]
