"""Operators that compare documents with each other or with a benchmark, held against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from reachgrid.llm import components, decontaminate, jaccard, mixing

from .conftest import words

BIG = 1 << 70


def shingles(t):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(zip(w, w[1:], w[2:], w[3:], strict=False)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])


def groups(rows):
    """Component of each row; rows of one id are one document, rows without id stand alone."""
    ids = [d if d is not None else BIG + i for i, (d, *_) in enumerate(rows)]
    sets, up = [shingles(t) for _, t, _ in rows], {d: d for d in ids}

    def top(a):
        while up[a] != a:
            a = up[a]
        return a
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = top(ids[i]), top(ids[j])
                up[max(a, b)] = min(a, b)
    return [(ids[i], len(sets[i]), top(ids[i])) for i in range(len(rows))]


@pytest.fixture(scope="module")
def near():
    r = random.Random(9)
    vocab = [f"v{i}" for i in range(400)] + ["the", "of"] * 40
    rows, n = [], 0
    for g in range(12):
        base = [r.choice(vocab) for _ in range(r.randint(30, 200))]
        for _ in range(r.randint(1, 14)):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 60))):
                k = r.randrange(len(w))
                w[k:k + 1] = r.choice(([], ["new"], [r.choice(vocab)], [w[k], "more"]))
            base = w if g % 3 == 0 else base  # chains and stars
            rows.append((n, " ".join(w), "s"))
            n += 1
    r.shuffle(rows)
    return rows


def test_jaccard_components(spark, table, near):
    out = jaccard.near_groups(table(near), cell_bits=16).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out) == sorted(groups(near))
    assert len({g[2] for g in groups(near)}) < len(near)


def test_jaccard_on_edges(spark, table, edges):
    got = sorted((r.n_shingles, r.doc_id or 0, r.component_id or 0) for r in jaccard.near_groups(table(edges), cell_bits=16).collect())
    assert got == sorted((n, d if d < BIG else 0, c if c < BIG else 0) for d, n, c in groups(edges))
    assert jaccard.near_groups(table([]), cell_bits=16).count() == 0 and jaccard.one_of_each(table([]), cell_bits=16).count() == 0


def test_jaccard_of_ids_at_the_borders_and_repeated_ids(spark, table, near):
    """Ids near 2^62 and 2^63, negative ones, documents tied together by an id with two texts, rows without id that are alike."""
    a, b, c, d = ((near[i][1] + " ") * 2 for i in (0, 20, 40, 60))
    top, nameless = (1 << 63) - 1, " ".join(f"q{i}" for i in range(60))
    rows = [(3, a, "s"), (10, a, "s"), (10, b, "s"), (11, b, "s"), (1 << 62, c, "s"), ((1 << 62) + 5, c, "s"), ((1 << 62) + 6, "one text that nobody else has", "s"),
            (top, d, "s"), (-5, d + "more", "s"), (-(1 << 63), "the least of all ids stands alone", "s"), (None, nameless, "s"), (None, nameless + " x", "s"),
            (None, "some other words here", "s"), (None, a, "s"), (77, None, "s"), (77, c, "s"), (top - 1, None, "s"), (11, "", "s")]
    want = [(d if d < BIG else None, n, c if c < BIG else None) for d, n, c in groups(rows)]
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_groups(table(rows), cell_bits=16).collect()]
    assert Counter(got) == Counter(want)
    assert {c for d, _, c in want if d in (3, 10, 11)} == {3} and {c for d, _, c in want if d in (77, 1 << 62)} == {77}
    kept = Counter((r.doc_id, r.text) for r in jaccard.one_of_each(table(rows), cell_bits=16).collect())
    assert {d for d, _ in kept} == {None, 3, 77, -5, (1 << 62) + 6, -(1 << 63), top - 1, 11}
    assert kept[None, "some other words here"] == 1 and kept[None, a] == 0 and sum(n for (d, t), n in kept.items() if d is None) == 2


def test_jaccard_with_a_full_sketch_and_split_blocks(spark, monkeypatch, table, near):
    want = sorted((d, c) for d, _, c in groups(near))
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 400)
    monkeypatch.setattr(jaccard, "HELD", 500)
    assert sorted((r.doc_id, r.component_id) for r in jaccard.near_groups(table(near), cell_bits=9).collect()) == want


def test_one_of_each(spark, table, near, edges):
    want = {c for _, _, c in groups(near)}
    kept = jaccard.one_of_each(table(near), cell_bits=16).collect()
    assert {r.doc_id for r in kept} == want and len(kept) == len(want) and kept[0].size == "x"
    kept = Counter(r.doc_id for r in jaccard.one_of_each(table(edges), cell_bits=16).collect())
    assert kept[4] == kept[5] == kept[6] == 1 and kept[8] == 1 and kept[9] == 0 and kept[2] == 0


def test_prefix_tree_finds_every_link():
    r = random.Random(4)
    for _ in range(30):
        base = sorted(r.sample(range(300), 60))
        sets = [np.array(sorted({x for x in base if r.random() > 0.06} | set(r.sample(range(300), r.randint(0, 6)))), np.uint32) for _ in range(40)]
        sizes = np.array([len(s) for s in sets])
        tree, has = jaccard.PrefixTree(sets, sizes), np.zeros(300, bool)
        for s in sets:
            want = [i for i, x in enumerate(sets) if 100 * len(np.intersect1d(s, x)) >= 85 * len(np.union1d(s, x))]
            assert sorted(tree.linked(s, len(s), 85, has)) == want


def test_components(spark):
    r = random.Random(8)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100 + r.randrange(60), 100 + r.randrange(60)) for _ in range(40)] + [(500, 500), (7, 3)]
    got = {x.node: x.component for x in components.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    up = {}
    for a, b in pairs:
        up.setdefault(a, a), up.setdefault(b, b)

    def top(a):
        while up[a] != a:
            a = up[a]
        return a
    for a, b in pairs:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    assert got == {a: top(a) for p in pairs for a in p if p[0] != p[1]}


def targets(rows):
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len(words(t))
    names = sorted(s for s in size if s is not None) + [None] * (None in size)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    fixed = {}
    while True:
        free = [s for s in names if s not in fixed]
        share = (sum(size.values()) - sum(fixed.values())) / max(1, sum(weight[s] for s in free))
        over = {s: 3.0 * size[s] for s in free if share * weight[s] > 3 * size[s]}
        if not over:
            return size, {s: fixed.get(s, share * weight[s]) for s in names}
        fixed |= over


@pytest.mark.parametrize("stretches", [1, 7, 4096])
def test_mixing(spark, table, edges, stretches):
    out = mixing.mix(table(edges), stretches=stretches).collect()
    size, target = targets(edges)
    assert sorted((r.doc_id or -1, r.size, r.source or "") for r in out) == sorted((d or -1, len(words(t)), s or "") for d, t, s in edges)
    taken = defaultdict(int)
    for r in out:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 3 * r.size
        assert r.taken >= r.epochs * r.size  # complete epochs come first
        taken[r.source] += r.taken
    for s in size:
        assert abs(taken[s] - target[s]) <= 1
    again = mixing.mix(table(edges[::-1]), stretches=13).collect()
    assert sorted((r.doc_id or -1, r.size, r.taken) for r in again) == sorted((r.doc_id or -1, r.size, r.taken) for r in out)
    assert mixing.mix(table([])).count() == 0 and mixing.repeated(table([])).count() == 0


def test_mixing_prefers_quality(spark, table):
    rows = [(i, ("good words only here " if i % 2 else "#1 $2 %3 &4 ") * 10, "a") for i in range(600)] + [(1000 + i, "other " * 40, "b") for i in range(600)]
    taken = {r.doc_id: r.taken for r in mixing.mix(table(rows), weights=(1, 3)).collect()}
    good, bad = (sum(taken[i] > 0 for i in range(k, 600, 2)) for k in (1, 0))
    assert good > 1.5 * bad > 0


def test_mixed_documents(spark, table, edges):
    made = Counter(r.doc_id for r in mixing.repeated(table(edges)).collect())
    size, target = targets(edges)
    took = defaultdict(int)
    for d, t, s in {(d, t, s) for d, t, s in edges}:
        if d in (3, 10, None):
            continue
        took[s] += made[d] * len(words(t))
    assert max(made.values()) <= 6
    assert abs(took["abc"[2]] - target["c"]) <= 130


def test_leaks(spark, table, edges):
    r = random.Random(6)
    vocab = ["the", "of", "and", "in", "to"]

    def prose(n, tag):
        return " ".join(r.choice(vocab) if r.random() < 0.5 else f"{tag}{r.randrange(3000)}" for _ in range(n))
    items = [(i, prose(r.randint(14, 60), f"q{i}x")) for i in range(30)] + [(90, None), (91, ""), (92, "the of"), (93, prose(200, "long"))]
    rows, want = [(1000 + i, prose(r.randint(60, 900), "d"), "s") for i in range(300)], set()
    for i in range(40):
        d, (item, t) = r.randrange(300), items[i % 30] if i < 38 else items[33]
        w = words(rows[d][1])
        at = r.randrange(len(w))
        if i % 3 == 0:  # a paraphrase: one word in seven replaced, case changed
            t = " ".join("other" if k % 7 == 3 else x.upper() for k, x in enumerate(t.split()))
        rows[d] = (rows[d][0], " ".join(w[:at]) + f"\n{t}\n" + " ".join(w[at:]), "s")
        want.add((rows[d][0], item))
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    docs = table(rows + edges)
    got = {(x.doc_id, x.item_id) for x in decontaminate.leaks(docs, bench).collect()}
    # A passage may be planted inside an earlier one and part it, so it need not be whole.
    assert got <= want and len(want - got) <= 1
    assert {(x.doc_id, x.item_id) for x in decontaminate.leaks(docs, bench, items=20).collect()} >= got - {(d, i) for d, i in got if i == 93}
    left = decontaminate.without_leaks(docs, bench)
    assert {x.doc_id for x in left.collect()} == {d for d, *_ in rows + edges} - {d for d, _ in got} and left.columns == docs.columns
    assert left.count() == len(rows) + len(edges) - len({d for d, _ in got})
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0 and decontaminate.without_leaks(table([]), bench).count() == 0


def test_leaks_of_more_parts_than_the_latent_space_has_room_for(spark, table):
    r = random.Random(12)
    vocab = [f"w{i}" for i in range(8000)]

    def prose(n):
        return " ".join(r.choice(vocab) for _ in range(n))
    items = [(i, prose(r.randint(15, 30))) for i in range(900)] + [(1000 + i, prose(640)) for i in range(20)] + [(2000, prose(64 * 300))]
    rows, want = [], set()
    for d in range(150):
        planted = [items[i] for i in range(d, 920, 150)]
        whole = [(i, t if i < 1000 else " ".join(t.split()[64 * (d % 10):64 * (d % 10 + 1)])) for i, t in planted]
        if d % 10 == 0:  # a part far behind in the longest item
            whole.append((2000, " ".join(items[-1][1].split()[64 * (299 - d):64 * (300 - d)])))
        rows.append((d, " ".join(f"{prose(120)} {t}" for _, t in whole) + " " + prose(200), "s"))
        want |= {(d, i) for i, _ in whole}
    assert sum(-(-len(t.split()) // decontaminate.PART) for _, t in items) > 1000
    blocks = list(decontaminate._benchmarks([{"item_id": i, "text": t} for i, t in items], 1000, 224))
    assert max(len(b.parts) for b in blocks) == 224 and sum(len(b.parts) for b in blocks) == 900 + 200 + 300
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontaminate.leaks(table(rows), bench).collect()}
    assert want <= got and len(got - want) <= 5


def test_passages_are_summed_without_a_row_per_entry():
    import tracemalloc

    import numpy as np
    r, halves, terms, k = np.random.default_rng(4), 300, 500, 256
    counts = r.integers(0, 3, (halves, terms))
    counts[7] = 0  # a half passage without terms
    half, term = np.nonzero(counts)
    weight, space = r.random(terms), r.standard_normal((terms, k)).astype(np.float32)
    tracemalloc.start()
    got = list(decontaminate._rows((half, term, counts[half, term]), weight, space))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20_000 * k * 4 < len(half) * k * 4  # a run of entries is 20,000
    want = (counts * weight) @ space
    assert np.concatenate([g[0] for g in got]).tolist() == np.unique(half).tolist()
    assert np.allclose(np.concatenate([g[1] for g in got]), want[np.unique(half)], rtol=1e-3, atol=1e-3)


def test_leaks_takes_texts_apart_once(spark, table):
    """Whatever the number of blocks of items and passes over the documents."""
    r = random.Random(15)
    items = [(i, " ".join(f"q{i}x{r.randrange(3000)}" for _ in range(30))) for i in range(6)]
    docs = table([(d, " ".join(f"w{r.randrange(500)}" for _ in range(80)) + " " + items[d % 6][1] * (d < 6), "s") for d in range(40)] + [(50, None, "s"), (51, " \t", "s")])
    seen = spark.sparkContext.accumulator(0)

    def watched(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.leaks(docs.select("doc_id", "text").mapInArrow(watched, "doc_id long, text string"), bench, items=2)
    assert {(x.doc_id, x.item_id) for x in got.collect()} == {(d, d) for d in range(6)}
    assert seen.value == 42
