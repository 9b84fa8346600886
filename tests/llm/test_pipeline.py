"""The pipeline's stages one after another, each held against brute force on what the one before kept."""

import random
import zlib

import numpy as np
import public_tokenizers

import corpus_pipeline
from reachgrid.llm import index, mixing, quality

from .conftest import words
from .test_tables import groups

SF_DIR = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    from tokenizers import Tokenizer
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF_DIR).write.parquet(str(tmp_path / name))
        kept[name] = docs, docs = docs, spark.read.parquet(str(tmp_path / name))
        if name != "token_index":
            assert docs.columns == columns
    ids = lambda df: [r.doc_id for r in df.collect()]
    before, after = kept["quality_rules"]
    assert sorted(ids(after)) == sorted(r.doc_id for r in quality.judge(before).collect() if r.kept)
    before, after = kept["jaccard_join"]
    rows = [(r.doc_id, r.text, r.source) for r in before.collect()]
    assert set(ids(after)) == {c for _, _, c in groups(rows)}
    before, after = kept["decontamination"]
    items = [" ".join(words(r.text.lower())) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in before.collect() if not any(i in " ".join(words(r.text.lower())) for i in items)}
    assert set(ids(after)) <= clean and len(clean) - after.count() <= 2  # edited passages go too
    before, after = kept["source_mixing"]
    plan = {r.doc_id: r.taken // max(r.size, 1) for r in mixing.mix(before, whole_documents=True).collect()}
    made = ids(after)
    assert all(made.count(d) == n for d, n in plan.items())
    before, after = kept["token_index"]
    tokenizer, at, want = Tokenizer.from_file(public_tokenizers.path(index.VOCABULARY)), 0, []
    for d, t in sorted((r.doc_id, r.text) for r in before.collect()):
        x = tokenizer.encode(t, add_special_tokens=False).ids + [0]
        want.append((d, at, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        at += len(x)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in after.collect()) == sorted(want)


def test_run_on_an_empty_table(spark, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{SF_DIR}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_copies_by_five_words_and_four_fifths(spark, table):
    r, rows = random.Random(15), []
    for g in range(30):
        base = [r.choice("abcdefgh") + str(r.randrange(500)) for _ in range(r.randint(50, 150))]
        for i in range(4):
            w = list(base)
            for _ in range(i * len(w) // 100):
                w[r.randrange(len(w))] = "changed"
            rows.append((10 * g + i, " ".join(w), "s"))
    r.shuffle(rows)

    def kept(k, percent):
        sets = {d: frozenset(zip(*(words(t)[i:] for i in range(k)), strict=False)) for d, t, _ in rows}
        top = {d: d for d in sets}
        for a in sorted(sets):
            for b in sorted(sets):
                if a < b and top[a] != top[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    low, high = sorted((top[a], top[b]))
                    top = {d: low if t == high else t for d, t in top.items()}
        return set(top.values())
    got = [x.doc_id for x in corpus_pipeline.jaccard_join(spark, table(rows), SF_DIR).collect()]
    assert sorted(got) == sorted(kept(5, 80)) and kept(5, 80) != kept(4, 85)
