"""Registered queries of this subpackage, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reachgrid.llm import chat, collocations, decontaminate, index, jaccard, katz, lines, mixing, quality, repeats, secrets, spelling, transducer
from reachgrid.llm.words import documents


def op1_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(documents(spark, sf_dir))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(documents(spark, sf_dir)).drop("kept_text")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transducer.token_counts(documents(spark, sf_dir), public_tokenizers.path(transducer.VOCABULARY))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source", "epochs")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("_key")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir)).drop("_row")


def op7_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = index.write_index(documents(spark, sf_dir), public_tokenizers.path(index.VOCABULARY))
    return index.read_digests(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32", "copy")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_groups(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir))


def op10_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    forged = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(
        "assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat.digests(chat.windows(turns.unionByName(forged)))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir)).drop("cut", "words")


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.sha2(F.when(F.col("n_dropped") > 0, lines.kept_text(F.col("text"), F.col("keep"))).otherwise(F.coalesce("text", F.lit(""))), 256)
    return lines.keep_bitmaps(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", kept.alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_katz_scores, op2_substring_dedup, op3_token_counts, op4_source_mixing, op5_decontamination, op6_quality_rules, op7_token_index, op8_jaccard_join, op9_secret_scan, op10_chat_windows, op11_spelling_variants, op12_phrase_collocations, op13_line_dedup)}
BLANKS = r"[\x20\x09-\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SQL: dict[str, str] = {
    "op11_spelling_variants": rf"""
        WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda v: list_reduce(list_prepend(v, range(8)), lambda c, k:
                 CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
        u AS (SELECT d, run, count(*) AS k FROM (SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest(regexp_extract_all(
                 translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[a-zÀ-ÿ]{{6,}}')) AS run FROM documents) GROUP BY ALL),
        x AS (SELECT run, k, hex(encode(d || ':' || run)) AS hx FROM u),
        h AS (SELECT run, k, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(length(hx) // 2), lambda i: ('0x' || hx[2 * i + 1:2 * i + 2])::BIGINT)),
                 lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) AS h FROM x CROSS JOIN t),
        v AS (SELECT CASE WHEN h % 199 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, k FROM h),
        w AS (SELECT word, sum(k)::BIGINT AS n FROM v WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
        m AS (SELECT word, n, i, word[:i - 1] AS a, word[i + 1:] AS b FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
        o AS (SELECT m.word, m.n, w.word AS near, w.n AS near_n FROM m JOIN w ON w.word = m.a || m.b),
        p AS (SELECT x.word, x.n, y.word AS near, y.n AS near_n FROM m x JOIN m y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
              UNION SELECT * FROM o UNION SELECT near, near_n, word, n FROM o),
        f AS (SELECT word, any_value(n) AS n, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS form, max(near_n) AS form_n FROM p GROUP BY word),
        g AS (SELECT word, form, form_n FROM f WHERE form_n >= 5 * n),
        c AS (SELECT word, form AS root FROM g UNION ALL SELECT c.word, g.form FROM c JOIN g ON g.word = c.root),
        z AS (SELECT word, root FROM c WHERE root NOT IN (SELECT word FROM g))
        SELECT w.word, g.form, coalesce(z.root, w.word) AS root, w.n, coalesce(f.n_near, 0) AS n_near, g.form_n
        FROM w LEFT JOIN f ON f.word = w.word LEFT JOIN g ON g.word = w.word LEFT JOIN z ON z.word = w.word""",
    "op12_phrase_collocations": rf"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'),
                                                                                     '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
        s AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
        c AS (SELECT lang, unnest([{{'w1': w[i], 'w2': NULL, 'w3': NULL}}, {{'w1': w[i], 'w2': w[i + 1], 'w3': NULL}},
                                   {{'w1': w[i], 'w2': w[i + 1], 'w3': w[i + 2]}}][1:len(w) - i + 1], recursive := true) FROM s),
        f AS (SELECT lang, w1, w2, w3, count(*) AS f FROM c GROUP BY ALL),
        n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE w2 IS NULL GROUP BY lang),
        f1 AS (SELECT lang, w1 AS w, f FROM f WHERE w2 IS NULL), f2 AS (SELECT lang, w1, w2, f FROM f WHERE w2 IS NOT NULL AND w3 IS NULL AND f >= 10),
        f3 AS (SELECT lang, w1, w2, w3, f FROM f WHERE w3 IS NOT NULL AND f >= 10),
        g AS (SELECT lang, w1, w2, max(f) AS m FROM (SELECT lang, w1, w2, f FROM f3 UNION ALL SELECT lang, w2, w3, f FROM f3) GROUP BY ALL),
        k AS (SELECT f2.lang, f2.w1 || ' ' || f2.w2 AS phrase, f2.f AS a, x.f AS l, y.f AS r, 1 AS k
              FROM f2 JOIN f1 x ON x.lang = f2.lang AND x.w = f2.w1 JOIN f1 y ON y.lang = f2.lang AND y.w = f2.w2 LEFT JOIN g ON g.lang = f2.lang AND g.w1 = f2.w1 AND g.w2 = f2.w2
              WHERE 100 * coalesce(m, 0) < 50 * f2.f
              UNION ALL SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || w3, f3.f, x.f, y.f, 1
              FROM f3 JOIN f1 x ON x.lang = f3.lang AND x.w = f3.w1 JOIN f2 y ON y.lang = f3.lang AND y.w1 = f3.w2 AND y.w2 = f3.w3
              UNION ALL SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || w3, f3.f, x.f, y.f, 2
              FROM f3 JOIN f2 x ON x.lang = f3.lang AND x.w1 = f3.w1 AND x.w2 = f3.w2 JOIN f1 y ON y.lang = f3.lang AND y.w = w3),
        o AS (SELECT *, (1000000::HUGEINT * a * a // (l::HUGEINT * r))::BIGINT AS score FROM k),
        b AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM b)
        SELECT lang, rank, phrase, a, l, r, n, score FROM t JOIN n USING (lang) WHERE rank <= 2000""",
    "op13_line_dedup": rf"""
        WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                          generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
        k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^{BLANKS}+', ''), '{BLANKS}+$', ''), '{UPPER}', '{UPPER.lower()}') AS key FROM l),
        c AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
        m AS (SELECT k.*, c.key IS NOT NULL AS gone FROM k LEFT JOIN c ON k.key = c.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM m GROUP BY doc_id""",
}
