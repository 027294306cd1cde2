"""The registered queries of the training-data operators, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontam, htmltext, mixing, phrases, pii, quality, runs, sharding, simhash, suffix, tokencount, toxicity, vafile
from .common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.recount_rows(tokencount.planned_edits(table(spark, sf_dir, "documents")))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.site_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_vector_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.top_k(table(spark, sf_dir, "embeddings"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents"), with_text=False)


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digest(runs.periodic_runs(table(spark, sf_dir, "documents"), runs.planted))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.personal_data(table(spark, sf_dir, "documents")))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.top_phrases(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_simhash, op3_quality, op4_decontamination, op5_vector_top_k,
        op6_suffix_dedup, op7_html_text, op8_sharding, op9_mixing, op10_toxicity,
        op11_periodic_runs, op12_personal_data, op13_phrases,
    )
}

ORACLES = {
    "op4_decontamination": r"""
        WITH d AS (
          SELECT row_number() OVER () AS r, doc_id,
                 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
          FROM documents
        ), b AS (
          SELECT item_id,
                 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
          FROM benchmark
        ), bw AS (
          SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g
          FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS t(i) WHERE len(w) > 0
        ), lens AS (SELECT DISTINCT n FROM bw),
        dw AS (
          SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
          FROM d, lens, unnest(range(1, len(w) - n + 2)) AS t(i)
        ), hits AS (SELECT r, dw.n, i, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
        pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM hits)) GROUP BY r),
        its AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY r)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
    """,
    "op5_vector_top_k": """
        WITH v AS (
          SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
          FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
          SELECT q.n AS query, q.vec_id AS query_id, c.vec_id AS vec_id,
                 coalesce(CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT), 0) AS score
          FROM v q, v c WHERE q.vec_id % 100 = 0 AND q.n <> c.n
        ), r AS (
          SELECT query_id, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank, vec_id, score FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
    """,
    "op13_phrases": r"""
        WITH p AS (
          SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM (
            SELECT coalesce(lang, 'und') AS lang,
                   unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents)
        ), words AS (SELECT lang, sum(len(w)) AS n FROM p GROUP BY lang),
        g AS (
          SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase, count(*) AS a
          FROM p, unnest(range(1, 6)) AS x(m), unnest(range(1, len(w) - m + 2)) AS y(i) GROUP BY lang, m, phrase HAVING count(*) >= 100
        ), c AS (SELECT lang, phrase, m, a, string_split(phrase, ' ') AS w FROM g WHERE m > 1),
        cuts AS (
          SELECT c.lang, c.phrase, c.a, k, l.a AS l, r.a AS r, words.n,
                 (1000 :: HUGEINT * c.a * words.n) // (l.a :: HUGEINT * r.a) AS score
          FROM c, unnest(range(1, c.m)) AS x(k), g AS l, g AS r, words
          WHERE l.lang = c.lang AND l.phrase = array_to_string(w[1 : k], ' ') AND r.lang = c.lang AND r.phrase = array_to_string(w[k + 1 : c.m], ' ') AND words.lang = c.lang
        ), best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        inside AS (
          SELECT lang, array_to_string(w[i : i + s - 1], ' ') AS phrase, max(a) AS longer
          FROM c, unnest(range(2, m)) AS x(s), unnest(range(1, m - s + 2)) AS y(i) GROUP BY 1, 2
        ), ranked AS (
          SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
          FROM best LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR longer < a
        )
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
    """,
}
