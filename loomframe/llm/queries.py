"""The queries of the corpus operators, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from . import decontaminate, exact_topk, language, licenses, main_text, packing, quality, simhash, token_files, token_histogram
from .common import fold, ship


def table(spark, sf_dir, name):
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_histogram(spark, sf_dir):
    return token_histogram.length_histogram(table(spark, sf_dir, "documents"))


def op2_attention_quality(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.learned(docs, labels.where(fold("doc_id", 5) != 0))
    return quality.scored(docs, model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op3_token_wavelet(spark, sf_dir):
    return token_files.token_digest(table(spark, sf_dir, "documents"))


def op4_wu_manber(spark, sf_dir):
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_line_blocks(spark, sf_dir):
    return main_text.main_text(table(spark, sf_dir, "pages"))


def op6_ppm_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    trees = language.learned(docs.where(fold("doc_id", 3) != 1))
    return language.identified(docs, trees).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op7_exact_topk(spark, sf_dir):
    return exact_topk.top_k(table(spark, sf_dir, "embeddings"))


def op8_rare_word_index(spark, sf_dir):
    return licenses.licence_marks(table(spark, sf_dir, "documents"))


def op9_simhash_trie(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_pattern_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    ship(spark)
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_token_histogram, op2_attention_quality, op3_token_wavelet, op4_wu_manber, op5_line_blocks, op6_ppm_language, op7_exact_topk, op8_rare_word_index, op9_simhash_trie, op10_pattern_packing, pipeline)}
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: By query; the others need tokenizers, trained models, XXH64 or an HTML parser, which SQL has not.
ORACLE_SQL: dict[str, str] = {
    "op4_wu_manber": f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS k, {_WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
p AS (SELECT DISTINCT item, m, w[s:s + m - 1] AS win FROM (SELECT item, w, m, UNNEST(range(1, len(w) - m + 2)) AS s FROM (SELECT item, w, least(13, len(w)) AS m FROM i WHERE len(w) > 0))),
x AS (SELECT k, s, m, w[s:s + m - 1] AS win FROM (SELECT k, w, m, UNNEST(range(1, len(w) - m + 2)) AS s FROM d, (SELECT DISTINCT m FROM p) WHERE len(w) >= m)),
h AS (SELECT x.k, x.s, x.m, p.item FROM x JOIN p ON x.m = p.m AND x.win = p.win),
n AS (SELECT k, count(DISTINCT word) AS n_hit FROM (SELECT k, UNNEST(range(s, s + m)) AS word FROM (SELECT DISTINCT k, s, m FROM h)) GROUP BY k),
g AS (SELECT k, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS sha FROM (SELECT DISTINCT k, item FROM h) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(sha, sha256('')) AS items_sha256,
coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN n USING (k) LEFT JOIN g USING (k)""",
    "op7_exact_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 5""",
}
