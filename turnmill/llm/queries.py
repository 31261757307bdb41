"""Registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .html_extract import op8_html_extraction
from .license_scan import op1_license_scan
from .mixing import op7_mixing
from .ordinal_toxicity import op2_toxicity
from .packing import op6_packing
from .pu_quality import op10_quality_classifier
from .quality_rules import RULES, STOP_WORDS, op5_quality_rules
from .shard_store import op4_sharding
from .simhash_dedup import op3_simhash_near_dedup
from .topk_search import op9_topk_search


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that corpus_pipeline's stages leave of ``documents``."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_toxicity": op2_toxicity,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_sharding": op4_sharding,
    "op5_quality_rules": op5_quality_rules,
    "op6_packing": op6_packing,
    "op7_mixing": op7_mixing,
    "op8_html_extraction": op8_html_extraction,
    "op9_topk_search": op9_topk_search,
    "op10_quality_classifier": op10_quality_classifier,
    "pipeline": pipeline,
}

_BOUNDS = " AND ".join(
    f"(n_words < {words} OR {m} {sign} {bound})"
    for m, least, most, words in RULES for sign, bound in ((">=", least), ("<=", most)) if bound is not None
)
_STOPS = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))

ORACLES = {
    "op5_quality_rules": rf"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
win AS (
  SELECT r, i, array_to_string(ws[i:i + 4], ' ') AS g
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM t)),
twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
rep AS (
  SELECT r, count(DISTINCT i + k) AS n FROM twice, range(0, 5) AS o(k) GROUP BY r),
m AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) AS BIGINT) AS n_lines,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
         len(list_filter(ws, lambda w: lower(w) IN ({_STOPS}))) AS stops,
         len(list_filter(ws, lambda w: regexp_matches(w, '[#*$%&|<>]'))) AS symbol_words,
         len(list_filter(ws, lambda w: ends_with(w, '!!'))) AS bang_words
  FROM t LEFT JOIN rep USING (r)),
q AS (
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
         word_chars / greatest(n_words, 1)::DOUBLE AS mean_word_chars,
         n_symbols / greatest(word_chars, 1)::DOUBLE AS symbol_char_ratio,
         symbol_words / greatest(n_words, 1)::DOUBLE AS symbol_word_ratio,
         bang_words / greatest(n_words, 1)::DOUBLE AS bang_word_ratio,
         n_dup_lines / greatest(n_lines, 1)::DOUBLE AS dup_line_ratio,
         stops / greatest(n_words, 1)::DOUBLE AS stop_word_ratio,
         n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {_BOUNDS} AS kept,
       {", ".join(f"round({r[0]}, 9) AS {r[0]}" for r in RULES)}
FROM q""",
    "op9_topk_search": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 10""",
}
