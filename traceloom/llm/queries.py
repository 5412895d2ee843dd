"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import additive, backoff, bpe, hamming, langid, mixing, neardup, packing, quality, secret_links

NEARDUP_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS sh FROM w),
u AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY 1)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN c ON c.a = s.doc_id
"""


def pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_hamming_topk": hamming.query,
    "op2_quality_grades": quality.query,
    "op3_additive_ann": additive.query,
    "op4_secret_links": secret_links.query,
    "op5_backoff_lm": backoff.query,
    "op6_packed_rows": packing.query,
    "op7_byte_bpe": bpe.query,
    "op8_source_mix": mixing.query,
    "op9_near_duplicates": neardup.query,
    "op10_language": langid.query,
    "pipeline": pipeline,
}

ORACLE_SQL = {"op1_hamming_topk": hamming.ORACLE, "op5_backoff_lm": backoff.ORACLE, "op8_source_mix": mixing.ORACLE, "op9_near_duplicates": NEARDUP_SQL}
