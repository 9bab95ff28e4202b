"""Queries of the corpus operators and SQL for those that SQL can express."""

from __future__ import annotations

from quarrymill.llm.alignment import op12_pair_count_alignment
from quarrymill.llm.decontamination import op1_template_decontamination
from quarrymill.llm.mixing import op9_block_mixing
from quarrymill.llm.near_dedup import op5_minhash_near_dedup
from quarrymill.llm.packing import op11_grouping_genetic_packing
from quarrymill.llm.quality import op6_additive_quality
from quarrymill.llm.resampling import op13_importance_resampling
from quarrymill.llm.scoring import op7_log_bilinear_scoring
from quarrymill.llm.sharding import op4_hash_tree_sharding
from quarrymill.llm.substring_dedup import op2_rlz_substring_dedup
from quarrymill.llm.token_counts import op3_section_token_counts
from quarrymill.llm.topk import op8_dual_tree_topk
from quarrymill.llm.toxicity import op10_subword_toxicity

QUERIES = {
    "op1_template_decontamination": op1_template_decontamination,
    "op2_rlz_substring_dedup": op2_rlz_substring_dedup,
    "op3_section_token_counts": op3_section_token_counts,
    "op4_hash_tree_sharding": op4_hash_tree_sharding,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_additive_quality": op6_additive_quality,
    "op7_log_bilinear_scoring": op7_log_bilinear_scoring,
    "op8_dual_tree_topk": op8_dual_tree_topk,
    "op9_block_mixing": op9_block_mixing,
    "op10_subword_toxicity": op10_subword_toxicity,
    "op11_grouping_genetic_packing": op11_grouping_genetic_packing,
    "op12_pair_count_alignment": op12_pair_count_alignment,
    "op13_importance_resampling": op13_importance_resampling,
}

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

#: Those that SQL can express; the others hash, draw or learn, and are tested against brute force.
ORACLE_SQL: dict[str, str] = {
    "op2_rlz_substring_dedup": f"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents
), g AS (
  SELECT doc_id, i, sha256(array_to_string(ws[i:i + 34], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)
), again AS (SELECT h FROM g GROUP BY h HAVING count(*) > 1
), gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM g WHERE h IN (SELECT h FROM again)
), p AS (SELECT doc_id, i, ws[i] AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)
), k AS (
  SELECT p.doc_id, count(*) AS n_kept, string_agg(p.word, ' ' ORDER BY p.i) AS kept
  FROM p LEFT JOIN gone ON p.doc_id = gone.doc_id AND p.i = gone.i WHERE gone.i IS NULL GROUP BY p.doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id
""",
    "op5_minhash_near_dedup": f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS h FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT pair.a, pair.b FROM pair JOIN n x ON x.doc_id = pair.a JOIN n y ON y.doc_id = pair.b WHERE 100 * pair.n >= 85 * (x.n + y.n - pair.n)
), e AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (SELECT a AS root, b AS node FROM e UNION SELECT reach.root, e.b FROM reach JOIN e ON reach.node = e.a
), c AS (SELECT root AS doc_id, min(node) AS least FROM reach GROUP BY root)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(c.least, w.doc_id)) AS component_id,
  w.doc_id = least(w.doc_id, coalesce(c.least, w.doc_id)) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.doc_id = w.doc_id
""",
    "op13_importance_resampling": r"""
WITH RECURSIVE bits AS (
  SELECT range AS i, range AS c, 0 AS k FROM range(256)
  UNION ALL SELECT i, xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END), k + 1 FROM bits WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8
), plain AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM (SELECT doc_id, text FROM documents UNION ALL SELECT NULL, text FROM benchmark)
), numbered AS (SELECT row_number() OVER () AS r, doc_id, ws FROM plain
), f AS (SELECT r, doc_id IS NULL AS target, unnest(ws) AS word FROM numbered
), kinds AS (SELECT DISTINCT word, hex(encode(word)) AS h FROM f
), hashed AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(h), 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT))),
    lambda a, b: xor(a >> 8, t[xor(a, b) % 256 + 1])), 4294967295) % 10000 AS bucket
  FROM kinds CROSS JOIN crc
), n AS (SELECT bucket, count(*) FILTER (NOT target) AS s, count(*) FILTER (target) AS t FROM f JOIN hashed USING (word) GROUP BY bucket
), g AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST((SELECT sum(s) FROM n) + 10000 AS DOUBLE)
    / (CAST(s + 1 AS DOUBLE) * CAST((SELECT sum(t) FROM n) + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM n
), w AS (
  SELECT r, CAST(sum(gain) AS BIGINT) AS weight FROM f JOIN hashed USING (word) JOIN g USING (bucket) WHERE NOT target GROUP BY r
), d AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM numbered LEFT JOIN w USING (r) WHERE doc_id IS NOT NULL
), drawn AS (
  SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS place FROM d
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT count(*) FROM d WHERE n_features >= 20) * 10 // 100 THEN place END AS rank FROM drawn
""",
    "op8_dual_tree_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
""",
}
