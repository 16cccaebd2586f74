"""The subpackage's queries and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op4_bpe_encoding
from .chat import op6_chat_formatting
from .cotraining import op2_quality_classifier
from .decontamination import op10_benchmark_decontamination
from .near_duplicates import op7_minhash_near_dedup
from .passage_dedup import op1_substring_dedup
from .quality_rules import op9_quality_rules, score_documents
from .suffix_dedup import op3_suffix_array_dedup
from .token_counts import op5_token_counts
from .toxicity import op8_toxicity


def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the quality rules that SQL can express."""
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_suffix_array_dedup": op3_suffix_array_dedup,
    "op4_bpe_encoding": op4_bpe_encoding,
    "op5_token_counts": op5_token_counts,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_quality_rules": op9_quality_rules,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "quality_base_counts": quality_base_counts,
}

_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

ORACLE_SQL: dict[str, str] = {
    "op3_suffix_array_dedup": """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), pieces AS (SELECT doc_id, b, substr(x, 2 * b + 1, 1098) AS y FROM (SELECT doc_id, x, unnest(generate_series(0, n - 50, 500)) AS b FROM h WHERE n >= 50)
), w AS (SELECT doc_id, b + j AS i, substr(y, 2 * j + 1, 100) AS g FROM (SELECT doc_id, b, y, unnest(generate_series(0, least(500, length(y) // 2 - 49) - 1)) AS j FROM pieces)
), m AS (SELECT g, min(doc_id) AS least FROM w GROUP BY g HAVING min(doc_id) <> max(doc_id)
), r AS (SELECT DISTINCT w.doc_id, i FROM w JOIN m USING (g) WHERE least < w.doc_id
), l AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM r
), s AS (SELECT doc_id, i, sum(CASE WHEN i - p <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM l
), spans AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS e FROM s GROUP BY doc_id, k
), cuts AS (
  SELECT doc_id, a, substr(x, 2 * coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 0) + 1, 2 * (a - coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 0))) AS piece, e, x, n
  FROM spans JOIN h USING (doc_id)
), left_over AS (
  SELECT doc_id, sum(e - a) AS removed, count(*) AS spans, string_agg(piece, '' ORDER BY a) || substr(any_value(x), 2 * max(e) + 1) AS x FROM cuts GROUP BY doc_id
)
SELECT h.doc_id, CAST(h.n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(left_over.x, h.x))) AS kept_sha256
FROM h LEFT JOIN left_over USING (doc_id)
""",
    "op6_chat_formatting": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), e AS (
  SELECT *, length(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g')) + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) + 32 AS n FROM c
), g AS (
  SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
         CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
         sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
         CAST(sum(n) AS BIGINT) AS formatted_chars
  FROM e GROUP BY conv_id
) SELECT * FROM g
""",
    "op7_minhash_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS g FROM w)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 75 * (nx.n + ny.n - i)
), b AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e
), r AS (SELECT doc_id AS a, doc_id AS z FROM w UNION SELECT r.a, b.y FROM r JOIN b ON r.z = b.x
), c AS (SELECT a, min(z) AS c FROM r GROUP BY a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c AS component_id, w.doc_id = c AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN c ON c.a = w.doc_id
""",
    "quality_base_counts": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM d WHERE len(w) >= 5)
), m AS (SELECT doc_id, g FROM g GROUP BY 1, 2 HAVING count(*) > 1
), r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT g.doc_id, unnest(generate_series(i, i + 4)) AS p FROM g JOIN m ON g.doc_id = m.doc_id AND g.g = m.g) GROUP BY 1
), l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d
), c AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM d JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)
) SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c
""",
    "op10_benchmark_decontamination": rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)
), ks AS (SELECT DISTINCT k FROM bw), dw AS (
  SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, ks WHERE len(w) >= k)
), hit AS (SELECT doc_id, i, bw.k, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g
), covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM hit) GROUP BY doc_id
), found AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(found.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(found.ids, '')) AS items_sha256, coalesce(covered.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
""",
}
