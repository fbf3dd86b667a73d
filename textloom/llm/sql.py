"""SQL of the queries that SQL can express, for DuckDB. The others are tested against
brute force, exact round trips or held-out accuracy in tests/llm."""

_TERMS = r"""
WITH n AS (SELECT count(text) AS records FROM clean_requests),
terms AS (
  SELECT request_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+')) AS term
  FROM clean_requests WHERE text IS NOT NULL
),
counted AS (
  SELECT term, count(*) AS occurrences, count(DISTINCT request_id) AS records FROM terms GROUP BY term
),
marked AS (
  SELECT term, occurrences, counted.records,
         CASE WHEN counted.records <= 1 THEN 'rare' WHEN counted.records * 5 > n.records THEN 'common' END AS mark
  FROM counted, n
)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p5_terms": _TERMS + "SELECT term, occurrences, records, mark FROM marked",
        "p5_found": _TERMS + "SELECT term, mark FROM marked WHERE mark IS NOT NULL",
        "p8_roundtrip": "SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents",
        "p8_spans": "SELECT doc_id, coalesce(length(text), 0)::INT AS covered, true AS in_order FROM documents",
    }
