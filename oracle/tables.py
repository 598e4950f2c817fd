"""DuckDB SQL of the operators that take their terms, phrases, weights or tiers from a table."""

from __future__ import annotations

TERM_TABLE = r"""
w AS (SELECT regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM benchmark),
ab AS (SELECT unnest(list_transform(w, lambda a, i: {'a': a, 'b': w[i + 1]}), recursive := true) FROM w),
terms AS (
  SELECT DISTINCT mode, term FROM (
    SELECT 'word' AS mode, a AS term FROM ab UNION ALL SELECT 'word', a || ' ' || b FROM ab UNION ALL SELECT 'word', a || ', ' || b FROM ab
    UNION ALL SELECT 'substring', substr(a, 2, 4) FROM ab WHERE length(a) > 4
    UNION ALL SELECT 'substring', right(a, 2) || ' ' || left(b, 2) FROM ab
    UNION ALL SELECT 'substring', right(a, 2) || '. ' || left(b, 1) FROM ab) WHERE term IS NOT NULL)"""


def marked(text: str) -> str:
    """Every word between two marks, so that a whole word is a plain piece of text."""
    return f"regexp_replace({text}, '([\\p{{L}}\\p{{N}}_]+)', chr(1) || '\\1' || chr(2), 'g')"


TERM_TABLE_HITS = f"""WITH {TERM_TABLE},
docs AS MATERIALIZED (SELECT doc_id, lower(text) AS t, {marked('lower(text)')} AS m FROM documents),
single AS (
  SELECT doc_id, word AS term, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(t, '[\\p{{L}}\\p{{N}}_]+')) AS word FROM docs)
  GROUP BY ALL),
others AS MATERIALIZED (SELECT mode, term, {marked('term')} AS m FROM terms WHERE contains(term, ' ')),
pieces AS MATERIALIZED (SELECT mode, term FROM terms WHERE mode = 'substring'),
counted AS (
  SELECT doc_id, term, mode, (length(t) - length(replace(t, term, ''))) // length(term) AS n FROM docs JOIN pieces ON contains(t, term)
  UNION ALL SELECT doc_id, term, mode, (length(docs.m) - length(replace(docs.m, others.m, ''))) // length(others.m)
  FROM docs JOIN others ON contains(docs.m, others.m) WHERE mode = 'word')
SELECT doc_id, term, mode, n::BIGINT AS n FROM counted
UNION ALL SELECT doc_id, term, mode, n FROM single JOIN terms USING (term) WHERE mode = 'word'"""


ORDER_PRICE_TIERS = """WITH tiers AS (SELECT DISTINCT (p_retailprice::DOUBLE - 899) * 5000 AS lower FROM part)
SELECT o_orderkey, lower AS tier FROM (SELECT o_orderkey, o_totalprice::DOUBLE AS price FROM orders) ASOF LEFT JOIN tiers ON price >= lower"""


def table_sql() -> dict[str, str]:
    return {"term_table_hits_docs": TERM_TABLE_HITS, "order_price_tiers": ORDER_PRICE_TIERS}
