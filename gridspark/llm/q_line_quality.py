"""Query of the quality rules."""

from gridspark.llm.base import query, table
from gridspark.llm.line_quality import MAX_DOCS_PER_LINE, MAX_PERCENT_PER_LINE, MIN_LEFT_PERCENT, quality_rules

# Words are code point runs without white space; windows repeat if their three words are equal.
SQL = f"""
WITH src AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
tok AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') AS w,
               list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]')) AS ls, text FROM src),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM tok)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
counts AS (SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
                  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
           FROM tok t LEFT JOIN cov c USING (doc_id)),
verdict AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM counts),
dl AS (SELECT s.doc_id, s.source, s.text, x,
              lower(trim(regexp_replace(x, '[ \\t\\x0B\\f\\r]+', ' ', 'g'), ' ')) AS line,
              len(list_filter(regexp_split_to_array(x, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')) AS n
       FROM (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS x FROM src) s
       WHERE regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]')),
hosts AS (SELECT source, count(DISTINCT doc_id) AS host_docs FROM documents GROUP BY source),
freq AS (SELECT l.source, line, first_doc FROM (SELECT source, line, min(doc_id) AS first_doc, count(DISTINCT doc_id) AS n_docs FROM dl GROUP BY source, line) l
         JOIN hosts h ON l.source IS NOT DISTINCT FROM h.source WHERE n_docs > {MAX_DOCS_PER_LINE} AND 100 * n_docs > {MAX_PERCENT_PER_LINE} * host_docs),
gone AS (SELECT dl.doc_id, sum(n) AS n FROM dl JOIN freq f ON dl.source IS NOT DISTINCT FROM f.source AND dl.line = f.line
         WHERE dl.doc_id <> f.first_doc GROUP BY dl.doc_id)
SELECT v.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       CAST(n_words - coalesce(g.n, 0) AS BIGINT) AS n_words_left,
       (NOT base_failed AND 100 * (n_words - coalesce(g.n, 0)) >= {MIN_LEFT_PERCENT} * n_words) AS kept
FROM verdict v LEFT JOIN gone g USING (doc_id)
"""


@query("op10_line_quality", SQL)
def op10_line_quality(spark, sf_dir):
    """Counts and verdict of every document."""
    return quality_rules(table(spark, sf_dir, "documents")).drop("text", "lang", "source", "n_chars", "clean_text")
