"""Query of benchmark decontamination."""

from pyspark.sql import functions as F

from gridspark.llm.base import query, table
from gridspark.llm.decontaminate import contamination

SQL = r"""
WITH lowered AS (
  SELECT 'd' AS kind, doc_id AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL
  SELECT 'b', item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
tok AS (SELECT kind, id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM lowered),
items AS (SELECT id AS item_id, i, least(len(w), 13) AS size, array_to_string(w[i : i + 12], ' ') AS k
          FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM tok WHERE kind = 'b' AND len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM items),
windows AS (SELECT id, size, i, array_to_string(w[i : i + size - 1], ' ') AS k
            FROM (SELECT id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM tok, sizes WHERE kind = 'd' AND len(w) >= size)),
found AS (SELECT w.id, w.i, w.size, x.item_id FROM windows w JOIN items x ON w.size = x.size AND w.k = x.k),
hit AS (SELECT id, count(DISTINCT p) AS n FROM (SELECT id, unnest(range(i, i + size)) AS p FROM found) GROUP BY id),
ids AS (SELECT id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY id)
SELECT t.id AS doc_id, CAST(len(t.w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(s.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s.items, '')) AS items_sha256, coalesce(h.n > 0 AND 20 * h.n >= len(t.w), false) AS contaminated
FROM tok t LEFT JOIN hit h USING (id) LEFT JOIN ids s USING (id) WHERE t.kind = 'd'
"""


@query("op5_decontaminate", SQL)
def op5_decontaminate(spark, sf_dir):
    """Hit words and items of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )
