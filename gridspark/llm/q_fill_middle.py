"""Query of the fill-in-the-middle transformation."""

from pyspark.sql import functions as F

from gridspark.llm.base import query, table
from gridspark.llm.fill_middle import fill_in_middle, restore

SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
             sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
d AS (SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS UBIGINT) % (len(u) + 1) AS h1, CAST('0x' || h[9:16] AS UBIGINT) % (len(u) + 1) AS h2,
             CAST('0x' || h[25:32] AS UBIGINT) % 100 AS h4 FROM t),
p AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN h4 < 50 THEN 'spm' ELSE 'psm' END AS form,
             array_to_string(u[1 : least(h1, h2)], '') AS prefix, array_to_string(u[least(h1, h2) + 1 : greatest(h1, h2)], '') AS middle,
             array_to_string(u[greatest(h1, h2) + 1 : n], '') AS suffix FROM d)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""


@query("op13_fill_middle", SQL)
def op13_fill_middle(spark, sf_dir):
    """Form, sizes and digests of every document, and of the text rebuilt from what was put out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = restore(fill_in_middle(docs).select("doc_id", "n_units", "form", "prefix_chars", "middle_chars", "output"))
    return out.select(
        "doc_id",
        F.col("n_units").alias("n"),
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2("restored", 256).alias("restored_sha256"),
    )
