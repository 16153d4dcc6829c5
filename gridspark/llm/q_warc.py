"""Query of revisit resolution, on captures that are derived from the pages."""

from pyspark.sql import functions as F

from gridspark.llm.base import query, table
from gridspark.llm.warc_revisit import resolve_revisits

# Every page is captured up to four times as a full response, 45 seconds apart, and is visited up to three times more: a while later, between
# two responses, or before all of them (every 11th), under a spelling of its url that has the same canonical form. Every third page has the same url,
# the front page of one host. Digests of every 5th revisit differ, every 5th has none; every 7th has another entity tag, every 3rd none.
CAPTURES = """
WITH named AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'https://front.example/' ELSE url END AS url, {bytes} AS bytes FROM pages),
copies AS (SELECT *, explode(sequence(0, CAST(page_id % 4 AS INT))) AS k FROM named),
again AS (SELECT *, explode(sequence(0, CAST(page_id % 3 AS INT))) AS k FROM named)
SELECT page_id * 16 + k AS record_id, url, page_id * 60 + k * 45 AS time, 'response' AS kind, md5(bytes) AS digest, page_id AS p FROM copies
UNION ALL
SELECT page_id * 16 + 8 + k, replace(replace(url, 'https://', 'http://'), '://', '://WWW.') || '#again',
       CASE WHEN page_id % 11 = 0 THEN page_id * 60 - 30 - k ELSE page_id * 60 + 20 + k * 50 * (1 + page_id % 50) END, 'revisit',
       CASE WHEN (page_id + k) % 5 = 0 THEN md5('changed') WHEN (page_id + k) % 5 = 1 THEN NULL ELSE md5(bytes) END, page_id
FROM again
"""
DUCK_CAPTURES = CAPTURES.replace("explode(sequence(0, CAST(page_id % 4 AS INT)))", "unnest(range(page_id % 4 + 1))").replace(
    "explode(sequence(0, CAST(page_id % 3 AS INT)))", "unnest(range(page_id % 3 + 1))"
)
NAMES = ["cache-control", "content-type", "date", "etag", "expires", "last-modified", "set-cookie"]
FIRST = [
    "'max-age=60'",
    "'text/html'",
    "CAST(time AS {s})",
    "'W/\"' || CAST(p AS {s}) || '\"'",
    "NULL",
    "'day ' || CAST(p % 28 AS {s})",
    "'first'",
]
AGAIN = [
    "'max-age=' || CAST(p % 9 AS {s})",
    "NULL",
    "CAST(time AS {s})",
    "CASE WHEN p % 7 = 0 THEN '\"other\"' WHEN p % 3 = 0 THEN NULL ELSE '\"' || CAST(p AS {s}) || '\"' END",
    "'day ' || CAST(p % 30 AS {s})",
    "CASE WHEN p % 2 = 0 THEN 'day ' || CAST((p + p % 4) % 28 AS {s}) END",
    "'again'",
]
HEADERS = [f"CASE WHEN kind = 'response' THEN {a} ELSE {b} END" for a, b in zip(FIRST, AGAIN, strict=True)]

_COLUMNS = ", ".join(f'{h.format(s="VARCHAR")} AS "{n}"' for n, h in zip(NAMES, HEADERS, strict=True))
_MERGED = ", ".join(
    f"""CASE WHEN status IN ('resolved', 'unchecked') THEN {f'coalesce(r."{n}", f."{n}")' if n not in ('content-type', 'set-cookie') else f'f."{n}"'}
        ELSE r."{n}" END AS "{n}\""""
    for n in NAMES
)
_SHOWN = " || ".join(f"""coalesce('{n}=' || "{n}" || ';', '')""" for n in NAMES)
SQL = f"""
WITH captures AS ({DUCK_CAPTURES.format(bytes="html")}),
parts AS (SELECT *, regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM captures),
named AS (SELECT record_id, time, kind, digest, p,
    regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^www\\.|:(80|443)$', '', 'g')
    || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '')
    || coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '\\?(.*)$', 1), '&'), lambda x: x <> '')), '&'), ''), '') AS key
  FROM parts),
full_rows AS (SELECT *, {_COLUMNS} FROM named),
latest AS (SELECT r.record_id, arg_max(f.record_id, (f.time, f.record_id)) AS source FROM full_rows r JOIN full_rows f
           ON r.kind = 'revisit' AND f.kind = 'response' AND r.key = f.key AND (f.time, f.record_id) < (r.time, r.record_id) GROUP BY r.record_id),
judged AS (SELECT r.record_id, l.source,
    CASE WHEN r.kind = 'response' THEN 'response' WHEN f.record_id IS NULL THEN 'no_source' WHEN r.digest <> f.digest THEN 'digest_differs'
         WHEN ltrim(r.etag, 'W/') <> ltrim(f.etag, 'W/') THEN 'etag_differs'
         WHEN (r.etag IS NULL OR f.etag IS NULL) AND r."last-modified" <> f."last-modified" THEN 'date_differs'
         WHEN (r.digest IS NOT NULL AND f.digest IS NOT NULL) OR (r.etag IS NOT NULL AND f.etag IS NOT NULL)
              OR (r."last-modified" IS NOT NULL AND f."last-modified" IS NOT NULL) THEN 'resolved' ELSE 'unchecked' END AS status
  FROM full_rows r LEFT JOIN latest l USING (record_id) LEFT JOIN full_rows f ON f.record_id = l.source),
merged AS (SELECT r.record_id, r.key, r.time, r.kind, j.status,
    CASE WHEN r.kind = 'response' THEN r.record_id WHEN j.status IN ('resolved', 'unchecked') THEN j.source END AS source_id, {_MERGED}
  FROM full_rows r JOIN judged j USING (record_id) LEFT JOIN full_rows f ON f.record_id = j.source)
SELECT record_id, key, time, kind, status, source_id, {_SHOWN} AS headers FROM merged
"""


@query("op1_warc_revisit", SQL)
def op1_warc_revisit(spark, sf_dir):
    """Every capture with the response that stands for it and its headers."""
    rows = spark.sql(CAPTURES.replace("FROM pages", "FROM {pages}").format(bytes="html", pages="{pages}"), pages=table(spark, sf_dir, "pages"))
    named = F.create_map(*[x for n, h in zip(NAMES, HEADERS, strict=True) for x in (F.lit(n), F.expr(h.format(s="STRING")))])
    found = resolve_revisits(rows.withColumn("headers", F.map_filter(named, lambda k, v: v.isNotNull())))
    shown = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"], F.lit(";"))))
    return found.withColumn("headers", F.array_join(shown, ""))
