"""WARC not-modified records: each takes its content from the latest earlier full response of its canonical url.

``resolve_revisits`` joins captures to themselves as of their time. A full response is a capture with a payload; a revisit has none. The response that counts is
the latest one before the revisit, by (time, record id). It is accepted if no validator contradicts it: payload digests must be equal
where both have one, entity tags must agree by weak comparison where both have one, and else Last-Modified must agree where
both have it; a revisit without any common validator is taken as ``unchecked``. Headers of the revisit replace those of the response only
where the 304 status permits it (``PERMITTED``); all others stay as stored.

How it scales: captures are dealt by ranges of (url, time, record id), so a url with a third of all captures spreads
over many ranges. Inside a range the latest response is a window over the rows of one url; what a range inherits comes from
one row per url and range that precedes it. Payloads do not move: the window carries record ids and
validators; the payload stays behind its id.

Defined results: a null url or time cannot be resolved (``no_source``). Equal times go by record id; a response at the time of the revisit with a
smaller id counts as earlier. Repeated rows are resolved one by one. A null header map is an empty one. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The header fields that a not-modified response may update.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]


def canonical_url(url: Column) -> Column:
    """A url without scheme, www, default port, fragment and trailing slash; host in lower case, query parameters sorted."""
    bare = F.regexp_replace(url, "#.*$", "")
    rest = F.regexp_replace(bare, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.translate(F.regexp_extract(rest, "^([^/?]*)", 1), UPPER, LOWER), "^www\\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(rest, "\\?(.*)$", 1)
    pairs = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: p != "")), "&")
    return F.concat(host, path, F.when(pairs != "", F.concat(F.lit("?"), pairs)).otherwise(""))


def latest_response(captures: DataFrame, partitions: int | None = None) -> DataFrame:
    """(key, time, record_id, source) rows with ``source`` replaced by that of the latest row before it that has one."""
    n = partitions or int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = captures.repartitionByRange(n, "key", "time", "record_id").withColumn("_w_part", F.spark_partition_id())
    ranged = cut_lineage(ranged)
    order = ["time", "record_id"]
    inside = Window.partitionBy("_w_part", "key").orderBy(*order)
    ends = ranged.groupBy("key", "_w_part").agg(F.max_by("source", F.when(F.col("source").isNotNull(), F.struct(*order))).alias("_w_last"))
    earlier = Window.partitionBy("key").orderBy("_w_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("key", "_w_part", F.last("_w_last", ignorenulls=True).over(earlier).alias("_w_carried"))
    own = F.last("source", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    return ranged.withColumn("_w_own", own).join(carried, ["key", "_w_part"]).withColumn("source", F.coalesce("_w_own", "_w_carried"))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def _verdict(digest: Column, headers: Column, source: Column) -> Column:
    """How the validators of a revisit and of its source compare."""
    tag, source_tag = _weak(headers["etag"]), _weak(source["headers"]["etag"])
    date, source_date = headers["last-modified"], source["headers"]["last-modified"]
    return (
        F.when(source.isNull(), "no_source")
        .when(digest != source["digest"], "digest_differs")
        .when(tag != source_tag, "etag_differs")
        .when((tag.isNull() | source_tag.isNull()) & (date != source_date), "date_differs")
        .when(digest.isNotNull() & source["digest"].isNotNull() | tag.isNotNull() & source_tag.isNotNull() | date.isNotNull() & source_date.isNotNull(), "resolved")
        .otherwise("unchecked")
    )


def merge_headers(stored: Column, fresh: Column, permitted: list[str] = PERMITTED) -> Column:
    """The stored headers, with the permitted fields of the fresh ones."""
    allowed = F.map_filter(fresh, lambda k, v: k.isin(permitted) & v.isNotNull())
    kept = F.map_filter(stored, lambda k, v: ~F.array_contains(F.map_keys(allowed), k))
    return F.map_concat(kept, allowed)


def resolve_revisits(captures: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rows (record_id, url, time, kind, digest, headers) with key, source_id, status and merged headers.

    ``kind`` is ``response`` or ``revisit``; header names are in lower case. Responses have the status ``response`` and their own id.
    """
    empty = F.create_map().cast("map<string,string>")
    rows = captures.select(
        "record_id", "time", "kind", "digest", F.coalesce("headers", empty).alias("headers"), canonical_url(F.col("url")).alias("key")
    )
    full = F.col("kind") == "response"
    source = F.struct(F.col("record_id").alias("id"), "digest", "headers")
    rows = rows.withColumn("source", F.when(full & F.col("key").isNotNull() & F.col("time").isNotNull(), source))
    known = rows.filter(F.col("key").isNotNull() & F.col("time").isNotNull())
    lost = rows.filter(F.col("key").isNull() | F.col("time").isNull())
    columns = ["record_id", "key", "time", "kind", "digest", "headers", "source"]
    joined = latest_response(known, partitions).select(*columns).unionByName(lost.select(*columns))
    status = F.when(full, "response").otherwise(_verdict(F.col("digest"), F.col("headers"), F.col("source")))
    taken = F.col("status").isin("resolved", "unchecked")
    return joined.withColumn("status", status).select(
        "record_id",
        "key",
        "time",
        "kind",
        "status",
        F.when(full, F.col("record_id")).when(taken, F.col("source")["id"]).alias("source_id"),
        F.when(taken, merge_headers(F.col("source")["headers"], F.col("headers"))).otherwise(F.col("headers")).alias("headers"),
    )
