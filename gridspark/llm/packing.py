"""Best-fit packing of documents into training sequences, with conflicts.

Documents fill bins of ``capacity`` tokens. Two documents of one source or of one cluster of duplicates never share a bin: every
bin carries a bitmap of its sources and one of its clusters. Documents come in descending order of size; bins are
kept in the order of what is left in them, and the search starts at the first bin with enough room and goes on to its successors
until the tightest compatible one is found. Without one a new bin is opened.

How it scales: documents are dealt by a hash of their id into shards of about ``SHARD_DOCS``, and every shard is packed alone
as a stream of its sorted rows; hot sources and clusters spread evenly over the shards. Only ids and sizes are shuffled. The work of a shard
is bounded, and the waste is that of its last open bins.

Defined results: a document longer than the capacity is cut: whole bins of its own, then a rest that is packed like any document. A
document without tokens (null or empty text) gets one row of length 0 without a bin. A null source or cluster conflicts with nothing. Ties in
size go by doc_id, then source, cluster. Repeated rows are packed one by one. An empty table gives no bins.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.llm.jaccard_join import near_duplicates
from gridspark.llm.textbytes import sorted_groups
from gridspark.session import cut_lineage

CAPACITY = 2048
SHARD_DOCS = 4096
PLAN = "bin_id long, position int, bin_offset int, doc_id long, piece int, piece_start long, length int"


def word_count(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")).cast("long")


class Bins:
    """Open bins by what is left in them."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.order: list[tuple[int, int]] = []  # (left, bin), ascending
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.items: list[int] = []

    def put(self, size: int, source: int, cluster: int) -> tuple[int, int, int]:
        """Bin, position and offset of an item; ``source`` and ``cluster`` are bitmaps of one bit or none."""
        order, sources, clusters = self.order, self.sources, self.clusters
        at = bisect_left(order, (size, -1))
        while at < len(order):
            left, number = order[at]
            if not (sources[number] & source or clusters[number] & cluster):
                del order[at]
                break
            at += 1
        else:
            left, number = self.capacity, len(sources)
            sources.append(0)
            clusters.append(0)
            self.items.append(0)
        sources[number] |= source
        clusters[number] |= cluster
        position, self.items[number] = self.items[number], self.items[number] + 1
        if left > size:
            insort(order, (left - size, number))
        return number, position, self.capacity - left


def _bitmaps(values: list) -> list[int]:
    """A bit for every value that occurs twice or more; others, and null, cannot conflict."""
    often = [v for v, n in Counter(values).items() if n > 1 and v is not None]
    bits = {v: 1 << i for i, v in enumerate(often)}
    return [bits.get(v, 0) for v in values]


def pack_shard(sizes: list[int], sources: list, clusters: list, capacity: int) -> list[tuple[int, int, int, int, int, int, int]]:
    """(item, bin, position, offset, piece, piece start, length) of items in descending order of size."""
    out, rest = [], []
    own = 0
    for i, size in enumerate(sizes):
        whole = size // capacity
        for piece in range(whole):
            out.append((i, own, 0, 0, piece, piece * capacity, capacity))
            own += 1
        if size % capacity:
            rest.append((size % capacity, i, whole))
    rest.sort(key=lambda r: (-r[0], r[1]))
    source_bits, cluster_bits = _bitmaps([sources[i] for _, i, _ in rest]), _bitmaps([clusters[i] for _, i, _ in rest])
    bins = Bins(capacity)
    for (size, i, piece), source, cluster in zip(rest, source_bits, cluster_bits, strict=True):
        number, position, offset = bins.put(size, source, cluster)
        out.append((i, own + number, position, offset, piece, piece * capacity, size))
    return out


def pack(
    docs: DataFrame,
    size: Column,
    source: Column,
    cluster: Column,
    doc_id: str = "doc_id",
    capacity: int = CAPACITY,
    shard_docs: int = SHARD_DOCS,
) -> DataFrame:
    """One row per piece of a document: its bin, its place there, and which tokens of the document it holds."""
    shards = max(1, -(-docs.count() // shard_docs))
    rows = docs.select(
        F.pmod(F.xxhash64(doc_id), F.lit(shards)).cast("int").alias("shard"),
        F.coalesce(size.cast("long"), F.lit(0)).alias("size"),
        F.col(doc_id).cast("long").alias("doc_id"),
        F.when(source.isNotNull(), F.xxhash64(source)).alias("source"),
        F.when(cluster.isNotNull(), F.xxhash64(cluster)).alias("cluster"),
    )

    def run(batches):
        for shard in sorted_groups(batches, ["shard"]):
            ids, number = shard.column("doc_id"), shard.column("shard")[0].as_py()
            sizes, sources, clusters = (shard.column(k).to_pylist() for k in ("size", "source", "cluster"))
            placed = np.array(pack_shard(sizes, sources, clusters, capacity), np.int64).reshape(-1, 7)
            columns = [
                pa.array(placed[:, 1] + (number << 32)),
                pa.array(placed[:, 2], pa.int32()),
                pa.array(placed[:, 3], pa.int32()),
                ids.take(pa.array(placed[:, 0])).combine_chunks(),
                pa.array(placed[:, 4], pa.int32()),
                pa.array(placed[:, 5]),
                pa.array(placed[:, 6], pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in PLAN.split(", ")])

    filled = rows.filter("size > 0").repartition(shards, "shard")
    filled = filled.sortWithinPartitions("shard", F.desc("size"), F.asc_nulls_first("doc_id"), "source", "cluster").mapInArrow(run, PLAN)
    nulls = [F.lit(None).cast("long").alias("bin_id"), F.lit(None).cast("int").alias("position"), F.lit(None).cast("int").alias("bin_offset")]
    empty = rows.filter("size <= 0").select(
        *nulls, "doc_id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("piece_start"), F.lit(0).alias("length")
    )
    return filled.union(empty)


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(_p_key, _p_class): the class of near copies of every document and text, by a hash of both.

    The hash takes the place of the id, so that rows with a null doc_id and different texts of one doc_id are compared as well.
    """
    key = F.xxhash64(doc_id, text).alias("_p_key")
    return near_duplicates(docs.select(key, text), "_p_key", text).select(F.col("doc_id").alias("_p_key"), F.col("class_id").alias("_p_class"))


def pack_apart(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", capacity: int = CAPACITY) -> DataFrame:
    """``pack`` by words, with near copies as clusters; texts of marks alone, which have no shingles, are one cluster if they are equal."""
    worded = F.col(text).rlike("[0-9A-Za-z]|[^\\x00-\\x7F]")
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        word_count(F.col(text)).alias("size"),
        F.xxhash64(doc_id, text).alias("_p_key"),
        F.when(~worded, F.xxhash64(text)).alias("_p_marks"),
    )
    rows = cut_lineage(rows.join(near_copies(docs, doc_id, text), "_p_key", "left"))
    return pack(rows, F.col("size"), F.col("source"), F.coalesce("_p_marks", "_p_class"), capacity=capacity)
