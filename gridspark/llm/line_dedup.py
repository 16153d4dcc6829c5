"""Lines that many documents share stay in one of them only.

A line's key is the line without white space at both ends, A-Z in lower case. Keys of at least ``min_chars`` code points that stand in at
least ``min_docs`` documents lose all their lines, except in the document with the largest id that holds them.

* ``line_counts`` hashes lines to 128 bits in numpy batches and counts the different documents of each hash (two aggregations with
  partial sums on the map side, so that a line of a third of all documents arrives as one row a task).
* ``line_index`` deals the hashes that reach the limit into shards of about ``SHARD_KEYS`` and builds for each shard a minimal perfect
  hash over its distinct line hashes, with arrays of fingerprints, counts and keepers in the order of the hash's numbers.
* ``drop_lines`` sends documents through the arrays: a line is dropped if the fingerprint at its number is its own, the count reaches the limit
  and the keeper is another document.

How it scales: documents are read twice and never shuffled as long as the index has at most ``INDEX_BYTES`` (its size is summed up first): it is then
broadcast and probed in place. A larger index stays in the shared folder as rows; the hashes of the lines, not the lines, are then dealt to the
shards, probed in the same way against one shard after the other, and only the numbers of the lines to drop go back to the documents. Both ways give the
same result. The fingerprint has 64 bits beside the 64 that choose the shard and the place, so a foreign line passes with a probability of 2**-64.

Defined results: a null or empty text is one empty line. Rows that repeat a doc_id are one document; a null doc_id is one document too, smaller
than all others. An empty table gives no rows. Input columns named like a result column are replaced; all others stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridspark.llm.perfect_hash import PerfectHash
from gridspark.llm.textbytes import LOWER, chunks, code_points, sorted_groups, text_bytes
from gridspark.session import cut_lineage

MIN_CHARS = 20
MIN_DOCS = 3
SHARD_KEYS = 1 << 15
INDEX_BYTES = 64 << 20
# Stands for a null doc_id; smaller than every id.
NO_ID = -(1 << 63)

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


# ---- lines ------------------------------------------------------------------------------------------------------------------


class Lines:
    """The lines of the texts of one batch: bytes, owning texts, and 128-bit hashes of the keys that are long enough."""

    def __init__(self, column: pa.Array, min_chars: int):
        data, offsets = text_bytes(column)
        n = len(column)
        feeds = np.flatnonzero(data == 0x0A)
        owner = np.searchsorted(offsets, feeds, side="right") - 1
        per_text = np.bincount(owner, minlength=n) + 1
        self.first = np.concatenate([[0], np.cumsum(per_text)])
        self.text = np.repeat(np.arange(n), per_text)
        # A line starts at a text or behind a line feed, and ends at a line feed or at the end of the text.
        last = self.first[1:] - 1
        self.starts, self.ends = np.empty(self.text.size, np.int64), np.empty(self.text.size, np.int64)
        inner = np.ones(self.text.size, bool)
        inner[self.first[:-1]] = False
        self.starts[self.first[:-1]], self.starts[inner] = offsets[:-1], feeds + 1
        inner[:] = True
        inner[last] = False
        self.ends[last], self.ends[inner] = offsets[1:], feeds
        self.data = data.tobytes()
        solid = np.flatnonzero(~SPACE[data])
        low, high = np.searchsorted(solid, self.starts), np.searchsorted(solid, self.ends)
        full = np.flatnonzero(high > low)
        a, b = solid[low[full]], solid[high[full] - 1] + 1
        points = code_points(data)
        long = points[b] - points[a] >= min_chars
        self.hashed, a, b = full[long], a[long].tolist(), b[long].tolist()
        lowered = LOWER[data].tobytes()
        digests = b"".join(xxhash.xxh3_128_digest(lowered[i:j]) for i, j in zip(a, b, strict=True))
        self.keys = np.frombuffer(digests, "<u8").reshape(-1, 2).astype(np.uint64)


def _ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)


def line_counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, n_docs, keeper) of every different key of at least ``min_chars``: its documents and the largest of their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            lines = Lines(batch.column("text"), min_chars)
            rows = np.column_stack([lines.keys, _ids(batch.column("doc"))[lines.text[lines.hashed]].astype(np.uint64)]).astype(np.int64)
            rows = np.unique(rows, axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, k])) for k in range(3)], names=["h1", "h2", "doc"])

    hashed = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text")).mapInArrow(run, "h1 long, h2 long, doc long")
    return hashed.groupBy("h1", "h2").agg(F.count_distinct("doc").alias("n_docs"), F.max("doc").alias("keeper"))


# ---- index ------------------------------------------------------------------------------------------------------------------


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of a key, from the upper half of its first word."""
    return ((keys[:, 0] >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


class Shard:
    """A perfect hash and the arrays it points into."""

    KINDS = {"sizes": "<i8", "bits": "<u8", "fingerprints": "<u8", "counts": "<u4", "keepers": "<i8"}

    def __init__(self, numbers: PerfectHash, fingerprints: np.ndarray, counts: np.ndarray, keepers: np.ndarray):
        self.numbers, self.fingerprints, self.counts, self.keepers = numbers, fingerprints, counts, keepers

    @classmethod
    def build(cls, keys: np.ndarray, counts: np.ndarray, keepers: np.ndarray) -> Shard:
        numbers = PerfectHash.build(keys)
        order = np.argsort(numbers(keys))
        return cls(numbers, keys[order, 1], np.minimum(counts, 0xFFFFFFFF)[order].astype("<u4"), keepers[order])

    def to_bytes(self) -> dict[str, bytes]:
        parts = [self.numbers.sizes, self.numbers.bits, self.fingerprints, self.counts, self.keepers]
        return {k: p.astype(kind).tobytes() for (k, kind), p in zip(self.KINDS.items(), parts, strict=True)}

    @classmethod
    def from_bytes(cls, stored: dict[str, bytes]) -> Shard:
        part = {k: np.frombuffer(stored[k], kind) for k, kind in cls.KINDS.items()}
        bits = part["bits"]
        before = (np.cumsum(np.bitwise_count(bits), dtype=np.int64) - np.bitwise_count(bits)).astype("<u4")
        return cls(PerfectHash(part["sizes"], bits, before), part["fingerprints"], part["counts"], part["keepers"])

    def drops(self, keys: np.ndarray, docs: np.ndarray, min_docs: int) -> np.ndarray:
        """Whether each line, of a document, is to go."""
        at = self.numbers(keys)
        hit = np.flatnonzero(at >= 0)
        hit = hit[self.fingerprints[at[hit]] == keys[hit, 1]]
        out = np.zeros(len(keys), bool)
        out[hit] = (self.counts[at[hit]] >= min_docs) & (self.keepers[at[hit]] != docs[hit])
        return out


INDEX = "shard long, n_keys long, sizes binary, bits binary, fingerprints binary, counts binary, keepers binary"


def line_index(counts: DataFrame, min_docs: int = MIN_DOCS, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int]:
    """One row per shard of the keys in at least ``min_docs`` documents (materialised), and the number of shards."""
    frequent = cut_lineage(counts.filter(F.col("n_docs") >= min_docs))
    shards = max(1, -(-frequent.count() // shard_keys))

    def deal(batches):
        for batch in batches:
            keys = np.column_stack([batch.column(k).to_numpy() for k in ("h1", "h2")]).view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(shard_of(keys, shards)), *batch.columns], names=["shard", *batch.schema.names])

    def build(batches):
        for rows in sorted_groups(batches, ["shard"]):
            keys = np.column_stack([rows.column(k).to_numpy() for k in ("h1", "h2")]).view(np.uint64)
            made = Shard.build(keys, rows.column("n_docs").to_numpy(), rows.column("keeper").to_numpy()).to_bytes()
            cells = {"shard": pa.array([rows.column("shard")[0].as_py()]), "n_keys": pa.array([rows.num_rows])}
            cells |= {k: pa.array([v], pa.binary()) for k, v in made.items()}
            yield pa.RecordBatch.from_arrays(list(cells.values()), names=list(cells))

    dealt = frequent.mapInArrow(deal, "shard long, h1 long, h2 long, n_docs long, keeper long")
    index = dealt.repartitionByRange(shards, "shard").sortWithinPartitions("shard").mapInArrow(build, INDEX)
    return cut_lineage(index), shards


# ---- documents --------------------------------------------------------------------------------------------------------------

RESULT = T.StructType(
    [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_text", T.StringType())]
)


def _kept(lines: Lines, gone: np.ndarray, text: int) -> str:
    own = range(lines.first[text], lines.first[text + 1])
    return b"\n".join(lines.data[lines.starts[i] : lines.ends[i]] for i in own if not gone[i]).decode()


def _result(batch: pa.RecordBatch, column: str, lines: Lines, gone: np.ndarray, names: list[str]) -> pa.RecordBatch:
    n_lines = np.diff(lines.first)
    n_gone = np.bincount(lines.text[gone], minlength=batch.num_rows) if batch.num_rows else np.zeros(0, np.int64)
    texts = batch.column(column).to_pylist()
    kept = [_kept(lines, gone, i) if n else texts[i] or "" for i, n in enumerate(n_gone.tolist())]
    extra = [pa.array(n_lines, pa.int64()), pa.array(n_gone, pa.int64()), pa.array(kept, pa.string())]
    return pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*names, *RESULT.names])


def _probe_here(docs: DataFrame, index: DataFrame, shards: int, text: str, doc_id: str, min_chars: int, min_docs: int) -> DataFrame:
    """Probe the broadcast arrays."""
    stored = {r["shard"]: {k: bytes(r[k]) for k in Shard.KINDS} for r in index.collect()}
    shared = docs.sparkSession.sparkContext.broadcast(stored)
    names = docs.columns

    def run(batches):
        arrays = {k: Shard.from_bytes(v) for k, v in shared.value.items()}
        for batch in chunks(batches, text):
            lines = Lines(batch.column(text), min_chars)
            ids = _ids(batch.column(doc_id))[lines.text[lines.hashed]]
            gone = np.zeros(lines.text.size, bool)
            part = shard_of(lines.keys, shards)
            for k in np.unique(part).tolist():
                if k in arrays:
                    own = np.flatnonzero(part == k)
                    gone[lines.hashed[own]] = arrays[k].drops(lines.keys[own], ids[own], min_docs)
            yield _result(batch, text, lines, gone, names)

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *RESULT.fields]))


def _probe_dealt(docs: DataFrame, index: DataFrame, shards: int, text: str, doc_id: str, min_chars: int, min_docs: int) -> DataFrame:
    """Deal line hashes to the shards, salted by document so that a hot line spreads, and bring the dropped numbers back."""
    spread = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // shards)

    def hashes(batches):
        for batch in chunks(batches, "text"):
            lines = Lines(batch.column("text"), min_chars)
            own = lines.text[lines.hashed]
            ids, texts = _ids(batch.column("doc")), batch.column("digest").to_numpy(zero_copy_only=False)
            cells = [shard_of(lines.keys, shards), ids[own] % spread, *lines.keys.T.astype(np.int64), ids[own], texts[own], lines.hashed - lines.first[own]]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cells], names=["shard", "salt", "h1", "h2", "doc", "digest", "line"])

    def probe(batches):
        arrays, here = None, None
        for batch in batches:
            # Rows of arrays have no line, whose numbers are null.
            h1, h2, lines_of = (batch.column(k).fill_null(0).to_numpy() for k in ("h1", "h2", "doc"))
            keys = np.column_stack([h1, h2]).view(np.uint64)
            part = np.column_stack([batch.column(k).to_numpy() for k in ("shard", "salt")])
            heads = np.asarray(batch.column("bits").is_valid())
            gone = np.zeros(batch.num_rows, bool)
            edges = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]).any(axis=1) | heads[1:]]))
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), batch.num_rows], strict=True):
                if heads[a]:
                    here = tuple(part[a])
                    arrays = Shard.from_bytes({k: batch.column(k)[a].as_py() for k in Shard.KINDS})
                    a += 1
                if b > a and here == tuple(part[a]):
                    gone[a:b] = arrays.drops(keys[a:b], lines_of[a:b], min_docs)
            hit = pa.array(gone)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(hit) for k in ("doc", "digest", "line")], names=["doc", "digest", "line"])

    narrow = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("digest"), F.col(text).alias("text"))
    rows = narrow.mapInArrow(hashes, "shard long, salt long, h1 long, h2 long, doc long, digest long, line long")
    heads = index.drop("n_keys").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(spread - 1).cast("long"))))
    both = heads.unionByName(rows, allowMissingColumns=True)
    both = both.repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("bits").isNull())
    hits = both.mapInArrow(probe, "doc long, digest long, line long").groupBy(
        F.col("doc").alias("_gone_doc"), F.col("digest").alias("_gone_text")
    ).agg(F.collect_set("line").alias("_gone_lines"))
    keyed = docs.withColumns({"_gone_doc": F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)), "_gone_text": F.xxhash64(text)})
    joined = keyed.join(hits, ["_gone_doc", "_gone_text"], "left")
    names = docs.columns

    def rebuild(batches):
        for batch in chunks(batches, text):
            lines = Lines(batch.column(text), 1 << 62)
            gone = np.zeros(lines.text.size, bool)
            for i, numbers in enumerate(batch.column("_gone_lines").to_pylist()):
                if numbers:
                    gone[lines.first[i] + np.array(numbers)] = True
            yield _result(batch.select(names), text, lines, gone, names)

    return joined.select(*names, "_gone_lines").mapInArrow(rebuild, T.StructType([*docs.schema.fields, *RESULT.fields]))


def drop_lines(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
    index_bytes: int = INDEX_BYTES,
    shard_keys: int = SHARD_KEYS,
) -> DataFrame:
    """``docs`` with n_lines, n_dropped and kept_text (the other lines, joined by line feeds)."""
    docs = docs.drop(*[c for c in docs.columns if c in RESULT.names and c not in (text, doc_id)])
    index, shards = line_index(line_counts(docs, text, doc_id, min_chars), min_docs, shard_keys)
    size = index.select(F.sum(sum((F.length(k) for k in Shard.KINDS), F.lit(0)))).first()[0] or 0
    probe = _probe_here if size <= index_bytes else _probe_dealt
    return probe(docs, index, shards, text, doc_id, min_chars, min_docs)
