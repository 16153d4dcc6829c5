"""Similarity join of documents by word n-grams, with Bayesian pruning of MinHash candidates.

Documents are linked when the Jaccard similarity of their sets of five-word shingles is at least 0.8. The steps:

1. Texts with the same words in the same order are one class; only its representative, the document with the smallest id, goes on.
2. A representative gets ``HASHES`` MinHash values; ``BANDS`` bands of them are its bucket keys. Buckets with
   one member, and buckets with the same members as another one, are dropped.
3. Inside a bucket, pairs compare their MinHash values a few at a time. A pair is dropped as soon as the posterior
   probability that its similarity reaches the threshold (uniform prior) is below ``TOLERANCE``. The survivors of a bucket are
   reported as a forest (each member with the smallest one of its survivors), not as pairs; the forests make candidate groups.
4. Inside a candidate group, all pairs are verified exactly on their shingle sets; a block of documents against a block of documents is
   one matrix product. Reported are the links of each document and again a forest, whose components are the classes.

How it scales: no step emits the pairs of a group. Exact copies collapse in an aggregation. Large buckets and large
candidate groups are cut into blocks by hash, and every pair of blocks is a group of its own with bounded content, so one group of
copies spreads over many tasks. Nothing is capped: a group of any size gets all its blocks.

Defined results: a null text or one without words is a class of its own without links, as is every document whose text shares
less than the threshold with all others. A text of fewer than five words has one shingle, all its words. Rows that share a doc_id
are one document, the one whose text has the most shingles (then the smallest digest) standing for it. Null doc_ids are left out. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.components import components
from gridspark.llm.textbytes import LOWER, WORD, chunks, mix, runs, shingle_hashes, sorted_groups, text_bytes, word_hashes
from gridspark.session import cut_lineage

SHINGLE = 5
THRESHOLD = 0.8
HASHES = 96
BANDS = 24
STEP = 16
TOLERANCE = 1e-4
# Blocks are made for about so many documents, and of a candidate group for about so many shingles.
BLOCK_DOCS = 1024
BLOCK_SHINGLES = 300_000

_rng = np.random.default_rng(20240229)
_ADD = _rng.integers(0, 2**32, HASHES, dtype=np.uint32)
_MUL = _rng.integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


# ---- sketches ---------------------------------------------------------------------------------------------------------------


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes | None]]:
    """Shingle hashes of all texts in order, the index of their text, and a digest of each text's words (none without words)."""
    data, offsets = text_bytes(column)
    low = LOWER[data]
    starts, ends = runs(WORD[low], offsets)
    words = word_hashes(low, starts, ends)
    first = np.append(np.searchsorted(starts, offsets[:-1]), starts.size).astype(np.int64)
    counts = np.diff(first)
    text = np.repeat(np.arange(counts.size), counts)
    hashes = shingle_hashes(words, SHINGLE)
    owner = text[: hashes.size]
    inside = np.arange(hashes.size) + SHINGLE <= first[1:][owner]
    hashes, owner = hashes[inside], owner[inside]
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if short.size:
        extra = np.array([_fold(words[first[i] : first[i + 1]]) for i in short.tolist()], np.uint64)
        hashes, owner = np.concatenate([hashes, extra]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        hashes, owner = hashes[order], owner[order]
    raw, cut = memoryview(words.astype("<u8").tobytes()), (8 * first).tolist()
    digests = [blake2b(raw[a:b], digest_size=16).digest() if b > a else None for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return hashes, owner, digests


def _fold(words: np.ndarray) -> np.uint64:
    out = np.zeros(1, np.uint64)
    for k in range(words.size):
        out = mix(out + words[k : k + 1] + np.uint64(100 + words.size))
    return out[0]


def _signatures(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """MinHash values (texts, HASHES) of texts whose shingles begin at ``first``."""
    low = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    out = np.empty((first.size, HASHES), np.uint32)
    for k in range(HASHES):
        values = (low ^ _ADD[k]) * _MUL[k]
        values ^= values >> np.uint32(15)
        values *= np.uint32(0x846CA68B)
        out[:, k] = np.minimum.reduceat(values, first)
    return out


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (doc_id, digest, shingles, signature of 16 bits a value, bucket keys)."""
    for batch in chunks(batches, "t"):
        hashes, owner, digests = shingle_sets(batch.column("t"))
        n = batch.num_rows
        counts = np.bincount(owner, minlength=n)
        has = np.flatnonzero(counts)
        first = (np.cumsum(counts) - counts)[has]
        signature = np.zeros((n, HASHES), np.uint32)
        keys = np.zeros((n, BANDS), np.uint64)
        if has.size:
            signature[has] = _signatures(hashes, first)
            rows = signature[has].astype(np.uint64).reshape(has.size, BANDS, HASHES // BANDS)
            key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (has.size, BANDS))
            for k in range(HASHES // BANDS):
                key = mix(key + rows[:, :, k] * np.uint64(0x9E3779B97F4A7C15))
            keys[has] = key
        flat = signature.astype("<u2").tobytes()
        size = 2 * HASHES
        bounds = np.where(counts > 0, BANDS, 0)
        offsets = np.concatenate([[0], np.cumsum(bounds)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("d"),
                pa.array(digests, pa.binary()),
                pa.array(counts, pa.int64()),
                pa.array([flat[i * size : (i + 1) * size] for i in range(n)], pa.binary()),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[has].reshape(-1).view(np.int64))),
            ],
            names=["doc_id", "digest", "n_shingles", "signature", "keys"],
        )


# ---- pruning ----------------------------------------------------------------------------------------------------------------


def posterior(matches: int, seen: int, threshold: float) -> float:
    """Probability that the similarity is at least ``threshold`` after ``matches`` equal values of ``seen``, from a uniform prior."""
    x = np.linspace(0, 1, 4097)[1:-1]
    log_pdf = matches * np.log(x) + (seen - matches) * np.log1p(-x)
    log_pdf += lgamma(seen + 2) - lgamma(matches + 1) - lgamma(seen - matches + 1)
    pdf = np.exp(log_pdf)
    return float(pdf[x >= threshold].sum() / pdf.sum())


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """For each step, the smallest number of equal values with which a pair goes on."""
    return [next(m for m in range(n + 1) if posterior(m, n, threshold) >= tolerance) for n in range(STEP, HASHES + 1, STEP)]


def survivors(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i of left, j of right) that no step drops."""
    matches = np.zeros(i.size, np.int32)
    for step, need in enumerate(least):
        part = slice(step * STEP, (step + 1) * STEP)
        matches = matches + (left[i, part] == right[j, part]).sum(axis=1, dtype=np.int32)
        keep = matches >= need
        i, j, matches = i[keep], j[keep], matches[keep]
    return i, j


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest member of each member's component, members numbered in the order of their ids."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _pairs(side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a group: of one block with itself, or of a first with a second block."""
    if side.min() == side.max():
        return np.triu_indices(side.size, 1)
    a, b = np.flatnonzero(side == side.min()), np.flatnonzero(side == side.max())
    return np.repeat(a, b.size), np.tile(b, a.size)


def _repeats(group: pa.RecordBatch | pa.Table, side: np.ndarray) -> bool:
    """Whether a group of two blocks holds rows of one only; that block meets itself in a group of its own."""
    return group.column("low")[0].as_py() != group.column("high")[0].as_py() and side.min() == side.max()


def _prune(least: list[int]):
    """Sorted bucket blocks to edges (u, v) of a forest of their surviving pairs."""

    def run(batches):
        us, vs = [], []
        for group in sorted_groups(batches, ["key", "low", "high"]):
            ids = group.column("rep").to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, side = ids[order], group.column("block").to_numpy()[order]
            if _repeats(group, side):
                continue
            signature = np.frombuffer(b"".join(group.column("signature").to_pylist()), "<u2").reshape(-1, HASHES)[order]
            i, j = survivors(signature, signature, *_pairs(side), least)
            root = _roots(ids.size, i, j)
            moved = root != np.arange(ids.size)
            us.append(ids[moved])
            vs.append(ids[root[moved]])
            if len(us) >= 256:
                yield _edges(us, vs)
                us, vs = [], []
        if us:
            yield _edges(us, vs)

    return run


def _edges(us: list, vs: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(us), pa.int64()), pa.array(np.concatenate(vs), pa.int64())], names=["u", "v"])


def _in_blocks(members: DataFrame, key: str, blocks: str) -> DataFrame:
    """Each member, in its block of ``blocks``, once for every block its block meets; sorted by (key, low, high)."""
    own = F.pmod(F.xxhash64("rep", F.lit(7)), F.col(blocks)).cast("int")
    other = F.explode(F.sequence(F.lit(0), (F.col(blocks) - 1).cast("int")))
    placed = members.withColumn("block", own).withColumn("_other", other)
    placed = placed.withColumns({"low": F.least("block", "_other"), "high": F.greatest("block", "_other")}).drop("_other", blocks)
    return placed.repartition(key, "low", "high").sortWithinPartitions(key, "low", "high")


def candidate_groups(sketches: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """(node, root): the representatives that survive a comparison with another one, by candidate group."""
    members = sketches.select(F.col("doc_id").alias("rep"), F.explode("keys").alias("key"))
    buckets = members.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("rep")).alias("content"), F.min("rep").alias("least")).filter("n > 1")
    buckets = buckets.groupBy("n", "content", "least").agg(F.min("key").alias("key"))
    buckets = buckets.select("key", F.ceil(F.col("n") / BLOCK_DOCS).cast("int").alias("blocks"))
    kept = members.join(buckets, "key").join(sketches.select(F.col("doc_id").alias("rep"), "signature"), "rep")
    edges = _in_blocks(kept, "key", "blocks").mapInArrow(_prune(least_matches(threshold, tolerance)), "u long, v long")
    return components(edges)


# ---- verification -----------------------------------------------------------------------------------------------------------


def _links(sets: list[np.ndarray], side: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a group whose sets are similar enough, by exact intersections."""
    n = len(sets)
    sizes = np.array([s.size for s in sets])
    if n == 2:
        both = np.intersect1d(sets[0], sets[1], assume_unique=True).size
        hit = both >= threshold * (sizes.sum() - both) - 1e-9
        return (np.array([0]), np.array([1])) if hit else (np.zeros(0, int), np.zeros(0, int))
    flat = np.concatenate(sets)
    values, index, times = np.unique(flat, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), sizes)
    shared = times[index] > 1
    column, row = (np.cumsum(times > 1) - 1)[index[shared]], row[shared]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    common = np.zeros((n, n), np.float32)
    total, width = int((times > 1).sum()), 2048
    cuts = np.searchsorted(column, np.arange(0, total + width, width))
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        part = np.zeros((n, width), np.float32)
        part[row[a:b], column[a:b] - k * width] = 1
        common += part @ part.T
    i, j = _pairs(side)
    both = common[i, j].astype(np.float64)
    hit = both >= threshold * (sizes[i] + sizes[j] - both) - 1e-9
    return i[hit], j[hit]


def _verify(threshold: float):
    """Sorted blocks of candidate groups to (rep, links, root), links counted in documents."""

    def run(batches):
        for group in sorted_groups(batches, ["root", "low", "high"]):
            hashes, owner, digests = shingle_sets(group.column("t"))
            right = [a == b for a, b in zip(digests, group.column("digest").to_pylist(), strict=True)]
            ids = group.column("rep").to_numpy()
            _, once = np.unique(np.where(right, ids, -1), return_index=True)  # sorted by id; repeated rows once
            once = once[np.array(right)[once]]
            cuts = np.searchsorted(owner, np.arange(len(digests) + 1))
            sets = [np.unique(hashes[cuts[k] : cuts[k + 1]]) for k in once.tolist()]
            ids, side, copies = ids[once], group.column("block").to_numpy()[once], group.column("copies").to_numpy()[once]
            if ids.size < 2 or _repeats(group, side):
                continue
            i, j = _links(sets, side, threshold)
            links = np.bincount(i, copies[j], ids.size) + np.bincount(j, copies[i], ids.size)
            root = ids[_roots(ids.size, i, j)]
            found = links > 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[found]), pa.array(links[found].astype(np.int64)), pa.array(root[found])], names=["rep", "links", "root"]
            )

    return run


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE
) -> DataFrame:
    """(doc_id, class_id, n_links) of every document: its class's smallest doc_id, and how many other documents it is linked to."""
    named = docs.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t"))
    schema = "doc_id long, digest binary, n_shingles long, signature binary, keys array<long>"
    sketched = cut_lineage(named.mapInArrow(_sketch, schema))
    owners = sketched.groupBy("doc_id").agg(F.max_by("digest", F.struct("n_shingles", F.hex("digest"))).alias("digest"))
    classes = owners.filter(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    representatives = classes.select(F.col("rep").alias("doc_id"), "digest", "copies")
    sketches = cut_lineage(sketched.join(representatives, ["doc_id", "digest"]).dropDuplicates(["doc_id"]))
    groups = candidate_groups(sketches.select("doc_id", "signature", "keys"), threshold, tolerance)

    members = sketches.select(F.col("doc_id").alias("node"), "digest", "copies", "n_shingles").join(groups, "node")
    members = cut_lineage(members.withColumnRenamed("node", "rep"))
    blocks = members.groupBy("root").agg(F.sum("n_shingles").alias("s"), F.count("*").alias("n"))
    blocks = blocks.select("root", F.ceil(F.greatest(F.col("s") / BLOCK_SHINGLES, F.col("n") / BLOCK_DOCS)).cast("int").alias("blocks"))
    members = members.drop("n_shingles").join(blocks, "root")
    texts = named.join(members, named.d == members.rep).drop("d")
    links = cut_lineage(_in_blocks(texts, "root", "blocks").mapInArrow(_verify(threshold), "rep long, links long, root long"))
    roots = components(links.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    counts = links.groupBy("rep").agg(F.sum("links").alias("links"))
    found = counts.join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    whole = owners.join(classes, "digest", "left").join(found, "rep", "left")
    return whole.select(
        "doc_id",
        F.coalesce("root", "rep", "doc_id").alias("class_id"),
        (F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
    )
