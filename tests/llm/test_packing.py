import random

from pyspark.sql import functions as F

from gridspark.llm.packing import pack, pack_apart, pack_shard, word_count

from .conftest import prose


def brute(sizes, sources, clusters, capacity):
    """Tightest compatible bin by looking at all of them."""
    bins, out, own = [], [], 0
    for i, size in enumerate(sizes):
        for k in range(size // capacity):
            out.append((i, own, 0, 0, k, k * capacity, capacity))
            own += 1
    rest = sorted((-(s % capacity), i) for i, s in enumerate(sizes) if s % capacity)
    for minus, i in rest:
        size = -minus
        fits = [
            (b["left"], n)
            for n, b in enumerate(bins)
            if b["left"] >= size and sources[i] not in b["sources"] and clusters[i] not in b["clusters"]
        ]
        if not fits:
            bins.append({"left": capacity, "sources": set(), "clusters": set(), "n": 0})
            fits = [(capacity, len(bins) - 1)]
        n = min(fits)[1]
        b = bins[n]
        out.append((i, own + n, b["n"], capacity - b["left"], sizes[i] // capacity, sizes[i] // capacity * capacity, size))
        b["left"] -= size
        b["n"] += 1
        b["sources"] |= {sources[i]} - {None}
        b["clusters"] |= {clusters[i]} - {None}
    return out


def test_shard_matches_brute_force():
    rng = random.Random(5)
    for hot in (0, 1, 3):
        n = 400
        sizes = sorted((rng.choice([1, 5, 60, 64, rng.randint(1, 150)]) for _ in range(n)), reverse=True)
        sources = [None if rng.random() < 0.1 else rng.randrange(4) if rng.random() < hot / 3 else rng.randrange(30) for _ in range(n)]
        clusters = [None if rng.random() < 0.3 else rng.randrange(50) for _ in range(n)]
        assert pack_shard(sizes, sources, clusters, 64) == brute(sizes, sources, clusters, 64)


def test_every_token_is_placed_once_without_conflict(docs):
    rows = [(i, prose(i % 40, 1 + (i * 31) % 90)) for i in range(300)] + [(900, prose(1, 500)), (901, None), (902, ""), (903, " \n")]
    table = docs(rows).withColumn("source", F.concat(F.lit("s"), F.expr("if(doc_id % 3 = 0, 0, doc_id % 17)")))
    text = F.col("text")
    out = pack(table, word_count(text), F.col("source"), F.sha2(text, 256), capacity=100, shard_docs=64).collect()
    source = {r.doc_id: r.source for r in table.collect()}
    for i, t in rows:
        pieces = sorted((r.piece_start, r.length) for r in out if r.doc_id == i)
        assert sum(n for _, n in pieces) == len((t or "").split())
        assert all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:], strict=False))
    bins = {}
    for r in out:
        if r.bin_id is not None:
            bins.setdefault(r.bin_id, []).append(r)
    by_id = dict(rows)
    for items in bins.values():
        items.sort(key=lambda r: r.position)
        assert [r.bin_offset for r in items] == [sum(x.length for x in items[:k]) for k in range(len(items))]
        assert sum(r.length for r in items) <= 100
        assert len({source[r.doc_id] for r in items}) == len(items) == len({by_id[r.doc_id] for r in items})
    assert sorted(r.doc_id for r in out if r.bin_id is None) == [901, 902, 903]


def test_repeated_rows_null_ids_and_empty_table(docs):
    text = F.col("text")
    args = (word_count(text), F.col("source"), F.lit(None).cast("string"))
    out = pack(docs([(1, "a b"), (1, "a b"), (None, "c")]).selectExpr("*", "'x' AS shard", "5 AS size"), *args).collect()
    assert sorted(r.length for r in out) == [1, 2, 2] and len({r.bin_id for r in out}) == 3
    assert pack(docs([]), *args).collect() == []


def test_near_copies_of_other_sources_share_no_bin(docs):
    base = prose(5, 60)
    copies = [base, base.upper(), base.replace(" ", ", "), " ".join(["changed", *base.split()[1:]])]
    rows = [(i, t) for i, t in enumerate(copies)] + [(None, f"{base}!"), (7, prose(6, 9)), (7, f"{base}."), (8, "-- ?"), (9, "-- ?"), (10, prose(8, 30))]
    table = docs(rows, None).withColumn("source", F.concat(F.lit("s"), F.xxhash64("doc_id", "text")))
    bins = {}
    for r in pack_apart(table).collect():
        bins.setdefault((r.doc_id, r.length), []).append(r.bin_id)
    near = sum((bins[k, 60] for k in (0, 1, 2, 3, None, 7)), [])
    assert len(set(near)) == len(near) == 6
    assert bins[8, 2] != bins[9, 2]
    assert bins[10, 30][0] in near and bins[7, 9][0] in near
