import re

import pytest

from gridspark.llm.decontaminate import contamination

from .conftest import prose


def words_of(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text, items):
    w = words_of(text)
    hit, ids = set(), set()
    for item, t in items:
        v = words_of(t)
        if item is None or not v:
            continue
        n = min(13, len(v))
        windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)}
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in windows:
                hit.update(range(i, i + n))
                ids.add(str(item))
    return len(w), len(hit), sorted(ids), bool(hit) and 20 * len(hit) >= len(w)


ITEMS = [(1, prose(1, 20)), (2, prose(2, 13).upper()), (10, "Été, à Paris"), (11, "été à paris"), (3, ""), (4, None), (None, prose(5, 20)), (6, "...")]
DOCS = [
    (1, f"{prose(8, 30)} {prose(1, 20).replace(' ', ', ')} {prose(9, 10)}"),
    (2, prose(2, 13)),
    (3, prose(2, 12)),
    (4, "x été--à\nPARIS! y"),
    (5, "xété à paris"),
    (6, None),
    (7, ""),
    (8, " ".join(prose(1, 20).split()[3:18]) + " " + prose(7, 400)),
    (9, f"{prose(5, 20)}"),
    (10, "A" * 30_000 + " été à paris"),
    (11, f"{prose(1, 14)}\n{prose(1, 20)}"),
]


@pytest.mark.parametrize("pattern_bytes", [1 << 20, 1])
def test_matches_brute_force(spark, docs, pattern_bytes):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = contamination(docs(DOCS), items, pattern_bytes=500 if pattern_bytes == 1 else pattern_bytes).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in found} == {i: brute(t, ITEMS) for i, t in DOCS}


def test_places_are_those_of_the_original(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    row = contamination(docs([DOCS[3]]), items).first()
    assert [DOCS[3][1][h.start : h.end] for h in row.hits] == ["été--à\nPARIS"]


def test_empty_tables_and_clashing_columns(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in contamination(docs(DOCS[:2]), none).collect()] == [0, 0]
    assert contamination(docs([]), none).collect() == []
    clash = docs(DOCS[:1] * 2).selectExpr("*", "'x' AS n_hit", "1 AS items")
    assert [r.n_hit for r in contamination(clash, spark.createDataFrame(ITEMS, "item_id long, text string")).collect()] == [20, 20]
