import re
from itertools import combinations

import pytest

from gridspark.llm import jaccard_join as J
from gridspark.llm.components import components

from .conftest import prose


def shingles(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(pairs):
    sets = {i: shingles(t) for i, t in pairs}
    links, root = dict.fromkeys(sets, 0), {i: i for i in sets}
    for a, b in combinations(sorted(sets), 2):
        both, union = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        if union and both >= 0.8 * union - 1e-9:
            links[a] += 1
            links[b] += 1
            x, y = root[a], root[b]
            root = {i: min(x, y) if r in (x, y) else r for i, r in root.items()}
    return {i: (root[i], links[i]) for i in sets}


def edited(text, k):
    words = text.split()
    words[(k * 37) % len(words)] = f"edit{k}"
    return " ".join(words)


def found(df):
    return {r.doc_id: (r.class_id, r.n_links) for r in df.collect()}


def corpus():
    base, other = prose(1, 120), prose(2, 60)
    pairs = [(100 + k, edited(base, k)) for k in range(25)] + [(k, base) for k in range(5, 9)]
    pairs += [(200 + k, edited(other, 3 * k)) for k in range(6)] + [(300 + k, prose(50 + k, 80)) for k in range(20)]
    pairs += [(400, "a b c"), (401, "A, b! c"), (402, "a b"), (403, None), (404, ""), (405, "..."), (406, prose(9, 5)), (407, prose(9, 5).upper())]
    pairs += [(500, prose(11, 3000)), (501, edited(prose(11, 3000), 4)), (502, "x" * 40_000)]
    return pairs


def test_matches_brute_force(docs):
    assert found(J.near_duplicates(docs(corpus()))) == brute(corpus())


def test_blocks_give_the_same_result(docs, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_DOCS", 4)
    monkeypatch.setattr(J, "BLOCK_SHINGLES", 500)
    assert found(J.near_duplicates(docs(corpus()))) == brute(corpus())


def test_two_documents_in_one_of_several_blocks_count_once(docs, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_SHINGLES", 100)
    pairs = [(2 * k + side, edited(prose(60 + k, 150), side)) for k in range(16) for side in range(2)]
    assert found(J.near_duplicates(docs(pairs))) == brute(pairs) == {i: (i - i % 2, 1) for i, _ in pairs}


def test_repeated_rows_null_ids_and_empty_table(spark, docs):
    text = prose(4, 40)
    rows = docs([(1, text), (1, text), (1, "short"), (2, text), (None, text)]).selectExpr("*", "1 AS class_id", "'k' AS keys", "0 AS rep")
    assert found(J.near_duplicates(rows)) == {1: (1, 1), 2: (1, 1)}
    assert J.near_duplicates(docs([])).collect() == []


def test_pruning_keeps_the_similar_and_drops_the_distant():
    least = J.least_matches(0.8, 1e-4)
    assert all(J.posterior(m, n, 0.8) >= 1e-4 > J.posterior(m - 1, n, 0.8) for m, n in zip(least, range(16, 97, 16), strict=True))
    assert least[-1] > 48


@pytest.mark.parametrize("n", [1, 2, 40])
def test_components_of_a_path(spark, n):
    edges = spark.createDataFrame([(k, k + 1) for k in range(n)] + [(90, 90), (70, 80), (80, 70)], "u long, v long")
    want = {k: 0 for k in range(n + 1)} | {70: 70, 80: 70}
    assert {r.node: r.root for r in components(edges).collect()} == want
    assert components(edges.filter("u < 0")).collect() == []
