import re
from collections import Counter, defaultdict

from gridspark.llm.line_quality import quality_rules, rule_counts

from .conftest import prose


def brute_counts(text):
    text = text or ""
    words = [w for w in re.split("[ \t\n\x0b\x0c\r]+", text) if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {p for i, w in enumerate(windows) if times[w] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search("[^ \t\n\x0b\x0c\r]", x)]
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


TEXTS = [None, "", " \n\t ", "a", "a b c", "a b c a b c", "a a a a", "a a a", "x y z\nx y z\n\n", "é ñ\x0bü\r\n#*", "b b b c b b b c", "a b a b a b", "q " * 5000]


def test_counts_match_brute_force(docs):
    out = rule_counts(docs(list(enumerate(TEXTS)))).orderBy("doc_id").collect()
    got = [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out]
    assert got == [brute_counts(t) for t in TEXTS]


def test_frequent_lines_go_and_first_document_keeps_them(docs):
    boiler = prose(1, 60)
    pairs = [(i, f"{boiler.upper() if i % 2 else boiler}\n{prose(i + 10, 5)}") for i in range(8)] + [(20, prose(99, 70)), (21, None), (22, "")]
    out = {r.doc_id: r for r in quality_rules(docs(pairs), max_docs=5).collect()}
    assert out[0].kept and out[0].clean_text == pairs[0][1]
    for i in range(1, 8):
        assert not out[i].kept and not out[i].base_failed
        assert out[i].clean_text == prose(i + 10, 5) and out[i].n_words_left == 5
    assert out[20].kept and not out[21].kept and not out[22].kept
    assert out[21].clean_text is None and out[22].base_failed


def test_documents_are_counted_and_the_first_copy_stays(docs):
    text = prose(3, 80)
    same = {r.doc_id: r.kept for r in quality_rules(docs([(i, text) for i in range(9)]), max_docs=3).collect()}
    assert same == {0: True} | dict.fromkeys(range(1, 9), False)
    # Rows that repeat a doc_id are one document, and so are all without one.
    rows = [(1, text)] * 4 + [(2, text), (None, text), (None, f"{text}\nmore")]
    assert all(r.kept for r in quality_rules(docs(rows), max_docs=3).collect())
    assert sum(r.kept for r in quality_rules(docs(rows), max_docs=2).collect()) == 4
    apart = docs([(i, f"{text}\n{prose(i, 3)}") for i in range(3)], "a").union(docs([(i + 5, f"{text}\n{prose(i, 3)}") for i in range(3)], None))
    assert all(r.kept for r in quality_rules(apart, max_docs=3).collect())


def test_large_hosts_have_a_share_and_small_ones_a_floor(docs):
    shared = prose(1, 40)
    long = [(i, f"{shared}\n{prose(i + 10, 20)}" if i < 20 else prose(i + 10, 60)) for i in range(400)]
    left = lambda **kw: sorted(r.n_words_left for r in quality_rules(docs(long), **kw).filter("doc_id < 20").collect())
    assert left(max_docs=5, max_percent=5) == [60] * 20
    assert left(max_docs=5, max_percent=4.9) == [20] * 19 + [60]
    assert left(max_docs=20, max_percent=1) == [60] * 20


def test_repeated_rows_nulls_and_empty_table(docs):
    rows = quality_rules(docs([(1, prose(1, 60)), (1, prose(1, 60)), (None, prose(2, 60)), (None, None)])).collect()
    assert sorted(r.kept for r in rows) == [False, True, True, True]
    assert quality_rules(docs([])).collect() == []


def test_random_fixture_matches_brute_force(docs):
    lines = [prose(k, 4 + k % 9) for k in range(30)]
    pairs = [(i, "\n".join(lines[(i * j + j) % 30] for j in range(3 + i % 12))) for i in range(60)]
    limit = 12
    stands = defaultdict(set)
    for i, t in pairs:
        for x in t.split("\n"):
            stands[x].add(i)
    gone = {x: min(s) for x, s in stands.items() if len(s) > limit}
    out = {r.doc_id: r for r in quality_rules(docs(pairs), max_docs=limit).collect()}
    for i, t in pairs:
        left = [x for x in t.split("\n") if x not in gone or gone[x] == i]
        words = sum(len(x.split()) for x in left)
        assert out[i].clean_text == "\n".join(left) and out[i].n_words_left == words
        n, _, _, _, repeats = brute_counts(t)
        assert out[i].kept == (n >= 50 and 100 * repeats <= 50 * n and 100 * words >= 30 * n)


def test_default_limit_reaches_small_hosts(docs):
    shared = prose(1, 40)
    pairs = [(i, f"{shared}\n{prose(i + 10, 60 if i else 5)}") for i in range(9)] + [(i, f"{shared}\n{prose(i + 10, 15)}") for i in range(20, 22)]
    out = {r.doc_id: r for r in quality_rules(docs(pairs)).collect()}
    assert out[0].n_words_left == 45 and all(out[i].kept and out[i].n_words_left == 60 for i in range(1, 9))
    assert not out[20].kept and not out[20].base_failed and out[21].clean_text == prose(31, 15)
