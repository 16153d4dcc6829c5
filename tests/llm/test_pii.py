import random
import re

import pytest

from gridspark.llm.pii_crf import apart, base_spans, mask, personal_data, train, viterbi
from gridspark.llm.pii_seed import labelled_tokens

from .conftest import prose

PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def luhn(s):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(s[::-1])) % 10 == 0


def brute(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            fine = [True, kind != 1 or all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")), 12 <= len(digits) <= 19 and luhn(digits), 9 <= len(digits) <= 15]
            if fine[kind]:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


TEXTS = [
    "",
    "a@b.c,d@e.f@g.h x@y z@.q q@-.- a@b.c.d@e.f",
    "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.4 1.2.3 11.22.33.44.",
    "4111 1111 1111 1111, 4111-1111-1111-1112 4111  1111 0000000000000",
    "+1 (743) 555-3824 +12 +123456789 +1-2-3-4-5-6-7-8-9. ++49 30 123456 +1234567890123456",
    "é@b.c éa@b.cé 字1.2.3.4字",
    "@" * 50 + "a" * 500 + "@x.y",
    "mail me.19@mail5.example.com### 152.143.123.131### 4994226020900891",
]


@pytest.mark.parametrize("text", TEXTS)
def test_base_matches_the_patterns(text):
    assert base_spans(text) == brute(text)


def test_field_finds_held_out_spans_and_leaves_plain_text(spark, docs):
    field = train(labelled_tokens(spark))
    clean = ["in 1984 there were 12 of 300 pages", "chapter 4 verse 7, 2001 and 2002", prose(3, 40), "version 1.2 of part 77"]
    hits = [
        ('x token = "0a1b2c3d4e5f60718293a4b5c6d7e8f901234567" y', ["secret"]),
        ("call 718 555 0123 today", ["tel"]),
        ("ssn 321-54-9876 here", ["ssn"]),
        ("iban DE12 5001 0517 0648 4898 90 ok", ["iban"]),
        ("a@b.cc and password = \"q7w8e9r0\"", ["email", "secret"]),
    ]
    rows = [(i, t) for i, t in enumerate(clean)] + [(100 + i, t) for i, (t, _) in enumerate(hits)] + [(200, None), (201, "")]
    out = {r.doc_id: r for r in personal_data(docs(rows), field).collect()}
    assert all(out[i].spans == "" and out[i].masked == clean[i] for i in range(len(clean)))
    for i, (text, kinds) in enumerate(hits):
        assert [s.split(":")[0] for s in out[100 + i].spans.split(",")] == kinds, text
    assert out[104].n_email == 1 and out[104].masked == 'a <EMAIL> <SECRET>'.replace("a ", "", 1).replace(" <SECRET>", ' and password = "<SECRET>"')
    assert out[200].spans == "" and out[200].masked is None and out[201].masked == ""


def test_viterbi_is_the_best_of_all_paths(spark):
    from itertools import product

    import numpy as np

    field = train(labelled_tokens(spark))
    k = len(field.labels)
    scores = np.random.default_rng(3).normal(size=(6, 3, k)) * 3
    best = viterbi(scores, field)
    for n in range(6):
        def value(p, n=n):
            inner = sum(scores[n, t, p[t]] for t in range(3)) + sum(field.transitions[p[t], p[t + 1]] for t in range(2))
            return field.first[p[0]] + inner + field.last[p[2]]

        assert value(best[n]) == pytest.approx(max(value(p) for p in product(range(k), repeat=3)))


def test_empty_tables_and_clashing_columns(spark, docs):
    none = train(spark.createDataFrame([], "line int, position int, token string, label string"))
    assert none is None
    rows = docs([(1, "a@b.cc 718 555 0123"), (1, "a@b.cc 718 555 0123")]).selectExpr("*", "'x' AS spans", "1 AS masked")
    assert [r.spans for r in personal_data(rows, none).collect()] == ["email:0:6"] * 2
    assert personal_data(docs([]), none).collect() == []
    assert mask("abcdef", [(0, 0, 3), (2, 1, 4)]) == "<EMAIL>ef"
    with pytest.raises(ValueError):
        train(labelled_tokens(spark), max_tokens=5)


def test_letter_groups_and_secrets_of_letters_only(spark, docs):
    clean = ["the key to the house", "keep the secret of the old town", "he sent the token and left", "from 1990 UNTIL 2004 the", ""]
    hits = [
        ("iban BG80 BNBG 9661 1020 3456 78 ok", "iban <IBAN> ok"),
        ("account GB29 NWBK 6016 1331 9268 19 sort", "account <IBAN> sort"),
        ('x password = "correcthorse" y', 'x password = "<SECRET>" y'),
        ("token = 'mnbvcxzlkj'", "token = '<SECRET>'"),
    ]
    rows = [(i, t) for i, t in enumerate(clean)] + [(100 + i, t) for i, (t, _) in enumerate(hits)] + [(200, "forgot the password"), (201, '"correcthorse" is')]
    out = {r.doc_id: r.masked for r in personal_data(docs(rows), train(labelled_tokens(spark))).collect()}
    assert out == dict(enumerate(clean)) | {100 + i: m for i, (_, m) in enumerate(hits)} | {200: rows[-2][1], 201: rows[-1][1]}


def test_features_are_those_of_whole_tokens(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from gridspark.llm import pii_crf as P

    seen, features = [], P.token_features
    monkeypatch.setattr(P, "token_features", lambda *tokens: seen.append(tokens) or features(*tokens))
    before, long = "b" * 60 + ":", '"' + "aB" * 150 + '7x"'
    zeros = np.zeros(2)
    P.field_spans(pa.array([f"{before} = {long}"]), P.Field(("O", "B-secret"), np.zeros((P.BUCKETS, 2)), np.zeros((2, 2)), zeros, zeros))
    assert (long, "=", before) in seen


def test_very_long_numbers(spark, docs):
    field = train(labelled_tokens(spark))
    texts = ["0" * 5000 + ".1.2.3", "9" * 5000 + ".1.2.3", "1.2.3." + "0" * 5000 + "7", "see " + "0" * 4301 + "." + "0" * 9000 + ".255.0 end", "+" + "1" * 6000, "4" * 7000]
    out = personal_data(docs(list(enumerate(texts))), field).orderBy("doc_id").collect()
    assert [r.n_ip for r in out] == [1, 0, 1, 1, 0, 0]
    for row, text in zip(out, texts, strict=True):
        assert row.base_spans == ",".join(f"{'email ip card phone'.split()[k]}:{a}:{b}" for a, k, b in brute(text))


def test_overlaps_match_all_pairs():
    rng = random.Random(2)
    for _ in range(300):
        spans = lambda n: sorted((a, rng.randrange(4), a + rng.randrange(1, 9)) for a in (rng.randrange(60) for _ in range(n)))
        base, new = spans(rng.randrange(6)), spans(rng.randrange(8))
        assert apart(new, base) == [s for s in new if not any(s[0] < b and a < s[2] for a, _, b in base)]
    many = [(10 * i, 0, 10 * i + 5) for i in range(200_000)]
    assert len(apart([(a + 5, 4, a + 9) for a, _, _ in many], many)) == 200_000
