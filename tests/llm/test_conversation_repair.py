import hashlib
import heapq
import itertools
import random
import re

import pytest

from gridspark.llm.conversation_repair import NO_ID, repair, row_digests
from gridspark.llm.repair_dawg import LETTERS, Graph

SPACES = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """(cost, audit, written rows) of (role, text, fault) rows by a search over all edits, cheapest and ASCII-least first."""
    heap = [(0, "", 0, "", ())]
    done = set()
    while heap:
        cost, audit, i, initials, written = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            return cost, audit, list(written)
        if (i, initials[-1:]) in done:
            continue
        done.add((i, initials[-1:]))
        legal = lambda role: re.fullmatch("s?(ua)*u?", initials + role[:1]) and role[:1]
        for role in ("user", "assistant"):
            if legal(role):
                heapq.heappush(heap, (cost + 3, audit + "I", i, initials + role[0], (*written, f"{role}:")))
        if i == len(rows):
            continue
        role, text, fault = rows[i]
        heapq.heappush(heap, (cost + 4, audit + "D", i + 1, initials, written))
        if fault in ("blank", "duplicate"):
            continue
        extra = 3 if fault == "truncated" else 0
        if legal(role):
            heapq.heappush(heap, (cost + extra, audit + "K", i + 1, initials + role[0], (*written, f"{role}:{text}")))
        for other in ("user", "assistant"):
            if legal(other):
                heapq.heappush(heap, (cost + extra + 3, audit + "R", i + 1, initials + other[0], (*written, f"{other}:{text}")))


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        s = text.strip(SPACES)
        fault = "blank" if not s else "duplicate" if (role, text) in seen else "truncated" if s[-1] not in ".!?" else "ok"
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def test_graph_matches_a_search_over_all_edits():
    roles = ["system", "user", "assistant", "tool"]
    names = ["ok", "truncated", "blank", "duplicate"]
    letters = [c for c in LETTERS if c <= "I"]
    every = ["".join(p) for n in range(5) for p in itertools.product(letters, repeat=n)]
    rng = random.Random(1)
    chosen = sorted(rng.sample(every, 900)) + sorted("".join(rng.choices(letters, k=rng.randrange(5, 14))) for _ in range(150))
    graph = Graph()
    for reverse in chosen:
        rows = [(roles[LETTERS.index(c) % 4], "x", names[LETTERS.index(c) // 4]) for c in reversed(reverse)]
        assert graph.solve(reverse) == cheapest(rows)[:2], reverse


def test_suffixes_are_built_once():
    graph = Graph()
    signatures = sorted("".join(p) for p in itertools.product("ABC", repeat=6))
    for s in signatures:
        graph.solve(s)
    assert graph.built == sum(3**n for n in range(1, 7))
    assert graph.solve("CB" * 100_000)[0] == 0
    assert len(graph.register) < 2000


def brute(rows):
    by_conv = {}
    for conv, turn, role, text, n in rows:
        by_conv.setdefault(conv, []).extend([(turn, role if role is not None else " ", text if text is not None else " ")] * n)
    out = []
    for conv, own in by_conv.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
        marked = faults([r[1:] for r in own])
        turns = [t for t, _, _ in own if t is not None]
        count = lambda name: sum(f == name for _, _, f in marked)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, written = cheapest(marked)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((NO_ID if conv is None else conv, gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(written).encode()).hexdigest()))
    return sorted(out)


def sample():
    rng = random.Random(4)
    texts = ["Hello.", "Hello", "", " \t", "é字?", "Why!\n", "no end ", "A.\x0b", None]
    roles = ["user", "assistant", "system", "tool", None, "user", "assistant"]
    rows = []
    for conv in range(150):
        for turn in range(rng.randrange(1, 9)):
            rows.append((conv, rng.choice([turn, turn * 2, None, 3]), rng.choice(roles), rng.choice(texts), rng.choice([0, 1, 1, 1, 2])))
    rows += [(500, 0, "user", "gone.", 0), (None, 1, "user", "Hi.", 1), (None, 2, "assistant", "Ho.", 1), (-5, None, "assistant", "x", 1), (-5, None, "user", "y.", 1)]
    rows += [(600 + k, t, r, "Same in all.", 1) for k in range(40) for t, r in ((0, "user"), (1, "assistant"))]
    # A third of all rows in one conversation, with rows that repeat a lot.
    rows += [(700, t % 90, ("user", "assistant")[t % 2], f"Turn {t % 120}.", 1) for t in range(450)] + [(700, 5, "user", "Turn 5.", 30)]
    rows += [(701, 0, "user", "wort " * 300_000 + ".", 1)]
    return rows


SCHEMA = "conv_id long, turn int, role string, text string, copies int"


def test_conversations(spark):
    rows = sample()
    table = spark.createDataFrame(rows, SCHEMA).repartition(7)
    for c in ("gaps", "audit", "conv"):
        table = table.withColumn(c, table["role"])
    audit, repaired = repair(table, copies="copies")
    digests = {r["conv"]: r["sha256"] for r in row_digests(repaired).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted((*tuple(r), digests.get(r["conv"], empty)) for r in audit.collect()) == brute(rows)
    got = {}
    for r in repaired.collect():
        got.setdefault(r["conv"], []).append((r["place"], r["role"], r["text"], r["edit"]))
    for own in got.values():
        assert [p for p, *_ in own] == list(range(len(own)))
        assert re.fullmatch("(s?(ua)+)?", "".join(role[0] for _, role, _, _ in own))


def test_rows_without_copies_and_empty_table(spark):
    rows = [(1, 0, "user", "Hi.", 1), (1, 1, "assistant", "Ho.", 1)]
    audit, repaired = repair(spark.createDataFrame(rows, SCHEMA))
    assert [(r["cost"], r["audit"]) for r in audit.collect()] == [(0, "KK")]
    assert [tuple(r) for r in repaired.collect()] == [(1, 0, "user", "Hi.", "K"), (1, 1, "assistant", "Ho.", "K")]
    audit, repaired = repair(spark.createDataFrame([], SCHEMA))
    assert audit.collect() == [] == row_digests(repaired).collect()


@pytest.mark.parametrize(("initials", "cost", "audit"), [("", 0, ""), ("s", 4, "D"), ("u", 3, "KI"), ("a", 3, "IK"), ("uu", 3, "KR"), ("sua", 0, "KKK"), ("usa", 4, "KDK")])
def test_small_cases(initials, cost, audit):
    assert Graph().solve("".join(LETTERS["suax".index(c)] for c in reversed(initials))) == (cost, audit)
