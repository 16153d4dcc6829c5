import random
from collections import defaultdict

import numpy as np
import pytest

from gridspark.llm.line_dedup import Shard, drop_lines, line_counts, line_index
from gridspark.llm.perfect_hash import PerfectHash

SPACES = " \t\n\x0b\x0c\r"


@pytest.mark.parametrize("n", [0, 1, 2, 63, 5000, 200_000])
def test_numbers_are_minimal_and_perfect(n):
    keys = np.random.default_rng(n).integers(0, 1 << 63, (n, 2), dtype=np.uint64)
    keys[: n // 3, 0] = 7  # equal first words
    numbers = PerfectHash.build(keys)
    assert sorted(numbers(keys).tolist()) == list(range(n))
    assert numbers.bits.size * 64 <= 4.5 * n + 64 * 64
    other = numbers(np.random.default_rng(n + 1).integers(0, 1 << 63, (50, 2), dtype=np.uint64))
    assert ((other >= -1) & (other < max(n, 1))).all()


def test_equal_keys_are_an_error():
    with pytest.raises(ValueError):
        PerfectHash.build(np.array([[1, 2], [1, 2]], np.uint64))


def test_arrays_survive_bytes_and_reject_foreign_lines():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 1 << 63, (3000, 2), dtype=np.uint64)
    counts, keepers = rng.integers(1, 6, 3000), rng.integers(0, 50, 3000)
    shard = Shard.from_bytes(Shard.build(keys, counts, keepers).to_bytes())
    docs = rng.integers(0, 50, 3000)
    assert (shard.drops(keys, docs, 3) == ((counts >= 3) & (keepers != docs))).all()
    foreign = keys.copy()
    foreign[:, 1] ^= np.uint64(1)
    assert not shard.drops(foreign, docs, 0).any()


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACES))


def brute(rows, min_chars=20, min_docs=3):
    held = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            held[key(line)].add(i)
    order = lambda i: (i is not None, i or 0)
    gone = lambda i, k: len(k) >= min_chars and len(held[k]) >= min_docs and i != max(held[k], key=order)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not gone(i, key(x))]
        out.append((order(i), len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def sample():
    rng = random.Random(9)
    shared = [f"shared line number {k} Äé字 with words" for k in range(40)] + ["É" * 19, "É" * 20, "short one"]
    rows = []
    for i in range(400):
        lines = []
        for _ in range(rng.randrange(8)):
            line = rng.choice(shared) if rng.random() < 0.6 else f"line of its own {rng.random()}"
            line = line.upper() if rng.random() < 0.1 and line.isascii() else line
            lines.append(rng.choice(["", " ", "\t\r", "\x0b\x0c"]) + line + rng.choice(["", "  ", "\r"]))
        rows.append((i - 20, "\n".join(lines) + rng.choice(["", "\n", "\n\n"])))
    everywhere = "this line stands in a third of all documents"
    rows = [(i, f"{t}\n{everywhere}" if i % 3 == 0 else t) for i, t in rows]
    rows += [(None, "x\n" + shared[0]), (None, shared[1]), (5000, None), (5001, ""), (5002, "\n"), (5003, "  \n" + everywhere + "\n" + everywhere)]
    rows += [(6000, shared[2]), (6000, shared[2]), (6000, shared[3] + "\nother text of this id"), (6001, "wort " * 300_000 + "\n" + shared[4])]
    return rows


@pytest.mark.parametrize(("index_bytes", "shard_keys"), [(1 << 26, 1 << 15), (1 << 26, 7), (0, 1 << 15), (0, 9)])
def test_documents(docs, index_bytes, shard_keys):
    table = docs(sample()).withColumnRenamed("lang", "n_lines")
    out = drop_lines(table, index_bytes=index_bytes, shard_keys=shard_keys).collect()
    got = sorted(((r["doc_id"] is not None, r["doc_id"] or 0), r["n_lines"], r["n_dropped"], r["kept_text"]) for r in out)
    assert got == brute(sample())
    assert {"source", "n_chars"} <= set(out[0].asDict())


def test_counts_and_empty_table(docs):
    rows = [(i, "a line that is long enough\nand again one that is long") for i in range(5)]
    counts = line_counts(docs(rows)).collect()
    assert sorted((r["n_docs"], r["keeper"]) for r in counts) == [(5, 4), (5, 4)]
    assert line_index(line_counts(docs([])))[0].count() == 0
    assert drop_lines(docs([])).collect() == [] == drop_lines(docs([]), index_bytes=-1).collect()
