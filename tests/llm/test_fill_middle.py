import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridspark.llm.fill_middle import Cuts, fill_in_middle, join_parts, restore, split_parts
from gridspark.llm.textbytes import text_bytes

ALPHABET = st.text(alphabet="ab\n\r é字\U0001f600<PSM>", max_size=40)


def units_of(text, unit):
    return re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)


@pytest.mark.parametrize("unit", ["line", "code_point"])
@given(st.lists(ALPHABET, min_size=1, max_size=6))
@settings(max_examples=150, deadline=None)
def test_every_cut_of_every_text(unit, texts):
    data, offsets = text_bytes(pa.array(texts))
    cuts = Cuts(data, offsets, unit)
    split = [units_of(t, unit) for t in texts]
    assert cuts.units.tolist() == [len(u) for u in split]
    for k in range(max(map(len, split)) + 1):
        ks = np.minimum(k, cuts.units)
        want = [len("".join(u[: min(k, len(u))]).encode()) for u in split]
        at = cuts.after(ks)
        assert (at - offsets[:-1]).tolist() == want
        assert cuts.code_points(offsets[:-1], at).tolist() == [len("".join(u[: min(k, len(u))])) for u in split]


@given(st.sampled_from(["psm", "spm"]), *[st.text(alphabet="<>PSMa\n", max_size=8).filter(lambda t: not re.search("<[PSM]>", t))] * 3)
@settings(max_examples=300, deadline=None)
def test_parts_come_back(form, prefix, middle, suffix):
    assert split_parts(form, join_parts(form, prefix, middle, suffix)) == (prefix, middle, suffix)


def brute(doc_id, text, unit="line", seed=7, percent=100, spm=50):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    units = units_of(text, unit)
    n = len(units)
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= percent:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


ROWS = [(i, "\n".join(f"zeile {k} é字" for k in range(i % 9)) + "\n" * (i % 3)) for i in range(60)]
ROWS += [(100, None), (101, ""), (102, "\n"), (103, "a<P>b\nc"), (104, "x\r\ny\x0b\n\n"), (None, "no id\nat all\n"), (5, "again"), (5, "again"), (106, "lang " * 400_000 + "\nende")]


@pytest.mark.parametrize(("unit", "percent", "spm"), [("line", 100, 50), ("code_point", 70, 30)])
def test_documents(docs, unit, percent, spm):
    table = docs(ROWS).withColumnRenamed("lang", "form")
    out = restore(fill_in_middle(table, unit=unit, percent=percent, spm_percent=spm)).collect()
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "", r["n_units"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in out)
    want = sorted((i is None, i or 0, t or "", *brute(i, t, unit, 7, percent, spm)) for i, t in ROWS)
    assert got == want
    assert all(r["restored"] == (r["text"] or "") for r in out)
    assert {"source", "n_chars"} <= set(out[0].asDict())


def test_empty_table_and_unknown_unit(docs):
    assert restore(fill_in_middle(docs([]))).collect() == []
    with pytest.raises(ValueError):
        fill_in_middle(docs([]), unit="word")
