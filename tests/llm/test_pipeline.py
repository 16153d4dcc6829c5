import shutil

import pytest

import corpus_pipeline as P

from .conftest import prose


@pytest.fixture
def folder(spark, docs, tmp_path):
    benchmark = [(1, prose(70, 30)), (2, None)]
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    base = prose(1, 100)
    near = " ".join(["changed", *base.split()[1:]])
    rows = [(1, base), (2, base), (3, near), (4, prose(4, 80)), (5, "too short"), (6, None), (7, "")]
    rows += [(8, f"{prose(70, 30)} {prose(8, 60)}"), (9, f"{prose(9, 60)} mail me.1@host.example now"), (10, " ".join(["again"] * 200))]
    docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_stages_keep_clean_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = [{1, 2, 3, 4, 8, 9}, {1, 4, 8, 9}, {1, 4, 9}, {1, 4, 9}]
    for (name, stage), want in zip(P.STAGES, kept, strict=False):
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes), name
        docs = spark.createDataFrame(out.collect(), docs.schema)
        assert {r.doc_id for r in docs.collect()} == want, name
    text = {r.doc_id: (r.text, r.n_chars) for r in docs.collect()}
    assert "mail <EMAIL> now" in text[9][0] and text[9][1] == len(text[9][0]) and text[1][0] == prose(1, 100)
    plan = P.STAGES[-1][1](spark, docs, folder).collect()
    assert {r.doc_id for r in plan} == {1, 4, 9} and sum(r.length for r in plan) == sum(len(t.split()) for t, _ in text.values())


def test_run_and_empty_documents(spark, folder, docs, tmp_path):
    assert {r.doc_id for r in P.run(spark, folder).collect()} == {1, 4, 9}
    none = tmp_path / "none"
    docs([]).write.parquet(str(none / "documents.parquet"))
    shutil.copytree(f"{folder}/benchmark.parquet", str(none / "benchmark.parquet"))
    assert P.run(spark, str(none)).collect() == []


def test_names_and_order():
    assert [n for n, _ in P.STAGES] == ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "PII", "best-fit packing"]
    assert P.ORACLE_SQL is None


def test_deduplication_loses_no_text(docs, spark):
    longer = f"{prose(1, 100)} and more"
    rows = [(None, prose(11, 60)), (None, prose(12, 60)), (5, longer), (5, prose(13, 60)), (6, longer), (7, prose(14, 60))]
    rows += [(8, None), (None, None), (9, ""), (10, "..."), (None, prose(1, 100)), (20, prose(20, 300)), (19, prose(20, 300)), (19, prose(20, 300)), (None, prose(15, 60)), (30, prose(15, 60))]
    out = P.deduplicate(spark, docs(rows), "").collect()
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in out)
    want = [(None, prose(11, 60)), (None, prose(12, 60)), (5, longer), (5, prose(13, 60)), (7, prose(14, 60)), (8, ""), (None, ""), (9, ""), (10, "..."), (19, prose(20, 300)), (30, prose(15, 60))]
    assert got == sorted((i is None, i or 0, t) for i, t in want)
