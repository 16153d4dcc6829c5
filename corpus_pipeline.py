"""The corpus pipeline: every stage reads what its predecessor kept, as Parquet, and calls one operator of ``gridspark.llm``.

quality rules -> near duplicates -> benchmark decontamination -> personal data -> packing

Null ids and texts, empty and very long texts, repeated rows and further columns are those of the operators; each stage carries the columns of
the documents along. A null text fails the quality rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.llm.decontaminate import contamination
from gridspark.llm.line_quality import quality_rules
from gridspark.llm.packing import near_copies, pack_apart
from gridspark.llm.pii_crf import personal_data, train
from gridspark.llm.pii_seed import labelled_tokens
from gridspark.llm.token_blocks import shared_path


# A column name that documents do not have.
KEY = "_p_key"


def _with_text(docs: DataFrame, names: list[str], text: str) -> DataFrame:
    """The columns of the documents with another text; n_chars follows it."""
    columns = {"text": F.col(text), "n_chars": F.length(text).cast("long")}
    return docs.select(*[columns.get(c, F.col(c)).alias(c) for c in names])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without the lines that too many documents of their host share."""
    return _with_text(quality_rules(docs).filter("kept"), docs.columns, "clean_text")


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates: the one with the smallest id, rows without an id last.

    Documents are told apart by a hash of id and text, so rows with a null id are compared and kept like others, and so is every text of
    an id that stands there with several. Rows that repeat id and text count once. A null or empty text, or one without words, is a
    group of its own for each id.
    """
    names = docs.columns
    keyed = docs.withColumn(KEY, F.xxhash64("doc_id", "text"))
    classes = near_copies(docs)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", KEY)
    first = keyed.select("doc_id", KEY).join(classes, KEY).groupBy("_p_class").agg(F.min_by(KEY, order).alias(KEY)).select(KEY)
    return keyed.join(first, KEY, "left_semi").dropDuplicates(["doc_id", KEY]).select(*names)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contamination(docs, benchmark).filter(~F.col("contaminated")).select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return _with_text(personal_data(docs, train(labelled_tokens(spark))), docs.columns, "masked")


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bin and the place of every piece of every document; texts that are near copies once they are masked are one cluster."""
    return pack_apart(docs)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", deduplicate),
    ("benchmark decontamination", decontaminate),
    ("PII", mask_personal_data),
    ("best-fit packing", pack_documents),
]

# Near duplicates, the random field and the packing have no statement in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        path = shared_path(spark, f"pipeline-{number}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
