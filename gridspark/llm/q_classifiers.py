"""Queries of the text classifiers."""

from pyspark.sql import functions as F

from gridspark.llm import quality_model, toxicity
from gridspark.llm.base import query, table
from gridspark.llm.ftrl import score, train


def _held_out(folds: int, fold: int):
    return F.crc32(F.col("doc_id").cast("string")) % folds == fold


def _scored(spark, sf_dir, module, label, folds, fold):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(~_held_out(folds, fold)).select("doc_id", F.col(label).alias("label"))
    model = train(docs.join(labels, "doc_id"), module.GRAMS, module.RATES)
    found = score(docs, model, module.GRAMS)
    return found.select("doc_id", _held_out(folds, fold).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op3_toxicity")
def op3_toxicity(spark, sf_dir):
    """Toxicity of every document; labels of one fold of five are held out."""
    return _scored(spark, sf_dir, toxicity, "toxic", 5, 0)


@query("op6_quality_model")
def op6_quality_model(spark, sf_dir):
    """Quality of every document; labels of one fold of three are held out."""
    return _scored(spark, sf_dir, quality_model, "quality", 3, 1)
