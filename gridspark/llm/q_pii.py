"""Query of personal data."""

from pyspark.sql import functions as F

from gridspark.llm.base import query, table
from gridspark.llm.pii_crf import BASE, personal_data, train
from gridspark.llm.pii_seed import labelled_tokens


@query("op2_pii")
def op2_pii(spark, sf_dir):
    """Personal data of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = personal_data(docs, train(labelled_tokens(spark)))
    return found.select("doc_id", *[f"n_{kind}" for kind in BASE], F.sha2("base_spans", 256).alias("base_sha256"), "spans")
