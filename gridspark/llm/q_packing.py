"""Query of best-fit packing."""

from gridspark.llm.base import query, table
from gridspark.llm.packing import pack_apart


@query("op8_packing")
def op8_packing(spark, sf_dir):
    """The place of every document; near copies are one cluster."""
    return pack_apart(table(spark, sf_dir, "documents"))
