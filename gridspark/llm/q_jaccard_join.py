"""Query of the near-duplicate join."""

from gridspark.llm.base import query, table
from gridspark.llm.jaccard_join import near_duplicates


@query("op9_jaccard_join")
def op9_jaccard_join(spark, sf_dir):
    """Class and number of links of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))
