"""Query of the url filter."""

from gridspark.llm.base import query, table
from gridspark.llm.url_filter import Rule, judge, train
from gridspark.llm.url_seed import labelled_urls

RULES = [
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
]


@query("op4_url_filter")
def op4_url_filter(spark, sf_dir):
    """Verdict of every page's url."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, train(labelled_urls(spark)), RULES).drop("url")
