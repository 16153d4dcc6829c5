"""All queries of the subpackage."""

from importlib import import_module

from gridspark.llm.base import ORACLES, QUERIES

MODULES = ["q_line_quality", "q_decontaminate", "q_token_blocks", "q_jaccard_join", "q_packing", "q_classifiers", "q_url_filter", "q_pii", "q_warc", "q_line_dedup", "q_fill_middle", "q_conversation_repair"]

for _module in MODULES:
    import_module(f"gridspark.llm.{_module}")

__all__ = ["ORACLES", "QUERIES"]
