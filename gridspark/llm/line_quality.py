"""Quality rules: counts of each text, and lines that many documents of a host share.

``rule_counts`` adds the counts of a text, ``frequent_lines`` finds the lines that stand in too many documents
of one host, and ``quality_rules`` joins both into a verdict and the text without those lines. Everything is
built from SQL functions on the JVM side.

How it scales: repeats inside a text are found inside its row. Lines are hashed and grouped by (host, line) with
partial aggregation (the hashes are written once and read twice), so that a line which stands in a third of all documents arrives as one row per task; only
lines above the limit are joined back, and only per-document sums (and the few removed lines) reach the documents.

A line is frequent in a host if more than ``max_docs`` different documents of the host hold it and these are more than ``max_percent``
of the host's documents: an absolute floor for small hosts, a share for large ones.

Defined results: a null text has no words, fails the base rule and stays null. A null host is a host of its own. The document with the
smallest id keeps a frequent line, so that of many copies of a text in one host the first one stays whole. Rows of one doc_id are one document, a
null doc_id is one as well. Rows that repeat a doc_id and a text get the same verdict each. An empty table gives an empty result. Input columns may
have any name but those of the result; work columns start with ``_q_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.session import cut_lineage

SYMBOLS = "[#*$%&|<>]"
WINDOW = 3

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_DOCS_PER_LINE = 5
MAX_PERCENT_PER_LINE = 1
MIN_LEFT_PERCENT = 30

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _words(text: Column) -> Column:
    return F.filter(F.split(text, "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")


def _lines(text: Column) -> Column:
    """The lines of a text that hold a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t\\n\\x0B\\f\\r]"))


def normal_line(line: Column) -> Column:
    """A line in lower case, without outer and repeated white space."""
    return F.lower(F.trim(F.regexp_replace(line, "[ \\t\\x0B\\f\\r]{2,}|[\\t\\x0B\\f\\r]", " ")))


def _gaps(values: Column) -> Column:
    """Pairs of neighbours, as two arrays to zip."""
    n = F.greatest(F.size(values) - 1, F.lit(0))
    return F.slice(values, F.lit(1), n), F.slice(values, F.lit(2), n)


def rule_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long).

    For the repeats, hashes of three-word windows are sorted with their positions where any hash is repeated; equal
    neighbours give the positions of repeated windows, and each covers the words up to the next position, three at most.
    """
    source = F.coalesce(F.col(text), F.lit(""))
    lines = _lines(source)
    out = docs.withColumns({"_q_text_words": _words(source), "_q_lines": lines})
    out = out.withColumns({"_q_chars": F.length(F.array_join("_q_text_words", "")), "_q_words": F.transform("_q_text_words", lambda w: F.xxhash64(w))})
    n = F.size("_q_words")
    out = out.withColumn(
        "_q_keys",
        F.transform(
            F.slice("_q_words", F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(0))),
            lambda h, i: F.xxhash64(h, *[F.get("_q_words", i + k) for k in range(1, WINDOW)]),
        ),
    )
    repeats = F.size(F.array_distinct("_q_keys")) < F.size("_q_keys")
    out = out.withColumn("_q_order", F.when(repeats, F.sort_array(F.transform("_q_keys", lambda k, i: F.struct(k.alias("k"), i.alias("i"))))))
    here, there = _gaps(F.col("_q_order"))
    pairs = F.zip_with(here, there, lambda a, b: F.when(a["k"] == b["k"], F.array(a["i"], b["i"])))
    out = out.withColumn("_q_at", F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull())))))
    here, there = _gaps(F.col("_q_at"))
    covered = F.aggregate(F.zip_with(here, there, lambda a, b: F.least(b - a, F.lit(WINDOW))), F.lit(WINDOW), lambda s, x: s + x)
    return out.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.col("_q_chars").cast("long"),
            "n_symbols": F.regexp_count(source, F.lit(SYMBOLS)).cast("long"),
            "n_dup_lines": (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        }
    ).drop("_q_text_words", "_q_chars", "_q_words", "_q_lines", "_q_keys", "_q_order", "_q_at")


def base_failed(min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT) -> Column:
    """The verdict of the counts alone."""
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def _document_lines(docs: DataFrame, text: str, host: str, doc_id: str) -> DataFrame:
    """One row per document and line: the hash of the line and its number of words."""
    lines = F.transform(_lines(F.col(text)), lambda x: F.struct(F.xxhash64(normal_line(x)).alias("line"), F.size(_words(x)).alias("n")))
    return docs.filter(F.col(text).isNotNull()).select(
        F.col(doc_id).alias("_q_doc"), F.xxhash64(text).alias("_q_text"), F.xxhash64(host).alias("_q_host"), F.inline(lines)
    )


def frequent_lines(lines: DataFrame, hosts: DataFrame, max_docs: int = MAX_DOCS_PER_LINE, max_percent: float = MAX_PERCENT_PER_LINE) -> DataFrame:
    """(host, line, smallest document) of the lines in more than ``max_docs`` documents and ``max_percent`` of a host's documents."""
    return (
        lines.groupBy("_q_host", "line")
        .agg(F.count_distinct(F.struct("_q_doc")).alias("n_docs"), F.min("_q_doc").alias("first_doc"))
        .filter(F.col("n_docs") > max_docs)
        .join(hosts, "_q_host")
        .filter(100 * F.col("n_docs") > max_percent * F.col("host_docs"))
        .select("_q_host", "line", "first_doc")
    )


def host_sizes(docs: DataFrame, host: str, doc_id: str) -> DataFrame:
    """The number of different documents of each host."""
    return docs.groupBy(F.xxhash64(host).alias("_q_host")).agg(F.count_distinct(F.struct(doc_id)).alias("host_docs"))


def removed_lines(lines: DataFrame, frequent: DataFrame) -> DataFrame:
    """Per document and text: the hashes of its lines to remove and the number of words in them."""
    return (
        lines.join(frequent, ["_q_host", "line"])
        .filter(~F.col("_q_doc").eqNullSafe(F.col("first_doc")))
        .groupBy("_q_doc", "_q_text")
        .agg(F.collect_set("line").alias("_q_removed"), F.sum("n").alias("_q_gone"))
    )


def quality_rules(
    docs: DataFrame,
    text: str = "text",
    host: str = "source",
    doc_id: str = "doc_id",
    max_docs: int = MAX_DOCS_PER_LINE,
    max_percent: float = MAX_PERCENT_PER_LINE,
    min_left_percent: int = MIN_LEFT_PERCENT,
) -> DataFrame:
    """``docs`` with the counts, ``base_failed``, ``n_words_left``, ``kept`` and ``clean_text``.

    A document is depleted, and not kept, if fewer than ``min_left_percent`` of its words are left without the frequent lines.
    """
    lines = cut_lineage(_document_lines(docs, text, host, doc_id))
    gone = removed_lines(lines, frequent_lines(lines, host_sizes(docs, host, doc_id), max_docs, max_percent))
    counted = rule_counts(docs, text).withColumns({"_q_id": F.col(doc_id), "_q_hash": F.xxhash64(text)})
    both = counted.join(gone, F.col("_q_id").eqNullSafe(F.col("_q_doc")) & (F.col("_q_hash") == F.col("_q_text")), "left")
    left = F.col("n_words") - F.coalesce("_q_gone", F.lit(0))
    kept = ~base_failed() & (100 * left >= min_left_percent * F.col("n_words"))
    stay = F.filter(F.split(F.col(text), "\n"), lambda x: ~F.array_contains("_q_removed", F.xxhash64(normal_line(x))))
    return both.select(
        *[F.col(c) for c in docs.columns],
        *[F.col(c) for c in COUNTS],
        base_failed().alias("base_failed"),
        left.alias("n_words_left"),
        # Not deterministic for the optimiser, so that a filter on it stays here and does not copy the nested counts into scans.
        F.when(F.spark_partition_id() >= 0, kept).alias("kept"),
        F.when(F.col("_q_removed").isNull(), F.col(text)).otherwise(F.array_join(stay, "\n")).alias("clean_text"),
    )
