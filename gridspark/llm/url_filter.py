"""URL filter: fixed rules first, then logistic regression on hashed character n-grams of host and path.

``url_parts`` cuts urls, ``rule_verdict`` applies rules of host and path, ``train`` fits the regression to a small table of labelled
urls, and ``judge`` brings all together. N-grams, hashes, dot products and rules are SQL functions; the fit is Spark's own
logistic regression on the labelled table. The weights, ``DIM`` numbers, are a literal of the plan; nothing is shuffled or joined.

Defined results: a null url, or one without ``://``, has an empty host and path and gets the verdict of the intercept. Ties of equally long
rules go to the first one. Repeated rows are judged one by one, an empty table gives no rows. Result columns replace input columns of their names.
With one label only in the labelled table, every url gets that label.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.session import cut_lineage

DIM = 16384
SIZES = (3, 4, 5)
THRESHOLD = 0.5
REGULARISATION = 0.0003
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Weights:
    values: tuple[float, ...]
    intercept: float


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_verdict(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, or nulls."""
    name = verdict = None
    for rule in sorted(rules, key=lambda r: -len(r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name = F.when(fits, rule.name) if name is None else name.when(fits, rule.name)
        verdict = F.when(fits, rule.verdict) if verdict is None else verdict.when(fits, rule.verdict)
    null = F.lit(None).cast("string")
    return (null, null) if name is None else (name, verdict)


def _grams(text: Column, field: str, sizes: Sequence[int], dim: int) -> Column:
    """Hashed n-grams of a text between two marks."""
    marked = F.concat(F.lit("^"), text, F.lit("$"))

    def of_size(n: int) -> Column:
        starts = F.when(F.length(marked) >= n, F.sequence(F.lit(1), F.length(marked) - (n - 1))).otherwise(F.array().cast("array<int>"))
        # One parameter only: a second one would be the index of the element.
        return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.lit(field), F.substring(marked, i, F.lit(n))), F.lit(dim)).cast("int"))

    lists = [of_size(n) for n in sizes]
    return F.concat(*lists)


def url_features(host: Column, path: Column, sizes: Sequence[int] = SIZES, dim: int = DIM) -> Column:
    """The different feature numbers of a url, numbers in the path taken as equal; none for an empty host."""
    path = F.regexp_replace(path, "[0-9]+", "0")
    both = F.array_distinct(F.concat(_grams(host, "host", sizes, dim), _grams(path, "path", sizes, dim)))
    return F.when(host != "", both).otherwise(F.array().cast("array<int>"))


def train(labelled: DataFrame, url: str = "url", label: str = "blocked", dim: int = DIM) -> Weights:
    """Fit to (url, label 0 or 1); rows without a label are left out."""
    known = labelled.filter(F.col(label).isNotNull())
    host, path = url_parts(F.col(url))
    numbers = url_features(host, path, dim=dim).cast("array<string>")
    found = cut_lineage(known.select(F.col(label).cast("double").alias("label"), numbers.alias("f")))
    ones, rows = found.agg(F.sum("label"), F.count("*")).first()
    if not rows or ones in (0, rows):
        return Weights((0.0,) * dim, 35.0 if rows and ones else -35.0)
    names = CountVectorizer(inputCol="f", outputCol="features", vocabSize=dim, binary=True).fit(found)
    model = LogisticRegression(maxIter=60, regParam=REGULARISATION, standardization=False).fit(names.transform(found))
    values = dict(zip(map(int, names.vocabulary), model.coefficients.toArray().tolist(), strict=True))
    return Weights(tuple(values.get(i, 0.0) for i in range(dim)), float(model.intercept))


def url_score(features: Column, weights: Weights) -> Column:
    """Probability of label 1 as a sparse dot product."""
    table = F.split(F.lit(",".join(f"{w:.9g}" for w in weights.values)), ",").cast("array<double>")
    total = F.aggregate(features, F.lit(weights.intercept), lambda s, i: s + F.get(table, i))
    return 1 / (1 + F.exp(-total))


def judge(pages: DataFrame, weights: Weights, rules: Sequence[Rule], url: str = "url", threshold: float = THRESHOLD) -> DataFrame:
    """``pages`` with host, path, rule, score and verdict (allow or block)."""
    host, path = url_parts(F.col(url))
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "score", "verdict")]
    out = pages.select(*kept, host.alias("host"), path.alias("path"), *([F.col(url).alias("_u_url")] if url not in kept else []))
    name, verdict = rule_verdict(F.col("host"), F.col("path"), rules)
    out = out.withColumn("_u_features", url_features(F.col("host"), F.col("path")))
    out = out.withColumns({"rule": name, "score": url_score(F.col("_u_features"), weights)})
    learned = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return out.withColumn("verdict", F.coalesce(verdict, learned)).drop("_u_features", "_u_url")
