"""Queries on the given tables, one or more per operator, each with its SQL where SQL can say it."""

from gridspark.catalog.base import CATALOG, Entry, entries

__all__ = ["CATALOG", "Entry", "entries"]
