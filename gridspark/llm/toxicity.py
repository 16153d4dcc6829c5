"""Toxicity: a score from hashed words, word pairs, triples and skip-grams, learned by FTRL-proximal updates.

Defined results are those of ``ftrl``.
"""

from gridspark.llm.ftrl import Grams, Rates

GRAMS = Grams(offsets=((0,), (0, 1), (0, 2), (0, 3)))
RATES = Rates(alpha=1.0, beta=1.0, l1=8.0, l2=1.0)
