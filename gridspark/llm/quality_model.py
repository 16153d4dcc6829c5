"""Quality classifier: a score from hashed words and marks, their pairs and triples, learned by follow-the-regularised-leader updates.

Defined results are those of ``ftrl``.
"""

from gridspark.llm.ftrl import Grams, Rates

GRAMS = Grams(offsets=((0,), (0, 1), (0, 1, 2)), marks=True)
RATES = Rates(alpha=1.0, beta=1.0, l1=4.0, l2=1.0)
