"""Which stock locations are warehouses.

The planning steps do not agree on the keywords, so the variants are named.
``like`` patterns treat ``_`` as any character; ``word`` lists are literal.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# LIKE patterns per planning step.
LIKE_PATTERNS = {
    "procurement": ["%warehouse%", "% wh %", "%_wh%", "%hub%", "%central%", "%commissary%"],
    "alerts": ["%warehouse%", "%_wh%"],
    "run_rate": ["%warehouse%", "% wh %", "%_wh%"],
}
# Literal keywords of the warehouse plan.
PLAN_WORDS = [
    "warehouse", " wh", "wh ", "_wh", "hub", "central",
    "cluster store", "cluster kitchen", "store/wh",
]


def is_warehouse(name: Column, variant: str = "plan", more_words: tuple[str, ...] = ()) -> Column:
    """Whether a name is that of a warehouse; ``more_words`` are the caller's own keywords for the plan."""
    low = F.lower(name)
    if variant == "plan":
        tests = [F.contains(low, F.lit(word)) for word in [*PLAN_WORDS, *more_words]]
    else:
        tests = [low.like(pattern) for pattern in LIKE_PATTERNS[variant]]
    return reduce(lambda a, b: a | b, tests)
