"""Topic buckets of the section series.

A section counts toward every bucket whose pattern its lower-cased name
matches; buckets overlap on purpose and unmatched sections count nowhere.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bucket name and the LIKE patterns on lower(section).
TOPIC_BUCKETS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("world", ("%world%",)),
    ("politics", ("%politic%",)),
    ("business", ("%business%",)),
    ("culture", ("%culture%", "%art%")),
    ("climate", ("%climate%", "%environment%")),
    ("technology", ("%tech%", "%digital%")),
)

TOPIC_NAMES = tuple(name for name, _ in TOPIC_BUCKETS)


def matches(section: Column, patterns: tuple[str, ...]) -> Column:
    lowered = F.lower(section)
    cond = lowered.like(patterns[0])
    for pattern in patterns[1:]:
        cond = cond | lowered.like(pattern)
    return cond


def bucket_sums(section: Column, count: Column) -> list[Column]:
    """One ``SUM(CASE WHEN ... THEN count ELSE 0 END)`` per bucket."""
    return [
        F.sum(F.when(matches(section, patterns), count).otherwise(F.lit(0))).cast("long").alias(name)
        for name, patterns in TOPIC_BUCKETS
    ]
