"""Trigram postings of titles (QRY-7): which articles of a day hold which three
characters in a row.

One narrow row per day, trigram and article, the article as the 64-bit hash of
its key. Postings only narrow a search: two articles with one hash, or all
trigrams in other places, give a candidate that the search itself then refuses.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.operators.latest import article_key

GRAM = 3
# Trigrams of a search that are looked up: more of them hardly narrow it further.
MOST_GRAMS = 16


def grams(text: Column) -> Column:
    """The distinct trigrams of a text in lower case, by code point; null or short has none."""
    chars = F.split(F.lower(text), "")
    places = F.sequence(F.lit(0), F.size(chars) - GRAM)
    runs = F.transform(places, lambda i: F.concat(*[F.get(chars, i + k) for k in range(GRAM)]))
    return F.when(F.size(chars) >= GRAM, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def title_grams(latest: DataFrame) -> DataFrame:
    """``publication_date``, ``gram``, ``article``. Undated articles are in no window."""
    return latest.where(F.col("publication_date").isNotNull()).select(
        "publication_date", F.xxhash64(article_key()).alias("article"), F.explode(grams(F.col("web_title"))).alias("gram"))


def needle_grams(lowered: str, literal: bool = False, most: int = MOST_GRAMS) -> list[str]:
    """Trigrams that every title matching the (lower-case) text has: those of its
    runs between wildcards. None where all runs are shorter. Of many, ``most`` evenly spread."""
    runs = [lowered] if literal else re.split("[%_]", lowered)
    found = list(dict.fromkeys(run[i:i + GRAM] for run in runs for i in range(len(run) - GRAM + 1)))
    return [found[i * len(found) // most] for i in range(most)] if len(found) > most else found


def days_with(postings: DataFrame, wanted: list[str]) -> DataFrame:
    """The days on which one article has all of the trigrams (distinct ``publication_date``)."""
    return (postings.where(F.col("gram").isin(*wanted)).groupBy("publication_date", "article").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= len(wanted)).select("publication_date").distinct())
