"""QRY-7 over trigram postings: which days of a window a title search has to open.

``index_titles`` brings the postings up to date: only days whose folder of
``articles_latest`` is another than the one indexed are read. It is a job of
its own, so a refresh does not wait for it, and a search stays right however
far it lags or wherever it died: a day whose folder is not the indexed one is
searched without postings.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, LongType, StringType, StructField, StructType

from inkwell.config import ANALYTICS, Lake, configure
from inkwell.operators import titles
from inkwell.plans import queries as q
from inkwell.plans.refresh import in_dates, read_analytics
from inkwell.sources.store import NULL_PARTITION, TableStore

ARTICLES, DAY = "articles_latest", "publication_date"
GRAMS = "title_grams"
POSTING = StructType([StructField("article", LongType(), True), StructField("gram", StringType(), True)])
# The folder of every day whose postings are in GRAMS; written after them.
INDEXED = "title_gram_days"


def _folders(store: TableStore) -> dict[str, str]:
    """The folder of every dated day of the articles: one entry a day."""
    found = {f.rsplit("=", 1)[1]: f for f in store.partition_folders(ANALYTICS, ARTICLES, DAY)}
    found.pop(NULL_PARTITION, None)
    return found


def _indexed(store: TableStore) -> dict[str, str]:
    if store.current(ANALYTICS, INDEXED) is None:
        return {}
    return {r["day"]: r["folder"] for r in store.read(ANALYTICS, INDEXED).collect()}


def postings_of(store: TableStore) -> DataFrame:
    return store.read(ANALYTICS, GRAMS, schema=POSTING, partitions=StructType([StructField(DAY, DateType(), True)]),
                      columns=[DAY, *POSTING.fieldNames()])


def index_titles(spark: SparkSession, lake: Lake) -> int:
    """Index the days that have changed, and drop those that are gone; how many that were.

    The folders are listed before the articles are read, so what is recorded
    is never newer than the postings. Of two runs at once the second gets a
    ``Conflict``.
    """
    store = TableStore(configure(spark), lake)
    heads = store.head(ANALYTICS, GRAMS), store.head(ANALYTICS, INDEXED)
    now, was = _folders(store), _indexed(store)
    changed = sorted(d for d in now.keys() | was.keys() if now.get(d) != was.get(d))
    if not changed:
        return 0
    days = [date.fromisoformat(d) for d in changed]
    rows = titles.title_grams(read_analytics(store, ARTICLES).where(in_dates(days)))
    if was and store.current(ANALYTICS, GRAMS) is not None:
        store.replace_partitions(rows, ANALYTICS, GRAMS, partition_by=DAY, values=changed, cluster_by=("gram",), base=heads[0])
    else:
        store.replace(rows, ANALYTICS, GRAMS, partition_by=(DAY,), cluster_by=("gram",), base=heads[0])
    store.replace(spark.createDataFrame(sorted(now.items()), "day string, folder string").coalesce(1), ANALYTICS, INDEXED,
                  base=heads[1])
    return len(changed)


def search_days(store: TableStore, start: date | str, end: date | str, query_text: str | None, literal: bool = False) -> list[date] | None:
    """The days of the window that may hold a match; None where only a scan can tell
    (no text, no three characters in a row between wildcards, no postings)."""
    if query_text is None or store.current(ANALYTICS, GRAMS) is None:
        return None
    # lower case as the search has it
    lowered = store.spark.sql("SELECT lower(:text) AS text", args={"text": query_text}).first()["text"]
    wanted, was = titles.needle_grams(lowered, literal), _indexed(store)
    if not wanted or not was:
        return None
    now = {d: f for d, f in _folders(store).items() if str(start) <= d <= str(end)}
    current = [date.fromisoformat(d) for d, f in now.items() if was.get(d) == f]
    postings = postings_of(store).where(q.in_window(start, end))
    found = {r[0] for r in titles.days_with(postings, wanted).collect()}
    stale = [date.fromisoformat(d) for d, f in now.items() if was.get(d) != f]
    return sorted(stale + [d for d in current if d in found])


def narrowed(store: TableStore, articles, start: date | str, end: date | str, query_text: str | None,
             literal: bool = False) -> DataFrame:
    """``articles()`` (the table as stored), cut down to the days that may match.

    A table that changes between the look at the postings and the read is searched whole."""
    head = store.head(ANALYTICS, ARTICLES)
    days = search_days(store, start, end, query_text, literal)
    latest = articles()
    if days is None or store.head(ANALYTICS, ARTICLES) != head:
        return latest
    return latest.where(in_dates(days)) if days else latest.where(F.lit(False))
