"""SRC-1 … SRC-5: landed source pages → validated ``articles_raw`` rows.

A fetcher (not part of this library) lands the content API's response pages
under ``{landing}/day=YYYY-MM-DD/``: JSON Lines with one page envelope per
line, or one page per file. Spark reads them as text, parses the envelope,
explodes the results (each kept as its raw JSON text, so non-objects and
unknown fields survive), maps the source fields to columns, validates, and
writes accepted and rejected rows of a load in one pass.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType,
    DateType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

from inkwell.config import RAW
from inkwell.functions.formats import utc_literal
from inkwell.schemas import ARTICLES_RAW, PAGE_ENVELOPE, SOURCE_RESULT
from inkwell.sources.store import TableStore, new_id

# Reject reasons, first match wins.
NOT_A_DICT = "not_a_dict"
MISSING_ID = "missing_guardian_id"
MISSING_PUBLISHED = "missing_published_at"
UNPARSEABLE_PUBLISHED = "unparseable_published_at"
# Reasons of whole pages: the row's payload is the page's text.
UNPARSEABLE_PAGE = "unparseable_page"
NO_RESPONSE = "no_response"
RESULTS_NOT_A_LIST = "results_not_a_list"

RAW_TABLE = "articles_raw"
LOAD_LOG_TABLE = "articles_raw_loads"
FOLDS_TABLE = "articles_raw_folds"
# Loads left apart, and rows from which a load is large enough as it is.
MOST_LOADS = 100
FOLD_ROWS = 10_000_000
ACCEPTED = "accepted"


def read_landing(spark: SparkSession, landing_dir: str, *, one_page_per_file: bool = False,
                 days: tuple[date | str, date | str] | None = None) -> DataFrame:
    """SRC-1 input: landed text with its ``day`` partition and file path.

    ``days`` bounds the fetch days read; it prunes ``day=`` directories.
    """
    df = spark.read.text(landing_dir, wholetext=one_page_per_file).select(
        "value", "day", F.col("_metadata.file_path").alias("file_path"))
    if days is not None:
        lo, hi = (F.lit(str(d)).cast("date") for d in days)
        df = df.filter(F.col("day").between(lo, hi))
    return df


def read_pages(text: DataFrame) -> DataFrame:
    """The landed text with its envelope: ``_env``, ``_page`` (the envelope's
    ``currentPage``, else the ``page-N`` number in the file name) and
    ``page_reject``, why the page as a whole cannot be read, or null.

    Blank lines are no pages. The envelope is parsed once into a struct
    column: reading two fields straight off ``from_json`` would let the
    optimizer split it into one pruned parse per field. A second parse, to
    ``variant``, tells the types apart that text cannot: a results list from
    an object, and an object among the results from a string that looks like
    one.
    """
    from_name = F.regexp_extract(F.col("file_path"), r"page[-_=]?(\d+)", 1)
    keep = [c for c in ("day", "_batch_ts") if c in text.columns]
    parsed = text.filter(F.trim("value") != "").select(
        *keep, "value", F.from_json(F.col("value"), PAGE_ENVELOPE).getField("response").alias("_env"),
        F.try_parse_json("value").alias("_json"),
        F.when(from_name != "", from_name.cast("long")).alias("_page_from_name"))
    response = F.try_variant_get("_json", "$.response", "map<string,variant>")
    results = F.try_variant_get("_json", "$.response.results", "array<variant>")
    absent = F.expr("try_variant_get(_json, '$.response.results', 'variant')")
    reject = (F.when(F.col("_json").isNull(), F.lit(UNPARSEABLE_PAGE))
              .when(response.isNull(), F.lit(NO_RESPONSE))
              .when(results.isNull() & absent.isNotNull() & ~F.is_variant_null(absent), F.lit(RESULTS_NOT_A_LIST)))
    objects = F.transform(results, lambda r: F.try_variant_get(r, "$", "map<string,variant>").isNotNull())
    return parsed.select(*keep, "value", "_env", F.coalesce(F.col("_env.currentPage").cast("long"), F.col("_page_from_name"))
                         .alias("_page"), reject.alias("page_reject"), objects.alias("_objects"))


def explode_pages(text: DataFrame) -> DataFrame:
    """SRC-1: one row per result element, with the page it came from.

    An absent or null results list gives no rows; a page that cannot be read
    gives one row, its own text with the reason.
    """
    pages = read_pages(text)
    keep = [c for c in ("day", "_batch_ts") if c in pages.columns]
    element = "array<struct<result:string,is_object:boolean>>"
    elements = F.zip_with(F.col("_env.results"), F.col("_objects"),
                          lambda r, o: F.struct(r.alias("result"), F.coalesce(o, F.lit(False)).alias("is_object")))
    rows = F.when(F.col("page_reject").isNotNull(),
                  F.array(F.struct(F.col("value").alias("result"), F.lit(False).alias("is_object")))).otherwise(
        F.coalesce(elements, F.array().cast(element)))
    return pages.select(*keep, F.col("_page").alias("api_response_page"), "page_reject",
                        F.explode(rows).alias("_e")).select(
        *keep, "api_response_page", "page_reject", F.col("_e.result").alias("result"),
        F.col("_e.is_object").alias("_is_object"))


def page_completeness(text: DataFrame, days: tuple[date | str, date | str] | None = None) -> DataFrame:
    """Per fetch day: the pages the source announced, those landed, and whether
    every announced page is there.

    Every day with any landed text has a row, and with ``days`` every day of
    that window. A day none of whose pages can be read announces nothing
    (null) and has landed none; it is not complete, nor is a day of the
    window without text. Unreadable pages count as not landed.
    """
    readable = F.col("page_reject").isNull()
    found = read_pages(text).groupBy("day").agg(
        F.max(F.when(readable, F.col("_env.pages").cast("long"))).alias("announced"),
        F.countDistinct(F.when(readable, F.col("_page"))).alias("landed"),
        F.count_if(~readable).alias("unreadable"))
    if days is not None:
        lo, hi = (F.lit(str(d)).cast("date") for d in days)
        calendar = text.sparkSession.range(1).select(F.explode(F.sequence(lo, hi)).alias("day"))
        found = calendar.join(found, "day", "left")
    landed = F.coalesce("landed", F.lit(0))
    # a day whose pages announce no number is complete once one of them is readable
    complete = (landed > 0) & (landed >= F.coalesce("announced", F.lit(0)))
    return found.select("day", "announced", landed.alias("landed"), F.coalesce("unreadable", F.lit(0)).alias("unreadable"),
                        complete.alias("complete"))


def _present(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def normalise(results: DataFrame) -> DataFrame:
    """SRC-2: map the source fields to columns; tags are the non-empty tag
    titles; the element's own text is the raw payload.

    One parse per element: the struct is a column of its own projection and
    the fields are read from it in the next.
    """
    own = ("result", "api_response_page", "page_reject", "_is_object")
    extra = [c for c in results.columns if c not in own]
    parsed = results.select(*extra, *own, F.when(F.col("_is_object"), F.from_json(F.col("result"), SOURCE_RESULT)).alias("_obj"))
    obj = F.col("_obj")
    # each tag by itself: one that is no object costs only itself
    titles = F.transform(F.coalesce(obj.getField("tags"), F.array().cast("array<string>")),
                         lambda t: F.get_json_object(t, "$.webTitle"))
    published_text = obj.getField("webPublicationDate")
    # a time of day alone would be read as today's
    has_date = published_text.rlike(r"^\s*\d{4}-\d{2}-\d{2}")
    return parsed.select(
        *extra,
        obj.getField("id").alias("guardian_id"),
        obj.getField("webUrl").alias("web_url"),
        obj.getField("webTitle").alias("web_title"),
        obj.getField("sectionId").alias("section_id"),
        obj.getField("sectionName").alias("section_name"),
        obj.getField("pillarId").alias("pillar_id"),
        obj.getField("pillarName").alias("pillar_name"),
        F.when(has_date, F.try_to_timestamp(published_text)).alias("published_at"),
        F.filter(titles, _present).alias("tags"),
        "api_response_page",
        F.col("result").alias("raw_payload"),
        published_text.alias("_published_text"),
        "_is_object",
        "page_reject",
    )


def reject_reason() -> Column:
    """SRC-4 (quirks 16, 17): why a normalised row is rejected, or null."""
    return (F.when(F.col("page_reject").isNotNull(), F.col("page_reject"))
            .when(~F.col("_is_object"), F.lit(NOT_A_DICT))
            .when(~_present(F.col("guardian_id")), F.lit(MISSING_ID))
            .when(~_present(F.col("_published_text")), F.lit(MISSING_PUBLISHED))
            .when(F.col("published_at").isNull(), F.lit(UNPARSEABLE_PUBLISHED)))


def validated(text: DataFrame, ingested_at: datetime | Column) -> DataFrame:
    """SRC-1…4 on landed text: raw columns (+ ``landing_day`` when the text
    carries its fetch day) + ``reject_reason`` + ``accepted``.

    The ingest stamp is one value per load (SRC-3): a literal for a batch
    load, the micro-batch's own timestamp column for the stream, so a
    replayed load writes identical rows.
    """
    rows = normalise(explode_pages(text))
    reason = reject_reason()
    stamp = ingested_at if isinstance(ingested_at, Column) else utc_literal(ingested_at)
    out = rows.withColumn("ingested_at", stamp)
    day = [F.col("day").alias("landing_day")] if "day" in rows.columns else []
    return out.select(*[F.col(c) for c in ARTICLES_RAW.fieldNames()], *day,
                      reason.alias("reject_reason"), reason.isNull().alias(ACCEPTED))


def load(store: TableStore, text: DataFrame, ingested_at: datetime | Column, *,
         batch_id: str | None = None) -> dict[str, int]:
    """SRC-5: one write per load, partitioned into accepted and rejected rows.

    Counts come from an ``Observation`` on the same pass (no second scan of
    the landing text). The raw table reads the accepted side only, the
    quarantine the rejected side. All rejected → nothing enters raw.
    """
    obs = Observation("load")
    rows = validated(text, ingested_at).observe(
        obs, F.count_if(F.col(ACCEPTED)).alias("loaded"),
        F.count_if(~F.col(ACCEPTED)).alias("rejected"),
        F.max(F.when(F.col(ACCEPTED), F.col("ingested_at"))).cast("timestamp_ntz").alias("max_ingested_at"))
    batch_id = batch_id or new_id()
    store.append(rows, RAW, RAW_TABLE, batch_id=batch_id, partition_by=(ACCEPTED,))
    metrics = obs.get
    counts = {"loaded": int(metrics.get("loaded") or 0), "rejected": int(metrics.get("rejected") or 0)}
    _log_load(store, batch_id, counts["loaded"], counts["rejected"], metrics.get("max_ingested_at"))
    return counts


def _log_load(store: TableStore, batch_id: str, loaded: int, rejected: int,
              max_ingested_at: datetime | None, folded: bool = False) -> None:
    """The load's commit: one row in the load log, under the load's own batch id
    (a replayed load rewrites its row). Rows of a load without it are never read."""
    row = store.spark.createDataFrame([(loaded, rejected, max_ingested_at, folded)], LOAD_LOG)
    store.append(row.coalesce(1), RAW, LOAD_LOG_TABLE, batch_id=batch_id)


ACCEPTED_PARTITION = StructType([StructField(ACCEPTED, BooleanType(), True)])
QUARANTINE = StructType([*ARTICLES_RAW.fields, StructField("reject_reason", StringType(), True)])
# One row per load, in the load's own batch directory (UTC wall clock).
LOAD_LOG = StructType([StructField("loaded", LongType(), True), StructField("rejected", LongType(), True),
                       StructField("max_ingested_at", TimestampNTZType(), True),
                       StructField("folded", BooleanType(), True)])
# Which loads a fold holds the rows of.
FOLDS = StructType([StructField("load", StringType(), True)])
# All columns that raw files may have.
RAW_FILES = StructType([*ARTICLES_RAW.fields, StructField("landing_day", DateType(), True),
                        StructField("reject_reason", StringType(), True)])


def live_loads(store: TableStore) -> DataFrame:
    """The load log: ``batch`` and the figures of every load whose rows count. A load
    that a fold holds is left out as soon as the fold is in the log."""
    log = store.rows(RAW, LOAD_LOG_TABLE, LOAD_LOG).withColumn("folded", F.coalesce("folded", F.lit(False)))
    held = store.rows(RAW, FOLDS_TABLE, FOLDS).join(log.select("batch"), "batch", "left_semi").select(F.col("load").alias("batch"))
    return log.join(held, "batch", "left_anti")


def _of_loads(rows: DataFrame, loads: DataFrame, figure: str) -> DataFrame:
    """Semi join on the partition column: Spark prunes the folders of all other
    loads before the scan opens a file, and no name passes through the driver."""
    return rows.join(loads.where(F.col(figure) > 0).select("batch"), "batch", "left_semi")


def read_raw(store: TableStore, loads: DataFrame | None = None) -> DataFrame:
    """``articles_raw``: the accepted rows of every load, or of the given
    rows of the load log only."""
    rows = store.rows(RAW, RAW_TABLE, ARTICLES_RAW, ACCEPTED_PARTITION).where(F.col(ACCEPTED))
    return _of_loads(rows, live_loads(store) if loads is None else loads, "loaded").select(*ARTICLES_RAW.fieldNames())


def read_quarantine(store: TableStore) -> DataFrame:
    """The rejected rows of every load, with their reason."""
    rows = store.rows(RAW, RAW_TABLE, QUARANTINE, ACCEPTED_PARTITION).where(~F.col(ACCEPTED))
    return _of_loads(rows, live_loads(store), "rejected").select(*QUARANTINE.fieldNames())


def compact(store: TableStore, refreshed: DataFrame, *, most_loads: int = MOST_LOADS, fold_rows: int = FOLD_ROWS) -> int:
    """Fold the small loads into one folder once there are more than ``most_loads``;
    how many were folded.

    Only loads among ``refreshed`` (column ``batch``), or folds, are taken: their
    rows need not be told apart by load any more. Loads of ``fold_rows`` rows
    and more are left as they are. The fold first writes which loads it
    holds, then their rows, then its log row, which makes it count and them
    not in one step: a run that dies before leaves every count as it was.
    The folders of a fold's loads go with the next fold, when no reader holds
    them any more.
    """
    small = (live_loads(store).where(F.col("loaded") + F.col("rejected") < fold_rows)
             .join(refreshed.select("batch", F.lit(True).alias("_seen")), "batch", "left").where(F.col("folded") | F.col("_seen")))
    if small.count() <= most_loads:
        return 0
    # loads of folds that were already in the log
    log = store.rows(RAW, LOAD_LOG_TABLE, LOAD_LOG)
    old = store.rows(RAW, FOLDS_TABLE, FOLDS).join(log.select("batch"), "batch", "left_semi").select("load").distinct().persist()
    old.count()
    name = f"{new_id()}-fold"
    store.append(small.select(F.col("batch").alias("load")).coalesce(1), RAW, FOLDS_TABLE, batch_id=name)
    held = store.rows(RAW, FOLDS_TABLE, FOLDS).where(F.col("batch") == name).select(F.col("load").alias("batch"))
    rows = store.rows(RAW, RAW_TABLE, RAW_FILES, ACCEPTED_PARTITION).join(held, "batch", "left_semi")
    store.append(rows.select(*RAW_FILES.fieldNames(), ACCEPTED), RAW, RAW_TABLE, batch_id=name, partition_by=(ACCEPTED,))
    n, loaded, rejected, newest = log.join(held, "batch", "left_semi").agg(
        F.count(F.lit(1)), F.sum("loaded"), F.sum("rejected"), F.max("max_ingested_at")).first()
    _log_load(store, name, loaded, rejected, newest, folded=True)
    for row in old.toLocalIterator():
        for table in (RAW_TABLE, LOAD_LOG_TABLE):
            store.delete_batch(RAW, table, row["load"])
    old.unpersist()
    return n


def append_raw(store: TableStore, rows: DataFrame, *, batch_id: str | None = None) -> str:
    """Append rows already in the ``articles_raw`` layout as accepted rows
    (migrations, replays of an old warehouse, test fixtures)."""
    obs = Observation("append")
    out = rows.select(*ARTICLES_RAW.fieldNames()).withColumn(ACCEPTED, F.lit(True)).observe(
        obs, F.count(F.lit(1)).alias("loaded"),
        F.max("ingested_at").cast("timestamp_ntz").alias("max_ingested_at"))
    batch_id = batch_id or new_id()
    path = store.append(out, RAW, RAW_TABLE, batch_id=batch_id, partition_by=(ACCEPTED,))
    metrics = obs.get
    _log_load(store, batch_id, int(metrics.get("loaded") or 0), 0, metrics.get("max_ingested_at"))
    return path


def raw_article_count(store: TableStore) -> int:
    """SRC-8: rows of raw, summed over the load log; 0 when the table is missing."""
    return int(live_loads(store).agg(F.sum("loaded")).first()[0] or 0)


def latest_ingested_at(store: TableStore) -> datetime | None:
    """SRC-9: ``MAX(ingested_at)`` of raw; None when missing or empty.
    Read from the load log (one row per load), not from a scan of raw."""
    return live_loads(store).agg(F.max("max_ingested_at")).first()[0]
