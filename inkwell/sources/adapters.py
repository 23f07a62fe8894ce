"""Adapters from the driver's test tables to the warehouse's input shapes.

The test tables hold no articles or pipeline runs, so these derive them with
plain column expressions (one narrow projection each: no shuffle, the scan
reads only the columns used). The same derivations are spelled in DuckDB SQL
in ``__spark_entry__.oracle_sql`` so both engines start from equal rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# The eleven section names cycled by event_id % 11 (slot 8 is
# an empty name, slot 10 a missing one) and the pillar of each slot.
SECTION_CYCLE = (
    "World news", "Politics", "Business", "Culture", "Art and design",
    "Environment", "Technology", "Digital media", "", "Sport", None,
)
PILLAR_CYCLE = ("News", "News", "News", "Arts", "Arts", "News", "News", "Arts", None, "Sport", None)

# Orchestrator state reported for each event type; signup maps
# to a state the warehouse does not know, which normalises to 'scheduled'.
RUN_STATE_BY_EVENT = (
    ("purchase", "success"),
    ("error", "failed"),
    ("view", "running"),
    ("click", "queued"),
    ("signup", "up_for_retry"),
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


EVENT_COLUMNS = ("event_id", "ts", "user_id", "event_type", "value", "props")


def dealt(events: DataFrame, *by: Column | str) -> DataFrame:
    """The events dealt over the cluster by their own values, or ``by``, while their rows are
    narrow. A file is read by as many tasks as it has row groups, and all that
    is built of a row would be built by those few."""
    return events.repartition(*(by or EVENT_COLUMNS))


def _cycle(index: Column, values: tuple) -> Column:
    expr = None
    for i, value in enumerate(values):
        if value is None:
            continue
        expr = (F.when(index == i, F.lit(value)) if expr is None
                else expr.when(index == i, F.lit(value)))
    return expr.otherwise(F.lit(None).cast("string"))


def articles_raw_from_events(events: DataFrame) -> DataFrame:
    """``articles_raw`` rows derived from ``events`` (see FIXTURES.md §8).

    Four consecutive events share one article id, so most articles arrive in
    several versions; error events have no id and fall back to url#published.
    """
    eid = F.col("event_id")
    section_slot = eid % 11
    section = _cycle(section_slot, SECTION_CYCLE)
    pillar = _cycle(section_slot, PILLAR_CYCLE)
    published = F.col("ts").cast("timestamp")
    return events.select(
        F.when(F.col("event_type") == "error", F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("article/"), F.expr("event_id div 4").cast("string")))
        .alias("guardian_id"),
        F.concat(F.lit("https://example.org/u/"), F.col("user_id").cast("string")).alias("web_url"),
        F.concat(F.col("event_type"), F.lit(" story "), eid.cast("string")).alias("web_title"),
        F.lower(F.regexp_replace(section, "[^A-Za-z]", "")).alias("section_id"),
        section.alias("section_name"),
        F.when(pillar.isNotNull(), F.concat(F.lit("pillar/"), F.lower(pillar))).alias("pillar_id"),
        pillar.alias("pillar_name"),
        published.alias("published_at"),
        F.timestamp_add("HOUR", eid % 2, F.timestamp_add("DAY", F.lit(1), F.date_trunc("DAY", published)))
        .alias("ingested_at"),
        F.when(eid % 13 == 0, F.lit(None).cast("array<string>"))
        .otherwise(F.array(F.col("event_type"),
                           F.concat(F.lit("k"), F.get_json_object("props", "$.k"))))
        .alias("tags"),
        (eid % 4).alias("api_response_page"),
        F.concat(F.lit('{"id": '), eid.cast("string"), F.lit(', "type": "'), F.col("event_type"),
                 F.lit('", "props": '), F.col("props"), F.lit("}")).alias("raw_payload"),
    )


def articles_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles_raw_from_events(read_table(spark, sf_dir, "events"))


def run_records_from_events(events: DataFrame) -> DataFrame:
    """Orchestrator run records derived from ``events``.

    One record per event. Runs are keyed per dag and hour, so one sync can
    report a run several times (the upsert keeps the latest). Even users are
    the hourly ingest job, odd users the manual backfill job; every seventh
    event lacks a start date, and the backfill conf has both, one or no dates.
    """
    eid = F.col("event_id")
    ts = F.col("ts").cast("timestamp")
    manual = F.col("user_id") % 2 == 1
    state = None
    for event_type, run_state in RUN_STATE_BY_EVENT:
        state = (F.when(F.col("event_type") == event_type, F.lit(run_state)) if state is None
                 else state.when(F.col("event_type") == event_type, F.lit(run_state)))
    hour = F.date_trunc("HOUR", ts)
    day = F.date_format(ts, "yyyy-MM-dd")
    finished = F.col("event_type").isin("purchase", "error")
    conf_slot = eid % 3
    conf = (
        F.when(~manual, F.lit(None).cast("map<string,string>"))
        .when(conf_slot == 0, F.create_map(F.lit("start_date"), day, F.lit("end_date"),
                                           F.date_format(F.date_add(ts.cast("date"), 2), "yyyy-MM-dd")))
        .when(conf_slot == 1, F.create_map(F.lit("start_date"), day))
        .otherwise(F.create_map().cast("map<string,string>"))
    )
    return events.select(
        F.concat(F.when(manual, F.lit("manual__")).otherwise(F.lit("scheduled__")),
                 F.date_format(hour, "yyyy-MM-dd'T'HH:mm:ss")).alias("dag_run_id"),
        F.when(manual, F.lit("guardian_backfill_range")).otherwise(F.lit("guardian_ingest_recent")).alias("dag_id"),
        state.alias("state"),
        F.when(eid % 7 == 0, F.lit(None).cast("string"))
        .otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).alias("start_date"),
        F.when(finished, F.date_format(F.timestamp_add("SECOND", F.floor("value"), ts),
                                       "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).alias("end_date"),
        F.date_format(hour, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("logical_date"),
        conf.alias("conf"),
    )


# Events per landed page; every seventh page is cut off in the middle.
PAGE_SIZE = 50
BROKEN_PAGE = 3


def landing_results_from_events(events: DataFrame) -> DataFrame:
    """One source result element (JSON text) per event, with its fetch day
    and page (blocks of 50 consecutive events, so a page holds at most 50).

    Mixes in every case the validator handles: error events carry no id,
    every 17th an empty id, every 19th no publication date, every 23rd an
    unparseable one, every 29th element is not an object at all; every 13th
    has no tags and every 31st a tag without a title. Unknown fields ride
    along in the payload.
    """
    eid = F.col("event_id")
    ts = F.col("ts").cast("timestamp")
    section = _cycle(eid % 11, SECTION_CYCLE)
    pillar = _cycle(eid % 11, PILLAR_CYCLE)
    ident = (F.when(F.col("event_type") == "error", F.lit(None).cast("string"))
             .when(eid % 17 == 0, F.lit(""))
             .otherwise(F.concat(F.lit("article/"), F.expr("event_id div 4").cast("string"))))
    published = (F.when(eid % 19 == 0, F.lit(None).cast("string"))
                 .when(eid % 23 == 0, F.lit("not-a-date"))
                 .otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")))
    tag_struct = "struct<webTitle:string>"
    tags = F.when(eid % 13 == 0, F.lit(None).cast(f"array<{tag_struct}>")).otherwise(F.array(
        F.struct(F.col("event_type").alias("webTitle")),
        F.struct(F.lit("").alias("webTitle")),
        F.struct(F.when(eid % 31 == 0, F.lit(None).cast("string"))
                 .otherwise(F.concat(F.lit("k"), F.get_json_object("props", "$.k"))).alias("webTitle")),
    ))
    obj = F.to_json(F.struct(
        ident.alias("id"),
        F.lit("article").alias("type"),
        F.concat(F.lit("https://example.org/u/"), F.col("user_id").cast("string")).alias("webUrl"),
        F.concat(F.col("event_type"), F.lit(" story "), eid.cast("string")).alias("webTitle"),
        F.lower(F.regexp_replace(section, "[^A-Za-z]", "")).alias("sectionId"),
        section.alias("sectionName"),
        F.when(pillar.isNotNull(), F.concat(F.lit("pillar/"), F.lower(pillar))).alias("pillarId"),
        pillar.alias("pillarName"),
        published.alias("webPublicationDate"),
        tags.alias("tags"),
        F.struct(F.col("value").alias("score")).alias("fields"),
    ))
    element = F.when(eid % 29 == 0, F.concat(F.lit('"not an object '), eid.cast("string"), F.lit('"'))) \
        .otherwise(obj)
    return events.select(
        F.to_date(ts).alias("day"),
        (F.expr(f"event_id div {PAGE_SIZE}") + 1).alias("page"),
        element.alias("result"),
        eid.alias("_at"),
    )


def landing_pages_from_events(events: DataFrame) -> DataFrame:
    """Landed page envelopes (``day``, ``page``, ``value`` JSON text).

    Grouping by (day, page) is bounded: a page never holds more than 50
    results, whatever the skew of days. The events are dealt by page before
    their JSON is built: it takes several times their room. Days are few beside
    pages, so their page counts go to every task.
    """
    paged = dealt(events, F.to_date(F.col("ts").cast("timestamp")).alias("day"), (F.expr(f"event_id div {PAGE_SIZE}") + 1).alias("page"))
    results = landing_results_from_events(paged)
    in_order = F.sort_array(F.collect_list(F.struct("_at", "result")))
    pages = results.groupBy("day", "page").agg(in_order.getField("result").alias("results"))
    announced = landing_results_from_events(events).groupBy("day").agg(F.countDistinct("page").alias("pages"))
    head = F.concat(F.lit('{"response": {"status": "ok", "pages": '), F.col("pages").cast("string"),
                    F.lit(', "currentPage": '), F.col("page").cast("string"), F.lit(', "results": ['))
    whole = F.concat(head, F.array_join("results", ", "), F.lit("]}}"))
    value = F.when(F.col("page") % 7 == BROKEN_PAGE, F.left(whole, F.length(head) + 10)).otherwise(whole)
    pages = pages.join(F.broadcast(announced), "day")
    return pages.select("day", "page", value.alias("value"))


def write_landing(pages: DataFrame, landing_dir: str) -> None:
    """Land pages as JSON Lines under ``day=YYYY-MM-DD`` directories."""
    pages.select("day", "value").write.mode("overwrite").partitionBy("day").text(landing_dir)


def articles_from_documents(documents: DataFrame) -> DataFrame:
    """``articles_raw`` rows of multilingual documents: the title is the whole first
    line of the text (null as empty) with, in turn, a percent sign, an
    underscore or a backslash appended; the source is the tag."""
    first = F.substring_index(F.coalesce("text", F.lit("")), "\n", 1)
    n = F.col("doc_id")
    mark = F.element_at(F.array(F.lit(""), F.lit("100%"), F.lit("a_b"), F.lit("c\\d")), (n % 4 + 1).cast("int"))
    published = F.timestamp_seconds(F.lit(1704067200) + n % 2592000)
    return documents.select(
        F.concat(F.lit("doc/"), n.cast("string")).alias("guardian_id"), F.lit(None).cast("string").alias("web_url"),
        F.concat(first, F.lit(" "), mark).alias("web_title"),
        F.col("lang").alias("section_id"), F.col("lang").alias("section_name"),
        F.lit(None).cast("string").alias("pillar_id"), F.lit(None).cast("string").alias("pillar_name"),
        published.alias("published_at"), published.alias("ingested_at"), F.array("source").alias("tags"),
        F.lit(1).cast("long").alias("api_response_page"), F.lit(None).cast("string").alias("raw_payload"))
