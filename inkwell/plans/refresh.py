"""MAT-run: rebuild the analytics tables in dependency order.

Each step is one Spark job ending in a versioned write. Downstream steps read
the version just written (not the upstream plan), so every step starts from
files on the shared store: lineage stays one step long, and a lost executor
re-runs tasks of the current step only. A failed step marks everything that
depends on it ``skipped`` with ``blocked_by``; unrelated branches go on.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.config import ANALYTICS, OPS, Lake, Settings, configure
from inkwell.operators import quality, rollups
from inkwell.operators.latest import LATEST_COLUMNS, article_key, articles_latest
from inkwell.schemas import ARTICLES_RAW, DATA_QUALITY_RESULTS
from inkwell.functions.formats import lag_minutes, utc_literal
from inkwell.sources import key_index, landing
from inkwell.sources.store import TableStore

# The tables and what each depends on.
# Steps in build order, each with the steps it reads, how it is built from
# the tables already written, and its layout on disk. The two article-grain
# tables are partitioned by publication_date (date windows prune folders);
# the rollups keep their aggregate's partitioning, sorted by date inside each
# file, so date windows skip row groups by Parquet statistics.
STEPS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("articles_latest", ()),
    ("article_tags", ("articles_latest",)),
    ("daily_volume", ("articles_latest",)),
    ("section_counts_daily", ("articles_latest",)),
    ("section_daily", ("section_counts_daily",)),
    ("tag_counts_daily", ("article_tags",)),
    ("content_freshness", ("articles_latest",)),
)

LAYOUT: dict[str, dict] = {
    "articles_latest": {"partition_by": ("publication_date",), "cluster_by": ("section_name", "pillar_name"),
                        "bloom_filters": ("guardian_id",)},
    # read from articles_latest's day folders and exploded row by row, so
    # each task already holds one day (or a few packed small ones): no
    # rebalance shuffle is needed before the partitioned write
    "article_tags": {"partition_by": ("publication_date",), "cluster_by": ("tag", "section_name"),
                     "rebalance": False},
    "daily_volume": {"cluster_by": ("publication_date",)},
    "section_counts_daily": {"cluster_by": ("publication_date", "section")},
    "section_daily": {"cluster_by": ("publication_date",)},
    "tag_counts_daily": {"cluster_by": ("publication_date", "tag")},
    "content_freshness": {},
    "article_day_stats": {"cluster_by": ("publication_date",)},
    "tag_span_counts": {"cluster_by": ("level", "span", "tag")},
}

COLUMNS: dict[str, tuple[str, ...]] = {
    "articles_latest": LATEST_COLUMNS,
    "article_tags": ("guardian_id", "publication_date", "published_at", "section_name", "pillar_name", "tag"),
}


@dataclass(frozen=True)
class Step:
    """How one table's build ended."""

    table: str
    status: str
    duration_ms: float | None = None
    blocked_by: list[str] | None = None
    error: str | None = None

    @property
    def usable(self) -> bool:
        return self.status == "ok"

    def as_dict(self) -> dict:
        return {k: v for k, v in vars(self).items() if v is not None}

    @classmethod
    def attempt(cls, table: str, write: Callable[[], None], failure: Exception | None) -> Step:
        """Run a writer; an error becomes the step's outcome."""
        began = time.perf_counter()
        error = None
        try:
            if failure is not None:
                raise failure
            write()
        except Exception as exc:  # noqa: BLE001 - the report carries the error
            error = str(exc)
        spent = round((time.perf_counter() - began) * 1000, 2)
        return cls(table, "ok" if error is None else "failed", spent, error=error)


@dataclass
class RefreshReport:
    status: str
    steps: list[dict] = field(default_factory=list)
    error: str | None = None  # of the key index, which is no step of its own

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [(s["table"], s["status"], s.get("blocked_by"), s.get("duration_ms"), s.get("error"))
                for s in self.steps]
        return spark.createDataFrame(
            rows, "table string, status string, blocked_by array<string>, duration_ms double, error string")


def read_analytics(store: TableStore, name: str) -> DataFrame:
    return store.read(ANALYTICS, name, columns=COLUMNS.get(name))


# Loads that the tables hold, those in folds left out; and the loads of the run at work.
LEDGER = "articles_latest_batches"
LOADS = "refresh_loads"
# Dates an unfinished incremental run was changing; redone by the next run.
PENDING = "refresh_pending_dates"
# Per date and section: what MAT-7 is the aggregate of.
STATS = "article_day_stats"
# Tag counts of spans of 1, 2, 4, ... days: any window is the sum of a few.
SPANS = "tag_span_counts"
# The publication date of every article key, and how often it was loaded.
INDEX = "article_key_days"


@dataclass
class Delta:
    """What an incremental run changes: the publication dates whose rows change,
    the new rows of those dates, and what the key index gets."""

    dates: list
    latest_rows: DataFrame | None = None
    index_rows: DataFrame | None = None
    tag: str = ""
    cached: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        for df in self.cached:
            df.unpersist()


def in_dates(dates: list, column: str = "publication_date") -> Column:
    """Never null, so its negation keeps the null-date group too."""
    days = [d for d in dates if d is not None]
    cond = F.coalesce(F.col(column).isin(*days), F.lit(False)) if days else F.lit(False)
    return cond | F.col(column).isNull() if any(d is None for d in dates) else cond


def _of_keys(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """The rows whose article key is (``left_semi``) or is not (``left_anti``)
    among ``keys``; the null key equals itself."""
    keyed = rows.withColumn("_k", article_key())
    return keyed.join(keys, keyed["_k"].eqNullSafe(keys["_k"]), how).drop("_k")


def _keys(fresh: DataFrame) -> DataFrame:
    return fresh.select(article_key().alias("_k")).distinct()


def _winners(touched: DataFrame, fresh: DataFrame) -> DataFrame:
    """The latest version of every key of ``fresh``, given their stored rows."""
    return articles_latest(touched.select(*ARTICLES_RAW.fieldNames()).unionByName(fresh))


def merged_tables(previous: dict[str, DataFrame], fresh: DataFrame, refreshed_at: datetime | None = None) -> dict[str, DataFrame]:
    """All seven tables (and the per-day figures) after ``fresh`` raw rows, from
    the tables before: the incremental refresh without its storage.

    Only the dates that hold old or new rows of the new keys are computed
    again; every other row of every table is handed through.
    """
    keys, prior = _keys(fresh), previous["articles_latest"]
    touched = _of_keys(prior, keys, "left_semi")
    winners = _winners(touched, fresh)
    dates = touched.select("publication_date").unionByName(winners.select("publication_date")).distinct()
    dates = dates.withColumnRenamed("publication_date", "_date")

    def at(df: DataFrame, how: str) -> DataFrame:
        return df.join(dates, df["publication_date"].eqNullSafe(dates["_date"]), how)

    out = {"articles_latest": _of_keys(prior, keys, "left_anti").unionByName(winners)}

    def patch(name: str, source: str, compute: Callable[[DataFrame], DataFrame]) -> None:
        out[name] = at(previous[name], "left_anti").unionByName(compute(at(out[source], "left_semi")))

    patch("article_tags", "articles_latest", rollups.article_tags)
    patch("daily_volume", "articles_latest", rollups.daily_volume)
    patch("section_counts_daily", "articles_latest", rollups.section_counts_daily)
    patch("section_daily", "section_counts_daily", rollups.section_daily)
    patch("tag_counts_daily", "article_tags", rollups.tag_counts_daily)
    patch(STATS, "articles_latest", rollups.article_day_stats)
    if SPANS in previous:
        changed = dates.withColumnRenamed("_date", "publication_date")
        out[SPANS] = rollups.patched_tag_spans(previous[SPANS], at(out["tag_counts_daily"], "left_semi"), changed)
    return out | {"content_freshness": rollups.freshness_of(out[STATS], refreshed_at)}


def article_index(store: TableStore) -> key_index.KeyIndex:
    return key_index.KeyIndex(store, ANALYTICS, INDEX)


def index_rows(latest: DataFrame, raw: DataFrame) -> DataFrame:
    """The index of a whole table: loads count the rows that carry an id (DQ-3)."""
    return key_index.build(latest, raw, article_key(), "publication_date", F.col("guardian_id").isNotNull())


def index_layer(winners: DataFrame, fresh: DataFrame, known: DataFrame) -> DataFrame:
    """What a run adds to the index; ``known`` is what the index says of its keys."""
    return key_index.layer(winners, fresh, known, article_key(), "publication_date", F.col("guardian_id").isNotNull())


def article_days(store: TableStore, guardian_id: str) -> list | None:
    """The publication dates that may hold an article (None without an index):
    what the index says, and the dates of a run that has not ended."""
    index = article_index(store)
    return None if not index.exists() else [*index.places_of(guardian_id), *_pending(store)]


def compact_raw(store: TableStore, **bounds) -> int:
    """Fold the small raw loads that the tables already hold."""
    return landing.compact(store, store.read(ANALYTICS, LEDGER, columns=["batch"]), **bounds) if store.exists(ANALYTICS, LEDGER) else 0


def _pending(store: TableStore) -> list:
    """The dates a run has begun to change on top of the ledger as it is: once that
    has moved on, they are settled."""
    if not store.exists(ANALYTICS, PENDING):
        return []
    ledger = store.head(ANALYTICS, LEDGER)
    return [r[0] for r in store.read(ANALYTICS, PENDING).collect() if r["ledger"] == ledger]


def plan_delta(store: TableStore, loads: DataFrame | None = None) -> Delta | None:
    """The incremental change set, or None where there is no previous run.

    Only keys that occur in raw loads (of ``loads``) not yet in the ledger can
    change. Folded loads are in no ledger: only refreshed ones are folded. The key index says on which dates their rows are; only these
    dates of ``articles_latest`` are read (and those left by a run that died).
    The rows are found with a null-safe semi join, whose strategy Spark picks
    by the sizes it measures, deduplicated again together with the new rows,
    and the dates of both sides are the only partitions to rewrite. Rows of
    those dates whose key is untouched are carried over. Raw is append-only
    and the dedup keeps a maximum, so the result equals a full rebuild, and
    doing a run over again gives the same rows.
    """
    index = article_index(store)
    if store.current(ANALYTICS, "articles_latest") is None or not store.exists(ANALYTICS, LEDGER) or not index.exists():
        return None
    tag = store.head(ANALYTICS, LEDGER)
    loads = landing.live_loads(store) if loads is None else loads
    pending = set(_pending(store))
    new = loads.where(~F.col("folded")).join(store.read(ANALYTICS, LEDGER, columns=["batch"]), "batch", "left_anti")
    if new.isEmpty():
        return Delta(sorted(pending, key=_by_day))
    fresh = landing.read_raw(store, new)
    keys = _keys(fresh).persist(StorageLevel.MEMORY_AND_DISK)
    known = index.of_keys(keys.select(F.col("_k").alias("key"))).persist(StorageLevel.MEMORY_AND_DISK)
    old_days = {r[0] for r in known.select("place").distinct().collect()} | pending
    prior = read_analytics(store, "articles_latest")
    touched = _of_keys(prior.filter(in_dates(list(old_days))), keys, "left_semi").persist(StorageLevel.MEMORY_AND_DISK)
    winners = _winners(touched, fresh).persist(StorageLevel.MEMORY_AND_DISK)
    dates = sorted({r[0] for r in winners.select("publication_date").distinct().collect()} | old_days, key=_by_day)
    carried = _of_keys(prior.filter(in_dates(dates)), keys, "left_anti")
    return Delta(dates, carried.unionByName(winners), index_layer(winners, fresh, known), tag,
                 cached=[keys, known, touched, winners])


def _by_day(day) -> tuple:
    return day is None, day


def _write_dates(store: TableStore, dates: list) -> None:
    ledger = store.head(ANALYTICS, LEDGER)
    store.replace(store.spark.createDataFrame([(d, ledger) for d in dates], "publication_date date, ledger string").coalesce(1),
                  ANALYTICS, PENDING)


def _full_writers(store: TableStore, loads: DataFrame, refreshed_at: datetime | None) -> dict[str, Callable[[], None]]:
    def up(name: str) -> DataFrame:
        return read_analytics(store, name)

    builds: dict[str, Callable[[], DataFrame]] = {
        "articles_latest": lambda: articles_latest(landing.read_raw(store, loads)),
        "article_tags": lambda: rollups.article_tags(up("articles_latest")),
        "daily_volume": lambda: rollups.daily_volume(up("articles_latest")),
        "section_counts_daily": lambda: rollups.section_counts_daily(up("articles_latest")),
        "section_daily": lambda: rollups.section_daily(up("section_counts_daily")),
        "tag_counts_daily": lambda: rollups.tag_counts_daily(up("article_tags")),
    }

    def freshness() -> None:
        store.replace(rollups.article_day_stats(up("articles_latest")), ANALYTICS, STATS, **LAYOUT[STATS])
        _write_freshness(store, refreshed_at)

    writers = {name: (lambda n=name: store.replace(builds[n](), ANALYTICS, n, **LAYOUT[n])) for name in builds}

    def tags() -> None:
        store.replace(builds["tag_counts_daily"](), ANALYTICS, "tag_counts_daily", **LAYOUT["tag_counts_daily"])
        store.replace(rollups.tag_span_counts(up("tag_counts_daily")), ANALYTICS, SPANS, **LAYOUT[SPANS])

    return writers | {"content_freshness": freshness, "tag_counts_daily": tags}


def _write_freshness(store: TableStore, refreshed_at: datetime | None) -> None:
    """MAT-7 is always the aggregate of the stored per-day figures."""
    store.replace(rollups.freshness_of(store.read(ANALYTICS, STATS), refreshed_at), ANALYTICS, "content_freshness",
                  **LAYOUT["content_freshness"])


def _incremental_writers(store: TableStore, delta: Delta, full: dict[str, Callable[[], None]],
                         refreshed_at: datetime | None) -> dict[str, Callable[[], None]]:
    """Writers that touch only ``delta.dates``: the article-grain tables by new
    day folders and a new state, the small rollups by replacing their rows of
    those dates (a table missing on disk is rebuilt in full)."""
    dates = delta.dates
    inside, outside = in_dates(dates), ~in_dates(dates)

    def up(name: str, cond: Column) -> DataFrame:
        return read_analytics(store, name).filter(cond)

    def partitions(name: str, rows: Callable[[], DataFrame]) -> Callable[[], None]:
        def write() -> None:
            if not store.exists(ANALYTICS, name):
                full[name]()
            elif dates:
                store.replace_partitions(rows(), ANALYTICS, name, partition_by="publication_date",
                                         values=dates, cluster_by=LAYOUT[name].get("cluster_by", ()),
                                         bloom_filters=LAYOUT[name].get("bloom_filters", ()))
        return write

    def patch(name: str, recompute: Callable[[], DataFrame]) -> Callable[[], None]:
        def write() -> None:
            if not store.exists(ANALYTICS, name):
                full[name]()
            elif dates:
                kept = read_analytics(store, name).filter(outside)
                store.replace(kept.unionByName(recompute()), ANALYTICS, name, **LAYOUT[name])
        return write

    patch_tags = patch("tag_counts_daily", lambda: rollups.tag_counts_daily(up("article_tags", inside)))

    def tags() -> None:
        if not store.exists(ANALYTICS, "tag_counts_daily") or not store.exists(ANALYTICS, SPANS):
            full["tag_counts_daily"]()
        elif dates:
            patch_tags()
            changed = store.spark.createDataFrame([(d,) for d in dates], "publication_date date")
            store.replace(rollups.patched_tag_spans(read_analytics(store, SPANS), up("tag_counts_daily", inside), changed),
                          ANALYTICS, SPANS, **LAYOUT[SPANS])

    patch_stats = patch(STATS, lambda: rollups.article_day_stats(up("articles_latest", inside)))

    def freshness() -> None:
        if not store.exists(ANALYTICS, STATS):
            full["content_freshness"]()
            return
        patch_stats()
        _write_freshness(store, refreshed_at)

    return {
        # no new rows (only dates left pending): the table already holds them
        "articles_latest": (partitions("articles_latest", lambda: delta.latest_rows)
                            if delta.latest_rows is not None else (lambda: None)),
        "article_tags": partitions("article_tags", lambda: rollups.article_tags(up("articles_latest", inside))),
        "daily_volume": patch("daily_volume", lambda: rollups.daily_volume(up("articles_latest", inside))),
        "section_counts_daily": patch("section_counts_daily",
                                      lambda: rollups.section_counts_daily(up("articles_latest", inside))),
        "section_daily": patch("section_daily", lambda: rollups.section_daily(up("section_counts_daily", inside))),
        "tag_counts_daily": tags,
        "content_freshness": freshness,
    }


def _waves(names: list[str]) -> list[list[str]]:
    """Steps grouped so each depends only on earlier groups (DAG levels)."""
    deps = dict(STEPS)
    level: dict[str, int] = {}
    for name, ds in STEPS:
        level[name] = 1 + max((level[d] for d in ds), default=-1)
    out: dict[int, list[str]] = {}
    for name in names:
        out.setdefault(level[name], []).append(name)
    assert all(level[d] < level[n] for n in names for d in deps[n])
    return [out[k] for k in sorted(out)]


def run_transforms(spark: SparkSession, lake: Lake, *, refreshed_at: datetime | None = None,
                   only: Iterable[str] | None = None, incremental: bool = False,
                   fail: dict[str, Exception] | None = None, parallel: int = 4) -> RefreshReport:
    """Rebuild the analytics tables; ``fail`` injects an error into a step.

    Steps run level by level of the dependency graph; the steps of one level
    are independent and run as concurrent Spark jobs (``parallel`` at most),
    so small rollups share the cluster instead of queueing behind each other.
    A failed step skips everything that depends on it; others go on.

    ``incremental=True`` (the hourly run) rewrites only the publication dates
    that raw batches not yet covered can change (see ``plan_delta``); it
    falls back to the full rebuild when there is no previous run. The ledger of covered batches is written only when every step
    succeeded, so a partly failed run is redone, dates and all, next time.
    """
    configure(spark)
    store = TableStore(spark, lake)
    # the loads of this run, fixed: others may commit meanwhile
    store.replace(landing.live_loads(store).coalesce(1), ANALYTICS, LOADS)
    loads = store.read(ANALYTICS, LOADS)
    writers = _full_writers(store, loads, refreshed_at)
    delta = plan_delta(store, loads) if incremental and only is None else None
    if delta is not None:
        writers = _incremental_writers(store, delta, writers, refreshed_at)
        # recorded before any write: if a step fails, the next run redoes
        # these dates even when the keys that moved them have settled
        _write_dates(store, delta.dates)
    names = [n for n, _ in STEPS if only is None or n in set(only)]
    deps = dict(STEPS)
    done: dict[str, Step] = {}
    sc = spark.sparkContext
    group = sc.getLocalProperty("spark.jobGroup.id")

    def build(name: str) -> Step:
        blocking = [d for d in deps[name] if d in done and not done[d].usable]
        if blocking:
            return Step(name, "skipped", blocked_by=blocking)
        if group:  # local properties are per thread: keep the caller's job group
            sc.setLocalProperty("spark.jobGroup.id", group)
        return Step.attempt(name, writers[name], (fail or {}).get(name))

    error = None
    try:
        with ThreadPoolExecutor(max_workers=max(parallel, 1)) as pool:
            for wave in _waves(names):
                done.update((step.table, step) for step in list(pool.map(build, wave)))
        status = "materialized" if all(step.status != "failed" for step in done.values()) else "failed"
        # a subset rebuild vouches for nothing: only a full set of steps moves
        # the index, then the ledger (which settles the dates of an unfinished run)
        if status == "materialized" and only is None:
            indexed = Step.attempt(INDEX, lambda: _write_index(store, delta, loads), (fail or {}).get(INDEX))
            if indexed.usable:
                store.replace(loads.where(~F.col("folded")).select("batch").coalesce(1), ANALYTICS, LEDGER)
                article_index(store).fold()
            else:
                status, error = "failed", indexed.error
    finally:
        if delta is not None:
            delta.release()
    return RefreshReport(status=status, steps=[done[n].as_dict() for n in names], error=error)


def _write_index(store: TableStore, delta: Delta | None, loads: DataFrame) -> None:
    index = article_index(store)
    if delta is None:
        latest = read_analytics(store, "articles_latest")
        index.rebuild(index_rows(latest, landing.read_raw(store, loads)), latest.count())
    elif delta.index_rows is not None:
        index.add(delta.index_rows, delta.tag)


def run_quality_checks(spark: SparkSession, lake: Lake, settings: Settings = Settings(), *,
                       as_of: datetime | None = None, extended: bool = False) -> dict:
    """DQ-run: materialise the checks, then count them (QRY-9 rows)."""
    configure(spark)
    store = TableStore(spark, lake)
    # both counts are sums over the per-day figures; articles are read only
    # where an older refresh left none
    source = store.read(ANALYTICS, STATS) if store.exists(ANALYTICS, STATS) else read_analytics(store, "articles_latest")
    results = quality.quality_results(
        source, missing_section_threshold=settings.missing_section_threshold,
        missing_published_at_threshold=settings.missing_published_at_threshold, as_of=as_of)
    if extended:
        index = article_index(store)
        duplicates = (quality.duplicate_ids_of(index.layers(), as_of=as_of) if index.exists()
                      else quality.duplicate_ids(landing.read_raw(store), as_of=as_of))
        results = results.unionByName(duplicates).unionByName(
            quality.freshness_budget(read_analytics(store, "content_freshness"), as_of=as_of))
    store.replace(results.select(*DATA_QUALITY_RESULTS.fieldNames()), OPS, "data_quality_results")
    checks = store.read(OPS, "data_quality_results").count()
    return {"mode": "quality", "status": "materialized", "checks": checks}
