"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every historical version of every path is a row with a text. A version's
content address is the SHA-256 of its text. The *ledger* is a table with one
row for each blob and scan: which rule versions looked at it and what they
found. A scan takes the distinct blobs of its versions, removes the (blob,
rule version) pairs the ledger already has, reads the text of one version of
each blob that is left, runs only the rules that have not seen it, appends the
result to the ledger and joins the findings back to all paths. A rule whose
pattern changes gets a new version, and only that rule runs again.

Positions are code points, end exclusive. Spark has no function that returns
the positions of all matches, so they are sums: ``split`` by a pattern gives
the gaps between its matches and ``regexp_extract_all`` the matches. The
running sum is a window over the (few) matches, so a text with very many
matches costs a sort, not a quadratic fold.

Hot groups: blobs are reduced with partial aggregates on narrow rows; texts
are joined by path and blob, not by blob, so a content with millions of copies
moves one text and leaves the copies in their places.

Defined results: a null text is the empty blob; a null path is a path of its
own; repeated rows of a path and text are scanned once and each gets the
findings; empty tables give empty tables; other columns are ignored
(``redact`` hands them through).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm.common import materialize, text_of


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds candidates from left to right, none overlapping; one
    counts if its group ``group`` has at least ``least`` characters. ``needs``:
    a plain string that every match contains."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    needs: str = ""
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# Fixed patterns of the first three kinds; the others are public token formats.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, "AKIA"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
RULES = BASE_RULES + (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----", needs="PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", needs="eyJ"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}", needs="gh"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}", needs="xox"),
)
LEDGER = "blob binary, rules array<string>, spans array<struct<start:int,rank:int,rule:string,end:int>>"


def _matches(text: Column, rank: int, rule: Rule, wanted: Column) -> Column:
    """array<struct<rank, n, gap, length, ok>> of one rule's candidates."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    gaps = F.split(text, rule.pattern, -1)
    length = lambda m: F.char_length(F.regexp_extract(m, rule.pattern, rule.group) if rule.group else m)
    rows = F.transform(
        F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(g.alias("g"), m.alias("m"))),
        lambda x, i: F.struct(F.lit(rank).alias("rank"), i.alias("n"), F.char_length(x["g"]).alias("gap"),
                              F.char_length(x["m"]).alias("length"), (length(x["m"]) >= rule.least).alias("ok")))
    may = wanted & (text.contains(rule.needs) if rule.needs else text.rlike(rule.pattern))
    return F.when(may, rows).otherwise(F.array().cast("array<struct<rank:int,n:int,gap:int,length:int,ok:boolean>>"))


def _versions(docs: DataFrame, path: str, text: str) -> DataFrame:
    blob = F.unhex(F.sha2(text_of(text), 256))
    key = F.concat_ws(":", F.hex(blob), F.coalesce(F.col(path).cast("string"), F.lit("null")))
    return docs.select(F.col(path).alias("path"), blob.alias("blob"), key.alias("at"), text_of(text).alias("text"))


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules=RULES, path: str = "doc_id", text: str = "text"):
    """(findings, ledger rows to append).

    Findings: ``path``, ``blob``, ``spans`` for every row of ``docs``, spans
    sorted by start and rule. ``ledger`` has the columns of ``LEDGER``; the
    rows to append hold one entry for each newly scanned blob.
    """
    spark = docs.sparkSession
    keys = [r.key for r in rules]
    versions = materialize(_versions(docs, path, text).drop("text"), "secret-versions")
    blobs = versions.groupBy("blob").agg(F.min("at").alias("at"))
    # of the ledger only the blobs at hand, before anything of it is taken apart
    ledger = (spark.createDataFrame([], LEDGER) if ledger is None else
              materialize(ledger.join(blobs.select("blob"), "blob", "left_semi"), "secret-seen"))
    seen = (ledger.select("blob", F.explode("rules").alias("rule")).where(F.col("rule").isin(keys))
            .groupBy("blob").agg(F.collect_set("rule").alias("seen")))
    todo = (blobs.join(seen, "blob", "left")
            .withColumn("todo", F.array_except(F.array(*map(F.lit, keys)), F.coalesce("seen", F.array().cast("array<string>"))))
            .where(F.size("todo") > 0).select("at", "todo"))
    # one text for each blob; repeated rows of that path and text fall together
    texts = (_versions(docs, path, text).join(todo, "at")
             .groupBy("at").agg(F.first("blob").alias("blob"), F.first("text").alias("text"), F.first("todo").alias("todo")))
    raw = materialize(texts.select("blob", F.col("todo").alias("rules"), F.concat(
        *[_matches(F.col("text"), i, r, F.array_contains("todo", r.key)) for i, r in enumerate(rules)]).alias("hits")),
        "secret-hits")
    name = F.element_at(F.array(*map(F.lit, keys)), F.col("rank") + 1)
    before = F.sum(F.col("gap") + F.col("length")).over(Window.partitionBy("blob", "rank").orderBy("n"))
    spans = (raw.select("blob", F.explode("hits").alias("h")).select("blob", "h.*")
             .withColumn("end", before.cast("int")).where("ok")
             .select("blob", F.struct((F.col("end") - F.col("length")).cast("int").alias("start"), "rank",
                                      name.alias("rule"), "end").alias("span"))
             .groupBy("blob").agg(F.collect_list("span").alias("spans")))
    none = F.array().cast("array<struct<start:int,rank:int,rule:string,end:int>>")
    new = materialize(raw.select("blob", "rules").join(spans, "blob", "left")
                      .withColumn("spans", F.coalesce("spans", none)), "secret-ledger")
    rank_of = F.create_map(*[x for i, k in enumerate(keys) for x in (F.lit(k), F.lit(i))])
    known = (ledger.select("blob", F.explode("spans").alias("s")).where(F.col("s.rule").isin(keys))
             .unionByName(new.select("blob", F.explode("spans").alias("s")))
             .select("blob", F.struct("s.start", rank_of[F.col("s.rule")].alias("rank"), "s.rule", "s.end").alias("s"))
             .groupBy("blob").agg(F.sort_array(F.collect_set("s")).alias("spans")))
    findings = (versions.drop("at").join(known, "blob", "left")
                .select("path", "blob", F.coalesce("spans", none).alias("spans")))
    return findings, new


def rescan(docs: DataFrame, ledger_path: str, **options) -> DataFrame:
    """Scan against the ledger stored at ``ledger_path`` and append to it."""
    spark = docs.sparkSession
    try:
        ledger = spark.read.schema(LEDGER).parquet(ledger_path)
        ledger.schema  # noqa: B018
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        ledger = None
    findings, new = scan(docs, ledger, **options)
    findings = materialize(findings, "secret-findings")
    new.write.mode("append").parquet(ledger_path)
    return findings


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
        ":", F.substring_index(s["rule"], "@", 1), s["start"].cast("string"), s["end"].cast("string"))))


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span, overlapping ones as one, replaced by ``mark``."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda a, s: F.struct(
        F.greatest(a["at"], s["end"]).alias("at"),
        F.when(s["start"] >= a["at"], F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mark)))
        .otherwise(a["out"]).alias("out"))
    return F.aggregate(spans, start, step, lambda a: F.concat(
        a["out"], F.substring(text, a["at"] + 1, F.char_length(text))))


def redact(docs: DataFrame, rules=RULES, ledger: DataFrame | None = None) -> DataFrame:
    """``docs`` with the secrets in ``text`` replaced; all rows and columns stay.

    Only texts in which some rule's pattern occurs are joined with the
    findings; the others pass where they lie.
    """
    findings, _ = scan(docs, ledger, rules)
    by_blob = findings.where(F.size("spans") > 0).groupBy("blob").agg(F.first("spans").alias("_spans"))
    by_blob = materialize(by_blob.withColumnRenamed("blob", "_blob"), "secret-by-blob")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    suspect = F.lit(False)
    for r in rules:
        suspect = suspect | ((text_of().contains(r.needs) if r.needs else F.lit(True)) & text_of().rlike(r.pattern))
    rows = docs.select(F.struct(*columns).alias("_row"), text_of().alias("_text"), suspect.alias("_suspect"))
    clean = rows.where("NOT _suspect").select("_row.*")
    marked = rows.where("_suspect").withColumn("_blob", F.unhex(F.sha2("_text", 256))).join(by_blob, "_blob", "left")
    text = F.when(F.col("_spans").isNull(), F.col("_row")["text"]).otherwise(redacted(F.col("_text"), F.col("_spans")))
    return clean.unionByName(marked.select(F.col("_row").withField("text", text).alias("_row")).select("_row.*"))
