"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Two kinds of rules decide whether a text is kept. The fixed ones (too few
words, too many repeated words) always hold. The others compare one metric of
the text with a cutoff that is *selected* per stratum (the language): from a
fixed grid of cutoffs, only those may be used for which the labelled documents
prove that at most a small share of good documents would be rejected.

The proof is the exact binomial (Clopper-Pearson) bound. With ``k`` of ``n``
good labelled documents of the stratum beyond the cutoff, the upper confidence
bound of the rejected share is at most ``alpha`` exactly when
``P(Binomial(n, alpha) <= k) <= delta``. All cutoffs of all rules in all
strata are tested at once, so ``delta`` is the total error divided by their
number (Bonferroni); ``alpha`` is the allowed share divided by the number of
rules, so it holds for all rules of a stratum together. Of the proven cutoffs
the one that rejects most bad documents is used, the most lenient on ties;
one that rejects no larger share of bad than of good documents is not used.
The grid is fixed beforehand and the counts choose only among proven entries,
so every labelled document serves as holdout.

Defined results: a null text has no words and fails; a null language is a
stratum of its own; a document with contradictory labels counts as neither
good nor bad; repeated rows are judged alike; without labels no cutoff is
proven and only the fixed rules hold; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import materialize, text_of

WS = r"[\x20\x09-\x0D]+"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


@dataclass(frozen=True)
class Rule:
    """Reject when ``metric`` is above a cutoff (``above``) or below one."""

    name: str
    metric: str
    above: bool
    grid: tuple[float, ...]


# Fixed grids, from lenient to strict.
RULES = (
    Rule("symbols", "symbol_ratio", True, (2.0, 1.0, 0.7, 0.5, 0.35, 0.25, 0.18, 0.12)),
    Rule("bangs", "bang_ratio", True, (2.0, 1.0, 0.7, 0.5, 0.35, 0.25, 0.18, 0.12)),
    Rule("dup_lines", "dup_line_ratio", True, (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35)),
    Rule("repeats", "repeat_ratio", True, (0.45, 0.4, 0.35, 0.3, 0.25, 0.2)),
    Rule("long_words", "mean_word", True, (20.0, 15.0, 12.0, 10.0, 9.0)),
    Rule("short_words", "mean_word", False, (2.0, 2.5, 3.0, 3.5)),
)
MAX_FALSE_REJECTION = 0.02
ERROR = 0.05


def with_metrics(df: DataFrame, text: Column) -> DataFrame:
    """``df`` (whose columns start with no ``_q``) plus the metric columns.

    ``_q`` is a struct of n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, n_bangs and n_lines. Equal three-word windows are found by
    sorting the windows' 64-bit hashes with their positions, so a text of n
    words costs n log n; texts without an equal pair skip that step.
    """
    w = F.col("_qw")
    n = F.size(w)
    out = df.withColumn("_qt", text)
    out = out.withColumn("_qw", F.filter(F.split("_qt", WS, -1), lambda x: x != ""))
    out = out.withColumn("_ql", F.filter(F.split("_qt", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    out = out.withColumn("_qh", F.when(n >= 3, F.transform(
        F.slice(w, 1, F.greatest(n - 2, F.lit(1))),
        lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))))
    equal = F.col("_qs")
    out = out.withColumn("_qs", F.when(F.size(F.array_distinct("_qh")) < F.size("_qh"), F.sort_array(F.transform(
        F.col("_qh"), lambda h, i: F.struct(h.alias("h"), i.alias("p"))))))
    starts = F.filter(equal, lambda x, i: (x["h"] == F.get(equal, i - 1)["h"])
                      | (x["h"] == F.get(equal, i + 1)["h"]))
    out = out.withColumn("_qp", F.when(equal.isNotNull(), F.sort_array(F.transform(starts, lambda x: x["p"]))))
    # words covered by sorted window starts: each window adds those beyond the one before
    covered = F.aggregate(F.transform(F.col("_qp"), lambda p, i: F.when(
        i == 0, F.lit(3)).otherwise(F.least(F.lit(3), p - F.get(F.col("_qp"), i - 1)))),
        F.lit(0), lambda a, x: a + x)
    # the one-row explode keeps later filters above it: pushed below, they would
    # carry copies of these expressions
    out = out.withColumn("_q", F.explode(F.array(F.struct(
        n.cast("long").alias("n_words"),
        F.char_length(F.regexp_replace("_qt", WS, "")).cast("long").alias("word_chars"),
        F.regexp_count("_qt", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_ql") - F.size(F.array_distinct("_ql"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.regexp_count("_qt", F.lit("!")).cast("long").alias("n_bangs"),
        F.size("_ql").cast("long").alias("n_lines")))))
    return out.drop("_qt", "_qw", "_ql", "_qh", "_qs", "_qp")


def _ratio(a: Column, b: Column) -> Column:
    return a / F.greatest(b, F.lit(1))


def rule_metrics(q: Column) -> dict[str, Column]:
    return {
        "symbol_ratio": _ratio(q["n_symbols"], q["n_words"]),
        "bang_ratio": _ratio(q["n_bangs"], q["n_words"]),
        "dup_line_ratio": _ratio(q["n_dup_lines"], q["n_lines"]),
        "repeat_ratio": _ratio(q["n_repeat_words"], q["n_words"]),
        "mean_word": _ratio(q["word_chars"], q["n_words"]),
    }


def base_failed(q: Column) -> Column:
    return (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > MAX_REPEAT_PERCENT * q["n_words"])


def _beyond(rule: Rule, q: Column, cutoff) -> Column:
    m = rule_metrics(q)[rule.metric]
    return m > cutoff if rule.above else m < cutoff


def cutoffs(measured: DataFrame, labels: DataFrame, rules=RULES,
            max_false_rejection: float = MAX_FALSE_REJECTION, error: float = ERROR) -> DataFrame:
    """One row per stratum with labels: ``stratum`` and ``cuts``, a map from
    rule to proven cutoff (rules without one are absent).

    ``measured``: doc_id, stratum, ``_q``. ``labels``: doc_id, quality (1 good,
    0 bad). Documents that the fixed rules reject take no part: no cutoff
    decides about them.
    """
    truth = (labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
             .groupBy("doc_id").agg(F.min("quality").alias("lo"), F.max("quality").alias("hi"))
             .where("lo = hi").select("doc_id", (F.col("lo") == 1).alias("good")))
    q = F.col("_q")
    rows = measured.where(~base_failed(q)).join(truth, "doc_id")
    counts = [F.count_if(F.col("good")).alias("n_good"), F.count_if(~F.col("good")).alias("n_bad")]
    entries = []
    for r, rule in enumerate(rules):
        for g, cut in enumerate(rule.grid):
            hit = _beyond(rule, q, cut)
            counts += [F.count_if(F.col("good") & hit).alias(f"g{r}_{g}"),
                       F.count_if(~F.col("good") & hit).alias(f"b{r}_{g}")]
            entries.append(F.struct(F.lit(rule.name).alias("rule"), F.lit(g).alias("grid"),
                                    F.lit(cut).alias("cutoff"), F.col(f"g{r}_{g}").alias("k"),
                                    F.col(f"b{r}_{g}").alias("bad")))
    per_stratum = materialize(rows.groupBy("stratum").agg(*counts), "quality-counts")
    tests = max(1, per_stratum.count()) * len(entries)
    alpha, delta = max_false_rejection / len(rules), error / tests
    tried = (per_stratum.select("stratum", "n_good", "n_bad", F.explode(F.array(*entries)).alias("e"))
             .select("stratum", "n_good", "n_bad", "e.*"))
    # only k < alpha * n can pass, which also bounds the sum below
    tried = tried.where((F.col("k") < alpha * F.col("n_good"))
                        & (F.col("bad") * F.col("n_good") > F.col("k") * F.col("n_bad")))
    odds = math.log(alpha) - math.log1p(-alpha)
    start = F.col("n_good") * math.log1p(-alpha)
    tail = F.aggregate(
        F.when(F.col("k") > 0, F.sequence(F.lit(1).cast("long"), F.col("k"))).otherwise(F.array().cast("array<bigint>")),
        F.struct(start.alias("t"), F.exp(start).alias("s")),
        lambda a, i: F.struct(
            (a["t"] + F.log((F.col("n_good") - i + 1) / i) + odds).alias("t"),
            (a["s"] + F.exp(a["t"] + F.log((F.col("n_good") - i + 1) / i) + odds)).alias("s")),
        lambda a: a["s"])
    proven = tried.withColumn("p", tail).where(F.col("p") <= delta)
    best = proven.groupBy("stratum", "rule").agg(F.max_by("cutoff", F.struct("bad", -F.col("grid"))).alias("cutoff"))
    return best.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cuts"))


def verdict(q: Column, cuts: Column, rules=RULES) -> Column:
    """True where neither a fixed rule nor a proven cutoff rejects."""
    rejected = base_failed(q)
    for rule in rules:
        rejected = rejected | F.coalesce(_beyond(rule, q, F.element_at(cuts, rule.name)), F.lit(False))
    return ~rejected


def stratum_of(column: str = "lang") -> Column:
    """The stratum's name; a null language is a stratum of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("null"))


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, stratum and ``_q`` of every row, written once: one pass over the texts."""
    narrow = docs.select(F.col("doc_id"), stratum_of().alias("stratum"), text_of().alias("_text"))
    return materialize(with_metrics(narrow, F.col("_text")).drop("_text"), "quality-metrics")


def judge(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, the metrics, base_failed and kept, one row per row of ``docs``.

    The cutoffs form one small row per stratum; they are written first, so
    Spark knows their size and broadcasts them only below its own threshold.
    """
    measured = measure(docs)
    cuts = materialize(cutoffs(measured, labels, **options), "quality-cutoffs")
    q = F.col("_q")
    return measured.join(cuts, "stratum", "left").select(
        "doc_id", "stratum", "_q", base_failed(q).alias("base_failed"), verdict(q, F.col("cuts")).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns.

    The cutoffs come from a first pass; the second pass measures each row
    again where it lies, so no text is shuffled.
    """
    cuts = materialize(cutoffs(measure(docs), labels, **options), "quality-cutoffs")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                       stratum_of().alias("stratum"), text_of().alias("_text"))
    judged = with_metrics(rows, F.col("_text")).drop("_text").join(cuts, "stratum", "left")
    return judged.where(verdict(F.col("_q"), F.col("cuts"))).select("_row.*")
