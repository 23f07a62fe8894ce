"""Secret scan, personal data, license scan and quality rules against brute force."""

from __future__ import annotations

import random

import brute
import edge
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from inkwell.llm import gbt, license_scan, pii, quality_rules, registry, secret_scan

SF = "/root/testdata/sf0.001"


def _sf_texts(sf=SF):
    return dict(zip(*(pq.read_table(f"{sf}/documents.parquet").column(c).to_pylist() for c in ("doc_id", "text"))))


def _secret_rows(findings):
    base = F.filter("spans", lambda s: s["rank"] < 3)
    n = lambda k: F.size(F.filter("spans", lambda s: s["rule"] == f"{k}@1"))
    return findings.select("path", n("assign").alias("a"), n("access").alias("b"), n("hex").alias("c"),
                           F.sha2(secret_scan.span_text(base), 256).alias("d"))


def test_secrets_on_edges(spark):
    findings, new = secret_scan.scan(edge.documents(spark))
    assert edge.rows_of(_secret_rows(findings), *"path a b c d".split()) == edge.sort(
        [(d, *brute.secrets(t)) for d, t, _ in edge.texts()])
    # one ledger row for each distinct content
    assert new.count() == len({t or "" for _, t, _ in edge.texts()})
    assert [r["path"] for r in findings.filter("exists(spans, s -> s.rule = 'jwt@1')").collect()] == [9]
    empty, ledger = secret_scan.scan(edge.documents(spark, []))
    assert empty.count() == 0 and ledger.count() == 0


def test_registered_text_queries_equal_brute_force(spark):
    texts = _sf_texts()
    for r in registry.op1_secret_scan(spark, SF).collect():
        assert brute.secrets(texts[r["doc_id"]]) == (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"])
    for r in registry.op4_pii(spark, SF).collect():
        want = brute.pii(texts[r["doc_id"]])
        assert want[:5] == (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"])
        assert {f"{k}:{a}:{b}" for k, a, b in want[5]} <= set(r["spans"].split(","))
    for r in registry.op6_license_scan(spark, SF).collect():
        want = brute.licenses(texts[r["doc_id"]])
        assert want == (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    for r in registry.op10_quality_rules(spark, SF).collect():
        assert brute.quality(texts[r["doc_id"]]) == {k: r[k] for k in (
            "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")}
        assert not (r["base_failed"] and r["kept"])


def test_ledger_scans_only_unseen_pairs(spark, scratch):
    docs = edge.documents(spark)
    path = f"{scratch}/ledger"
    first = secret_scan.rescan(docs, path, rules=secret_scan.BASE_RULES)
    n = spark.read.parquet(path).count()
    again = secret_scan.rescan(docs, path, rules=secret_scan.BASE_RULES)
    assert spark.read.parquet(path).count() == n                       # nothing unseen
    assert edge.rows_of(first, "path", "spans") == edge.rows_of(again, "path", "spans")
    # a new version of one rule: every blob is due for that rule alone
    newer = secret_scan.Rule("hex", "[0-9a-f]{30,}", version=2)
    rules = (*secret_scan.BASE_RULES[:2], newer)
    secret_scan.rescan(docs, path, rules=rules)
    ledger = spark.read.parquet(path)
    assert ledger.count() == 2 * n and ledger.filter("rules = array('hex@2')").count() == n
    more = edge.documents(spark, [(99, "token=abcdefgh", "en"), (98, None, "en")])
    found = secret_scan.rescan(more, path, rules=rules)
    assert spark.read.parquet(path).count() == 2 * n + 1               # the empty blob is known
    assert [(r["path"], len(r["spans"])) for r in found.orderBy("path").collect()] == [(98, 0), (99, 1)]


def test_redaction_keeps_rows_and_columns(spark):
    docs = edge.documents(spark)
    out = secret_scan.redact(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    text = out.filter("doc_id = 9").first()["text"]
    assert text.startswith("[SECRET]' Token: abc secret=short [SECRET] AKIA12 [SECRET] api-key=no passwd:token: abcdefgh")
    same = {(d, t) for d, t, _ in edge.texts() if d not in (9, 10)}           # 10 holds a long run of digits
    assert same == {(r["doc_id"], r["text"]) for r in out.filter("doc_id is null or doc_id not in (9, 10)").collect()}
    over = spark.createDataFrame([("0123456789", [(1, 3), (2, 5), (5, 6), (8, 10)])], "t string, s array<struct<start:int,end:int>>")
    assert over.select(secret_scan.redacted(F.col("t"), F.col("s"), "#").alias("r")).first()["r"] == "0##67#"


def test_pii_on_edges(spark):
    found = pii.find(edge.documents(spark), min_rows=5)
    base = lambda spans: [(s["kind"], s["start"], s["end"]) for s in spans if s["base"]]
    got = [(r["doc_id"], base(r["spans"])) for r in found.collect()]
    assert edge.sort(got) == edge.sort([(d, brute.pii(t)[5]) for d, t, _ in edge.texts()])
    assert pii.find(edge.documents(spark, [])).count() == 0


def test_pii_base_equals_brute_force_on_random_texts():
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice("+1234567890.- ()@abé,%4444") for _ in range(rng.randint(0, 60)))
        assert [(pii.KINDS[k], a, b) for k, a, b in pii.base_spans(text)] == brute.pii(text)[5], text


def test_boosted_trees_and_calibration():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 5))
    p = 1 / (1 + np.exp(-8 * (x[:, 0] * x[:, 1] - 0.25)))
    y = (rng.random(4000) < p).astype(float)
    model = gbt.BoostedTrees().fit(x[:2500], y[:2500])
    scale = gbt.Isotonic().fit(model.raw(x[2500:3250]), y[2500:3250])
    got = scale(model.raw(x[3250:]))
    assert np.abs(got - p[3250:]).mean() < 0.1 and (np.diff(scale.p) >= 0).all()


def test_pii_judge_adds_likely_spans_only():
    """Phone numbers without a country code in the base's shape and context are
    added; other digit strings are not."""
    rng = random.Random(2)
    number = lambda: f"({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}"
    texts = [f"call me on +1 {number()} now" for _ in range(400)] + [
        f"order {rng.randint(10**8, 10**9)} of {rng.randint(1, 9)}" for _ in range(400)]
    rng.shuffle(texts)
    x, y = [], []
    for t in texts:
        base = pii.base_spans(t)
        for c in pii.candidates(t, base):
            x.append(pii.features(t, *c))
            y.append(float(c in base))
    judge = pii.fit(np.array(x), np.array(y))
    score = lambda t: max((judge.probability(np.array([pii.features(t, *c)]))[0]
                           for c in pii.candidates(t, []) if c[0] == 3), default=0)
    assert judge.thresholds[3] <= 1
    assert score("order 123456789 of 4") < judge.thresholds[3]


def test_pii_reports_the_common_unmarked_forms(spark):
    """Spelled-out addresses and numbers without a plus are reported however
    common they are beside the marked ones; order numbers are not."""
    rng = random.Random(4)
    name = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    forms = ((lambda: f"write to {name(6)}@{name(7)}.com today", lambda: f"write to {name(6)} [at] {name(7)} [dot] com today"),
             (lambda: f"call me on +1 ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)} now",
              lambda: f"call me on 1 ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)} now"))
    rows = [(f(), want) for marked, plain in forms for f, want in [(marked, True)] * 300 + [(plain, True)] * 300]
    rows += [(f"order {rng.randint(10**8, 10**9)} of {rng.randint(1, 9)}", False) for _ in range(300)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    found = {r["doc_id"]: r["spans"] for r in pii.find(docs).collect()}
    for part, least in ((range(300, 600), 0.9), (range(900, 1200), 0.9)):
        assert sum(bool(found[i]) for i in part) >= least * len(part)
        assert not any(s["base"] for i in part for s in found[i])
    assert not any(found[i] for i in range(1200, 1500))


def test_pii_judge_learns_from_every_candidate(spark, monkeypatch):
    """However few rows the driver may fit itself, the model is that of all candidates."""
    monkeypatch.setattr(gbt.BoostedTrees.__init__, "__defaults__", (3, 4, 0.2, 20, 1.0))
    rng = random.Random(5)
    number = lambda: f"({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}"
    texts = [f"call me on +1 {number()} now" for _ in range(300)] + [f"tel 1 {number()}, order {rng.randint(10**8, 10**9)}" for _ in range(200)]
    texts += [f"write to u{rng.randint(1, 999)}@host{rng.randint(1, 99)}.org" for _ in range(200)] * 2
    proposed = pii.propose(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).cache()
    rows = [(c["features"], c["base"]) for r in proposed.collect() for c in r["found"] if c["base"] or not c["part"]]
    whole, spread = pii.train(proposed), pii.train(proposed, max_rows=10)
    assert (whole.trees.trees, whole.trees.start, whole.thresholds) == (spread.trees.trees, spread.trees.start, spread.thresholds)
    assert all(np.array_equal(getattr(whole.scale, n), getattr(spread.scale, n)) for n in ("low", "p", "n"))
    held = proposed.selectExpr("doc_id", "explode(filter(found, c -> c.base OR NOT c.part)) AS c").selectExpr(
        "pmod(xxhash64(doc_id, c.kind, c.start, c.end), 3) = 2 AS held", "c.base", "c.features").collect()
    assert len(held) == len(rows) and spread.scale.n.sum() == sum(r["held"] for r in held)
    own = [r for r in held if not r["held"]]
    mean = sum(r["base"] for r in own) / len(own)
    assert spread.trees.start == pytest.approx(np.log(mean / (1 - mean)))
    cuts = gbt._bins(np.array([r["features"] for r in own], np.float64))
    assert all(np.array_equal(a, b) for a, b in zip(pii._cuts(spark.createDataFrame([(r["features"],) for r in own], "features array<float>")), cuts))
    assert sum(t < 1 for t in spread.thresholds) >= 2


def test_licenses_on_edges(spark):
    out = license_scan.scan(edge.documents(spark))
    got = edge.rows_of(out, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert got == edge.sort([(d, *brute.licenses(t)) for d, t, _ in edge.texts()])
    row = out.filter("doc_id = 11").first()
    assert row["labels"] == "cc-by,cc-by-nc-4.0,gpl,gpl-3.0,reserved" and row["score"] == 1.0
    assert license_scan.scan(edge.documents(spark, [])).count() == 0


def test_license_index_needs_phrases_and_place():
    index = license_scan.Index(license_scan.TEMPLATES, {b"license": 50, b"the": 90}, 100)
    words = license_scan.words_of
    for t in license_scan.TEMPLATES:
        assert index.scan([b"x", *words(t.text), b"y"], 0.7).get(t.label) == 1.0
    assert index.scan(words("released under the MIT Licence"), 0.7) == {}          # the key phrase is not there
    assert index.scan(words("License MIT the under released"), 0.7) == {}          # other places
    assert index.scan(words("we visited the MIT in version 2 of the license tour"), 0.7) == {}


def test_quality_metrics_on_edges(spark):
    docs = edge.documents(spark)
    out = quality_rules.judge(docs, spark.createDataFrame([], "doc_id long, quality int"))
    names = list(brute.quality(""))
    got = edge.rows_of(out.select("doc_id", "_q.*", "base_failed"), "doc_id", *names)
    assert got == edge.sort([(d, *brute.quality(t).values()) for d, t, _ in edge.texts()])
    assert quality_rules.judge(edge.documents(spark, []), spark.createDataFrame([], "doc_id long, quality int")).count() == 0


def _labelled(spark):
    """Good documents, and bad ones full of symbols, in two languages."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, labels = [], []
    for i in range(3000):
        bad = i % 3 == 0
        rows.append((i, " ".join(word() + (" ##" if bad else "") for _ in range(70)), "en" if i % 2 else None))
        labels.append((i, 0 if bad else 1))
    return edge.documents(spark, rows), spark.createDataFrame(labels + [(1, 0), (None, 1)], "doc_id long, quality int")


def test_proven_cutoffs_reject_bad_and_keep_good(spark):
    docs, labels = _labelled(spark)
    out = quality_rules.judge(docs, labels, max_false_rejection=0.2)
    kept = {r["doc_id"]: r["kept"] for r in out.collect()}
    assert all(kept[i] == (i % 3 != 0) for i in range(3000))
    stayed = quality_rules.keep_good(docs, labels, max_false_rejection=0.2)
    assert stayed.columns == docs.columns and {r["doc_id"] for r in stayed.collect()} == {i for i in range(3000) if i % 3}
    # a share too small for the sample: nothing is proven, nothing rejected
    assert quality_rules.judge(docs, labels, max_false_rejection=0.001).filter("not kept").count() == 0


def test_binomial_bound_is_exact(spark):
    """A cutoff with k of n good documents beyond it is proven exactly when the
    binomial tail is small enough."""
    from math import comb

    rule = quality_rules.Rule("symbols", "symbol_ratio", True, (0.5,))
    for n, k in ((300, 0), (300, 8), (300, 12), (60, 0), (800, 24), (800, 20)):
        q = "named_struct('n_words', 100L, 'word_chars', 400L, 'n_symbols', {}, 'n_dup_lines', 0L, 'n_repeat_words', 0L, 'n_bangs', 0L, 'n_lines', 1L)"
        rows = spark.range(n + 50).select(F.col("id").alias("doc_id"), F.lit("x").alias("stratum"),
                                          F.expr(q.format(f"if(id < {k} or id >= {n}, 90L, 0L)")).alias("_q"))
        labels = spark.range(n + 50).selectExpr("id as doc_id", f"if(id < {n}, 1, 0) as quality")
        tail = sum(comb(n, i) * 0.05 ** i * 0.95 ** (n - i) for i in range(k + 1))
        assert (quality_rules.cutoffs(rows, labels, (rule,), 0.05, 0.05).count() == 1) == (tail <= 0.05), (n, k, tail)


@pytest.mark.parametrize("name", ["op1_secret_scan", "op10_quality_rules"])
def test_native_queries_run_no_python(spark, name):
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    res = con.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in res.description]
    df = registry.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert edge.rows_of(df, *columns) == edge.sort([tuple(r) for r in res.fetchall()])


def test_license_notices_with_edited_words():
    """Each notice with one word put in, left out or replaced, outside its key phrases."""
    index = license_scan.Index(license_scan.TEMPLATES, {b"license": 50, b"the": 90, b"in": 80}, 100)
    around = license_scan.words_of("some words before the notice")
    for t, template in enumerate(license_scan.TEMPLATES):
        own = license_scan.words_of(template.text)
        fixed = {i for begin, phrase in index.phrases[t] for i in range(begin, begin + len(phrase))}
        joints = {i for begin, phrase in index.phrases[t] for i in range(begin + 1, begin + len(phrase))}
        edited = [own[:i] + [b"indeed"] + own[i:] for i in range(len(own) + 1) if i not in joints]
        for i in set(range(len(own))) - fixed:
            edited += [own[:i] + own[i + 1:], own[:i] + [b"indeed"] + own[i + 1:]]
        for words in edited:
            found = index.scan(around + words + around, 0.7)
            assert template.label in found and found[template.label] >= 0.7, words
        assert index.scan(around + own + around, 0.7)[template.label] == 1.0
    mit = license_scan.words_of(license_scan.TEMPLATES[2].text.replace("any person", "any natural person"))
    assert "mit" in index.scan(mit, 0.7)
    bsd = next(t for t in license_scan.TEMPLATES if t.label == "bsd")
    assert "bsd" in index.scan(license_scan.words_of(bsd.text.replace("with or without", "with or, indeed, without")), 0.7)
    # a key phrase that is cut, or out of order
    assert "mit" not in index.scan([w for w in mit if w != b"hereby"], 0.7)
    half = len(mit) // 2
    assert "mit" not in index.scan(mit[half:] + mit[:half], 0.7)


def test_license_alignment_equals_brute_force():
    rng = random.Random(7)
    for _ in range(400):
        own = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(1, 9))]
        words = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 14))]
        low = rng.randint(-4, 8)
        high = low + rng.randint(0, 6)
        best = {(0, 0): 0}
        for i in range(len(own) + 1):
            for p in range(len(words) + 1):
                best[i, p] = max([best[i - 1, p] if i else 0, best[i, p - 1] if p else 0,
                                  best[i - 1, p - 1] + 1 if i and p and own[i - 1] == words[p - 1]
                                  and low + i - 1 <= p - 1 <= high + i - 1 else 0])
        assert license_scan.in_place(own, words, low, high) == best[len(own), len(words)]


def test_license_places_equal_brute_force():
    rng = random.Random(8)
    for _ in range(400):
        hits = sorted((rng.randint(0, 20), rng.randint(0, 4)) for _ in range(rng.randint(0, 14)))
        slack, needed = rng.randint(0, 5), rng.randint(1, 4)
        sets = {}
        for first, _ in hits:
            inside = [h for h in hits if first <= h[0] <= first + slack]
            if len({at for _, at in inside}) >= needed:
                sets[first, inside[-1][0]] = frozenset(inside)
        largest = {k for k, v in sets.items() if not any(v < w for w in sets.values())}
        assert set(license_scan.Index._places(hits, needed, slack)) == largest


def test_pii_parts_equal_brute_force():
    rng = random.Random(3)
    words = ["4111 1111 1111 1111", "+44 20 7946 0958", "10.0.0.1", "1.2.3.4.5", "a.b@c.org", "jo [at] c [dot] org", "020 7946 0958", "12345678", "x", "-", "."]
    for _ in range(300):
        text = rng.choice(["", " ", ", "]).join(rng.choices(words, k=rng.randint(0, 12)))
        base = pii.base_spans(text)
        found = pii.candidates(text, base)
        want = [any(k == c[0] and (k, a, b) != c and a < c[2] and c[1] < b for k, a, b in base) for c in found]
        assert pii._parts(found, base) == want, text


def test_pii_of_a_text_with_very_many_candidates(spark):
    long = " ".join(f"10.0.{i % 256}.{i // 256} u{i}@h.org 555-01{i:05d}" for i in range(12_000))
    docs = spark.createDataFrame([(1, long), (2, "a@b.org"), (3, None), (4, long)], "doc_id long, text string").coalesce(1)
    rows = {r["doc_id"]: r["spans"] for r in pii.find(docs, max_rows=2000).collect()}
    assert sorted(rows) == [1, 2, 3, 4] and rows[3] == []
    for i, text in ((1, long), (2, "a@b.org"), (4, long)):
        assert sorted((pii.KINDS.index(s["kind"]), s["start"], s["end"]) for s in rows[i] if s["base"]) == sorted(pii.base_spans(text))
    # candidates of several rows in pieces: rows stay whole
    for piece in (1, 7, 100_000):
        assert [len(r["found"]) for r in pii.propose(docs, piece).orderBy("doc_id").collect()][1:3] == [1, 0]
