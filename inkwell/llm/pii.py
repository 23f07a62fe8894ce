"""Personal data: candidate spans, boosted trees, calibrated thresholds.

High-recall generators propose overlapping spans: e-mail addresses, plain and
spelled out; dotted numbers; digit strings with or without separators; phone
numbers with or without a country code. Spans that match a fixed format and
its check (address syntax, part range, Luhn, digit count) are *base* spans and
are always reported. The others are judged by boosted trees on features of
their format and their context.

The trees learn from the base spans with the deciding mark masked: features
read a spelled-out address as if written with ``@``, and a phone number without
its plus. Base spans are labelled; what lacks the mark is not negative but
unlabelled, so the trees' probability of a label is that of the datum times the
share of data written with the mark. That share is estimated per kind as the
mean calibrated probability of held-out base spans, and a candidate is reported
if its probability over the share reaches ``precision``. Parts of a base span
are not fitted on. All other candidates are: the third of them that a hash
picks is held out for isotonic calibration and the shares. A kind with fewer than ``LABELS``
held-out base spans adds nothing.

One pass over the texts writes the candidates with their features; fitting
and selection read only those. Bins are cut at exact quantiles of the features,
and candidates that fall into the same bins are counted as one row from then
on. Up to ``max_rows`` such rows, the driver fits them itself; beyond, the
executors work out the sums that each level of a tree, the calibration and the
shares need. Both give the same model.

Defined results: a null text is empty; a null id and repeated rows are kept as
they are (and count as often as they occur); a text of any length is one
row, its candidates held as columns of 100 bytes each; with fewer than
``min_rows`` candidates only base spans are reported; an empty table gives an
empty table; other columns are ignored. Positions are code points, end
exclusive.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm.common import map_arrow, materialize, text_of
from inkwell.llm.gbt import BINS, BoostedTrees, Counted, Isotonic, _bins, coded, pooled

KINDS = ("email", "ip", "card", "phone")
# distinct binned candidates, with their counts, that the driver fits itself
MAX_ROWS = 20_000
MIN_ROWS = 200
PRECISION = 0.95
LABELS = 20
# candidates handed on, or judged, at once
PIECE = 16_384

# Fixed formats.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", re.A)
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a run of digits can only match from its first digit, so the others are not tried
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Wider generators.
SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]{1,63}){1,5}")
DOTTED = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){2,4}(?![0-9])")
DIGITS = re.compile(r"(?<![0-9])\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,18}(?![0-9])")

CONTEXT = (
    re.compile(r"mail|contact|write|@", re.I), re.compile(r"\bip\b|host|server|addr", re.I),
    re.compile(r"card|visa|credit|pay|account", re.I), re.compile(r"phone|tel|call|mobile|fax|dial", re.I))
AT, DOT = (re.compile(rf"\x20?[\[(]{w}[\])]\x20?") for w in ("at", "dot"))
FEATURES = 19
REACH = 24


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed formats, by kind, then start."""
    found = []
    done, at = 0, text.find("@")
    while at >= 0:
        if m := DOMAIN.match(text, at):
            begin = at
            while begin > done and text[begin - 1] in LOCAL:
                begin -= 1
            if begin < at:
                found.append((0, begin, m.end()))
                done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:] if p.lstrip("0") else "0") <= 255 for p in m[0].split(".")):
            found.append((1, *m.span()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append((2, *m.span()))
    for m in PHONE.finditer(text):
        if 9 <= sum(map(str.isdigit, m[0])) <= 15:
            found.append((3, *m.span()))
    return found


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Base spans and what the wider generators propose, as (kind, start, end)."""
    wide = list(base)
    if "at" in text:
        wide += [(0, *m.span()) for m in SPELLED.finditer(text)]
    wide += [(1, *m.span()) for m in DOTTED.finditer(text)]
    for m in DIGITS.finditer(text):
        n = sum(map(str.isdigit, m[0]))
        begin = m.start() - (m.start() > 0 and text[m.start() - 1] == "+")
        if n >= 12:
            wide.append((2, m.start(), m.end()))
        if 7 <= n <= 15:
            wide.append((3, begin, m.end()))
    return list(dict.fromkeys(wide))


def features(text: str, kind: int, start: int, end: int) -> list[float]:
    span = text[start:end].lstrip("+")
    if kind == 0:
        span = DOT.sub(".", AT.sub("@", span))
    before, after = text[max(0, start - REACH):start], text[end:end + REACH]
    groups = re.findall(r"[0-9]+", span)
    digits = "".join(groups)
    sizes = [len(g) for g in groups] or [0]
    shape = 0
    for s in sizes[:6]:
        shape = shape * 5 + min(s, 4)
    touching = lambda c: 0.0 if not c else 1.0 if c.isspace() else 2.0 if c.isalnum() else 3.0
    return [float(x) for x in (
        kind, len(span), len(digits), len(groups), max(sizes), min(sizes), sizes[-1], shape, "(" in span, "-" in span, " " in span,
        span.count("."), luhn(digits) if len(digits) >= 2 else False, touching(before[-1:]), touching(after[:1]),
        max((int(g[-3:]) if len(g) < 4 else 999 for g in groups), default=0), bool(CONTEXT[kind].search(before)),
        sum(map(str.isdigit, before)), sum(map(str.isdigit, after)))]


CANDIDATE = "array<struct<kind:int,start:int,end:int,base:boolean,part:boolean,features:array<float>>>"


def _lists(lengths: list[int], fields: dict[str, pa.Array]) -> pa.ListArray:
    """A list of structs per row, from the fields of all rows' structs."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(list(fields.values()), list(fields)))


def _parts(found: list[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> list[bool]:
    """Which candidates overlap a base span of their kind that is not themselves: base
    spans of a kind are disjoint and in order, so their neighbours tell."""
    ends: list[list[int]] = [[] for _ in KINDS]
    spans: list[list[tuple[int, int]]] = [[] for _ in KINDS]
    for k, a, b in base:
        ends[k].append(b)
        spans[k].append((a, b))
    out = []
    for k, a, b in found:
        i = bisect_right(ends[k], a)
        # a base span meets no other of its kind
        out.append(i < len(spans[k]) and spans[k][i][0] < b and spans[k][i] != (a, b))
    return out


def propose(docs: DataFrame, piece: int = PIECE) -> DataFrame:
    """doc_id and all candidates with their features: one pass over the texts.

    A ``part`` overlaps a base span of its kind. Candidates are held as columns,
    and handed on as soon as there are ``piece`` of them."""
    rows = docs.select("doc_id", text_of().alias("_text"))
    schema = rows.select("doc_id", F.lit(None).cast(CANDIDATE).alias("found")).schema

    def run(batches):
        for batch in batches:
            lengths, places, values, begin = [], [], [], 0

            def flush(end):
                own = np.concatenate(places) if places else np.zeros((0, 5), np.int32)
                x = np.concatenate(values) if values else np.zeros((0, FEATURES), np.float32)
                offsets = pa.array(np.arange(0, x.size + 1, FEATURES, dtype=np.int32))
                found = _lists(lengths, {
                    **{n: pa.array(own[:, i]) for i, n in enumerate(("kind", "start", "end"))},
                    **{n: pa.array(own[:, i].astype(bool)) for i, n in ((3, "base"), (4, "part"))},
                    "features": pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))})
                return pa.RecordBatch.from_arrays([batch.column("doc_id").slice(begin, end - begin), found], names=["doc_id", "found"])

            for i, text in enumerate(batch.column("_text")):
                text = text.as_py()
                base = base_spans(text)
                found = candidates(text, base)
                lengths.append(len(found))
                if found:
                    own = set(base)
                    places.append(np.array([(*c, c in own, p) for c, p in zip(found, _parts(found, base))], np.int32))
                    x = np.empty((len(found), FEATURES), np.float32)
                    for j, c in enumerate(found):
                        x[j] = features(text, *c)
                    values.append(x)
                if sum(lengths) >= piece or len(lengths) >= 1024:
                    yield flush(i + 1)
                    lengths, places, values, begin = [], [], [], i + 1
            if lengths:
                yield flush(batch.num_rows)

    return map_arrow(rows, run, schema)


@dataclass
class Judge:
    """Trees, calibration and one threshold per kind."""

    trees: BoostedTrees | None = None
    scale: Isotonic | None = None
    thresholds: list[float] = field(default_factory=lambda: [math.inf] * len(KINDS))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self.scale(self.trees.raw(x)) if self.trees else np.zeros(len(x))


class Counts:
    """Distinct binned candidates by kind, with the counts of those to fit on and of
    those held out, in memory."""

    def __init__(self, kind: np.ndarray, codes: np.ndarray, counts: np.ndarray):
        # counts: all and labelled ones to fit on, all and labelled ones held out
        self.kind, self.codes, self.counts = kind, codes, counts
        self.rows = Counted(codes, counts[:, 0], counts[:, 1])

    def totals(self) -> list[float]:
        return self.counts.sum(axis=0).tolist()

    def sums(self, trees: BoostedTrees, tree: list, level: int) -> np.ndarray:
        return self.rows.sums(trees, tree, level)

    def held(self, trees: BoostedTrees) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct scores of held-out rows, with the labelled ones' count and the count."""
        own = self.counts[:, 2] > 0
        raw, at = np.unique(trees.raw_of_codes(self.codes[own]), return_inverse=True)
        labelled, n = (np.bincount(at, self.counts[own, i], len(raw)) for i in (3, 2))
        return raw, labelled, n

    def blocks(self, trees: BoostedTrees) -> list[list[float]]:
        return pooled((v, n, s, s) for s, v, n in zip(*(c.tolist() for c in self.held(trees))))

    def shares(self, trees: BoostedTrees, scale: Isotonic) -> np.ndarray:
        """Per kind: the count of labelled held-out rows, and the sum of their
        probabilities in units of 1 / 2**24."""
        p = np.rint(scale(trees.raw_of_codes(self.codes)) * 2.0 ** 24)
        return np.stack([np.bincount(self.kind, w, len(KINDS)) for w in (self.counts[:, 3], self.counts[:, 3] * p)])


COUNTS = ("n", "y", "held_n", "held_y")


def _counts_of(batch) -> Counts:
    """The rows of a batch of ``binned``."""
    codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, FEATURES)
    return Counts(batch.column("kind").to_numpy(), codes, np.stack([batch.column(c).to_numpy() for c in COUNTS], axis=1).astype(np.float64))


class SpreadCounts:
    """The same as ``Counts`` of rows that stay on the executors."""

    def __init__(self, table: DataFrame):
        self.table = table

    def _sum(self, of_batch, shape: tuple) -> np.ndarray:
        """The sum of ``of_batch`` over all batches, one array handed on by each task."""
        def run(batches):
            total = np.zeros(shape)
            for batch in batches:
                if batch.num_rows:
                    total += of_batch(_counts_of(batch))
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

        parts = map_arrow(self.table, run, "part binary").toLocalIterator()
        return sum((np.frombuffer(r["part"]).reshape(shape) for r in parts), np.zeros(shape))

    def totals(self) -> list[float]:
        return [float(v or 0) for v in self.table.agg(*(F.sum(c) for c in COUNTS)).first()]

    def sums(self, trees: BoostedTrees, tree: list, level: int) -> np.ndarray:
        return self._sum(lambda rows: rows.sums(trees, tree, level), (3, 2 ** level, FEATURES, BINS))

    def blocks(self, trees: BoostedTrees) -> list[list[float]]:
        """Pooled in ranges of scores first, then over all of them."""
        def scored(batches):
            for batch in batches:
                if batch.num_rows:
                    raw, y, n = _counts_of(batch).held(trees)
                    yield pa.RecordBatch.from_arrays([pa.array(raw), pa.array(y), pa.array(n)], names=["raw", "y", "n"])

        def pool(batches):
            rows = (r for batch in batches for r in zip(*(batch.column(i).to_pylist() for i in (1, 2, 0, 0))))
            blocks = pooled(rows)
            yield pa.RecordBatch.from_arrays([pa.array([b[i] for b in blocks], pa.float64()) for i in range(4)], names=["y", "n", "low", "top"])

        scores = map_arrow(self.table, scored, "raw double, y double, n double").groupBy("raw").agg(
            F.sum("y").alias("y"), F.sum("n").alias("n"))
        ranges = map_arrow(scores.repartitionByRange("raw").sortWithinPartitions("raw"), pool, "y double, n double, low double, top double")
        return pooled(sorted(map(tuple, ranges.collect()), key=lambda b: b[2]))

    def shares(self, trees: BoostedTrees, scale: Isotonic) -> np.ndarray:
        return self._sum(lambda rows: rows.shares(trees, scale), (2, len(KINDS)))


def _judge(cuts: list[np.ndarray], rows: Counts | SpreadCounts, precision: float = PRECISION, min_rows: int = MIN_ROWS) -> Judge:
    n, labelled, held_n, held_y = rows.totals()
    if n + held_n < min_rows or not n or not 0 < labelled + held_y < n + held_n:
        return Judge()
    trees = BoostedTrees().fit_sums(cuts, n, labelled, rows.sums)
    judge = Judge(trees, Isotonic().of_blocks(rows.blocks(trees)))
    for k, (found, total) in enumerate(rows.shares(trees, judge.scale).T.tolist()):
        if found >= LABELS:
            judge.thresholds[k] = precision * total / 2.0 ** 24 / found
    return judge


def fit(x: np.ndarray, y: np.ndarray, precision: float = PRECISION, min_rows: int = MIN_ROWS) -> Judge:
    """Trees on two thirds of the rows, calibration and thresholds on the rest."""
    if len(y) < min_rows:
        return Judge()
    held = np.arange(len(y)) % 3 == 2
    cuts = _bins(x[~held])
    counts = np.stack([~held, ~held * y, held, held * y], axis=1).astype(np.float64)
    return _judge(cuts, Counts(x[:, 0].astype(int), coded(cuts, x), counts), precision, min_rows)


def _cuts(rows: DataFrame) -> list[np.ndarray]:
    """Exact quantiles of every feature, as ``gbt._bins`` has them, from the counts of
    its distinct values."""
    values = rows.select(F.posexplode("features").alias("f", "v")).groupBy("f", "v").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("f")
    upto = F.sum("n").over(own.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = values.select("f", "v", "n", upto.alias("upto"), F.sum("n").over(own).alias("all"))
    met = F.exists(F.sequence(F.lit(1), F.lit(BINS - 1)), lambda j: F.floor(j * (F.col("all") - 1) / BINS).between(
        F.col("upto") - F.col("n"), F.col("upto") - 1))
    found: list[list[float]] = [[] for _ in range(FEATURES)]
    for r in ranked.where(met).select("f", "v").collect():
        found[r["f"]].append(r["v"])
    return [np.array(sorted(c), np.float64) for c in found]


def binned(rows: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """``kind``, ``code`` (the bin of each feature) and the counts of the candidates there."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)
                codes = coded(cuts, x.astype(np.float64)).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("kind"), batch.column("base"), batch.column("held"),
                     pa.array([codes[i:i + FEATURES] for i in range(0, len(codes), FEATURES)], pa.binary())],
                    names=["kind", "base", "held", "code"])

    held, base = F.col("held"), F.col("base")
    return map_arrow(rows, run, "kind int, base boolean, held boolean, code binary").groupBy("kind", "code").agg(
        F.count_if(~held).alias("n"), F.count_if(~held & base).alias("y"),
        F.count_if(held).alias("held_n"), F.count_if(held & base).alias("held_y"))


def train(proposed: DataFrame, max_rows: int = MAX_ROWS, **options) -> Judge:
    """Fit on all candidates: on the driver up to ``max_rows`` distinct binned ones, else on the executors."""
    # what overlaps a base span of its kind is neither another datum nor a counterexample
    rows = proposed.select("doc_id", F.explode(F.filter("found", lambda c: c["base"] | ~c["part"])).alias("c")).select(
        "c.kind", "c.base", (F.pmod(F.xxhash64("doc_id", "c.kind", "c.start", "c.end"), F.lit(3)) == 2).alias("held"), "c.features")
    cuts = _cuts(rows.where(~F.col("held")))
    table = materialize(binned(rows, cuts), "pii-counts")
    few = table.count()
    if not few:
        return Judge()
    return _judge(cuts, _counts_of(table.toArrow()) if few <= max_rows else SpreadCounts(table), **options)


SPAN = "array<struct<kind:string,start:int,end:int,base:boolean,score:double>>"


def _merged(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the union of spans, as disjoint spans in order."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted(spans):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def select(proposed: DataFrame, judge: Judge) -> DataFrame:
    """doc_id and ``spans``: the base spans, and of the others those at or above
    their kind's threshold that overlap neither a base span nor a likelier one."""
    schema = proposed.select("doc_id", F.lit(None).cast(SPAN).alias("spans")).schema
    thresholds = np.array(judge.thresholds)

    def run(batches):
        for batch in batches:
            column = batch.column("found")
            cuts = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))])
            kind, start, end, base, _, values = column.flatten().flatten()
            kind, start, end, base = (c.to_numpy(zero_copy_only=False) for c in (kind, start, end, base))
            x = values.flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)
            p = np.concatenate([np.zeros(0), *(judge.probability(x[i:i + PIECE].astype(np.float64)) for i in range(0, len(x), PIECE))])
            wanted = np.flatnonzero(base | (p >= thresholds[kind]))
            lengths, out = [], []
            for own in np.split(wanted, np.searchsorted(wanted, cuts[1:-1])) if len(cuts) > 1 else []:
                ranked = sorted(zip((~base[own]).tolist(), (-p[own]).tolist(), kind[own].tolist(), start[own].tolist(), end[own].tolist()))
                taken = [c for c in ranked if not c[0]]
                starts, ends = _merged([c[3:] for c in taken])
                for other, q, k, a, b in ranked[len(taken):]:
                    # disjoint spans in order: the first that ends after this one begins decides
                    i = bisect_right(ends, a)
                    if i < len(starts) and starts[i] < b:
                        continue
                    starts.insert(i, a)
                    ends.insert(i, b)
                    taken.append((other, q, k, a, b))
                lengths.append(len(taken))
                out += sorted(taken, key=lambda t: t[2:])
            other, q, k, a, b = zip(*out) if out else [()] * 5
            spans = _lists(lengths, {
                "kind": pa.array([KINDS[i] for i in k], pa.string()), "start": pa.array(a, pa.int32()), "end": pa.array(b, pa.int32()),
                "base": pa.array([not o for o in other], pa.bool_()), "score": pa.array([-y for y in q], pa.float64())})
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), spans], names=["doc_id", "spans"])

    return map_arrow(proposed, run, schema)


def find(docs: DataFrame, max_rows: int = MAX_ROWS, **options) -> DataFrame:
    """doc_id and ``spans`` for every row of ``docs``."""
    proposed = materialize(propose(docs), "pii-candidates")
    return select(proposed, train(proposed, max_rows, **options))
