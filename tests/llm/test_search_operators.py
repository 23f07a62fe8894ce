"""Learned partitions, spelling variants and importance resampling against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import edge
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from inkwell.llm import ann_partitions, importance, registry, spelling_variants

SF = "/root/testdata/sf0.001"
LOWER = {c: c + 32 for c in range(65, 91)}


def _sf(table, *columns):
    t = pq.read_table(f"{SF}/{table}.parquet")
    return list(zip(*(t.column(c).to_pylist() for c in columns)))


# --------------------------------------------------------- learned partitions

def _single(vector):
    return vector and [None if x is None else float(np.float32(x)) for x in vector]


def _nearest(rows, every=50, k=5):
    """(query, rank) -> (id, score), by comparing everything."""
    good = {i: np.array(_single(v), float) for i, v in rows
            if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    out = {}
    for q, x in good.items():
        if q % every == 0:
            some = sorted((-(x @ y / (math.sqrt(x @ x) * math.sqrt(y @ y))), i) for i, y in good.items() if i != q and len(y) == len(x))
            for rank, (s, i) in enumerate(some[:k], 1):
                out[q, rank] = i, -s
    return out


def _found(df):
    return {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in df.collect()}


def _vectors(spark, rows):
    return spark.createDataFrame([(i, _single(v), "own", 0) for i, v in rows], "vec_id long, embedding array<float>, name string, part int")


def _recall(found, want):
    near = defaultdict(set)
    for (q, _), (i, _) in found.items():
        near[q].add(i)
    return sum(i in near[q] for (q, _), (i, _) in want.items()) / len(want)


def test_search_finds_nearly_all(spark):
    want = _nearest(_sf("embeddings", "vec_id", "embedding"))
    found = _found(registry.op11_ann_partitions(spark, SF))
    assert len(found) == len(want) and _recall(found, want) >= 0.9
    for (q, r), (i, s) in found.items():
        assert (q, r) in want and s <= want[q, r][1] + 1e-12


def test_search_prunes_and_finds_among_groups(spark):
    """Where vectors have neighbours, few partitions are enough."""
    rng = np.random.default_rng(2)
    centre = rng.standard_normal((40, 16))
    rows = [(i, (centre[i % 40] + 0.2 * rng.standard_normal(16)).astype(np.float32).tolist()) for i in range(3000)]
    x = np.array([v for _, v in rows], float)
    router = ann_partitions.fit(x, len(x))
    parts = router.w2.shape[1]
    assert parts >= 8 and router.probes <= parts // 2
    size = np.bincount(router.ranked(ann_partitions.unit(x), 1)[:, 0], minlength=parts)
    assert size.max() <= 4 * len(x) / parts
    want = _nearest(rows)
    assert _recall(_found(ann_partitions.search(_vectors(spark, rows).repartition(5))), want) >= 0.9


def test_search_on_edges(spark):
    """Copies, ties, odd lengths and rows that take no part; small blocks, so that one partition is many cells."""
    rng = np.random.default_rng(4)
    plain = [(i, rng.integers(-3, 4, 6).astype(float).tolist()) for i in range(60)]
    same = [(i, [1.0, 2.0, 0.0, 0.0, 1.0, 1.0]) for i in range(100, 160)]
    odd = [(0, None), (50, []), (200, [0.0] * 6), (250, [1.0, None, 0, 0, 0, 0]), (300, [float("nan")] * 6), (350, [float("inf")] + [1.0] * 5),
           (None, [1.0] * 6), (400, [1.0, 1.0]), (401, [1.0, 0.5]), (450, [3.0]), (500, [1e38] * 6), (550, [1e-38] * 6), (600, [2.0] * 6)]
    rows = [r for r in plain if r[0] not in (0, 50)] + same + odd
    rows += rows[:3] + same[:1]
    df = _vectors(spark, rows)
    want = _nearest(rows)
    for block in (200, 1 << 20):
        found = _found(ann_partitions.search(df, recall=1.0, block_bytes=block))
        assert found.keys() == want.keys()
        for key, (i, s) in want.items():
            assert abs(found[key][1] - s) < 1e-12, key
    # copies: the smallest other ids, in order
    assert [found[100, r][0] for r in range(1, 6)] == [101, 102, 103, 104, 105]
    assert [found[150, r][0] for r in range(1, 6)] == [100, 101, 102, 103, 104]
    assert {k for k in found if k[0] in (400, 450)} == {(400, 1)} and found[400, 1][0] == 401
    assert ann_partitions.search(_vectors(spark, [])).count() == 0
    assert ann_partitions.search(_vectors(spark, [(0, [1.0])])).count() == 0
    assert _found(ann_partitions.search(_vectors(spark, [(0, [1.0, 0.0]), (1, [1.0, 1.0])]))).keys() == {(0, 1)}


def test_graph_partitions_are_balanced():
    rng = np.random.default_rng(1)
    x = ann_partitions.unit(rng.standard_normal((500, 8)))
    near = ann_partitions.neighbours(x, 10)
    assert all((x[i] @ x[near[i]].T >= np.sort(x[i] @ np.delete(x, i, 0).T)[-10] - 1e-12).all() for i in range(0, 500, 50))
    for parts in (2, 7, 16):
        of = ann_partitions.partition_graph(near, parts)
        size = np.bincount(of, minlength=parts)
        assert size.min() >= 500 // parts - 4 and size.max() <= -(-500 // parts) + 4
        # fewer edges are cut than by chance
        assert (of[near] != of[:, None]).mean() < 0.9 * (1 - 1 / parts)


# ---------------------------------------------------------- spelling variants

def _words(docs, drop=97, least=5, min_count=3):
    count = Counter()
    for i, text in docs:
        for r in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            r = r.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{r}".encode())
            if h % drop == 0:
                r = r[:h % len(r)] + r[h % len(r) + 1:]
            count[r] += 1
    return {w: n for w, n in count.items() if len(w) >= least and n >= min_count}


def _variants(words):
    near, same = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            same[w[:i], w[i + 1:]].add(w)
            if w[:i] + w[i + 1:] in words:
                near[w].add(w[:i] + w[i + 1:])
                near[w[:i] + w[i + 1:]].add(w)
    for group in same.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w in words:
        if near[w]:
            best = min(near[w], key=lambda y: (-words[y], y))
            if words[best] >= 2 * words[w]:
                form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words.get(form.get(w))))
    return edge.sort(out)


VARIANT = ("word", "form", "root", "n", "n_near", "form_n")


def test_variants_equal_brute_force(spark):
    assert edge.rows_of(registry.op12_spelling_variants(spark, SF), *VARIANT) == _variants(_words(_sf("documents", "doc_id", "text")))


def test_variants_on_edges(spark):
    word = "straße straßen strasse Straßen ÀÉÎõü àéîõü ABCDE abcde abcdef abcdx " * 4
    rows = [(1, None, "en"), (None, word, "en"), (None, word, None), (2, word, "en"), (2, word, "en"), (3, "", "x"),
            (4, ("x" * 5000 + " " + "x" * 4999 + "y ") * 3, "en"), (5, "漢abcde字abcdeff abcdeĀabcdé " * 5, "en"),
            (6, " ".join(random.Random(3).choice("abcdeé") * 3 + "abc" for _ in range(300)), "en")]
    want = _variants(_words([r[:2] for r in rows], drop=3))
    assert edge.rows_of(spelling_variants.group(edge.documents(spark, rows).repartition(3), drop=3), *VARIANT) == want
    assert spelling_variants.group(edge.documents(spark, [])).count() == 0


def test_pieces_of_a_long_text_count_alike(spark, monkeypatch):
    text = " ".join(random.Random(8).choice(["alpha", "alphas", "beta5gamma", "delta\n\nDELTA"]) for _ in range(2000))
    whole = Counter()
    for w, n in spelling_variants.runs_of(text, b"7:", drop=2):
        whole[w] += n
    monkeypatch.setattr(spelling_variants, "PIECE", 50)
    parts = Counter()
    for w, n in spelling_variants.runs_of(text, b"7:", drop=2):
        parts[w] += n
    assert parts == whole


@pytest.mark.parametrize("cell_rows,size", [(2048, 1 << 16), (5, 1 << 16), (2048, 40), (3, 1)])
def test_near_pairs_lose_nothing(spark, cell_rows, size):
    """Few letters make long gram lists; small cells split them, a small dictionary keeps grams short."""
    rng = random.Random(cell_rows + size)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(5, 8))): rng.randint(1, 50) for _ in range(400)}
    words |= {"a" * n: n for n in range(5, 14)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert edge.rows_of(spelling_variants.variants(df, size=size, frequent=2, cell_rows=cell_rows), *VARIANT) == _variants(words)


@pytest.mark.parametrize("pairs", [1, 7, 1 << 20])
def test_cells_are_compared_by_arrays(monkeypatch, pairs):
    """All pairs of a cell as numbers: only words above ``SHORT`` are looked at one by one."""
    monkeypatch.setattr(spelling_variants, "PAIRS", pairs)
    rng = random.Random(pairs)
    rows, want, one_by_one = [], set(), []
    for key in (2, 3, 4, 5):
        own = {"".join(rng.choice("aéz") for _ in range(rng.randint(5, 7))) for _ in range(60)} | {"漢" * n for n in (63, 64, 65, 66)}
        rows += [(key, -1, -1, -1, w, len(w), 99, 0) for w in own for _ in range(1 + (w[0] == "z"))]
        # at a distance from the right, words of equal length are left to the cell of the left
        want |= {(a, len(a), b, len(b)) for a in own for b in own if a < b and (key % 2 == 0 or len(a) != len(b)) and spelling_variants.one_edit(a, b)}
    whole = spelling_variants.one_edit
    monkeypatch.setattr(spelling_variants, "one_edit", lambda a, b: one_by_one.append((a, b)) or whole(a, b))
    names = ["key", "lo", "hi", "side", "word", "n", "bound", "bits"]
    kinds = [pa.int64(), *[pa.int32()] * 3, pa.string(), pa.int64(), pa.int32(), pa.int64()]
    table = pa.table([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)
    got = spelling_variants._near_in_cells(table)
    assert sorted(zip(*(got.column(c).to_pylist() for c in ("a", "n_a", "b", "n_b")))) == sorted(want)
    assert {max(len(a), len(b)) for a, b in one_by_one} == {65, 66}
    assert spelling_variants._near_in_cells(table.slice(0, 0)).num_rows == 0


def test_bounds_cover_every_edit():
    """At least (grams - bound) grams of either word outlast any single edit."""
    rng = random.Random(6)
    dictionary = {"".join(rng.choice("ab^$") for _ in range(rng.randint(2, 4))): rng.randint(1, 9) for _ in range(60)}
    for _ in range(2000):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(5, 9)))
        i = rng.randrange(len(a))
        b = rng.choice([a[:i] + a[i + 1:], a[:i] + "c" + a[i:], a[:i] + "c" + a[i + 1:], a + "a"])
        for x, y in ((a, b), (b, a)):
            own, other = spelling_variants.decompose(x, dictionary), spelling_variants.decompose(y, dictionary)
            left = set(enumerate(other)) | {(k - len(other), g) for k, g in enumerate(other)}
            kept = sum((k, g) in left or (k - len(own), g) in left for k, g in enumerate(own))
            assert kept >= len(own) - spelling_variants.most_affected(own)
            assert spelling_variants.most_affected(own) < len(own) or min(len(x), len(y)) < 5
        assert spelling_variants.one_edit(a, b) == (a != b)
    assert not spelling_variants.one_edit("abcde", "abcde") and not spelling_variants.one_edit("abcde", "abdce")


# ------------------------------------------------------ importance resampling

def _feature_buckets(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    runs = [" ".join(words[i:i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]
    return len(words), [zlib.crc32(r.encode()) % 10_000 for r in runs]


def _resampled(docs, target, percent=5):
    own = [(i, *_feature_buckets(t)) for i, t in docs]
    source, goal = Counter(b for _, _, f in own for b in f), Counter(b for t in target for b in _feature_buckets(t)[1])
    s_all, t_all = sum(source.values()), sum(goal.values())
    gain = {b: math.floor(1000 * math.log((goal[b] + 1) * (s_all + 10_000) / ((source[b] + 1) * (t_all + 10_000)))) for b in range(10_000)}
    rows = []
    for i, n, f in own:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for rank, r in enumerate(fit[:percent * len(fit) // 100], 1):
        r[4] = rank
    return edge.sort(map(tuple, rows))


SCORE = ("doc_id", "n_features", "weight", "score", "rank", "n_words")


def test_resampling_equals_brute_force(spark):
    want = _resampled(_sf("documents", "doc_id", "text"), [t for t, in _sf("benchmark", "text")])
    assert edge.rows_of(registry.op13_importance_resampling(spark, SF), *SCORE) == want
    assert max(r[4] or 0 for r in want) > 5


def test_resampling_on_edges(spark):
    rows = edge.texts()
    target = [None, "", "one two three", "Same LINE here " * 40]
    goal = spark.createDataFrame([(t, 1) for t in target], "text string, weight int")
    for parts in (1, 7):
        got = edge.rows_of(importance.resample(edge.documents(spark).repartition(parts), goal, percent=60), *SCORE)
        assert got == _resampled([r[:2] for r in rows], target, 60)
    none = spark.createDataFrame([], "text string")
    assert edge.rows_of(importance.resample(edge.documents(spark), none), *SCORE) == _resampled([r[:2] for r in rows], [])
    assert importance.resample(edge.documents(spark, []), goal).count() == 0


def test_position_table_crc():
    """Spans of all lengths, overlapping, also far beyond the table and with small look-ups."""
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 300_000).astype(np.uint8)
    start = np.append(rng.integers(0, 290_000, 400), [0, 0, 5, 17])
    size = np.append(rng.integers(1, 9_000, 400), [300_000, 255, 256, 257])
    for depth in (4, 256):
        got = importance.PositionCrc(depth).spans(data, start, start + size)
        assert got.tolist() == [zlib.crc32(data[a:a + n].tobytes()) for a, n in zip(start, size)]
    short = np.minimum(size, 30)
    assert importance.position_crc().spans(data, start, start + short).tolist() == [
        zlib.crc32(data[a:a + n].tobytes()) for a, n in zip(start, short)]
    assert importance.position_crc().constants(np.array([0, 1, 300])).tolist() == [zlib.crc32(bytes(n)) for n in (0, 1, 300)]


def test_features_of_long_and_short_texts(monkeypatch):
    monkeypatch.setattr(importance, "PIECE", 7)
    texts = ["", "a", "Hello WORLD é漢 x1", "z" * 255, "z" * 256, "q" * 257 + " b " + "r" * 100_000 + " c", "  ", "A-b_c", "a b c d e f g h " * 9]
    for kind in (pa.string(), pa.large_string()):
        found, n = [[] for _ in texts], None
        for words, text, bucket in importance.features(pa.array(["skipped", *texts], kind).slice(1)):
            if words is not None:
                n = words.tolist()
                continue
            for i, b in zip(text.tolist(), bucket.tolist()):
                found[i].append(b)
        assert [(a, sorted(b)) for a, b in zip(n, found)] == [(a, sorted(b)) for a, b in map(_feature_buckets, texts)]
