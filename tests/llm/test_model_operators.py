"""Packing, BPE, language-model scoring, WARC and the near-duplicate operators
against brute force, exact round trips and held-out accuracy."""

from __future__ import annotations

import gzip
import hashlib
import random
from collections import Counter

import brute
import edge
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from inkwell.llm import (
    attention_lm,
    byte_bpe,
    common,
    embedding_dedup,
    lm_score,
    packing,
    registry,
    simhash_dedup,
    warc,
    word_bpe,
)

SF = "/root/testdata/sf0.001"
BYTE = public_tokenizers.path("byte_bpe_50k.json")
WORD = public_tokenizers.path("word_bpe_49k.json")


def _sf(table, *columns):
    t = pq.read_table(f"{SF}/{table}.parquet")
    return list(zip(*(t.column(c).to_pylist() for c in columns)))


def _ids(path):
    t = Tokenizer.from_file(path)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


# ------------------------------------------------------------------- packing

def test_packing_holds_every_id_once(spark):
    pieces = [r.asDict() for r in registry.op2_packing(spark, SF).collect()]
    assert brute.pieces_hold(pieces, _sf("documents", "doc_id", "text"), _ids(BYTE))


def test_packing_on_edges(spark):
    rows = [(i, t, lang) for i, (_, t, lang) in enumerate(edge.texts())]
    for parts in (1, 7):
        pieces = packing.digest(packing.pack(edge.documents(spark, rows).repartition(parts), BYTE, size=64))
        assert brute.pieces_hold([r.asDict() for r in pieces.collect()], [r[:2] for r in rows], _ids(BYTE), size=64)
    # repeated rows and null ids: every row's ids are there
    out = packing.pack(edge.documents(spark), BYTE)
    assert out.agg(F.sum("length")).first()[0] == sum(len(_ids(BYTE)(t)) + 1 for _, t, _ in edge.texts())
    assert packing.pack(edge.documents(spark, []), BYTE).count() == 0


def test_rank_encoder_equals_the_tokenizer():
    bpe, ids, rng = byte_bpe.ByteBpe(BYTE), _ids(BYTE), random.Random(1)
    assert bpe.ranks is not None
    for _ in range(3000):
        text = "".join(rng.choice(" \n\tab'sre1!éß<|endoftext|> 漢\x85́") for _ in range(rng.randint(0, 24)))
        assert bpe.encode(text).tolist() == ids(text), text
    assert byte_bpe.ByteBpe(WORD).ranks is None


def test_very_long_white_space():
    """Runs at which the rank encoder's pattern engine gives up go to the tokenizers library."""
    bpe, ids = byte_bpe.ByteBpe(BYTE), _ids(BYTE)
    for text in (" " * 1_000_000 + "a", "a" + "\n" * 1_000_000 + "a", "a" + " \n" * 500_000, " " * 100_000 + "a", " " * 100_001 + "a"):
        assert bpe.encode(text).tolist() == ids(text)


# ----------------------------------------------------------------------- BPE

def _encoded(text, tokenizer):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    return len(ids), " ".join(map(str, ids)), tokenizer.decode(ids, skip_special_tokens=False)


def test_bpe_on_edges(spark):
    tokenizer = Tokenizer.from_file(WORD)
    want = edge.sort([(d, *_encoded(t, tokenizer)) for d, t, _ in edge.texts()])
    for leaf in (word_bpe.LEAF, 50):
        out = word_bpe.encode_decode(edge.documents(spark), WORD, leaf=leaf)
        assert edge.rows_of(out, "doc_id", "n_tokens", "ids", "decoded") == want
    assert word_bpe.encode_decode(edge.documents(spark, []), WORD).count() == 0


def test_bpe_query_equals_the_tokenizer(spark):
    tokenizer, texts = Tokenizer.from_file(WORD), dict(_sf("documents", "doc_id", "text"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in registry.op3_bpe(spark, SF).collect():
        n, ids, text = _encoded(texts[r["doc_id"]], tokenizer)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (n, sha(ids), sha(text))


def test_tree_concatenation_equals_encoding_the_whole():
    bpe, rng = word_bpe.WordBpe(WORD), random.Random(2)
    for _ in range(300):
        alphabet = rng.choice(["a", "ab", "theraino", "abcdefghijklmnop", "é", "thx"])
        run = "".join(rng.choice(alphabet) for _ in range(rng.randint(20, 900)))
        run = bpe.tokenizer.pre_tokenizer.pre_tokenize_str(run)[0][0]
        size = rng.choice([3, 7, 16, 50, 128])
        leaves = [(run[i:i + size], *bpe.encode_run(run[i:i + size])) for i in range(0, len(run), size)]
        text, ids, starts = word_bpe.tree(leaves, bpe.encode_run, rng.choice([2, 4, 16, 64]))
        whole = bpe.encode_run(run)
        assert text == run and ids.tolist() == whole[0].tolist() and starts.tolist() == whole[1].tolist()


# ------------------------------------------------------------ language model

def test_lm_base_scores_equal_brute_force(spark):
    want = brute.unigram(_sf("documents", "doc_id", "text"))
    for r in registry.op5_lm_score(spark, SF).collect():
        held, n, known, train, base = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, train)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] < 0


def test_lm_on_edges(spark):
    """Repeated rows, null ids and small blocks; a score per row, the same however blocks are cut."""
    rows = [(i, t, lang) for i, (_, t, lang) in enumerate(edge.texts())]
    want = brute.unigram([r[:2] for r in rows])
    docs = edge.documents(spark, rows).coalesce(1)
    for block in (200, 1 << 20):
        out = lm_score.score(docs, BYTE, block_bytes=block, train_share=1, rounds=1).collect()
        assert len(out) == len(rows)
        for r in out:
            assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == want[r["doc_id"]][:4]
            assert r["base_score"] == pytest.approx(want[r["doc_id"]][4], rel=1e-9)
    assert lm_score.score(edge.documents(spark), BYTE, rounds=0).count() == len(rows)
    assert lm_score.score(edge.documents(spark, []), BYTE, rounds=1).count() == 0


def test_lm_trains_on_every_training_document(spark, monkeypatch):
    """The rounds together step once over each token of every document that is not
    held out, also where documents are cut into pieces."""
    monkeypatch.setattr(lm_score, "PIECE", 64)
    blocks = lm_score.blocks_of(spark.read.parquet(f"{SF}/documents.parquet"), BYTE).where("word IS NULL").drop("word", "place", "n")
    rows = [r.asDict(recursive=True) for r in blocks.collect()]
    want = sum(len(ids) + 1 for r in rows for m, _, ids in lm_score._documents(r) if not m["held"])
    k = attention_lm.CLASSES
    of, bigram = np.zeros(1 << 16, np.uint8), attention_lm.bigram_logits(np.zeros((k, k)))
    pieces = [r.asDict() for r in lm_score.sequences_of(blocks, of).collect()]
    assert max(len(p["classes"]) for p in pieces) == 64
    got = [lm_score.trained([p for p in pieces if p["turn"] == r], r, attention_lm.start_params(), bigram)[-1]
           for r in range(lm_score.ROUNDS)]
    assert sum(got) == want and min(got) > 0


def test_lm_scores_do_not_depend_on_partitions(spark, monkeypatch):
    """One partition or eight, one block or many, several trainers, and sums by tree: the same scores."""
    monkeypatch.setattr(lm_score, "SHARD", 1 << 13)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one = {r["doc_id"]: r for r in lm_score.score(docs.coalesce(1), BYTE).collect()}
    monkeypatch.setattr(lm_score, "SUMS", 3)
    eight = lm_score.score(docs.repartition(8), BYTE, block_bytes=1 << 15).collect()
    assert len(eight) == len(one)
    for r in eight:
        assert abs(r["score"] - one[r["doc_id"]]["score"]) / r["n_tokens"] < 1e-3


def test_lm_pieces_are_windows_of_the_whole():
    """A document in pieces gives the windows, context included, of the whole document."""
    rng = np.random.default_rng(8)
    for size in (0, 1, 63, 64, 65, 128, 200):
        x = rng.integers(0, attention_lm.CLASSES - 1, size)
        pieces = [(x[max(0, i - attention_lm.BLOCK - 1):i], x[i:i + 64], i + 64 >= size) for i in range(0, max(1, size), 64)]
        whole, cut = attention_lm.windows([x]), attention_lm.windows(pieces)
        real = whole[3]
        assert (cut[3] == real).all() and (cut[1] == whole[1]).all()
        assert (cut[2][real] == whole[2][real]).all()
        seen = np.concatenate([np.repeat(whole[1][:, None], attention_lm.BLOCK, axis=1), real], axis=1)
        assert (cut[0][seen] == whole[0][seen]).all()


def test_lm_context_and_mixture():
    """A score depends on a token more than 15 back; each share in ``MIXES`` gives its own mixture."""
    rng = np.random.default_rng(5)
    params = attention_lm.start_params()
    params["U"] = rng.standard_normal(params["U"].shape).astype(np.float32)
    k = attention_lm.CLASSES
    bigram, of = np.zeros((k, k), np.float32), np.arange(200, dtype=np.uint8) % (k - 1)
    a = np.arange(40, dtype="<u2")
    b = a.copy()
    b[14] = 99
    share, words, unigram = np.zeros(200), np.arange(40), rng.random(41)
    last = [lm_score.lm.log_probs(params, bigram, *lm_score.lm.windows([of[x].astype(np.int64)])[:3]).ravel()[31] for x in (a, b)]
    assert last[0] != last[1]
    (got, left_out), = lm_score._model_scores([(a, words, unigram, None)], params, bigram, of, share)
    w = attention_lm.windows([of[a].astype(np.int64)])
    p = np.exp(attention_lm.log_probs(params, bigram, *w[:3])[w[3]].astype(np.float64))
    assert left_out is None and got == pytest.approx([np.log10(x * p + (1 - x) * unigram).sum() for x in lm_score.MIXES])


def test_lm_mixtures_of_a_group_are_those_of_each_document():
    """Documents scored together, with and without words, longer and shorter than ``PRODUCT``, held out or not."""
    rng = np.random.default_rng(9)
    words = np.array([1, 40, lm_score.PRODUCT, 1, lm_score.PRODUCT + 1])
    cuts = np.append(0, np.cumsum(words))
    p, u = rng.random(cuts[-1]), rng.random(cuts[-1])
    got = lm_score._mixtures(p, [u[a:b] for a, b in zip(cuts, cuts[1:])], words)
    assert got == [pytest.approx([np.log10(x * p[a:b] + (1 - x) * u[a:b]).sum() for x in lm_score.MIXES]) for a, b in zip(cuts, cuts[1:])]
    assert lm_score._mixtures(p[:0], [], words[:0]) == []
    k = attention_lm.CLASSES
    of, share, params, bigram = np.arange(200, dtype=np.uint8), rng.random(200), attention_lm.start_params(), np.zeros((k, k), np.float32)
    docs = []
    for i, n in enumerate((0, 40, 3, 0)):
        unigram = rng.random(len(range(0, n, 3)) + 1)
        docs.append((rng.integers(0, 200, n).astype("<u2"), np.arange(0, n, 3), unigram, None if i % 2 else unigram / 2))
    together = lm_score._model_scores(docs, params, bigram, of, share)
    for own, doc in zip(together, docs):
        (alone,) = lm_score._model_scores([doc], params, bigram, of, share)
        assert own[0] == pytest.approx(alone[0], rel=1e-5) and (own[1] is None) == (doc[3] is None) == (alone[1] is None)
        assert own[1] is None or own[1] == pytest.approx(alone[1], rel=1e-5)


def test_lm_words_are_counted_in_one_exchange(spark):
    rng = np.random.default_rng(2)
    rows = [(f"{b}", f"w{w}".encode(), i, int(rng.integers(0, 3) * (w != 7))) for b in range(9) for i, w in enumerate(rng.permutation(30)[:20])]
    total = Counter()
    for _, w, _, n in rows:
        total[w] += n
    counted = lm_score.counts_of(spark.createDataFrame(rows, "block string, word binary, place int, n long"))
    assert counted._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = counted.collect()
    assert sorted((r["block"], r["place"], r["c"]) for r in got) == sorted((b, i, total[w]) for b, w, i, _ in rows if total[w])
    assert sorted(r["c"] for r in got if r["first"]) == sorted(n for n in total.values() if n)


def test_lm_words_are_cut_and_numbered_as_bytes_are():
    """Any ASCII white space cuts, no other does; A-Z only are lower-cased; numbers follow first occurrence, also over batches."""
    rng = random.Random(3)
    texts = [f"a{chr(i)}B" for i in range(0x300)] + ["", " ", "\n\tX\x0b\x0c\u00c0 \u0130\r", "A\x1cB\x85 \u2003c"]
    texts += ["".join(rng.choice(" \t\n\x0b\x0c\r\x1c\x00aBb\u00c0\u00a0") for _ in range(rng.randint(0, 12))) for _ in range(500)]
    for column in (pa.array(texts), pa.array(texts).slice(40, 700), pa.array([""]), pa.array(texts).slice(0, 0)):
        want = [t.encode().lower().split() for t in column.to_pylist()]
        words, lengths = lm_score.words_of(column)
        assert [w.encode() for w in words.to_pylist()] == sum(want, []) and lengths.tolist() == [len(w) for w in want]
        assert words.dictionary.to_pylist() == list(dict.fromkeys(w.decode() for w in sum(want, [])))


def test_lm_documents_of_a_block(monkeypatch):
    """Subwords put together for many documents at once, and for a long one in parts."""
    monkeypatch.setattr(lm_score, "WORDS", 8)
    rng = np.random.default_rng(4)
    coded = [rng.integers(0, 1 << 16, n).astype("<u2") for n in rng.integers(0, 5, 30)]
    lengths = [0, 3, 40, 0, 7, 8, 9, 1, 0]
    places = rng.integers(0, 30, sum(lengths))
    ends = np.cumsum([2 * len(c) for c in coded])
    row = {"ids": [{"length": n, "held": i % 3 == 1} for i, n in enumerate(lengths)]} | {
        c: lm_score._packed(x.tobytes()) for c, x in (("places", places.astype("<u4")), ("ends", ends.astype("<u4")), ("subwords", np.concatenate(coded)))}
    cuts = np.cumsum([0, *lengths])
    for wanted in (lambda m: True, lambda m: not m["held"], lambda m: False):
        got = list(lm_score._documents(row, wanted))
        want = [places[a:b] for m, a, b in zip(row["ids"], cuts, cuts[1:]) if wanted(m)]
        assert [own.tolist() for _, own, _ in got] == [w.tolist() for w in want]
        assert [ids.tolist() for *_, ids in got] == [[x for w in own for x in coded[w].tolist()] for own in want]


def test_attention_gradients_and_scores():
    """Analytic gradients equal differences; scoring equals the training forward
    pass; every token is scored once whatever the document's length."""
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, attention_lm.CLASSES - 1, n) for n in (0, 5, 15, 16, 17, 100)]
    params = {k: v.astype(np.float64) for k, v in attention_lm.start_params().items()}
    params["U"] = rng.standard_normal(params["U"].shape) * 0.3
    bigram = attention_lm.bigram_logits(rng.random((attention_lm.CLASSES,) * 2) * 5).astype(np.float64)
    inputs, has, target, real, document = attention_lm.windows(docs)
    assert np.bincount(document, real.sum(axis=1)).tolist() == [len(d) + 1 for d in docs]
    loss, g = attention_lm.gradients(params, bigram, inputs, has, target, real)
    logs = attention_lm.log_probs({k: v.astype(np.float32) for k, v in params.items()}, bigram.astype(np.float32),
                                  inputs, has, target)
    assert -(logs * real).sum() / real.sum() == pytest.approx(loss, rel=1e-4)
    for name in attention_lm.SHAPES:
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        ends = []
        for step in (1e-5, -1e-5):
            params[name][at] += step
            ends.append(attention_lm.gradients(params, bigram, inputs, has, target, real)[0])
            params[name][at] -= step
        assert (ends[0] - ends[1]) / 2e-5 == pytest.approx(g[name][at], rel=1e-3, abs=1e-7), name
    # causal: a later token changes no earlier score
    other = [d.copy() for d in docs]
    other[-1][60] = (other[-1][60] + 1) % (attention_lm.CLASSES - 1)
    flat = lambda x: (lambda w: attention_lm.log_probs({k: v.astype(np.float32) for k, v in params.items()},
                                                       bigram.astype(np.float32), *w[:3])[w[3]][-101:])(attention_lm.windows(x))
    a, b = flat(docs), flat(other)
    assert np.allclose(a[:60], b[:60]) and not np.allclose(a[60:], b[60:])


def test_training_lowers_held_out_loss():
    """A pattern two steps back, which the bigram table cannot hold."""
    rng = np.random.default_rng(3)

    def text():
        x = list(rng.integers(0, 12, 2))
        for _ in range(120):
            x.append((x[-2] + 1) % 12 if rng.random() < 0.9 else int(rng.integers(0, 12)))
        return np.array(x)

    train, held = [text() for _ in range(150)], [text() for _ in range(20)]
    k = attention_lm.CLASSES
    pairs = np.zeros((k, k))
    for t in train:
        np.add.at(pairs, (t[:-1], t[1:]), 1)
    bigram = attention_lm.bigram_logits(pairs)
    trainer = attention_lm.Trainer(attention_lm.start_params(), bigram)
    loss = lambda p: (lambda w: -(attention_lm.log_probs(p, bigram, *w[:3]) * w[3]).sum() / w[3].sum())(
        attention_lm.windows(held))
    before = loss(trainer.params)
    for _ in range(20):
        trainer.feed(train)
    assert loss(trainer.params) < 0.75 * before


# ---------------------------------------------------------------------- WARC

def test_warc_query_equals_brute_force(spark):
    want = brute.warc(_sf("pages", "page_id", "html"))
    rows = registry.op7_warc(spark, SF).collect()
    assert len(rows) == len(want)
    for r in rows:
        assert want[r["page_id"]] == (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])
    order = [(r["url_key"], r["captured"], r["page_id"]) for r in sorted(rows, key=lambda r: (r["segment"], r["segment_row"]))]
    assert order == sorted(order)


def test_warc_on_edges(spark, scratch):
    rows = [(1, "http://a.b/x", None), (2, "HTTP://A.b:8080/x?q=é", ""), (3, None, "p\r\n\r\nWARC/1.1\r\nContent-Length: 9\r\n\r\n"),
            (4, "http://a.b/x\r\nInjected: 1", "p" * 200_000), (5, "http://a.b/x", "p" * 200_000), (None, "http://a.b/y", "é\0\U0001f600"),
            (6, "http://[broken", "é\0\U0001f600"), (7, "http://a.b/x", "once\r\n"), (7, "http://a.b/x", "once\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha", F.lit("clash"))
    path = f"{scratch}/warc"
    out = warc.round_trip(pages, path=path)
    got = edge.rows_of(out, "page_id", "url", "payload_bytes", "record_type", "refers_to")
    assert [(g[0], *g[2:]) for g in got] == [
        (None, 7, "revisit", 6), (1, 0, "response", None), (2, 0, "revisit", 1), (3, len(rows[2][2]), "response", None),
        (4, 200_000, "response", None), (5, 200_000, "revisit", 4), (6, 7, "response", None), (7, 6, "response", None),
        (7, 6, "response", None)]
    # the files are archives: header lines, then blocks of the lengths they state
    records = []
    for f in spark.read.format("binaryFile").load(path).collect():
        records += list(warc.parse(gzip.open(__import__("io").BytesIO(bytes(f["content"])))))
    assert len(records) == len(rows) and all(h["WARC-Type"] in ("response", "revisit") for _, h, _ in records)
    small = warc.round_trip(pages, revisit_from=7)
    assert small.filter("record_type = 'revisit'").count() == 2
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_loser_tree_merges_any_number_of_runs():
    rng = random.Random(1)
    for n in range(9):
        runs = [sorted((rng.randint(0, 9), rng.random()) for _ in range(rng.randint(0, 12))) for _ in range(n)]
        assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_many_archives_merge_into_one_order(spark):
    pages = spark.range(500).select(
        F.col("id").alias("page_id"), F.concat(F.lit("http://h"), (F.col("id") % 3).cast("string"), F.lit(".org/p")).alias("url"),
        F.concat(F.lit("text "), (F.col("id") % 50).cast("string")).alias("html")).repartition(9)
    rows = warc.capture_history(common.materialize(warc.read(spark, _written(spark, pages)), "t"), 5).collect()
    order = [(r["url_key"], r["captured"], r["page_id"]) for r in sorted(rows, key=lambda r: (r["segment"], r["segment_row"]))]
    assert len(order) == 500 and order == sorted(order) and len({r["archive"] for r in rows}) > 5


def test_history_counts_a_url_over_all_its_ranges(spark, monkeypatch):
    # one URL with most captures, captures that share time and id, and URLs of one capture
    urls = F.when(F.col("id") % 10 == 0, F.concat(F.lit("http://z.org/"), F.col("id").cast("string"))).otherwise(F.lit("http://hot.org/"))
    pages = spark.range(600).select((F.col("id") % 400).alias("page_id"), urls.alias("url"), F.col("id").cast("string").alias("html"))
    pages = pages.unionByName(pages.limit(3)).repartition(7)
    monkeypatch.setattr(warc, "RANGE", 20)
    monkeypatch.setattr(warc, "SLICE", 7)
    rows = warc.capture_history(common.materialize(warc.read(spark, _written(spark, pages)), "t")).collect()
    rows.sort(key=lambda r: (r["segment"], r["segment_row"]))
    assert len(rows) == 603 and len({r["segment"] for r in rows}) > 10
    order = [(r["url_key"], r["captured"], r["page_id"], r["archive"], r["position"]) for r in rows]
    assert order == sorted(order)
    seen: dict = {}
    for r in rows:
        assert r["history_row"] == seen.get(r["url_key"], 0)
        seen[r["url_key"]] = r["history_row"] + 1
    assert max(seen.values()) > 500


def test_archives_are_bounded_by_bytes(spark):
    pages = spark.range(400).select(F.col("id").alias("page_id"), F.lit("http://a.org/").alias("url"),
                                    F.repeat(F.lit("x"), F.when(F.col("id") % 100 == 7, 90_000).otherwise(1000).cast("int")).alias("html"))
    path = common.fresh_path(spark, "warc-test")
    warc.write(pages.coalesce(1), path, revisit_from=1 << 30, bundle=10_000, bundles=4)
    sizes = [len(gzip.decompress(bytes(f["content"]))) for f in spark.read.format("binaryFile").load(path).collect()]
    # four bundles of 10,000 bytes and their last records, a long one in one of them
    assert len(sizes) > 8 and max(sizes) < 4 * 16_000 + 90_000
    rows = warc.read(spark, path).collect()
    assert sorted(r["page_id"] for r in rows) == list(range(400))
    assert {r["page_id"] for r in rows if r["payload_bytes"] == 90_000} == {7, 107, 207, 307}


def _written(spark, pages):
    path = common.fresh_path(spark, "warc-test")
    warc.write(pages, path)
    return path


# ---------------------------------------------------------- near duplicates

def test_simhash_query_equals_brute_force(spark):
    want = brute.simhash_components(_sf("documents", "doc_id", "text"))
    for r in registry.op9_simhash_dedup(spark, SF).collect():
        assert want[r["doc_id"]] == (r["fingerprint"], r["component_id"])


def test_simhash_on_edges(spark):
    out = simhash_dedup.near_duplicates(edge.documents(spark)).collect()
    assert len(out) == len(edge.texts())
    want = edge.sort([(d, brute.simhash(t)) for d, t, _ in edge.texts()])
    assert edge.sort([(r["doc_id"], r["_fp"] % 2 ** 64) for r in out]) == want
    # the component of a null id is that of its text
    by_fp = {r["_fp"] % 2 ** 64: r["component_id"] for r in out}
    assert by_fp[brute.simhash(None)] == 1
    f = np.array([w[1] for w in want], dtype=np.uint64)
    label = brute.components(len(f), lambda i: np.bitwise_count(f ^ f[i]) <= 4)
    for k in set(label):
        ids = {by_fp[int(f[i])] for i in np.flatnonzero(label == k)}
        assert ids == {min((want[i][0] for i in np.flatnonzero(label == k) if want[i][0] is not None), default=None)}
    assert simhash_dedup.near_duplicates(edge.documents(spark, [])).count() == 0


@pytest.mark.parametrize("shard_rows", [3, 8192])
def test_simhash_links_of_random_fingerprints(spark, shard_rows):
    """Dense groups, chains and equal blocks; split shards give the same components."""
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 2 ** 63, 40, dtype=np.uint64)
    fps = [int(c) for c in centres]
    for c in centres[:12]:
        x = int(c)
        for _ in range(25):
            for b in rng.choice(64, rng.integers(1, 6), replace=False):
                x ^= 1 << int(b)
            fps.append(x)
    fps = np.unique(np.array([f % 2 ** 64 for f in fps], dtype=np.uint64))
    edges = simhash_dedup.link_edges(spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "_fp long"), 4, shard_rows)
    found = {r["node"]: r["component"] for r in common.connected_components(edges).collect()}
    label = brute.components(len(fps), lambda i: np.bitwise_count(fps ^ fps[i]) <= 4)
    signed = fps.view(np.int64)
    for k in set(label):
        own = signed[label == k]
        assert {found.get(int(x), int(x)) for x in own} == {int(own.min())}


def test_bk_forest_equals_inserting_one_by_one():
    rng = np.random.default_rng(2)
    fps = rng.integers(0, 64, 300).astype(np.uint64) ** np.uint64(3)
    group = rng.integers(0, 4, 300)
    forest = simhash_dedup.Forest(fps, group)
    for g in range(4):
        rows = np.flatnonzero(group == g)
        children: dict[int, dict[int, int]] = {}
        for i in rows[1:]:
            at = rows[0]
            while True:
                d = int(fps[i] ^ fps[at]).bit_count()
                if d not in children.setdefault(int(at), {}):
                    children[int(at)][d] = int(i)
                    break
                at = children[int(at)][d]
            assert (forest.parent[i], forest.edge[i]) == (at, d)


def test_keep_first_keeps_one_of_each_component(spark):
    docs = edge.documents(spark)
    out = simhash_dedup.keep_first(docs)
    assert out.columns == docs.columns
    marked = simhash_dedup.near_duplicates(docs).collect()
    assert out.count() == len({(r["component_id"]) for r in marked})
    assert {r["doc_id"] for r in out.collect()} == {r["component_id"] for r in marked}
    nulls = edge.documents(spark, [(None, "same text here again", "en"), (None, "same text here again", "de"), (None, "same text here again", "de")])
    assert simhash_dedup.keep_first(nulls).count() == 1


def _vector_truth(rows, threshold=0.95):
    good = [i for i, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and any(v)]
    links = np.zeros((len(rows), len(rows)), bool)
    for i in good:
        for j in good:
            if i != j and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                links[i, j] = a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold
    label = brute.components(len(rows), lambda i: links[i])
    least = {k: min((rows[i][0] for i in np.flatnonzero(label == k) if rows[i][0] is not None), default=None) for k in set(label)}
    return edge.sort([(rows[i][0], int(links[i].sum()), least[label[i]]) for i in range(len(rows))])


@pytest.mark.parametrize("cell_rows", [4, 2048])
def test_embedding_links_equal_brute_force(spark, cell_rows):
    rng = np.random.default_rng(1)
    rows, n = [], 0
    for _ in range(30):
        centre = rng.standard_normal(64)
        for _ in range(rng.integers(1, 12)):
            rows.append((n, (centre + rng.standard_normal(64) * rng.choice([0.0, 0.1, 0.25])).tolist()))
            n += 1
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = embedding_dedup.near_duplicates(vectors, cell_rows=cell_rows)
    assert edge.rows_of(out, "id", "n_links", "component_id") == _vector_truth(rows)


def test_embedding_layout_holds_its_recall(spark):
    for rows in (0, 1, 10 ** 4, 10 ** 8, 10 ** 9, 10 ** 12):
        tables, bits = embedding_dedup.layout(rows)
        agrees = (1 - np.arccos(0.95) / np.pi) ** bits
        assert 1 - (1 - agrees) ** tables >= 0.9975 and rows / 2 ** bits <= embedding_dedup.BUCKET_ROWS
    assert embedding_dedup.layout(10 ** 6, 1.0)[0] >= 1
    # measured, at the layout of a billion rows: pairs right above the threshold
    rng, rows = np.random.default_rng(5), []
    for i in range(600):
        a, b = rng.standard_normal((2, 96))
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        rows += [(2 * i, a.tolist()), (2 * i + 1, (0.951 * a + (1 - 0.951 ** 2) ** 0.5 * b).tolist())]
    tables, bits = embedding_dedup.layout(10 ** 9)
    out = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), tables=tables, bits=bits)
    assert out.filter("n_links = 1 AND component_id = id - id % 2").count() >= 0.99 * len(rows)


def test_embeddings_on_edges(spark):
    v, nan, inf = [1.0, 2.0, 3.0], float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0, 0.0]), (4, [1.0, None, 3.0]), (5, [1.0, nan, 3.0]), (6, [1.0, inf, 3.0]),
            (7, v), (8, v), (8, v), (9, [2.0, 4.0, 6.0]), (None, v), (10, [1.0, 2.0]), (11, [1e300, 2e300, 3e300]),
            (12, [-1.0, -2.0, -3.0]), (13, [1e-200, 2e-200, 3e-200])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns(
        {"name": F.lit("clash"), "signature": F.lit(1)})
    got = edge.rows_of(embedding_dedup.near_duplicates(vectors), "id", "n_links", "component_id")
    bad = [(i, 0, i) for i in (1, 2, 3, 4, 5, 6, 10, 12)]
    assert got == edge.sort(bad + [(i, 6, 7) for i in (7, 8, 8, 9, None, 11, 13)])
    assert embedding_dedup.near_duplicates(vectors.limit(0)).count() == 0


def test_components_of_paths_stars_and_loops(spark):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1100)] + [(5000, 5000), (None, 7), (7, None)]
    edges += [(6000 + rng.randint(0, 99), 6000 + rng.randint(0, 99)) for _ in range(60)] + edges[:20]
    rng.shuffle(edges)
    found = {r["node"]: r["component"] for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(201)) and all(found[i] == 1000 for i in range(1000, 1100)) and 5000 not in found
    label: dict[int, int] = {}
    for _ in range(100):
        for a, b in edges:
            if a is not None and b is not None and a >= 6000:
                label[a] = label[b] = min(label.get(a, a), label.get(b, b))
    assert all(found[x] == y for x, y in label.items() if x in found)
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_word_cache_is_bounded_by_characters(monkeypatch):
    """Long words go with their batch, many short ones with their generation; every batch finds its own."""
    monkeypatch.setattr(word_bpe, "CACHE_CHARS", 4000)
    bpe, ids, rng = word_bpe.WordBpe(WORD), _ids(WORD), random.Random(2)
    for _ in range(60):
        words = {"".join(rng.choice("abcdé漢") for _ in range(rng.choice([1, 3, 8, 70, 500]))) for _ in range(40)}
        pieces = {w for w in words if not word_bpe.OTHER.search(w)}
        bpe.learn(words - pieces, pieces)
        for w in words:
            assert bpe.words[w][0] == " ".join(map(str, ids(w)))
        assert sum(len(w) for w in bpe.words if len(w) <= word_bpe.CACHE_LENGTH) <= 4000
        assert sum(len(w) for w in bpe.older) <= 4000 + 40 * 500
        assert len([w for w in bpe.words if len(w) > word_bpe.CACHE_LENGTH]) <= 40
