"""The corpus pipeline against a brute-force version of its four stages."""

from __future__ import annotations

import brute
import edge
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from inkwell.llm import secret_scan

SF = "/root/testdata/sf0.001"


def _redacted(text):
    """Only the three base kinds occur in the test tables."""
    import re

    spans = []
    for kind, (pattern, flags, group, least) in brute.SECRET.items():
        spans += [m.span() for m in re.finditer(pattern, text, flags) if len(m[group]) >= least]
    out, at = "", 0
    for a, b in sorted(spans):
        if a >= at:
            out += text[at:a] + "[SECRET]"
        at = max(at, b)
    return out + text[at:]


def test_run_equals_brute_force(spark):
    docs = list(zip(*(pq.read_table(f"{SF}/documents.parquet").column(c).to_pylist() for c in ("doc_id", "text"))))
    # so few labels prove no cutoff: only the fixed rules reject
    kept = [(d, t) for d, t in docs if not brute.quality(t)["base_failed"]]
    groups = brute.simhash_components(kept)
    firsts = [(d, t) for d, t in kept if groups[d][1] == d]
    want = [(d, _redacted(t)) for d, t in firsts]
    assert len(want) < len(kept) < len(docs)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = [r.asDict() for r in corpus_pipeline.run(spark, SF).collect()]
    assert brute.pieces_hold(pieces, want, lambda t: tokenizer.encode(t, add_special_tokens=False).ids)


def test_stages_keep_columns_on_edges(spark):
    docs = edge.documents(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        empty = stage(spark, docs.limit(0), SF)
        assert empty.columns == docs.columns and empty.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), SF).count() == 0
    # a clean document comes through unchanged
    out = {r["doc_id"]: r["text"] for r in corpus_pipeline.secret_stage(spark, docs, SF).collect()}
    assert out[8] == dict((d, t) for d, t, _ in edge.texts())[8]


def test_stage_order_is_the_contract():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_dedup", "secret_scan", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None
    assert len({r.kind for r in secret_scan.RULES}) == len(secret_scan.RULES)


def test_shared_folder_is_the_one_the_session_names(spark):
    from types import SimpleNamespace

    from inkwell.llm import common

    def session(setting, master):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: setting), sparkContext=SimpleNamespace(master=master))

    assert common.shared_dir(session("hdfs:/named/by/cluster/", "yarn")) == "hdfs:/named/by/cluster"
    local = session(None, "local[2]")
    assert common.shared_dir(local) == common.shared_dir(local) != common.shared_dir(session(None, "local[2]"))
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            common.shared_dir(session(None, master))
    assert common.fresh_path(spark, "x") != common.fresh_path(spark, "x")
