"""The registered queries of this subpackage: each operator over whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import (
    ann_partitions,
    embedding_dedup,
    importance,
    license_scan,
    lm_score,
    packing,
    pii,
    quality_rules,
    secret_scan,
    simhash_dedup,
    spelling_variants,
    warc,
    word_bpe,
)
from inkwell.llm.common import fresh_path


def tokenizer_file(name: str) -> str:
    """Path of a public vocabulary file, installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    # two scans through one written ledger: the second runs only the rules that the
    # first did not, and finds the others' spans in the ledger
    docs, ledger = _read(spark, sf_dir, "documents"), fresh_path(spark, "secret-ledger")
    secret_scan.rescan(docs, ledger, rules=secret_scan.BASE_RULES)
    findings = secret_scan.rescan(docs, ledger)
    spans = F.col("spans")
    of = lambda kind: F.size(F.filter(spans, lambda s: s["rule"] == f"{kind}@1")).cast("long")
    base = F.filter(spans, lambda s: s["rank"] < len(secret_scan.BASE_RULES))
    return findings.select(
        F.col("path").alias("doc_id"), of("assign").alias("n_assign"), of("access").alias("n_access"),
        of("hex").alias("n_hex"), F.sha2(secret_scan.span_text(base), 256).alias("base_sha256"),
        secret_scan.span_text(spans).alias("spans"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(_read(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json")))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = word_bpe.encode_decode(_read(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), digests=True)
    return found.select("doc_id", "n_tokens", F.col("ids").alias("ids_sha256"), F.col("decoded").alias("decoded_sha256"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_read(spark, sf_dir, "documents"))
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["base"])
    text = lambda x: F.concat_ws(",", F.transform(x, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    n = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *map(n, pii.KINDS),
        F.sha2(text(base), 256).alias("base_sha256"), text(spans).alias("spans"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(_read(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_read(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.round_trip(_read(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured",
                        "segment", "segment_row", "history_row")


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embedding_dedup.near_duplicates(_read(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id",
                        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return judged.select("doc_id", *[F.col(f"_q.{c}") for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], "base_failed", "kept")


def op11_ann_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_partitions.search(_read(spark, sf_dir, "embeddings"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.group(_read(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank", "n_words")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_secret_scan, op2_packing, op3_bpe, op4_pii, op5_lm_score, op6_license_scan, op7_warc, op8_embedding_dedup, op9_simhash_dedup, op10_quality_rules, op11_ann_partitions,
        op12_spelling_variants, op13_importance_resampling)}


def oracle_sql() -> dict[str, str]:
    from inkwell.llm.oracles import SQL

    return dict(SQL)
