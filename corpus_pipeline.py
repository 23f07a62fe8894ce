"""Corpus preparation: quality rules, near-duplicates, secrets, packing.

``STAGES`` lists the stages in order. Each function takes (spark, docs,
sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet in the
shared folder and gives it to the next stage. All stages but the last return
the columns of ``docs``.

1. ``quality_rules`` drops the documents that the fixed rules or a proven
   cutoff reject. Labels come from the ``labels`` table.
2. ``simhash_dedup`` keeps one document of each near-duplicate component: the
   one with the smallest id.
3. ``secret_scan`` replaces every secret in the text; no document goes.
4. ``packing`` cuts the remaining documents into training sequences.

Defined results: a null or empty text has no words and is rejected by stage 1;
a null id is kept like any other and represents its group only where the group
holds no other id; of repeated rows with equal text one stays; texts of any
length pass whole through every stage; an empty table, or one of which nothing
is kept, gives no sequences; further columns of ``docs``, also ones named like
those the operators use, come out of the first three stages as they went in.

``ORACLE_SQL`` is None: SQL can express neither the hashes of stage 2 nor the
tokenizer of stage 4. ``tests/llm/test_pipeline.py`` holds ``run`` against a
brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkwell.llm import packing, quality_rules, secret_scan, simhash_dedup
from inkwell.llm.common import materialize
from inkwell.llm.registry import tokenizer_file


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_dedup.keep_first(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(docs, tokenizer_file("byte_bpe_50k.json")))


STAGES = [
    ("quality_rules", quality_stage),
    ("simhash_dedup", near_duplicate_stage),
    ("secret_scan", secret_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
