"""A corpus pipeline of five stages over ``documents``; each writes Parquet that the next one reads.

1. ``quality_rules``: documents that fail the rules, or whose host does, go.
2. ``near_duplicates``: one document of each group of near copies (five-word shingles, similarity 0.75) stays.
3. ``decontamination``: documents that hold a benchmark item go.
4. ``secret_scan``: secrets in the texts are replaced by a mark; all documents stay.
5. ``packing``: documents are tokenized and cut into sequences, one row each, with their token ids.

All but the last return the columns of ``documents``. Nulls, empty and repeated rows and empty tables have the
results that the operators' modules state.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from zeitband.llm import decontaminate, host_rules, jaccard, packing, secrets
from zeitband.llm.common import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return host_rules.keep_good(docs, host="source", reject_rate=0.5, block_rate=0.9)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs, k=5, percent=75)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.drop_leaking(docs, items, share=0.6, least_overlap=0.6)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_secrets(docs, mark="[secret]")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, longest=2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("packing", packed),
]

#: Shingle sets, retrieval and tokenization are beyond SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
