"""The corpus pipeline: quality, lines, near duplicates, benchmark items, packing.

``STAGES`` lists (name, function); each takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tallyspark.llm import decontaminate, line_dedup, ngram_join, packing, quality
from tallyspark.llm._shared import staged
from tallyspark.llm._tokens import vocabulary


def _pack(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", quality.keep_good),
    ("line_dedup", line_dedup.without_repeated_lines),
    ("ngram_jaccard_join", ngram_join.keep_one_of_each),
    ("benchmark_decontamination", decontaminate.keep_uncontaminated),
    ("packing", _pack),
]

# The classifier's scores and the byte-pair ids can't be expressed in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
