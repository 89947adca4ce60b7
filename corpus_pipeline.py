"""A corpus pipeline of five stages; each stage's documents are written as Parquet and read again by the next.

Stages take (spark, docs, sf_dir). They handle null and empty texts, null ids, repeated rows, empty tables and extra
columns as their operators' docstrings say.
"""

from pyspark.sql import DataFrame, SparkSession

from curatrix.llm import near_dedup, phrase_automata, poisson_mix, quality_rules, sentencepiece_codec
from curatrix.llm.common import spill

STAGES = [
    ("quality_rules", quality_rules.stage),
    ("near_dedup", near_dedup.stage),
    ("substring_dedup", phrase_automata.stage),
    ("mixing", poisson_mix.stage),
    ("sentencepiece", sentencepiece_codec.stage),
]

#: ProbMinHash classes and automata can't be told in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = spill(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
