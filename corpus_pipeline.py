"""The corpus pipeline: quality rules, near-duplicate removal, benchmark
decontamination, mixing to target weights, token files.

``run(spark, sf_dir)`` applies ``STAGES`` to ``documents``; every stage's result
is written to the shared folder and read back as the next one's input. All but
the last return rows with the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyroll.llm import decontaminate, jaccard_join, mixing, rules, token_files
from keyroll.llm.common import read, store
from keyroll.llm.queries import mix_domain, prepare, tokenizer_path

# The mix: nine tenths of the tokens the earlier stages keep, each document at
# most once; equal weights per domain, the languages by size.
TOTAL = "available * 9 div 10"
WEIGHTS = {"lang": {"en": 4, "de": 2, "fr": 2, "es": 1}, "source": {"src0": 8}}


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that the rules reject go."""
    prepare(spark)
    return rules.keep_passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: of each group of similar documents the smallest id stays."""
    prepare(spark)
    return jaccard_join.keep_one(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that hold a benchmark item go."""
    prepare(spark)
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark").select("item_id", "text"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents chosen for the target weights."""
    prepare(spark)
    return mixing.select_mix(docs, mix_domain(), F.expr(TOTAL), WEIGHTS).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: token files; returns what is read back from them."""
    prepare(spark)
    return token_files.read_files(token_files.write_files(docs, tokenizer_path()))


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("benchmark_leaks", benchmark_leaks),
          ("source_mix", mix), ("token_files", tokens)]

# The third stage (latent retrieval) and the tokenizer are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    prepare(spark)
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
