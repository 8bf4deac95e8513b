"""A training corpus in five stages: quality rules, near duplicates, repeated strings, mixing, packing.

Every stage gets all that its predecessor kept and writes Parquet; all but the last return the columns of
`documents`. A stage that cuts texts sets n_chars anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessella.llm import jaccard, mixing, packing, quality, suffix
from tessella.llm.stage import written


#: Repeated strings of so many bytes go: fewer than any passage of over 50 words has, unless its words have three letters on average.
PASSAGE_BYTES = 200


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that fail the base rules, or whose host is rejected, go."""
    return quality.accepted(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: one document of each component of near duplicates stays."""
    return jaccard.deduplicate(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: repeated strings are cut out; a document of which no word is left goes."""
    cut = suffix.cut(docs, length=PASSAGE_BYTES, gram=PASSAGE_BYTES // 4)
    had = F.col("text").rlike("[^\\x20\\x09-\\x0D]")
    return cut.where(F.coalesce(had, F.lit(False))).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: each document comes as often as the mix takes it."""
    return mixing.mixture(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: the pieces of all documents with their sequences and offsets."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("suffix-array dedup", suffix_array_dedup),
    ("mixing sources to target weights", source_mixing),
    ("packing", sequence_packing),
]

#: Neither the suffix-array stage nor the packing stage can be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
