"""A corpus pipeline in five stages, counted as part of lakeforge.llm.

Each stage takes what its predecessor kept, written as Parquet and read again.  All stages but the last return the
columns of documents.  Nulls, empty texts and empty tables are handled as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeforge.llm import op2_personal_data, op4_sentencepiece, op7_quality_classifier, op8_mixing, op10_near_duplicates
from lakeforge.llm._store import tuned, written
from lakeforge.session import ship

THRESHOLD = 0.7


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    ship(tuned(spark))
    model = op7_quality_classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return op7_quality_classifier.scored(docs, model).where(F.col("score") >= THRESHOLD).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least doc_id."""
    ship(tuned(spark))
    return op10_near_duplicates.deduplicated(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and what gives it away replaced; n_chars follows."""
    out = op2_personal_data.sanitised(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    out = op8_mixing.taken(docs, op8_mixing.plan(docs)).where("times > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), "times"))).select("row.*")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents with ids, n_tokens, and whether decoding gives the text back."""
    ship(tuned(spark))
    return op4_sentencepiece.tokenised(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixing", mixing), ("encoding", encoding)]
#: The classifier is learnt and the groups are found by hashing, which SQL can't express; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
