"""A training corpus from ``documents``, stage by stage. Each stage reads what the one before it wrote.

What holds for every stage: an empty table gives an empty one; texts of any length are read whole; rows with
equal or null ids and repeated rows are rows of their own unless said otherwise; all but the last stage return
the columns that they got, whatever others there are and whatever they are called.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lexitally.llm import bpe
from lexitally.llm.mixing import mixed_documents
from lexitally.llm.near_copies import drop_near_copies
from lexitally.llm.quality_classifier import keep_graded, ratings_of, train
from lexitally.llm.quality_rules import keep_good
from lexitally.sources.workdir import written

#: A clean document lost weighs more than a toxic one kept.
TOP_GRADE, LEAST_TAIL = 2, 0.4
#: Rows with texts that go to Python at a time: ten times as many, Spark's default, take a hundred MB where texts are long.
ARROW_ROWS = "1000"


def _few_rows_at_a_time(spark: SparkSession) -> None:
    """For the session, as a stage's DataFrame is only run when it is written."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that probably have the top grade (good and not toxic) stay.

    Null and empty texts have no features and go by the thresholds alone; without labels all documents stay.
    """
    _few_rows_at_a_time(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return keep_graded(docs, train(docs, ratings_of(labels), TOP_GRADE), TOP_GRADE, LEAST_TAIL)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the risk-controlled ones stay.

    Null, empty and short texts go; null languages are one stratum; rules without enough labels are off.
    """
    _few_rows_at_a_time(spark)
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word Jaccard similarity of at least 0.8) stays.

    SimHash fingerprints and vantage-point shards (9) propose the closest pairs, an exact prefix filter those that no
    workable radius holds; texts confirm both. Of a group the smallest id stays, null ids last; repeated rows
    are a group, and so are all texts without words. Unrelated texts of one id both stay.
    """
    _few_rows_at_a_time(spark)
    return drop_near_copies(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: none, one, two or three times.

    Texts without words are never taken. Rows of one id share what is taken of them.
    """
    _few_rows_at_a_time(spark)
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each row; null and empty texts have no tokens."""
    _few_rows_at_a_time(spark)
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_classifier", classify),
    ("quality_rules", rules),
    ("simhash_near_dedup", near_dedup),
    ("mixing", mixture),
    ("byte_level_bpe", tokens),
]
#: Trained models and 64-bit hashes are beyond DuckDB's SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
