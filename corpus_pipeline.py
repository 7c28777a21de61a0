"""A corpus pipeline of the operators in ``orderlake.llm``.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last
keep the columns of ``documents``. ``run`` writes each stage as Parquet in the
shared folder and gives that to the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlake.llm import decontaminate, jaccard, langid, mixing, toxicity
from orderlake.llm.common import durable
from orderlake.shipping import ship


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a known language go."""
    ship(spark)
    return langid.keep_known(docs)


def clean_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    ship(spark)
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    ship(spark)
    return jaccard.keep_one(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a test item go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def weighted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    return mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken", F.col("epochs").cast("long").alias("epochs"))


STAGES = [
    ("language_id", language),
    ("toxicity", clean_language),
    ("near_duplicates", one_of_each),
    ("decontamination", no_benchmark),
    ("mixing", weighted),
]
#: The first three stages learn or search by hashing, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = durable(docs, f"pipeline-{name}")
    return docs
