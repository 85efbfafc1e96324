"""The corpus pipeline: five stages, each one operator, each over all its predecessor kept.

``STAGES`` lists (name, function); a function takes ``(spark, docs, sf_dir)`` and returns
a DataFrame. ``run`` writes each stage's result as Parquet in the shared folder and reads
it again as the next one's documents. All stages but the last return the columns of
documents; the last one the encoding digests.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from marquetry.llm.bpe import round_trip_digests
from marquetry.llm.mixing import mix_sources
from marquetry.llm.quality_bayes import keep_good
from marquetry.llm.simhash import keep_representatives
from marquetry.llm.tokenizer import default_path
from marquetry.llm.toxicity import drop_toxic
from marquetry.runtime import ensure_checkpoint_dir, read_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return keep_good(docs, read_table(spark, sf_dir, "labels"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose severity is none, most likely."""
    return drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id."""
    return keep_representatives(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target rate draws, in random order."""
    return mix_sources(docs, copy_col=None)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and decoded texts."""
    return round_trip_digests(docs, default_path())


STAGES = [
    ("quality", quality),
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("encoding", encoding),
]

#: The classifiers and the tokenizer can't be told in SQL; tests hold the stages against
#: brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``. A stage's table goes when the next one is
    written; the last one stays, as the result reads it."""
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if number:
            _remove(spark, f"{folder}/{number - 1}-{STAGES[number - 1][0]}")
    return docs


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
