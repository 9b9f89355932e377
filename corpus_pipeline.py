"""The corpus pipeline: quality, near duplicates, benchmark passages, personal data, tokens.

Each stage reads all rows that the one before kept, and all but the last give back the columns
of the documents table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sitehazard.llm import bpe, decontaminate, jaccard_join, pii, quality_rules
from sitehazard.llm.common import importable
from sitehazard.session import shared_path, tune

#: For the shared test tables; a job passes its own secret.
KEY = "key of the test pipeline"
#: Words whose ids a task of the last stage remembers: few, beside what earlier stages hold.
REMEMBERED = 100_000
#: Near duplicates: words in a shingle, and the least similarity in hundredths.
SHINGLE, SIMILAR = 5, 80


def small_batches(spark: SparkSession) -> None:
    """Whole documents go to Python workers by a few MB at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighed quality rules keep."""
    return quality_rules.keep_good(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near duplicates."""
    small_batches(spark)
    return jaccard_join.first_of_each(docs, percent=SIMILAR, shingle=SHINGLE)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no ten words in a row with a benchmark item."""
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def under_pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal numbers, dates and addresses replaced in the text."""
    return pii.rewrite(docs, KEY)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the digest of their round trip."""
    small_batches(spark)
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    rows = bpe.encode_decode(docs, vocabulary, docs.columns, remember=REMEMBERED)
    return rows.drop("text", "decoded")


STAGES = [
    ("quality_rules", good_documents),
    ("jaccard_join", one_of_each_group),
    ("decontamination", without_benchmarks),
    ("pii", under_pseudonyms),
    ("bpe", encoded),
]
#: Not expressible: the votes' weights are fitted in rounds, groups are closed transitively, and
#: merges depend on each other.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each writes Parquet that the next one reads."""
    docs = importable(tune(spark)).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
