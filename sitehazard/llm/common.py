"""Helpers shared by the text operators: the documents table, words, and the settled folder."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from sitehazard.session import importable, settle

__all__ = [
    "WordHashes", "documents", "folded_words", "give_back", "importable", "named_as", "numbered", "placed", "settle",
    "table", "text_key",
]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD_GAP = "[ \\t-\\r]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def text_key(column: str = "text"):
    """A 64-bit key of a whole text; null reads as the empty text.

    Equal texts share a key. Two different texts share one with probability 2^-64 a pair.
    """
    return F.xxhash64(F.coalesce(F.col(column), F.lit("")))


def numbered(df: DataFrame) -> DataFrame:
    """The rows with columns c0, c1 and so on, so that no name meets one of an operator's own."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def named_as(df: DataFrame, names: list[str]) -> DataFrame:
    """The numbered columns under their names again, without any others."""
    return df.select(*(F.col(f"c{i}").alias(name) for i, name in enumerate(names)))


def placed(df: DataFrame) -> DataFrame:
    """The rows, numbered columns, and ``place``, which tells each row from all others.

    The place is the same in every job: the file's name and the row's number in it. Rows that don't
    come from files are written to the shared folder first.
    """
    place = F.concat_ws(":", "_metadata.file_path", "_metadata.row_index").alias("place")
    rows = numbered(df)
    try:
        if "_metadata" in df.columns:
            raise AnalysisException("the name is taken")
        rows.select(place)
    except AnalysisException:
        rows = settle(rows, "rows")
    return rows.select("*", place)


def give_back() -> None:
    """Return a worker's unused memory to the machine; the worker stays, for other work."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def folded_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z in lower case; none for null."""
    return text.encode("utf-8", "replace").lower().split() if text else []


class WordHashes(dict):
    """64-bit hashes of words, remembered. Cleared when full, which changes no result."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value
