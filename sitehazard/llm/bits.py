"""A filter of fixed size over 64-bit values, built by Spark and broadcast to workers.

Its size is a parameter and doesn't grow with the data; a fuller filter only has more false
positives, which its users must be indifferent to.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

ODD = np.uint64(0x9E3779B97F4A7C15)


class BitFilter:
    def __init__(self, words: np.ndarray, power: int):
        self.words, self.power = words, power

    def __contains__(self, value: int) -> bool:
        return bool(self.has(np.array([value & 0xFFFFFFFFFFFFFFFF], np.uint64))[0])

    def has(self, values: np.ndarray) -> np.ndarray:
        found = np.ones(len(values), bool)
        for place in places(values, self.power):
            found &= (self.words[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
        return found


def places(values: np.ndarray, power: int) -> list[np.ndarray]:
    """Two bit positions of each value."""
    shift = np.uint64(64 - power)
    mixed = values * ODD
    return [mixed >> shift, ((mixed ^ (mixed >> np.uint64(29))) * ODD) >> shift]


def bit_filter(values: DataFrame, column: str, power: int = 25) -> BitFilter:
    """A filter of 2^power bits over a column of longs; at most 2^(power - 6) rows are collected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            place = np.unique(np.concatenate(places(raw, power)))
            word, start = np.unique(place >> np.uint64(6), return_index=True)
            bit = np.uint64(1) << (place & np.uint64(63))
            bits = np.bitwise_or.reduceat(bit, start) if len(place) else bit
            yield pa.RecordBatch.from_arrays(
                [pa.array(word.astype(np.int32)), pa.array(bits.view(np.int64))], ["word", "bits"]
            )

    parts = values.select(column).where(F.col(column).isNotNull())
    rows = (
        parts.mapInArrow(run, "word int, bits bigint")
        .groupBy("word")
        .agg(F.bit_or("bits").alias("bits"))
        .toArrow()
    )
    words = np.zeros(1 << (power - 6), np.uint64)
    words[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return BitFilter(words, power)
