"""Sets of 64-bit keys as bitmaps of fixed size: what one pass over the texts tells the next."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumen.llm import textvec

#: Bits of a bitmap, 16 MB.
BITS = 27

U = np.uint64


def _spots(part: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of the bitmap for each (part, key)."""
    h = textvec.mix(key ^ (part.astype(U) + U(1)) * U(0x9E3779B97F4A7C15))
    return h >> U(64 - BITS), (h & U((1 << BITS) - 1))


class Bitmap:
    """A set of (part, 64-bit key) of fixed size that may hold too many, never too few."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def has(self, part: np.ndarray, key: np.ndarray) -> np.ndarray:
        a, b = _spots(part, key)
        one = (self.words[(a >> U(6)).astype(np.int64)] >> (a & U(63))) & (self.words[(b >> U(6)).astype(np.int64)] >> (b & U(63)))
        return (one & U(1)).astype(bool)


def bitmap(rows: DataFrame, part: str = "shard", key: str = "gram") -> Bitmap:
    """The bitmap of ``rows`` (part, key): bits are joined in the tasks and in Spark, 16 MB reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(1 << (BITS - 6), U)
        for batch in batches:
            parts, keys = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for spot in _spots(parts, keys.view(U)):
                np.bitwise_or.at(words, (spot >> U(6)).astype(np.int64), U(1) << (spot & U(63)))
        at = np.flatnonzero(words)
        for i in range(0, len(at), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(at[i:i + (1 << 16)].astype(np.int32)),
                                              pa.array(words[at[i:i + (1 << 16)]].view(np.int64))], ["at", "bits"])

    t = (rows.select(part, key).mapInArrow(run, "at int, bits long")
         .groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow())
    words = np.zeros(1 << (BITS - 6), U)
    words[t.column("at").to_numpy()] = t.column("bits").to_numpy().view(U)
    return Bitmap(words)
