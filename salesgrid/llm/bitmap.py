"""A filter of fixed size for 64-bit keys, to be broadcast."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch

MAX_BITS = 1 << 29         # 64 MB: the bound on what is built and broadcast
BITS_PER_KEY = 16
CHUNKS = 1 << 12           # rows at most that the driver is sent


class Bitmap:
    """Says yes to all of its keys and, the fuller it is, to some others.

    Tasks filter with it before they emit rows, so that a later exact join has
    less to do; with a full bitmap that join has more to do, with the same result.
    It is built by a distributed ``bit_or`` of 64-bit words, which tasks put together
    to at most ``CHUNKS`` chunks. The driver reads those a partition at a time, so that it
    holds the bits once and nothing for each key or word.
    """

    def __init__(self, keys: DataFrame, n: int):
        bits = 1 << int(np.clip(np.ceil(np.log2(max(n, 1) * BITS_PER_KEY)), 16, np.log2(MAX_BITS)))
        at = F.col("key").bitwiseAND(F.lit(bits - 1))
        bit = F.expr("shiftleft(1L, CAST(key & 63 AS INT))")
        table = keys.select(F.shiftright(at, 6).cast("int").alias("word"), bit.alias("bit")).groupBy("word") \
            .agg(F.bit_or("bit").alias("bits"))
        words = np.zeros(bits // 64, np.int64)
        size = max(1, len(words) // CHUNKS)
        chunks, path = scratch.write(table.repartition(F.expr(f"word div {size}")).mapInArrow(
            _chunks(size), "start long, words binary"), "bitmap")
        for chunk in chunks.toLocalIterator():
            words[chunk.start:chunk.start + size] = np.frombuffer(chunk.words, np.int64)
        scratch.remove(keys.sparkSession, path)
        self.mask = np.uint64(bits - 1)
        self.words = keys.sparkSession.sparkContext.broadcast(words.view(np.uint64))

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = keys & self.mask
        word = self.words.value[(at >> np.uint64(6)).astype(np.int64)]
        return (word >> (keys & np.uint64(63))) & np.uint64(1) == 1

    def release(self) -> None:
        """Let go of the bits in the driver and the executors, once all that filters with them is written."""
        self.words.destroy()


def _chunks(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(start, words): every ``size`` words of the bitmap, from (word, bits) rows dealt by chunk."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: dict[int, np.ndarray] = {}
        for batch in batches:
            word, bits = (batch.column(c).to_numpy() for c in ("word", "bits"))
            order = np.argsort(word, kind="stable")
            word, bits = word[order].astype(np.int64), bits[order]
            numbers, first = np.unique(word // size, return_index=True)
            for number, a, b in zip(numbers.tolist(), first, np.append(first[1:], len(word))):
                if number not in chunks:
                    chunks[number] = np.zeros(size, np.int64)
                chunks[number][word[a:b] - number * size] = bits[a:b]
        for number, chunk in chunks.items():
            yield pa.RecordBatch.from_arrays([pa.array([number * size], pa.int64()), pa.array([chunk.tobytes()])],
                                             names=["start", "words"])
    return run
