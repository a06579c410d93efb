import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from salesgrid.llm import bitmap


def _has(built, keys):
    return built.has(np.array(keys, np.int64).view(np.uint64))


@pytest.mark.parametrize("max_bits", [1 << 16, 1 << 29])
def test_every_key_and_no_other_bit(spark, monkeypatch, max_bits):
    monkeypatch.setattr(bitmap, "MAX_BITS", max_bits)
    frame = spark.range(30_000).select(F.xxhash64(F.col("id") % 20_000).alias("key")) \
        .union(spark.createDataFrame([(0,), (-1,), (2**63 - 1,), (-2**63,), (63,), (64,)], "key long"))
    keys = np.array([r.key for r in frame.collect()])
    built = bitmap.Bitmap(frame, len(keys))
    bits = len(built.words.value) * 64
    assert bits == min(max_bits, 1 << 19) and _has(built, keys).all()
    wanted = np.zeros(bits, bool)
    wanted[(keys & (bits - 1)).astype(np.int64)] = True
    assert (np.unpackbits(built.words.value.view(np.uint8), bitorder="little").astype(bool) == wanted).all()


def test_no_keys(spark):
    assert not _has(bitmap.Bitmap(spark.range(0).select(F.col("id").alias("key")), 0), [0, -1, 5]).any()


def test_driver_holds_little_but_the_bits(spark):
    n, arrow = 1 << 18, "spark.sql.execution.arrow.pyspark.enabled"
    keys = spark.range(n).select(F.xxhash64("id").alias("key"))
    before = spark.conf.get(arrow)
    spark.conf.set(arrow, "false")      # Spark's default
    tracemalloc.start()
    try:
        bitmap.Bitmap(keys, n)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
        spark.conf.set(arrow, before)
    assert most < 8 * n * bitmap.BITS_PER_KEY / 8


def test_released_bits_are_gone(spark):
    built = bitmap.Bitmap(spark.range(9).select(F.col("id").alias("key")), 9)
    before = _has(built, [3, 20]).tolist()
    built.release()
    assert before == [True, False]
    with pytest.raises(Exception):
        spark.range(1).mapInArrow(lambda batches: ([built.has(np.zeros(1, np.uint64)), *batches][1:]), "id long").collect()
