"""Distributed NTILE / percentiles equal the single-partition definitions."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from salesgrid.plans import ranking


@pytest.mark.parametrize("n,tiles,distinct,parts", [(1, 5, 1, 2), (4, 5, 3, 3), (37, 5, 3, 4),
                                                    (500, 7, 2, 8), (1000, 5, 400, 5)])
def test_ntiles_match_windows(spark, n, tiles, distinct, parts):
    rnd = random.Random(n * 31 + tiles)
    rows = [(f"a{i:05d}" if i else None, rnd.randrange(distinct) if rnd.random() > 0.05 else None,
             rnd.random() * 100) for i in range(n)]
    df = spark.createDataFrame(rows, "account string, v long, x double").withColumn(
        "x", F.col("x").cast("decimal(15,2)"))
    got = {r.account: (r.t, r.s) for r in ranking.add_ntiles(
        df, "account", {"t": -F.col("v"), "s": F.col("x")}, tiles, partitions=parts).collect()}
    w = Window.orderBy(F.col("v").desc_nulls_last(), F.col("account").asc_nulls_last())
    x = Window.orderBy(F.col("x").asc_nulls_last(), F.col("account").asc_nulls_last())
    want = {r.account: (r.t, r.s) for r in df.select("account", F.ntile(tiles).over(w).alias("t"),
                                                     F.ntile(tiles).over(x).alias("s")).collect()}
    assert got == want
    sizes = np.bincount([t for t, _ in got.values()])[1:]
    assert sizes.max() - sizes.min() <= 1


def test_positions_are_a_permutation_under_heavy_ties(spark):
    # one value holds a third of the rows; positions must still be 0..n-1 exactly once
    rows = [(i, 7 if i % 3 == 0 else i) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, v long")
    pos = ranking.positions(df, [F.col("v"), F.col("id")], partitions=6)
    got = sorted(r._pos for r in pos.select("_pos").collect())
    assert got == list(range(3000))


@pytest.mark.parametrize("parts", [None, 5])
@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.75, 0.9, 1.0])
def test_percentiles_match_numpy(spark, q, parts):
    rnd = random.Random(7)
    rows = [(g, rnd.choice([None, rnd.random() * 100, float(rnd.randrange(5))]))
            for g in ("a", "b", None) for _ in range(rnd.randrange(1, 60))]
    rows.append(("empty", None))
    df = spark.createDataFrame(rows, "g string, x double")
    out = {r.g: r.value for r in ranking.percentiles(df, ["x"], [q], group_cols=["g"],
                                                    partitions=parts).collect()}
    for g in ("a", "b", None):
        vals = [x for gg, x in rows if gg == g and x is not None]
        if vals:
            assert out[g] == pytest.approx(float(np.percentile(vals, q * 100)), rel=1e-12, abs=1e-12)
    assert out["empty"] is None


def test_single_partition_exchanges_only_feed_per_partition_counts(spark):
    df = spark.range(0, 2000).withColumn("x", (F.col("id") * 7919) % 1000)
    out = ranking.percentiles(df, ["x"], [0.5])
    lines = out._jdf.queryExecution().executedPlan().toString().splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            # the only single-task stages are over one row per range partition
            assert "_part" in lines[i + 1], "\n".join(lines[i:i + 3])
    assert out.first().value == pytest.approx(
        float(np.percentile([(i * 7919) % 1000 for i in range(2000)], 50)))
