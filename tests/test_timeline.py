"""What came before on a time line: equal to brute force, whatever the cell width, with ties, nulls and hot keys."""

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from salesgrid.plans.timeline import DAY, asof_join, chain_levels, previous_second

START = datetime.datetime(1969, 12, 30)


def rows(rng, n, keys, span):
    return [(rng.choice(keys), START + datetime.timedelta(seconds=rng.randrange(span)), i, rng.choice("abcde")) for i in range(n)]


def frame(spark, data):
    return spark.createDataFrame(data, "k string, t timestamp_ntz, id long, kind string")


@pytest.mark.parametrize("width", [1, 50, 1000, DAY])
@pytest.mark.parametrize("strict", [False, True])
def test_asof_join(spark, width, strict):
    rng = random.Random(width)
    keys = ["hot"] * 6 + ["x", "y", "z", None]
    left = rows(rng, 200, keys, 3000) + [("x", None, 900, "a"), ("nobody", START, 901, "a")]
    right = rows(rng, 150, keys[:-2] + [None], 3000) + [("x", None, 800, "b")] + [("y", START + datetime.timedelta(seconds=10), 700 + i, "e") for i in range(3)]

    def latest(k, t):
        found = [(u, i, c) for key, u, i, c in right if key == k and k is not None and t is not None and u is not None
                 and (u < t if strict else u <= t)]
        return max(found)[1:] if found else (None, None)

    got = asof_join(frame(spark, left), frame(spark, right).select("k", "t", F.col("id").alias("rid"), F.col("kind").alias("rkind")),
                    "k", "t", "t", "rid", ["rid", "rkind"], strict=strict, width=width)
    assert got.columns == ["k", "t", "id", "kind", "rid", "rkind"]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(str((*x, *latest(x[0], x[1]))) for x in left)


@pytest.mark.parametrize("width", [1, 60, 100_000])
def test_previous(spark, width):
    rng = random.Random(width)
    data = rows(rng, 300, ["hot"] * 5 + ["x", "y"], 2000) + [(None, START, 1000, "a"), (None, START, 1001, "a"), ("x", None, 1002, "a")]
    got = {r.id: r.previous_second for r in previous_second(frame(spark, data), "k", "t", "id", width=width).collect()}
    second = lambda t: int((t - datetime.datetime(1970, 1, 1)).total_seconds())
    for k, t, i, _ in data:
        before = [(u, j) for key, u, j, _ in data if key == k and k is not None and u is not None and t is not None and (u, j) < (t, i)]
        assert got[i] == (second(max(before)[0]) if before else None)


def levels(data, steps, within):
    """Longest chain of each key, by trying every start."""
    out = {}
    for k in {r[0] for r in data if r[0] is not None}:
        own = sorted((t, i, c) for key, t, i, c in data if key == k and t is not None)
        best = 0
        for a, (start, _, kind) in enumerate(own):
            if kind != steps[0]:
                continue
            level = 1
            for t, _, c in own[a + 1:]:
                if level < len(steps) and c == steps[level] and (t - start).total_seconds() <= within:
                    level += 1
            best = max(best, level)
        out[k] = best
    return out


@pytest.mark.parametrize("steps", [("a",), ("a", "b"), ("c", "a", "d"), ("a", "b", "c", "d")])
def test_chains(spark, steps):
    rng = random.Random(len(steps))
    for within, span in ((30, 400), (7, 60), (1000, 900)):
        data = rows(rng, 250, ["hot"] * 4 + [f"k{i}" for i in range(12)] + [None], span)
        data += [("tied", START, i, c) for i, c in enumerate("abcd")] + [("backwards", START, 9 - i, c) for i, c in enumerate("abcd")]
        data += [("never", START, 1, "e"), ("no time", None, 1, "a"), ("edge", START, 1, steps[0]), ("edge", START + datetime.timedelta(seconds=within), 2, steps[-1])]
        got = {r.k: r.level for r in chain_levels(frame(spark, data), "k", "t", "id", "kind", steps, within).collect()}
        assert got == levels(data, steps, within)


def test_steps_must_differ(spark):
    with pytest.raises(ValueError):
        chain_levels(frame(spark, []), "k", "t", "id", "kind", ("a", "a"), 5)


def test_a_hot_key_is_spread_over_its_time(spark):
    """A key with all rows: no task of the window sees more than its cells."""
    n = 20_000
    hot = spark.range(n).select(F.lit("hot").alias("k"), F.expr("TIMESTAMP_NTZ'2020-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * 60)").alias("t"),
                                F.col("id"), F.element_at(F.array(*[F.lit(c) for c in "abcde"]), (F.col("id") % 5 + 1).cast("int")).alias("kind"))
    got = previous_second(hot, "k", "t", "id", width=3600)
    assert got.filter("previous_second IS NULL").count() == 1
    assert re.search(r"Window \[lag.*\n.*Sort.*\n.*Exchange hashpartitioning\([^)]*_cell", got._jdf.queryExecution().executedPlan().toString())
    assert chain_levels(hot, "k", "t", "id", "kind", ("a", "b", "c"), 120).first().level == 3
    assert chain_levels(hot, "k", "t", "id", "kind", ("a", "b", "c"), 119).first().level == 2
