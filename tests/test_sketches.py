"""Merged sketches: within the stated error of the exact answers, on a skewed key, and equal however they were merged."""

import pytest
from pyspark.sql import functions as F

from salesgrid.operators import sketches as K
from salesgrid.plans.model import CrmModel

N = 60_000


@pytest.fixture(scope="module")
def model(spark):
    """A third of all deals is in one sector; values are skewed."""
    deals = spark.range(N).select(
        F.col("id").cast("string").alias("opportunity_id"), F.concat(F.lit("a"), F.col("id") % 9000).alias("account"), F.lit("Won").alias("deal_stage"),
        F.expr("date_add(DATE'2020-01-01', CAST(id % 50 AS INT))").alias("close_date"),
        F.expr("CAST(pow((id * 7919) % 60000, 2) / 1000 AS DECIMAL(15,2))").alias("close_value"))
    accounts = spark.range(9000).select(F.concat(F.lit("a"), F.col("id")).alias("account"),
                                        F.when(F.col("id") < 3000, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 40)).alias("sector"))
    return CrmModel.from_frames(deals, accounts, accounts, accounts)


@pytest.fixture(scope="module")
def daily(model, spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sketches") / "daily")
    K.daily_sketches(model, "sector").write.parquet(path)
    return spark.read.parquet(path)


def test_distinct_counts(daily):
    got = {r.group: r for r in K.estimates(K.merge(daily)).collect()}
    bound = 3 * 1.04 / 2 ** (K.LG_K / 2)
    assert abs(got["hot"].approx_distinct / 3000 - 1) <= bound and got["hot"].deals == 21_000
    assert all(abs(r.approx_distinct - 150) <= max(1, 150 * bound) for g, r in got.items() if g != "hot")
    assert abs(K.estimates(K.merge(daily, [])).first().approx_distinct / 9000 - 1) <= bound


def test_merged_equals_one_pass(model, daily):
    """Merging days or halves of them in any order gives the one-pass estimate of the distinct count."""
    one = model.pipeline("account").agg(F.hll_sketch_estimate(F.hll_sketch_agg("account", F.lit(K.LG_K)))).first()[0]
    assert K.estimates(K.merge(daily, [])).first().approx_distinct == pytest.approx(one, rel=0.01)
    weeks = daily.withColumn("week", F.weekofyear("day"))
    twice = K.merge(K.merge(weeks, ["group", "week"]))
    got, want = ({r.group: r.approx_distinct for r in K.estimates(x).collect()} for x in (twice, K.merge(daily)))
    assert got.keys() == want.keys() and all(abs(got[g] - want[g]) <= 0.01 * want[g] + 1 for g in want)


def test_rank_error_of_quantiles(model, daily):
    exact = model.pipeline("account", "close_value").join(model.accounts(), "account").withColumn("v", F.col("close_value").cast("double"))
    asked = (0.1, 0.5, 0.9, 0.99)
    for r in K.estimates(K.merge(daily.filter("group IN ('hot', 's1', 's39')")), asked).collect():
        own = exact.filter(F.col("sector") == r.group)
        n = own.count()
        for q in asked:
            answer = r[f"p{q * 100:g}"]
            below, upto = own.agg(F.count(F.when(F.col("v") < answer, 1)), F.count(F.when(F.col("v") <= answer, 1))).first()
            assert below / n - 0.035 <= q <= upto / n + 0.035, (r.group, q)


def test_ranges_of_days_and_empty_input(daily, model):
    some = K.merge(daily.filter("day < '2020-01-11'"), [])
    assert K.estimates(some).first().deals == N // 5
    empty = CrmModel.from_frames(model._pipeline.limit(0), model.accounts(), model.accounts(), model.accounts())
    assert K.approx_summary(empty).collect() == []
