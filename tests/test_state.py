"""Metrics from the maintained state equal the full scan, whatever the order, number and repetition of batches."""

import datetime
import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from salesgrid import operators as O
from salesgrid.plans.model import CrmModel
from salesgrid.plans.state import DEAL_COLUMNS, AccountState, build
from salesgrid.sources import files

SF = "/root/testdata/sf0.001"
FEW = (O.acquisition_cost_proxy, O.churn_status, O.cohort_retention)
METRICS = (O.customer_lifetime_value, O.acquisition_cost_proxy, O.churn_status, O.purchase_counts, O.repeat_purchase_rate,
           O.cohort_retention, O.cohort_retention_long, O.health_score, O.churn_risk, O.rfm_segments, O.period_retention,
           O.discounted_clv, O.predicted_clv)
DEALS = "opportunity_id string, account string, deal_stage string, engage_date date, close_date date, close_value decimal(15,2)"
AS_OF = {"as_of": "2020-12-31"}


def day(text):
    return datetime.date.fromisoformat(text) if text else None


def deals(spark, rows):
    return spark.createDataFrame([(o, a, s, day(e), day(c), None if v is None else Decimal(v))
                                  for o, a, s, e, c, v in rows], DEALS)


ROWS = [("o1", "x", "Won", "2019-01-01", "2019-02-01", "10.50"), ("o2", "x", "Won", "2019-03-01", "2020-02-01", "20.25"),
        ("o3", "y", "Won", None, "2019-02-01", None), ("o4", None, "Won", "2019-01-05", "2019-02-01", "7.00"),
        ("o5", "y", "Lost", "2019-01-05", "2019-02-01", "0.00"), ("o6", "z", "Engaging", "2019-01-05", None, None),
        ("o7", "y", "Won", "2020-01-05", "2020-01-05", "0.00"), ("o8", "x", "Won", "2019-02-02", "2019-02-01", "1.00"),
        (None, "w", "Won", "2019-02-02", None, "3.00")]


def answers(model, metrics=FEW):
    return {f.__name__: sorted(map(str, f(model, sort=False).collect())) if f not in (O.purchase_counts, O.repeat_purchase_rate)
            else sorted(map(str, f(model).collect())) for f in metrics}


def full(spark, frame, metrics=FEW):
    """The same metrics by a scan of all deals."""
    nothing = spark.createDataFrame([], "account string, sector string, revenue double")
    return answers(CrmModel.from_frames(frame, nothing, nothing, nothing, **AS_OF), metrics)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data missing")
def test_three_batches_a_replay_and_a_late_one_equal_the_scan(spark):
    state = E.state_for(spark, SF)
    assert len(state.batches()) == 4
    want = answers(E.model_for(spark, SF), METRICS)
    assert answers(state.model(**E.PARAMS), METRICS) == want
    read = O.customer_lifetime_value(state.model(**E.PARAMS)).inputFiles()
    assert read and all("/account-state" in f for f in read)        # no scan of the deals
    state.compact()
    assert answers(state.model(**E.PARAMS)) == {f.__name__: want[f.__name__] for f in FEW}


def test_nulls_stages_and_single_deals(spark, tmp_path):
    frame = deals(spark, ROWS)
    state = build(spark, str(tmp_path / "s"), [(i, deals(spark, [r])) for i, r in enumerate(ROWS)])
    assert answers(state.model(**AS_OF), METRICS) == full(spark, frame, METRICS)


def test_replays_change_nothing_even_after_compaction(spark, tmp_path):
    frame = deals(spark, ROWS)
    state = AccountState(spark, str(tmp_path / "s"))
    assert state.apply(frame, "2024/01 a") and not state.apply(frame, "2024/01 a")
    assert state.compact() == 1
    assert not state.apply(frame, "2024/01 a")
    state.vacuum()
    assert not state.apply(frame, "2024/01 a") and files.children(spark, f"{state.path}/batches") == []
    assert state.apply(deals(spark, [("n", "x", "Won", "2020-01-01", "2020-05-05", "5.00")]), "b") and state.compact() == 2
    state.vacuum()
    assert files.children(spark, f"{state.path}/snapshots") == ["2"]
    more = frame.union(deals(spark, [("n", "x", "Won", "2020-01-01", "2020-05-05", "5.00")]).select(frame.columns))
    assert answers(state.model(**AS_OF)) == full(spark, more)


def test_unfinished_writes_do_not_count(spark, tmp_path):
    frame = deals(spark, ROWS)
    state = build(spark, str(tmp_path / "s"), [(1, frame)])
    want = answers(state.model(**AS_OF))
    state.apply(frame, "crashed")
    os.remove(f"{state.path}/batches/id-crashed/_SUCCESS")
    state.compact()
    os.remove(f"{state.path}/snapshots/1/batches/_SUCCESS")
    assert state.batches() == {"id-1"} and answers(state.model(**AS_OF)) == want
    assert state.apply(frame.limit(0), "crashed")       # the writer starts anew over what it left
    assert state.compact() == 1 and answers(state.model(**AS_OF)) == want


def test_retracted_deals_leave_no_trace(spark, tmp_path):
    right, wrong = deals(spark, ROWS[:4]), deals(spark, [("w", "gone", "Won", "2019-01-01", "2021-01-01", "99.00"),
                                                         ("v", "x", "Won", "2018-01-01", "2021-01-01", "99.00")])
    state = build(spark, str(tmp_path / "s"), [(1, right.unionByName(wrong))])
    state.apply(deals(spark, []), 2, retracted=wrong)
    assert answers(state.model(**AS_OF)) == full(spark, right)
    state.compact()
    assert answers(state.model(**AS_OF)) == full(spark, right)
    other = AccountState(spark, str(tmp_path / "t"))       # the correction comes first
    other.apply(deals(spark, []), 2, retracted=wrong)
    other.compact()
    other.apply(right.unionByName(wrong), 1)
    assert answers(other.model(**AS_OF)) == full(spark, right)


def test_empty_state_and_metrics_it_cannot_answer(spark, tmp_path):
    model = AccountState(spark, str(tmp_path / "none")).model(**AS_OF)
    assert O.churn_status(model).collect() == [] and O.repeat_purchase_rate(model).first().total_customers == 0
    for metric in (O.deal_conversion, O.agent_performance, O.account_features, O.touchpoints):
        with pytest.raises(ValueError):
            metric(model).collect()


def test_a_stream_of_deals(spark, tmp_path):
    """Micro-batches are batches; a restarted query that repeats none leaves the state as it was."""
    source = str(tmp_path / "in")
    for i, r in enumerate(ROWS):
        deals(spark, [r]).coalesce(1).write.mode("append").parquet(source)
    state = AccountState(spark, str(tmp_path / "s"))
    for _ in range(2):
        stream = spark.readStream.schema(DEALS).option("maxFilesPerTrigger", 4).parquet(source)
        state.follow(stream.select(*DEAL_COLUMNS), str(tmp_path / "ckpt"), availableNow=True).awaitTermination()
        assert len(state.batches()) == 3 and answers(state.model(**AS_OF)) == full(spark, deals(spark, ROWS))
    # the same micro-batch again, as after a failure between its effect and its commit
    assert not state.apply(deals(spark, ROWS), "stream-0")


def test_one_pass_over_a_batch_with_partial_sums(spark, tmp_path):
    from salesgrid.plans.state import deltas
    hot = spark.range(50_000).select(F.col("id").cast("string").alias("opportunity_id"), F.lit("hot").alias("account"), F.lit("Won").alias("deal_stage"),
                                     F.lit(day("2019-01-01")).alias("engage_date"), F.expr("date_add(DATE'2019-02-01', CAST(id % 20 AS INT))").alias("close_date"),
                                     F.lit(1).cast("decimal(15,2)").alias("close_value"))
    plan = deltas(hot)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("partial_count") > 0
    assert deltas(hot).count() == 20
