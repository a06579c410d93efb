"""Deal conversion and sales-cycle metrics, per stage and per sales agent."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..plans.model import AGENT_KEY, CrmModel
from . import _stats as S


def deal_conversion(model: CrmModel) -> DataFrame:
    """Q10: opportunities, won/lost counts, win rate over all stages, revenue (one row)."""
    p = model.pipeline("deal_stage", "close_value")
    return p.agg(
        F.count(F.lit(1)).alias("total_opportunities"),
        C.count_when(C.is_won()).alias("won_deals"),
        C.count_when(C.is_lost()).alias("lost_deals"),
        C.percent(C.count_when(C.is_won()), F.count(F.lit(1))).alias("win_rate"),
        F.sum(C.won_value()).cast("double").alias("total_revenue"),
        C.money_mean(C.won_value_or_null()).alias("avg_deal_size"),
    )


def stage_conversion(model: CrmModel, sort: bool = True) -> DataFrame:
    """Q11: count and won value per stage, with the stage's rank by count.

    The rank window runs over the aggregated stages (one row per stage).
    """
    p = model.pipeline("deal_stage", "close_value")
    g = p.groupBy("deal_stage").agg(
        F.count(F.lit(1)).alias("count"),
        F.sum(C.won_value()).cast("double").alias("total_value"))
    out = g.withColumn("rank", F.rank().over(Window.orderBy(F.col("count").desc())).cast("bigint"))
    if sort:
        out = out.orderBy(F.col("count").desc(), F.col("deal_stage").asc_nulls_last())
    return out


def sales_cycle_stats(model: CrmModel) -> DataFrame:
    """Q12: mean, min, max and median days from engagement to a won close (one row).

    The exact median buffers one count per distinct day number, which is
    bounded by the calendar span of the data, not by its volume.
    """
    p = model.pipeline("deal_stage", "engage_date", "close_date")
    d = (p.filter(C.is_won() & F.col("engage_date").isNotNull())
         .select(C.day_diff("engage_date", "close_date").alias("d")))
    return d.agg(C.mean("d").alias("avg_sales_cycle_days"),
                 F.min("d").alias("min_sales_cycle_days"),
                 F.max("d").alias("max_sales_cycle_days"),
                 F.percentile(F.col("d"), F.lit(0.5)).alias("median_sales_cycle_days"))


def agent_performance(model: CrmModel, sort: bool = True) -> DataFrame:
    """Q13: per agent (with manager and office): counts, win rate, revenue, cycle.

    The fact table is aggregated by the agent's key; only one row per key
    meets the agents' table.
    """
    p = model.agent_keyed_pipeline("opportunity_id", "deal_stage", "close_value",
                                   "engage_date", "close_date")
    # aggregate by the agent key, name the aggregated rows, then merge rows that
    # share a name (keys without a match all have the NULL name)
    parts = S.deal_stats(p, [AGENT_KEY])
    j = S.rollup(model.agent_names(parts), ["sales_agent", "manager", "regional_office"])
    out = j.select("sales_agent", "manager", "regional_office",
                   F.col("_opps").alias("total_opportunities"),
                   F.col("_won").alias("won_deals"), F.col("_lost").alias("lost_deals"),
                   S.win_rate().alias("win_rate"), S.total_revenue().alias("total_revenue"),
                   S.avg_deal_size().alias("avg_deal_size"),
                   S.avg_sales_cycle().alias("avg_sales_cycle"))
    if sort:
        out = out.orderBy(F.col("total_revenue").desc_nulls_last(),
                          F.col("sales_agent").asc_nulls_last())
    return out
