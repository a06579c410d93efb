"""Industry and geographic metrics, industry penetration and regional revenue share."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..plans.model import ACCOUNT_KEY, AGENT_KEY, CrmModel
from . import _stats as S


def _per_account_parts(model: CrmModel) -> DataFrame:
    p = model.account_keyed_pipeline("opportunity_id", "deal_stage", "close_value")
    keyed = S.deal_stats(p, [ACCOUNT_KEY], with_cycle=False)
    return S.rollup(model.account_names(keyed), ["account"])


def _by_account_attribute(model: CrmModel, attribute: str) -> DataFrame:
    """Aggregate by account, attach ``attribute`` from accounts, re-aggregate by it.

    Each pre-aggregated row is one distinct account, so ``COUNT(DISTINCT
    account)`` becomes ``COUNT(account)`` and needs no second distinct pass.
    """
    parts = _per_account_parts(model)
    acc = model.accounts().select("account", attribute)
    j = parts.join(acc, "account", "left")
    return S.rollup(j, [attribute], extra=[
        F.count("account").alias("customer_count"),
        F.count(F.when(F.col("_won") > 0, F.col("account"))).alias("_won_customers"),
    ])


def industry_performance(model: CrmModel, sort: bool = True) -> DataFrame:
    """Q17: per sector: customers, deals, win rate, revenue, revenue per won customer."""
    g = _by_account_attribute(model, "sector")
    out = g.select("sector", "customer_count",
                   F.col("_opps").alias("deal_count"),
                   F.col("_won").alias("won_deals"),
                   S.win_rate().alias("win_rate"),
                   S.total_revenue().alias("total_revenue"),
                   S.avg_deal_size().alias("avg_deal_size"),
                   C.ratio("_won_value", "_won_customers").alias("revenue_per_customer"))
    if sort:
        out = out.orderBy(F.col("total_revenue").desc_nulls_last(), F.col("sector").asc_nulls_last())
    return out


def geographic_performance(model: CrmModel, sort: bool = True) -> DataFrame:
    """Q18: per office location: customers, deals, won/lost, win rate, revenue."""
    g = _by_account_attribute(model, "office_location")
    out = g.select("office_location", "customer_count",
                   F.col("_opps").alias("deal_count"),
                   F.col("_won").alias("won_deals"), F.col("_lost").alias("lost_deals"),
                   S.win_rate().alias("win_rate"),
                   S.total_revenue().alias("total_revenue"),
                   S.avg_deal_size().alias("avg_deal_size"))
    if sort:
        out = out.orderBy(F.col("total_revenue").desc_nulls_last(),
                          F.col("office_location").asc_nulls_last())
    return out


def industry_penetration(model: CrmModel, sort: bool = True) -> DataFrame:
    """Customers in a sector (accounts with a won deal) over all accounts in it."""
    won_accounts = S.per_account(model, ("deal_stage",), {}, C.is_won()) \
        .filter(F.col("account").isNotNull()).withColumn("_buyer", F.lit(1))
    acc = model.accounts().select("account", "sector")
    j = acc.join(won_accounts, "account", "left")
    g = j.groupBy("sector").agg(
        F.count("account").alias("addressable_accounts"),
        F.count("_buyer").alias("customers"))
    out = g.select("sector", "customers", "addressable_accounts",
                   C.percent("customers", "addressable_accounts").alias("penetration_rate"))
    if sort:
        out = out.orderBy(F.col("penetration_rate").desc_nulls_last(), F.col("sector").asc_nulls_last())
    return out


def regional_ratio(model: CrmModel, sort: bool = True) -> DataFrame:
    """Won revenue per regional office as a percentage of all won revenue."""
    p = model.agent_keyed_pipeline("deal_stage", "close_value")
    per_agent = p.groupBy(AGENT_KEY).agg(F.sum(C.won_value()).alias("_v"))
    per_region = (model.agent_names(per_agent)
                  .groupBy("regional_office").agg(F.sum("_v").alias("_rv")))
    # Every agent falls in exactly one office group (unmatched ones in NULL), so
    # the total is the sum over office groups: a window over one row per
    # office, instead of a second pass over the fact table.
    j = per_region.withColumn("_tv", F.sum("_rv").over(Window.partitionBy()))
    out = j.select("regional_office",
                   F.col("_rv").cast("double").alias("region_revenue"),
                   F.col("_tv").cast("double").alias("total_revenue"),
                   C.percent(F.col("_rv").cast("double"), F.col("_tv").cast("double"))
                   .alias("revenue_share"))
    if sort:
        out = out.orderBy(F.col("revenue_share").desc_nulls_last(),
                          F.col("regional_office").asc_nulls_last())
    return out
