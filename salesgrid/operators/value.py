"""Customer value metrics: order value, lifetime value, acquisition-cost proxy.

Every metric here reads only won deals and groups by account: one shuffle of
the fact table on ``account`` with map-side partial aggregation, so a hot
account collapses to one partial row per input task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..plans.joins import single_row
from ..plans.model import CrmModel
from ..session import reliable_checkpoint
from . import _stats as S


def average_order_value(model: CrmModel) -> DataFrame:
    """Q1: mean close value of won deals (one row)."""
    p = model.pipeline("deal_stage", "close_value").filter(C.is_won())
    return p.agg(C.money_mean("close_value").alias("average_order_value"))


_SUMMARY_COLUMNS = ("deal_stage", "close_value", "close_date", "opportunity_id")
_SUMMARY_PARTS = {"_v_sum": ("sum", "close_value"), "_v_n": ("count", "close_value"),
                  "_opps": ("count", "opportunity_id"), "_first": ("min", "close_date"),
                  "_last": ("max", "close_date")}


def _won_account_summary(model: CrmModel) -> DataFrame:
    g = S.per_account(model, _SUMMARY_COLUMNS, _SUMMARY_PARTS, C.is_won())
    return g.select("account", C.ratio("_v_sum", "_v_n").alias("avg_value_per_deal"),
                    F.col("_opps").alias("total_deals"), "_first", "_last")


def _won_account_years(model: CrmModel) -> DataFrame:
    """Won deals per (account, close year): additive parts of the per-account summary."""
    return S.per_account(model, _SUMMARY_COLUMNS, _SUMMARY_PARTS, C.is_won(),
                         {"year": F.year("close_date").cast("bigint")})


def _summary_from_years(years: DataFrame) -> DataFrame:
    g = years.groupBy("account").agg(F.sum("_v_sum").alias("_v_sum"), F.sum("_v_n").alias("_v_n"),
                                     F.sum("_opps").alias("total_deals"),
                                     F.min("_first").alias("_first"), F.max("_last").alias("_last"))
    return g.select("account", C.ratio("_v_sum", "_v_n").alias("avg_value_per_deal"),
                    "total_deals", "_first", "_last")


def customer_lifetime_value(model: CrmModel, discount_rate: float = 0.10,
                            horizon_years: int = 3, no_lifespan_factor: float = 2.74,
                            days_per_year: float = 365.0, sort: bool = True,
                            _summary: DataFrame | None = None) -> DataFrame:
    """Q2: historical, annualised and discounted multi-year CLV per account.

    ``projected_3yr_clv`` multiplies the annual value by the sum of discount
    factors for t = 0..horizon-1; accounts with a single purchase day use
    ``no_lifespan_factor`` instead (2.74 in the original analysis).
    """
    factor = C.discount_factor_sum(discount_rate, horizon_years, start=0)
    s = _won_account_summary(model) if _summary is None else _summary
    years = (C.day_diff("_first", "_last").cast("double") / F.lit(days_per_year))
    s = s.select(F.col("account").alias("company_sold_to"), "avg_value_per_deal",
                 "total_deals", years.alias("customer_lifespan_years"))
    avg, deals, yrs = F.col("avg_value_per_deal"), F.col("total_deals"), F.col("customer_lifespan_years")
    out = s.select(
        "company_sold_to", "avg_value_per_deal", "total_deals", "customer_lifespan_years",
        (avg * deals.cast("double")).alias("historical_clv"),
        F.when(yrs > 0, avg * (deals.cast("double") / yrs))
         .otherwise(avg * deals.cast("double")).alias("annual_clv"),
        F.when(yrs > 0, avg * (deals.cast("double") / yrs) * F.lit(factor))
         .otherwise(avg * deals.cast("double") * F.lit(float(no_lifespan_factor)))
         .alias("projected_3yr_clv"),
    )
    if sort:
        out = out.orderBy(F.col("projected_3yr_clv").desc_nulls_last(),
                          F.col("company_sold_to").asc_nulls_last())
    return out


def acquisition_cost_proxy(model: CrmModel, daily_cost: float = 100.0, sort: bool = True) -> DataFrame:
    """Q3: sales-cycle length as a CAC proxy, CLV:CAC ratio and payback months.

    The original joins two per-account aggregates of the same filtered rows;
    here it is one aggregate (one shuffle). The join dropped the NULL account
    group, so it is filtered out explicitly.
    """
    g = S.per_account(model, ("deal_stage", "engage_date", "close_date", "close_value"), {
        "_days": ("sum", "cycle_days"), "_timed": ("count", "cycle_days"), "_sum": ("sum", "close_value")}, C.is_won())
    g = g.filter(F.col("account").isNotNull()).select(
        "account", C.ratio("_days", "_timed").alias("avg_sales_cycle_days"),
        F.col("_sum").cast("double").alias("_total"))
    cac = F.col("avg_sales_cycle_days") * F.lit(float(daily_cost))
    out = g.select(
        "account", "avg_sales_cycle_days",
        cac.alias("estimated_cac"),
        F.col("_total").alias("customer_lifetime_value"),
        (F.col("_total") / C.nullif_zero(cac)).alias("clv_cac_ratio"),
        (cac / C.nullif_zero(F.col("_total") / F.lit(12.0))).alias("cac_payback_months"),
    )
    if sort:
        out = out.orderBy(F.col("clv_cac_ratio").desc_nulls_last(), F.col("account").asc_nulls_last())
    return out


def discounted_clv(model: CrmModel, discount_rate: float = 0.10, years: int = 3,
                   margin: float = 1.0, sort: bool = True) -> DataFrame:
    """Sum over t = 1..n of annual profit / (1 + d)^t, per account.

    Annual profit is the annualised CLV of Q2 times ``margin``.
    """
    factor = C.discount_factor_sum(discount_rate, years, start=1)
    clv = customer_lifetime_value(model, sort=False)
    profit = F.col("annual_clv") * F.lit(float(margin))
    out = clv.select(F.col("company_sold_to").alias("account"),
                     profit.alias("annual_profit"),
                     (profit * F.lit(factor)).alias("discounted_clv"))
    if sort:
        out = out.orderBy(F.col("discounted_clv").desc_nulls_last(), F.col("account").asc_nulls_last())
    return out


def predicted_clv(model: CrmModel, discount_rate: float = 0.10, margin: float = 1.0,
                  retention_rate: float | None = None, granularity: str = "year",
                  sort: bool = True) -> DataFrame:
    """Margin * r / (1 + d - r) per account.

    ``margin`` scales the account's annualised value (Q2) into annual profit;
    ``r`` is given, or else the pooled period retention of D3 (retained
    customers over customers at period start, summed over all periods).
    """
    from .retention import active_periods, pooled_retention

    if retention_rate is not None:
        clv = customer_lifetime_value(model, sort=False)
        r = model.spark.range(1).select(F.lit(float(retention_rate)).alias("_r"))
    elif granularity == "year":
        # One pass over the fact table: the per-(account, year) aggregate feeds
        # both the account summary and the yearly active-account pairs.
        years = reliable_checkpoint(_won_account_years(model))
        clv = customer_lifetime_value(model, sort=False, _summary=_summary_from_years(years))
        r = pooled_retention(years.filter(F.col("account").isNotNull() & F.col("year").isNotNull())
                             .select("account", F.col("year").alias("period")))
    else:
        clv = customer_lifetime_value(model, sort=False)
        r = pooled_retention(active_periods(model, granularity))
    profit = F.col("annual_clv") * F.lit(float(margin))
    out = clv.crossJoin(single_row(r)).select(
        F.col("company_sold_to").alias("account"),
        profit.alias("annual_profit"),
        F.col("_r").alias("retention_rate"),
        (profit * (F.col("_r") / C.nullif_zero(F.lit(1.0 + discount_rate) - F.col("_r")))).alias("predicted_clv"))
    if sort:
        out = out.orderBy(F.col("predicted_clv").desc_nulls_last(), F.col("account").asc_nulls_last())
    return out
