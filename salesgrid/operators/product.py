"""Product metrics: performance, penetration, cross-sell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..plans.joins import single_row
from ..plans.model import ACCOUNT_KEY, CrmModel
from ..session import reliable_checkpoint
from . import _stats as S


def product_performance(model: CrmModel, sort: bool = True) -> DataFrame:
    """Q14: per product and series: deal counts, win rate, revenue, cycle, customers."""
    p = model.account_keyed_pipeline("product", "opportunity_id", "deal_stage", "close_value",
                                     "engage_date", "close_date")
    cells = model.account_names(S.deal_stats(p, ["product", ACCOUNT_KEY]))
    parts = S.rollup(S.rollup(cells, ["product", "account"]), ["product"],
                     extra=[F.count("account").alias("unique_customers")])
    prods = model.products().select("product", "series")
    j = parts.join(prods, "product", "left")
    out = j.select("product", "series",
                   F.col("_opps").alias("total_opportunities"),
                   F.col("_won").alias("won_deals"), F.col("_lost").alias("lost_deals"),
                   S.win_rate().alias("win_rate"), S.total_revenue().alias("total_revenue"),
                   S.avg_deal_size().alias("avg_deal_size"),
                   S.avg_sales_cycle().alias("avg_sales_cycle"),
                   "unique_customers")
    if sort:
        out = out.orderBy(F.col("total_revenue").desc_nulls_last(), F.col("product").asc_nulls_last())
    return out


def _won_pairs(model: CrmModel) -> DataFrame:
    """Distinct (account, product) pairs of won deals: one shuffle, deduplicated map-side."""
    return S.per_account(model, ("product", "deal_stage"), {}, C.is_won(), {"product": F.col("product")})


def product_penetration(model: CrmModel, sort: bool = True) -> DataFrame:
    """Q15: share of buying customers that bought each product.

    The pairs feed two aggregates (per product, and distinct accounts
    overall); they are checkpointed so the fact table is read once.
    """
    pairs = reliable_checkpoint(_won_pairs(model))
    per_product = pairs.groupBy("product").agg(F.count("account").alias("customers_with_product"))
    total = pairs.agg(F.countDistinct("account").alias("total_customers"))
    j = per_product.crossJoin(single_row(total))
    out = j.select("product", "customers_with_product", "total_customers",
                   C.percent("customers_with_product", "total_customers").alias("penetration_rate"))
    if sort:
        out = out.orderBy(F.col("penetration_rate").desc_nulls_last(), F.col("product").asc_nulls_last())
    return out


def cross_sell(model: CrmModel) -> DataFrame:
    """Q16: customers buying more than one product (one row; none without won deals).

    The per-account groups include the NULL account (numerator, average, max)
    while total_customers counts distinct non-NULL accounts, as the original.
    """
    pairs = _won_pairs(model)
    per_account = pairs.groupBy("account").agg(F.count("product").alias("unique_products"))
    cross = C.sum_flag(F.col("unique_products") > 1)
    g = per_account.agg(
        cross.cast("double").alias("cross_sell_customers"),
        F.count("account").alias("total_customers"),
        C.percent(cross, F.count("account")).alias("cross_sell_rate"),
        C.mean("unique_products").alias("avg_products_per_customer"),
        F.max("unique_products").alias("max_products_per_customer"),
        F.count(F.lit(1)).alias("_groups"))
    return g.filter(F.col("_groups") > 0).drop("_groups")
