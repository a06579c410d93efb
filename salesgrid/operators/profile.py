"""Customer profiles: 360 view, touchpoints, column statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..plans import ranking
from ..plans.model import ACCOUNT_KEY, AGENT_KEY, CrmModel
from ..session import reliable_checkpoint


def customer_360(model: CrmModel, sort: bool = True) -> DataFrame:
    """Q21: account attributes with opportunity, won-deal, value and product counts.

    Grouped by account first (the five attributes are functions of the
    accounts key) and joined to accounts afterwards. The distinct counts are
    counts of distinct pairs, (account, opportunity) and, of won deals,
    (account, product), taken from one aggregate of the fact rows: no row is
    copied, and a hot account is split over its opportunities and products. An
    opportunity belongs to one account.
    """
    p = model.account_keyed_pipeline("opportunity_id", "deal_stage", "close_value", "close_date", "product")
    won = C.is_won()
    cells = reliable_checkpoint(p.groupBy(ACCOUNT_KEY, "opportunity_id", "product").agg(
        F.max(won).alias("_won"), F.sum(C.won_value()).alias("_value"),
        F.min(F.when(won, F.col("close_date"))).alias("_first"),
        F.max(F.when(won, F.col("close_date"))).alias("_last")))
    deals = cells.groupBy(ACCOUNT_KEY, "opportunity_id").agg(
        F.max("_won").alias("_won"), F.sum("_value").alias("_value"), F.min("_first").alias("_first"),
        F.max("_last").alias("_last"))
    keyed = deals.groupBy(ACCOUNT_KEY).agg(
        F.count("opportunity_id").alias("_opps"),
        F.count(F.when(F.col("_won"), F.col("opportunity_id"))).alias("_wins"),
        F.sum("_value").alias("_value"), F.min("_first").alias("_first"), F.max("_last").alias("_last"))
    g = model.account_names(keyed).groupBy("account").agg(
        F.sum("_opps").alias("total_opportunities"), F.sum("_wins").alias("won_deals"),
        F.sum("_value").cast("double").alias("lifetime_value"),
        F.min("_first").alias("first_purchase_date"), F.max("_last").alias("last_purchase_date"))
    bought = model.account_names(cells.filter("_won").select(ACCOUNT_KEY, "product").distinct())
    products = _pair_counts(bought, "product", "unique_products_purchased")
    acc = model.accounts().select("account", "sector", "year_established",
                                  F.col("revenue").alias("company_revenue"), "employees",
                                  "office_location")
    j = _with_counts(g, products, "unique_products_purchased").join(acc, "account", "left")
    out = j.select("account", "sector", "year_established", "company_revenue", "employees",
                   "office_location", "total_opportunities", "won_deals", "lifetime_value",
                   "first_purchase_date", "last_purchase_date", "unique_products_purchased")
    if sort:
        out = out.orderBy(F.col("lifetime_value").desc_nulls_last(), F.col("account").asc_nulls_last())
    return out


def _pair_counts(p: DataFrame, column: str, name: str) -> DataFrame:
    """Distinct values of ``column`` per account, by distinct pairs."""
    pairs = p.select("account", column).filter(F.col(column).isNotNull()).distinct()
    return pairs.groupBy(F.col("account").alias("_a")).agg(F.count(F.lit(1)).alias(name))


def _with_counts(g: DataFrame, counts: DataFrame, name: str) -> DataFrame:
    """Attach a per-account count; the NULL account is a group like any other."""
    return g.join(counts, F.col("account").eqNullSafe(F.col("_a")), "left").drop("_a") \
        .withColumn(name, F.coalesce(F.col(name), F.lit(0).cast("bigint")))


def touchpoints(model: CrmModel, sort: bool = True) -> DataFrame:
    """Q22: engagement-to-close days, distinct agents and products, per account (all stages).

    Distinct (account, agent key) and (account, product) pairs are counted;
    agents are named only after that, so fact rows never meet the agents' table.
    """
    p = model.account_keyed_pipeline(AGENT_KEY, "engage_date", "close_date", "product")
    d = C.day_diff("engage_date", "close_date")
    cells = reliable_checkpoint(p.groupBy(ACCOUNT_KEY, AGENT_KEY, "product").agg(
        F.sum(d).alias("_sum"), F.count(d).alias("_n"), F.min(d).alias("_lo"), F.max(d).alias("_hi")))
    keyed = cells.groupBy(ACCOUNT_KEY).agg(
        F.sum("_sum").alias("_sum"), F.sum("_n").alias("_n"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    g = model.account_names(keyed).groupBy("account").agg(
        (F.sum("_sum").cast("double") / C.nullif_zero(F.sum("_n")).cast("double"))
        .alias("avg_engagement_to_close_days"),
        F.min("_lo").alias("fastest_close_days"), F.max("_hi").alias("longest_close_days"))
    agents = model.account_names(model.agent_names(cells.select(ACCOUNT_KEY, AGENT_KEY).distinct()))
    products = model.account_names(cells.select(ACCOUNT_KEY, "product").distinct())
    g = _with_counts(g, _pair_counts(agents, "sales_agent", "unique_sales_agents"), "unique_sales_agents")
    g = _with_counts(g, _pair_counts(products, "product", "unique_products_considered"),
                     "unique_products_considered")
    g = g.select("account", "avg_engagement_to_close_days", "fastest_close_days", "longest_close_days",
                 "unique_sales_agents", "unique_products_considered")
    if sort:
        g = g.orderBy(F.col("avg_engagement_to_close_days").asc_nulls_last(),
                      F.col("account").asc_nulls_last())
    return g


def column_profile(df: DataFrame, columns: Sequence[str] | None = None,
                   quantiles: Sequence[float] = (0.25, 0.5, 0.75),
                   materialised: bool = False) -> DataFrame:
    """Q23: describe() + info() of a table, in long form (one row per column).

    count / null_count / dtype for every column; mean, sample std, min, exact
    interpolated quartiles and max for numeric ones (NULL otherwise);
    min_text and max_text for the others (NULL for numeric ones). One pass for
    the moments, one distributed sort of value counts for all the quartiles.
    """
    if not materialised:
        df = reliable_checkpoint(df)  # read by the moments pass and by the quartile sort
    cols = list(columns) if columns else df.columns
    types = {f.name: f.dataType for f in df.schema.fields}
    numeric = [c for c in cols if isinstance(types[c], T.NumericType)]

    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(cols):
        aggs.append(F.count(c).alias(f"_c{i}"))
        x = F.col(c).cast("double" if c in numeric else "string")
        aggs += [F.min(x).alias(f"_lo{i}"), F.max(x).alias(f"_hi{i}")]
        if c in numeric:
            aggs += [F.avg(x).alias(f"_m{i}"), F.stddev_samp(x).alias(f"_s{i}")]
    stats = df.agg(*aggs)
    rows = []
    for i, c in enumerate(cols):
        num = c in numeric
        null_d, null_s = F.lit(None).cast("double"), F.lit(None).cast("string")
        rows.append(F.struct(
            F.lit(i).alias("position"), F.lit(c).alias("column"),
            F.lit(types[c].simpleString()).alias("dtype"),
            F.col(f"_c{i}").alias("count"),
            (F.col("_n") - F.col(f"_c{i}")).alias("null_count"),
            (F.col(f"_m{i}") if num else null_d).alias("mean"),
            (F.col(f"_s{i}") if num else null_d).alias("std"),
            (F.col(f"_lo{i}") if num else null_d).alias("min"),
            (F.col(f"_hi{i}") if num else null_d).alias("max"),
            (null_s if num else F.col(f"_lo{i}")).alias("min_text"),
            (null_s if num else F.col(f"_hi{i}")).alias("max_text")))
    long = stats.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    labels = {float(v): f"p{int(round(v * 100))}" for v in quantiles}
    if numeric:
        q = ranking.percentiles(df, numeric, quantiles)
        qw = q.groupBy("column").agg(*[
            F.max(F.when(F.col("q") == F.lit(v), F.col("value"))).alias(lbl) for v, lbl in labels.items()])
        long = long.join(qw, "column", "left")
    else:
        for lbl in labels.values():
            long = long.withColumn(lbl, F.lit(None).cast("double"))
    return long.select("position", "column", "dtype", "count", "null_count", "mean", "std",
                       "min", *labels.values(), "max", "min_text", "max_text")
