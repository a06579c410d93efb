"""Segmentation and scoring: RFM, value segments, health score, churn risk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..plans import ranking
from ..plans.joins import single_row
from ..plans.model import CrmModel
from ..session import reliable_checkpoint
from . import _stats as S
from .retention import _as_of

# RFM segment rules, checked in this order; the first match wins.
# Each rule: (label, r condition, f condition, m condition) as (op, score).
RFM_RULES = (
    ("Champions", (">=", 4), (">=", 4), (">=", 4)),
    ("Loyal Customers", (">=", 4), (">=", 3), (">=", 3)),
    ("Potential Loyalist", (">=", 3), (">=", 1), (">=", 2)),
    ("New Customers", (">=", 4), ("<=", 2), ("<=", 2)),
    ("Promising", (">=", 3), ("<=", 2), ("<=", 2)),
    ("At Risk", ("<=", 2), (">=", 3), (">=", 3)),
    ("Needs Attention", ("<=", 2), (">=", 3), ("<=", 2)),
    ("Can't Lose Them", ("<=", 2), ("<=", 2), (">=", 3)),
    ("Hibernating", ("<=", 2), ("<=", 2), ("<=", 2)),
)
RFM_DEFAULT = "About to Sleep"

# Value segment labels (size above P75, frequency above P75).
VALUE_SEGMENTS = {
    (True, True): "High Value (Key Accounts)",
    (True, False): "Big Spenders (Low Frequency)",
    (False, True): "Regular Customers (Low Value)",
    (False, False): "Low Value (Growth Opportunity)",
}

# Health status tiers (greater or equal) and churn-risk tiers (greater).
HEALTH_TIERS = ((80, "Excellent"), (60, "Good"), (40, "Average"), (20, "At Risk"))
HEALTH_DEFAULT = "Critical"
CHURN_RISK_TIERS = ((365, "Very High Risk"), (180, "High Risk"), (90, "Medium Risk"),
                    (30, "Low Risk"))
CHURN_RISK_DEFAULT = "Very Low Risk"


def _cmp(col: str, rule) -> F.Column:
    op, v = rule
    return F.col(col) >= v if op == ">=" else F.col(col) <= v


def rfm_segments(model: CrmModel, as_of: str | None = None, tiles: int = 5,
                 sort: bool = True) -> DataFrame:
    """Recency / frequency / monetary quintiles and a named segment.

    NTILE orders: recency_days DESC, frequency ASC, monetary ASC; ties are
    broken by account (NULLs last) so the scores are deterministic. The three
    exact NTILEs share one distributed sort of narrow (score, value, account) rows.
    """
    as_of = _as_of(model, as_of)
    base = S.per_account(model, ("deal_stage", "close_date", "opportunity_id", "close_value"), {
        "_last": ("max", "close_date"), "frequency": ("count", "opportunity_id"),
        "monetary": ("sum", "close_value")}, C.is_won())
    base = base.select("account", C.days_since("_last", as_of).alias("recency_days"), "frequency", "monetary")
    base = reliable_checkpoint(base)
    scored = ranking.add_ntiles(base, "account", {
        "r_score": -F.col("recency_days"), "f_score": F.col("frequency"), "m_score": F.col("monetary")}, tiles)

    seg = None
    for label, r, f, m in RFM_RULES:
        cond = _cmp("r_score", r) & _cmp("f_score", f) & _cmp("m_score", m)
        seg = F.when(cond, F.lit(label)) if seg is None else seg.when(cond, F.lit(label))
    seg = seg.otherwise(F.lit(RFM_DEFAULT))
    out = scored.select(
        "account", "recency_days", "frequency",
        F.col("monetary").cast("double").alias("monetary"),
        "r_score", "f_score", "m_score",
        F.concat(F.col("r_score").cast("string"), F.col("f_score").cast("string"),
                 F.col("m_score").cast("string")).alias("rfm_cell"),
        seg.alias("customer_segment"))
    if sort:
        top = (F.col("r_score") >= 4) & (F.col("f_score") >= 4) & (F.col("m_score") >= 4)
        low = (F.col("r_score") <= 2) & (F.col("f_score") <= 2) & (F.col("m_score") <= 2)
        priority = F.when(top, 1).when(low, 9).otherwise(5)
        out = out.orderBy(priority, F.col("account").asc_nulls_last())
    return out


def value_segments(model: CrmModel, quantile: float = 0.75, sort: bool = True) -> DataFrame:
    """Q9: deal size and frequency per account against their P75 (exact, interpolated).

    Grouping by (account, sector, revenue) equals grouping by account and
    attaching the account's attributes afterwards, because ``account`` is the
    accounts key; so the fact table is aggregated first and joined after.
    """
    g = S.per_account(model, ("deal_stage", "close_value", "opportunity_id"), {
        "_sum": ("sum", "close_value"), "_n": ("count", "close_value"),
        "purchase_frequency": ("count", "opportunity_id")}, C.is_won())
    g = g.select("account", C.ratio("_sum", "_n").alias("avg_deal_size"), "purchase_frequency",
                 F.col("_sum").cast("double").alias("total_spend"))
    acc = model.accounts().select("account", "sector", "revenue")
    cv = reliable_checkpoint(g.join(acc, "account", "left"))
    pct = ranking.percentiles(cv, ["avg_deal_size", "purchase_frequency"], [quantile])
    thresholds = pct.groupBy().agg(
        F.max(F.when(F.col("column") == "avg_deal_size", F.col("value"))).alias("_p_size"),
        F.max(F.when(F.col("column") == "purchase_frequency", F.col("value"))).alias("_p_freq"))
    j = cv.crossJoin(single_row(thresholds))
    big = F.col("avg_deal_size") > F.col("_p_size")
    small = F.col("avg_deal_size") <= F.col("_p_size")
    often = F.col("purchase_frequency") > F.col("_p_freq")
    rarely = F.col("purchase_frequency") <= F.col("_p_freq")
    label = (F.when(big & often, F.lit(VALUE_SEGMENTS[(True, True)]))
             .when(big & rarely, F.lit(VALUE_SEGMENTS[(True, False)]))
             .when(small & often, F.lit(VALUE_SEGMENTS[(False, True)]))
             .otherwise(F.lit(VALUE_SEGMENTS[(False, False)])))
    out = j.select("account", "sector", "revenue", "avg_deal_size", "purchase_frequency",
                   "total_spend", label.alias("value_segment"))
    if sort:
        out = out.orderBy(F.col("total_spend").desc_nulls_last(), F.col("account").asc_nulls_last())
    return out


def health_score(model: CrmModel, as_of: str | None = None,
                 weights: tuple[float, float, float] = (0.4, 0.3, 0.3),
                 tiers=HEALTH_TIERS, default: str = HEALTH_DEFAULT, sort: bool = True) -> DataFrame:
    """Q19: weighted, max-normalised recency / frequency / monetary score at ``as_of``.

    ``as_of`` is required, here or as the model's parameter (the original takes
    the current date). A maximum of 0 makes its normalised score NULL.

    recency score = 1000 / days since last purchase (NULL on day 0, which
    makes the health score NULL and the status the default tier). The three
    maxima are one global aggregate, broadcast as a single row.
    """
    as_of = as_of or model.param("as_of")
    if as_of is None:
        raise ValueError("health_score needs an as_of date")
    comp = S.per_account(model, ("deal_stage", "close_date", "opportunity_id", "close_value"), {
        "_last": ("max", "close_date"), "frequency_score": ("count", "opportunity_id"),
        "_sum": ("sum", "close_value")}, C.is_won())
    comp = comp.select("account", C.days_since("_last", as_of).alias("_days"), "frequency_score",
                       F.col("_sum").cast("double").alias("monetary_score"))
    comp = comp.select("account",
                       ((F.lit(1.0) / C.nullif_zero("_days").cast("double")) * F.lit(1000.0))
                       .alias("recency_score"),
                       "frequency_score", "monetary_score")
    comp = reliable_checkpoint(comp)
    mx = comp.agg(F.max("recency_score").alias("_mr"), F.max("frequency_score").alias("_mf"),
                  F.max("monetary_score").alias("_mm"))
    j = comp.crossJoin(single_row(mx))
    nr = (F.col("recency_score") / C.nullif_zero("_mr")) * F.lit(100.0)
    nf = (F.col("frequency_score").cast("double") / C.nullif_zero("_mf").cast("double")) * F.lit(100.0)
    nm = (F.col("monetary_score") / C.nullif_zero("_mm")) * F.lit(100.0)
    n = j.select("account", nr.alias("norm_recency"), nf.alias("norm_frequency"),
                 nm.alias("norm_monetary"))
    wr, wf, wm = (F.lit(float(w)) for w in weights)
    score = wr * F.col("norm_recency") + wf * F.col("norm_frequency") + wm * F.col("norm_monetary")
    out = n.select("account", "norm_recency", "norm_frequency", "norm_monetary",
                   score.alias("health_score"))
    out = out.withColumn("health_status", C.tiered("health_score", tiers, default, op=">="))
    if sort:
        out = out.orderBy(F.col("health_score").desc_nulls_last(), F.col("account").asc_nulls_last())
    return out


def churn_risk(model: CrmModel, as_of: str | None = None, day_weight: float = 0.6,
               count_weight: float = 0.2, value_weight: float = 0.001,
               tiers=CHURN_RISK_TIERS, default: str = CHURN_RISK_DEFAULT,
               sort: bool = True) -> DataFrame:
    """Q20: days-since-purchase risk damped by purchase count and average value.

    score = days * w_d / (count * w_c + avg_value * w_v + 1), with NULLIF on the
    count and average value (an average of 0 makes the score NULL).
    """
    as_of = _as_of(model, as_of)
    g = S.per_account(model, ("deal_stage", "close_date", "engage_date", "opportunity_id", "close_value"), {
        "last_purchase_date": ("max", "close_date"), "purchase_count": ("count", "opportunity_id"),
        "_days": ("sum", "cycle_days"), "_timed": ("count", "cycle_days"), "_sum": ("sum", "close_value"),
        "_n": ("count", "close_value")}, C.is_won())
    g = g.select("account", "last_purchase_date", "purchase_count", C.ratio("_days", "_timed").alias("avg_sales_cycle"),
                 C.ratio("_sum", "_n").alias("avg_purchase_value"))
    g = g.withColumn("days_since_purchase", C.days_since("last_purchase_date", as_of))
    den = (C.nullif_zero("purchase_count").cast("double") * F.lit(float(count_weight))
           + C.nullif_zero("avg_purchase_value") * F.lit(float(value_weight)) + F.lit(1.0))
    score = (F.col("days_since_purchase").cast("double") * F.lit(float(day_weight))) / den
    out = g.select("account", "last_purchase_date", "days_since_purchase", "purchase_count",
                   "avg_sales_cycle", "avg_purchase_value", score.alias("churn_risk_score"),
                   C.tiered("days_since_purchase", tiers, default).alias("churn_risk_level"))
    if sort:
        out = out.orderBy(F.col("churn_risk_score").desc_nulls_last(), F.col("account").asc_nulls_last())
    return out
