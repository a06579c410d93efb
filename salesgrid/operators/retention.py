"""Retention metrics: churn status, repeat purchases, cohorts, period retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..plans.joins import single_row
from ..plans.model import CrmModel
from ..session import reliable_checkpoint
from . import _stats as S

DEFAULT_AS_OF = "2018-04-15"

# Churn tiers in days since last purchase (strictly greater than).
CHURN_TIERS = ((365, "Churned"), (180, "At Risk"), (90, "Needs Attention"))
CHURN_DEFAULT = "Active"

# Cohort month offsets reported by the cohort table.
COHORT_MONTHS = (0, 1, 2, 3, 6, 12)


def _as_of(model: CrmModel, as_of):
    return as_of or model.param("as_of", DEFAULT_AS_OF)


def churn_status(model: CrmModel, as_of: str | None = None,
                 tiers=CHURN_TIERS, default: str = CHURN_DEFAULT, sort: bool = True) -> DataFrame:
    """Q4: first/last purchase, days since last purchase and a retention label."""
    as_of = _as_of(model, as_of)
    g = S.per_account(model, ("deal_stage", "close_date", "opportunity_id"), {
        "first_purchase_date": ("min", "close_date"), "last_purchase_date": ("max", "close_date"),
        "purchase_count": ("count", "opportunity_id")}, C.is_won())
    out = g.select("account", "first_purchase_date", "last_purchase_date",
                   C.days_since("last_purchase_date", as_of).alias("days_since_last_purchase"),
                   "purchase_count")
    out = out.withColumn("retention_status", C.tiered("days_since_last_purchase", tiers, default))
    if sort:
        out = out.orderBy(F.col("days_since_last_purchase").desc_nulls_last(),
                          F.col("account").asc_nulls_last())
    return out


def purchase_counts(model: CrmModel) -> DataFrame:
    """Q5: number of won deals per account (the NULL account is its own group)."""
    return S.per_account(model, ("deal_stage", "opportunity_id"),
                         {"purchase_count": ("count", "opportunity_id")}, C.is_won())


def repeat_purchase_rate(model: CrmModel) -> DataFrame:
    """Q6: accounts with more than one won deal, out of all buying groups (one row)."""
    pc = purchase_counts(model)
    repeat = C.sum_flag(F.col("purchase_count") > 1)
    return pc.agg(
        repeat.cast("double").alias("repeat_customers"),
        F.count(F.lit(1)).alias("total_customers"),
        ((repeat.cast("double") / C.nullif_zero(F.count(F.lit(1))).cast("double"))
         * F.lit(100.0)).alias("repeat_purchase_rate"),
    )


def _account_months(model: CrmModel) -> DataFrame:
    """Won deals per (account, calendar month) with the account's first month.

    The fact table is pre-aggregated to one row per account-month before the
    window, so a window partition holds at most one row per month of history
    however many deals a hot account has.
    """
    m = S.per_account(model, ("deal_stage", "close_date"), {"deals": ("count", "rows")}, C.is_won(),
                      {"ym": C.month_index("close_date")}).filter(F.col("account").isNotNull())
    return m.withColumn("first_ym", F.min("ym").over(Window.partitionBy("account")))


def cohort_retention(model: CrmModel, months: Sequence[int] = COHORT_MONTHS,
                     distinct_customers: bool = False, sort: bool = True) -> DataFrame:
    """Acquisition-month cohorts and activity N months after acquisition.

    ``month_N`` counts won *deals* in month N (as the original does), so it can
    exceed ``cohort_size``; ``distinct_customers=True`` counts accounts instead.
    Accounts whose won deals have no close date form a cohort with NULL year and month.
    """
    m = _account_months(model)
    since = F.col("ym") - F.col("first_ym")
    weight = F.lit(1) if distinct_customers else F.col("deals")
    # An account has one row in its first month; in the cohort without dates, it has one row.
    is_first = F.col("ym").eqNullSafe(F.col("first_ym"))
    aggs = [F.count(F.when(is_first, F.lit(1))).alias("cohort_size")]
    aggs += [F.sum(F.when(since == n, weight).otherwise(F.lit(0))).cast("bigint").alias(f"month_{n}")
             for n in months]
    g = m.groupBy("first_ym").agg(*aggs)
    out = g.select(
        F.floor(F.col("first_ym") / 12).cast("bigint").alias("acquisition_year"),
        (F.col("first_ym") % 12 + 1).cast("bigint").alias("acquisition_month"),
        "cohort_size", *[f"month_{n}" for n in months])
    if sort:
        out = out.orderBy("acquisition_year", "acquisition_month")
    return out


def cohort_retention_long(model: CrmModel, months: Sequence[int] = COHORT_MONTHS,
                          distinct_customers: bool = False, sort: bool = True) -> DataFrame:
    """Q8: the cohort table unpivoted for a heat map: one row per cohort and month."""
    wide = cohort_retention(model, months, distinct_customers, sort=False)
    long = wide.unpivot(["acquisition_year", "acquisition_month", "cohort_size"],
                        [f"month_{n}" for n in months], "month_label", "active_customers")
    out = long.select(
        F.concat(F.col("acquisition_year").cast("string"), F.lit("-"),
                 F.lpad(F.col("acquisition_month").cast("string"), 2, "0")).alias("cohort"),
        F.regexp_replace("month_label", "month_", "").cast("int").alias("month"),
        (C.ratio("active_customers", "cohort_size") * F.lit(100.0)).alias("retention_rate"),
        "active_customers", "cohort_size")
    if sort:
        out = out.orderBy("cohort", "month")
    return out


_GRANULARITY = {
    # period index of a date, and the first day of a period index
    "year": (lambda d: F.year(d).cast("bigint"),
             lambda i: F.make_date(i.cast("int"), F.lit(1), F.lit(1))),
    "quarter": (lambda d: F.year(d).cast("bigint") * 4 + F.floor((F.month(d) - 1) / 3).cast("bigint"),
                lambda i: F.make_date(F.floor(i / 4).cast("int"), ((i % 4) * 3 + 1).cast("int"), F.lit(1))),
    "month": (lambda d: C.month_index(d),
              lambda i: F.make_date(F.floor(i / 12).cast("int"), (i % 12 + 1).cast("int"), F.lit(1))),
}


def active_periods(model: CrmModel, granularity: str = "year") -> DataFrame:
    """Distinct (account, period) pairs of accounts with a won deal closing in the period."""
    to_idx, _ = _GRANULARITY[granularity]
    return S.per_account(model, ("deal_stage", "close_date"), {}, C.is_won() & F.col("close_date").isNotNull(),
                         {"period": to_idx(F.col("close_date"))}).filter(F.col("account").isNotNull())


def period_retention(model: CrmModel, granularity: str = "year", sort: bool = True) -> DataFrame:
    """D3: retention = (end - new) / start and churn = lost / start, per period.

    Customers of a period are the accounts with a won deal closing in it.
    retained = active in both the previous and this period; lost = active in
    the previous period only; new = active in this period only (reactivated
    accounts count as new, so churn = 1 - retention). Periods run from the
    second observed period to the last.
    """
    ap = active_periods(model, granularity)
    return retention_from_active_periods(ap, granularity, sort)


def pooled_retention(ap: DataFrame, rate: str = "_r") -> DataFrame:
    """One row: retained customers over customers at period start, summed over all periods of D3,
    from distinct (account, period) pairs. One pass: no calendar is needed for the pooled rate.
    """
    w = Window.partitionBy("account").orderBy("period")
    kept = ap.select("period", (F.lag("period").over(w) == F.col("period") - 1).alias("_kept"))
    per = kept.groupBy("period").agg(F.count(F.lit(1)).alias("_active"), C.sum_flag(F.col("_kept")).alias("_retained"))
    # Customers at the start of a period are those of the one before; the last one starts none.
    last = F.max("period").over(Window.partitionBy())
    flagged = per.select("_active", "_retained", (F.col("period") < last).alias("_starts"))
    return flagged.agg(C.ratio(F.sum("_retained"), F.sum(F.when(F.col("_starts"), F.col("_active")))).alias(rate))


def retention_from_active_periods(ap: DataFrame, granularity: str = "year",
                                  sort: bool = True) -> DataFrame:
    """D3 from distinct (account, period) pairs of accounts with a won deal."""
    _, to_start = _GRANULARITY[granularity]
    w = Window.partitionBy("account").orderBy("period")
    flagged = ap.select("period",
                        (F.lag("period").over(w) == F.col("period") - 1).alias("_kept"),
                        (F.lead("period").over(w) == F.col("period") + 1).alias("_stays"))
    # Each (account, period) contributes to its own period and to the next one.
    contrib = flagged.select(F.explode(F.array(
        F.struct(F.col("period").alias("period"), F.lit(0).alias("start"), F.lit(1).alias("end"),
                 F.when(F.coalesce("_kept", F.lit(False)), 1).otherwise(0).alias("retained"),
                 F.when(F.coalesce("_kept", F.lit(False)), 0).otherwise(1).alias("new"),
                 F.lit(0).alias("lost")),
        F.struct((F.col("period") + 1).alias("period"), F.lit(1).alias("start"), F.lit(0).alias("end"),
                 F.lit(0).alias("retained"), F.lit(0).alias("new"),
                 F.when(F.coalesce("_stays", F.lit(False)), 0).otherwise(1).alias("lost")),
    )).alias("c")).select("c.*")
    g = contrib.groupBy("period").agg(
        F.sum("start").cast("bigint").alias("customers_start"),
        F.sum("end").cast("bigint").alias("customers_end"),
        F.sum("new").cast("bigint").alias("new_customers"),
        F.sum("retained").cast("bigint").alias("retained_customers"),
        F.sum("lost").cast("bigint").alias("lost_customers"))
    # Every period from the second observed one to the last, empty ones included
    # (bounded by the date span, not by the data volume).
    # One row per period, read twice below: materialise it once so the fact
    # table is not scanned a second time for the observed span.
    g = reliable_checkpoint(g)
    observed = F.when(F.col("customers_end") > 0, F.col("period"))
    span = g.agg(F.min(observed).alias("_lo"), F.max(observed).alias("_hi"))
    periods = single_row(span).select(F.explode(F.when(
        F.col("_hi") > F.col("_lo"), F.sequence(F.col("_lo") + 1, F.col("_hi"))
    ).otherwise(F.array().cast("array<bigint>"))).alias("period"))
    counts = ["customers_start", "customers_end", "new_customers", "retained_customers",
              "lost_customers"]
    g = periods.join(g, "period", "left").select(
        "period", *[F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c) for c in counts])
    out = g.select(
        to_start(F.col("period")).alias("period_start"),
        "customers_start", "customers_end", "new_customers", "retained_customers", "lost_customers",
        C.ratio(F.col("customers_end") - F.col("new_customers"), "customers_start")
        .alias("retention_rate"),
        C.ratio("lost_customers", "customers_start").alias("churn_rate"))
    if sort:
        out = out.orderBy("period_start")
    return out
