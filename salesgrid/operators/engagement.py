"""Metrics over interactions: lead and funnel conversion, first contact to purchase, engagement, full health score.

Interactions are rows of (account, contact_id, contact_time, channel, value); the
model brings them (``CrmModel.interactions``). Everything per account is first
reduced to (account, day, channel) counts or to one row a (account, time range),
so that a hot account is no task of its own (``plans.timeline``).
"""

from __future__ import annotations

from collections.abc import Sequence
from math import log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..plans import ranking
from ..plans.joins import single_row
from ..plans.model import CrmModel
from ..plans.timeline import DAY, asof_join, chain_levels, previous_second
from ..session import reliable_checkpoint
from . import _stats as S
from .segmentation import HEALTH_DEFAULT, HEALTH_TIERS

# The steps of a visit that ends in a purchase, and the channels that are no support case.
FUNNEL = ("view", "click", "signup", "purchase")
SUPPORT = "error"

_TERM = "decimal(38,12)"      # sums of real numbers are exact, whatever the order


def funnel(model: CrmModel, steps: Sequence[str] = FUNNEL, within_days: float = 90.0, by: str | None = None,
           sort: bool = True) -> DataFrame:
    """Conversion over visitors: accounts that get to each step, in order, within a window.

    One row a step (and per account attribute ``by``): accounts that reach it, as
    a share of all visitors and of those at the step before. Visitors are all
    accounts with an interaction; contacts without an account are left out.
    """
    levels = chain_levels(model.interactions(), "account", "contact_time", "contact_id", "channel", steps,
                          int(within_days * DAY))
    group = [by] if by else []
    if by:
        levels = levels.join(model.accounts().select("account", by), "account", "left")
    counts = levels.groupBy(*group).agg(F.count(F.lit(1)).alias("visitors"), *[
        C.count_when(F.col("level") >= j).alias(f"_n{j}") for j in range(1, len(steps) + 1)])
    reached = F.explode(F.array(*[
        F.struct(F.lit(j).alias("step"), F.lit(s).alias("channel"), F.col(f"_n{j}").alias("accounts"),
                 (F.col(f"_n{j - 1}") if j > 1 else F.col("visitors")).alias("_from"))
        for j, s in enumerate(steps, 1)]))
    out = counts.select(*group, "visitors", reached.alias("r")).select(
        *group, "r.step", "r.channel", "visitors", "r.accounts",
        C.percent("r.accounts", "visitors").alias("conversion_rate"), C.percent("r.accounts", "r._from").alias("step_rate"))
    return out.orderBy(*[F.col(c).asc_nulls_last() for c in group], "step") if sort else out


def _first_contacts(model: CrmModel) -> DataFrame:
    return model.interactions().filter("account IS NOT NULL AND contact_time IS NOT NULL").groupBy("account").agg(
        F.min("contact_time").cast("date").alias("first_contact"))


def lead_conversion(model: CrmModel, by: str = "sector", sort: bool = True) -> DataFrame:
    """Conversion over leads: accounts with a contact, and how many of them bought on or after the first one.

    One row per account attribute ``by``.
    """
    days = S.per_account(model, ("deal_stage", "close_date"), {"_last": ("max", "close_date")}, C.is_won()) \
        .filter(F.col("account").isNotNull())
    leads = _first_contacts(model).join(days, "account", "left").join(model.accounts().select("account", by), "account", "left")
    bought = F.col("_last") >= F.col("first_contact")
    out = leads.groupBy(by).agg(F.count(F.lit(1)).alias("leads"), C.sum_flag(bought).alias("customers"))
    out = out.select(by, "leads", "customers", C.percent("customers", "leads").alias("conversion_rate"))
    return out.orderBy(F.col("conversion_rate").desc_nulls_last(), F.col(by).asc_nulls_last()) if sort else out


def contact_to_purchase(model: CrmModel) -> DataFrame:
    """One row a won deal: the account's first contact, the latest one up to the close day, and the days from each.

    Contacts count up to the end of the close day. Deals without an account, or
    closed before any contact, have NULLs.
    """
    won = model.pipeline("opportunity_id", "account", "deal_stage", "close_date").filter(C.is_won()) \
        .select("opportunity_id", "account", "close_date", F.expr("CAST(date_add(close_date, 1) AS TIMESTAMP_NTZ)").alias("_end"))
    contacts = model.interactions().withColumn("last_contact", F.col("contact_time").cast("date")) \
        .withColumnRenamed("channel", "last_channel")
    latest = asof_join(won, contacts, "account", "_end", "contact_time", "contact_id", ["last_contact", "last_channel"],
                       strict=True).drop("_end")
    first = _first_contacts(model)
    out = latest.join(first, "account", "left")
    before = F.col("last_contact").isNotNull()      # else the first contact came after the purchase
    return out.select("opportunity_id", "account", "close_date", F.when(before, F.col("first_contact")).alias("first_contact"),
                      "last_contact", "last_channel",
                      F.when(before, C.day_diff("first_contact", "close_date")).alias("days_from_first_contact"),
                      C.day_diff("last_contact", "close_date").alias("days_from_last_contact"))


def contact_cycle(model: CrmModel) -> DataFrame:
    """Sales cycle from first contact to the first purchase after it, over accounts (one row, exact median)."""
    bought = S.per_account(model, ("deal_stage", "close_date"), {}, C.is_won() & F.col("close_date").isNotNull(),
                           {"close_date": F.col("close_date")})
    first = bought.join(_first_contacts(model), "account").filter(F.col("close_date") >= F.col("first_contact")) \
        .groupBy("account", "first_contact").agg(F.min("close_date").alias("_bought"))
    days = reliable_checkpoint(first.select(C.day_diff("first_contact", "_bought").alias("days")))
    median = ranking.percentiles(days, ["days"], [0.5]).groupBy().agg(F.max("value").alias("median_days"))
    stats = days.agg(F.count("days").alias("customers"), C.mean("days").alias("avg_days"), F.min("days").alias("min_days"),
                     F.max("days").alias("max_days"))
    return stats.crossJoin(single_row(median)).select("customers", "avg_days", "min_days", "max_days", "median_days")


def sessions(model: CrmModel, gap_minutes: float = 2880.0, sort: bool = True) -> DataFrame:
    """Sessions per account: runs of contacts with no gap longer than ``gap_minutes`` between them."""
    contacts = model.interactions().filter("account IS NOT NULL AND contact_time IS NOT NULL") \
        .select("account", "contact_time", "contact_id")
    r = previous_second(contacts, "account", "contact_time", "contact_id")
    pause = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', contact_time)") - F.col("previous_second")
    goes_on = F.coalesce(pause <= F.lit(int(gap_minutes * 60)), F.lit(False))
    out = r.groupBy("account").agg(F.count(F.lit(1)).alias("contacts"), C.sum_flag(~goes_on).alias("sessions"),
                                   F.coalesce(F.sum(F.when(goes_on, pause)), F.lit(0)).alias("_seconds"))
    out = out.select("account", "contacts", "sessions", C.ratio("contacts", "sessions").alias("contacts_per_session"),
                     (C.ratio("_seconds", "sessions") / F.lit(60.0)).alias("avg_session_minutes"))
    return out.orderBy(F.col("sessions").desc(), "account") if sort else out


def _activity(model: CrmModel, as_of: str, half_life_days: float, n_channels: int) -> DataFrame:
    """Per account up to ``as_of``: time-decayed contacts and support cases, and the spread over channels."""
    days = model.interactions().filter(F.col("account").isNotNull()) \
        .groupBy("account", "channel", F.col("contact_time").cast("date").alias("_day")).agg(F.count(F.lit(1)).alias("_n")) \
        .filter(F.col("_day") <= F.lit(as_of).cast("date"))
    weight = (F.col("_n").cast("double") * F.pow(F.lit(0.5), C.days_since("_day", as_of).cast("double") / F.lit(float(half_life_days)))) \
        .cast(_TERM)
    support = F.col("channel").eqNullSafe(SUPPORT)
    per_channel = days.groupBy("account", "channel").agg(F.sum("_n").alias("_n"), F.sum(weight).alias("_w"))
    totals = per_channel.groupBy("account").agg(
        F.sum("_n").alias("_all"), F.sum(F.when(~support, F.col("_w"))).alias("_rate"), F.sum("_w").alias("_weight"),
        F.sum(F.when(support, F.col("_w"))).alias("_support"))
    share = F.col("_n").cast("double") / F.col("_all").cast("double")
    spread = per_channel.join(totals.select("account", "_all"), "account").groupBy("account") \
        .agg(F.sum((-share * F.log(share)).cast(_TERM)).alias("_h"))
    burden = F.coalesce(F.col("_support"), F.lit(0)).cast("double") / C.nullif_zero("_weight").cast("double")
    return totals.join(spread, "account").select(
        "account", F.col("_all").alias("contacts"), F.coalesce(F.col("_rate"), F.lit(0)).cast("double").alias("interaction_rate"),
        (F.col("_h").cast("double") / F.lit(log(n_channels))).alias("channel_diversity"),
        (F.lit(1.0) - F.coalesce(burden, F.lit(0.0))).alias("support_health"))


def _components(model: CrmModel, as_of: str | None, half_life_days: float, n_channels: int) -> DataFrame:
    """Per account with won deals: normalised (0 to 100) recency, frequency, monetary value, interaction rate,
    channel diversity and support health. Accounts without contacts have no rate or diversity and no support cases."""
    as_of = as_of or model.param("as_of")
    if as_of is None:
        raise ValueError("an as_of date is needed")
    deals = S.per_account(model, ("deal_stage", "close_date", "opportunity_id", "close_value"), {
        "_last": ("max", "close_date"), "_f": ("count", "opportunity_id"), "_sum": ("sum", "close_value")}, C.is_won()) \
        .filter(F.col("account").isNotNull())
    fresh = F.lit(1000.0) / C.nullif_zero(C.days_since("_last", as_of)).cast("double")
    parts = deals.select("account", fresh.alias("_r"), F.col("_f").cast("double").alias("_f"), F.col("_sum").cast("double").alias("_m")) \
        .join(_activity(model, as_of, half_life_days, n_channels), "account", "left") \
        .select("account", "_r", "_f", "_m", F.coalesce("contacts", F.lit(0)).alias("contacts"),
                F.coalesce("interaction_rate", F.lit(0.0)).alias("_i"), F.coalesce("channel_diversity", F.lit(0.0)).alias("_d"),
                F.coalesce("support_health", F.lit(1.0)).alias("_s"))
    parts = reliable_checkpoint(parts)
    most = parts.agg(*[F.max(c).alias(f"{c}_max") for c in ("_r", "_f", "_m", "_i")])
    norm = lambda c: (F.col(c) / C.nullif_zero(f"{c}_max")) * F.lit(100.0)
    return parts.crossJoin(single_row(most)).select(
        "account", "contacts", norm("_r").alias("norm_recency"), norm("_f").alias("norm_frequency"), norm("_m").alias("norm_monetary"),
        F.coalesce(norm("_i"), F.lit(0.0)).alias("norm_interaction"), (F.col("_d") * F.lit(100.0)).alias("norm_diversity"),
        (F.col("_s") * F.lit(100.0)).alias("norm_support"))


def _weighted(weights: Sequence[float], columns: Sequence[str]):
    total = F.lit(0.0)
    for w, c in zip(weights, columns):
        total = total + F.lit(float(w)) * F.col(c)
    return total


_ENGAGEMENT = ("norm_frequency", "norm_recency", "norm_interaction", "norm_diversity")


def engagement_score(model: CrmModel, as_of: str | None = None, weights: Sequence[float] = (0.3, 0.2, 0.3, 0.2),
                     half_life_days: float = 180.0, n_channels: int = 5, sort: bool = True) -> DataFrame:
    """Weighted purchase frequency, recency, interaction rate and channel diversity, each from 0 to 100."""
    out = _components(model, as_of, half_life_days, n_channels).select(
        "account", "contacts", *_ENGAGEMENT, _weighted(weights, _ENGAGEMENT).alias("engagement_score"))
    return out.orderBy(F.col("engagement_score").desc_nulls_last(), "account") if sort else out


def full_health_score(model: CrmModel, as_of: str | None = None, weights: Sequence[float] = (0.3, 0.2, 0.2, 0.2, 0.1),
                      half_life_days: float = 180.0, n_channels: int = 5, tiers=HEALTH_TIERS, default: str = HEALTH_DEFAULT,
                      sort: bool = True) -> DataFrame:
    """Health score with all five terms: recency, frequency, monetary value, engagement and support.

    Engagement is the mean of interaction rate and channel diversity, support the
    time-decayed share of contacts that are no support cases.
    """
    parts = _components(model, as_of, half_life_days, n_channels).withColumn(
        "norm_engagement", (F.col("norm_interaction") + F.col("norm_diversity")) / F.lit(2.0))
    terms = ("norm_recency", "norm_frequency", "norm_monetary", "norm_engagement", "norm_support")
    out = parts.select("account", *terms, _weighted(weights, terms).alias("health_score"))
    out = out.withColumn("health_status", C.tiered("health_score", tiers, default, op=">="))
    return out.orderBy(F.col("health_score").desc_nulls_last(), "account") if sort else out
