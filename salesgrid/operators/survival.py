"""Churn probability from discrete-time hazards of the next purchase.

Time runs in months. An account's active months (months with a won deal) cut its
history into spells: one from each active month to the next, and one from the
last to the end of observation, which is censored there, not counted as churn. A
spell is described by what was known at its start only (how many active months
the account had by then), so nothing looks ahead.

``hazard_table`` is the life table of the spells: it needs no row per account and
month, only the histogram of spell lengths. ``fit_hazard`` smooths it into a
logistic hazard of the logarithms of both. ``churn_probability`` turns either
into the probability that an account makes no purchase in the coming months,
given the months it has already been without one. ``backtest`` fits on the
spells as they looked at an earlier month and scores what followed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..plans.model import CrmModel
from ..session import reliable_checkpoint
from . import _stats as S

CLASSES = (1, 2, 4, 8)      # least number of active months of each frequency class


def _end_month(model: CrmModel, as_of: str | None) -> tuple[str, int]:
    as_of = str(as_of or model.param("as_of"))
    year, month = int(as_of[:4]), int(as_of[5:7])
    return as_of, 12 * year + month - 1


def active_months(model: CrmModel) -> DataFrame:
    """(account, ym): months in which the account has a won deal; at most a row for each calendar month."""
    return S.per_account(model, ("deal_stage", "close_date"), {}, C.is_won() & F.col("close_date").isNotNull(),
                         {"ym": C.month_index("close_date")}).filter(F.col("account").isNotNull())


def spells(months: DataFrame, until: int) -> DataFrame:
    """account, ym, seen (active months so far), gap (months to the next, or to ``until``) and bought (it ended with a purchase).

    Months after ``until`` are left out before anything is computed. A spell censored after 0 months is none.
    """
    w = Window.partitionBy("account").orderBy("ym")
    known = months.filter(F.col("ym") <= until)
    following = F.lead("ym").over(w)
    s = known.select("account", "ym", F.row_number().over(w).cast("bigint").alias("seen"),
                     (F.coalesce(following, F.lit(until)) - F.col("ym")).alias("gap"), following.isNotNull().alias("bought"))
    return s.filter("gap > 0")


def frequency_class(seen, classes: Sequence[int] = CLASSES) -> Column:
    """The largest of ``classes`` that is not above ``seen``."""
    return F.greatest(*[F.when(C._col(seen) >= c, c) for c in classes], F.lit(classes[0])).cast("bigint")


def hazard_table(model: CrmModel, as_of: str | None = None, classes: Sequence[int] = CLASSES,
                 sort: bool = True, _spells: DataFrame | None = None) -> DataFrame:
    """Life table: for each frequency class and month since the last purchase, spells at risk, purchases, hazard, survival.

    At risk in month t are the spells that last at least t months, censored ones
    included. ``survival`` is the probability of no purchase up to month t.
    """
    s = spells(active_months(model), _end_month(model, as_of)[1]) if _spells is None else _spells
    lengths = s.groupBy(frequency_class("seen", classes).alias("frequency_class"), F.col("gap").alias("month")).agg(
        F.count(F.lit(1)).alias("_n"), C.sum_flag(F.col("bought")).alias("purchases"))
    later = Window.partitionBy("frequency_class").orderBy(F.col("month").desc())
    h = lengths.withColumn("at_risk", F.sum("_n").over(later))
    # every month up to the longest spell of the class, also those in which none ends
    upto = Window.partitionBy("frequency_class").orderBy("month")
    h = h.withColumn("_from", F.coalesce(F.lag("month").over(upto), F.lit(0)) + 1)
    h = h.select("frequency_class", F.explode(F.sequence("_from", "month")).alias("t"), "month", "at_risk", "purchases") \
        .select("frequency_class", F.col("t").alias("month"), "at_risk",
                F.when(F.col("t") == F.col("month"), F.col("purchases")).otherwise(0).cast("bigint").alias("purchases"))
    hazard = C.ratio("purchases", "at_risk")
    log_survival = F.sum(F.log(F.when(hazard < 1.0, F.lit(1.0) - hazard))).over(upto)
    nobody = F.max(hazard).over(upto) >= 1.0
    out = h.select("frequency_class", "month", "at_risk", "purchases", hazard.alias("hazard"),
                   F.when(nobody, 0.0).otherwise(F.exp(F.coalesce(log_survival, F.lit(0.0)))).alias("survival"))
    return out.orderBy("frequency_class", "month") if sort else out


@dataclass(frozen=True)
class Hazard:
    """Logistic hazard: intercept and weights of ln(months since the last purchase) and ln(active months so far)."""

    intercept: float
    month: float
    seen: float


def fit_hazard(spell_rows: DataFrame, max_iter: int = 50, ridge: float = 1e-4) -> Hazard:
    """Maximum likelihood over all account-months of the spells, counted by (month, active months so far).

    The fit reads one row for each such pair, of which there are at most the square of the number of months.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    counts = spell_rows.groupBy("seen", "gap").agg(F.count(F.lit(1)).alias("_n"), C.sum_flag(F.col("bought")).alias("_b"))
    later = Window.partitionBy("seen").orderBy(F.col("gap").desc())
    upto = Window.partitionBy("seen").orderBy("gap")
    cells = counts.withColumn("_risk", F.sum("_n").over(later)).withColumn("_from", F.coalesce(F.lag("gap").over(upto), F.lit(0)) + 1) \
        .select("seen", "gap", "_b", "_risk", F.explode(F.sequence("_from", "gap")).alias("t"))
    bought = F.when(F.col("t") == F.col("gap"), F.col("_b")).otherwise(0)
    rows = cells.select("seen", "t", F.explode(F.array(
        F.struct(F.lit(1.0).alias("label"), bought.cast("double").alias("weight")),
        F.struct(F.lit(0.0).alias("label"), (F.col("_risk") - bought).cast("double").alias("weight")))).alias("r")) \
        .filter("r.weight > 0").select(F.log(F.col("t").cast("double")).alias("x1"), F.log(F.col("seen").cast("double")).alias("x2"), "r.*")
    rows = reliable_checkpoint(rows)
    kinds = {r.label for r in rows.select("label").distinct().collect()}
    if kinds != {0.0, 1.0}:
        raise ValueError("a hazard needs spells that ended with a purchase and months without one")
    fitted = LogisticRegression(weightCol="weight", maxIter=max_iter, regParam=ridge, tol=1e-8).fit(
        VectorAssembler(inputCols=["x1", "x2"], outputCol="features").transform(rows))
    return Hazard(float(fitted.intercept), float(fitted.coefficients[0]), float(fitted.coefficients[1]))


def _open_spells(months: DataFrame, until: int) -> DataFrame:
    """account, seen, idle: each account's active months so far, and the months since the last."""
    return months.filter(F.col("ym") <= until).groupBy("account").agg(
        F.count(F.lit(1)).alias("seen"), (F.lit(until) - F.max("ym")).cast("bigint").alias("idle"))


def _no_purchase(hazard: Hazard, horizon: int) -> Column:
    """Product over the coming months of one minus the hazard."""
    def stay(acc, k):
        z = F.lit(hazard.intercept) + F.lit(hazard.month) * F.log((F.col("idle") + k).cast("double")) \
            + F.lit(hazard.seen) * F.log(F.col("seen").cast("double"))
        return acc * (F.lit(1.0) / (F.lit(1.0) + F.exp(z)))
    return F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), F.lit(1.0), stay)


def churn_probability(model: CrmModel, as_of: str | None = None, horizon: int = 6, hazard: Hazard | None = None,
                      classes: Sequence[int] = CLASSES, sort: bool = True) -> DataFrame:
    """Per account: months since the last purchase and the probability of none in the next ``horizon`` months.

    By the life table: S(idle + horizon) / S(idle), where a month beyond a class' longest spell adds nothing, and an
    account beyond the month in which every spell had ended gets NULL. With ``hazard``: by the fitted hazard.
    """
    _, until = _end_month(model, as_of)
    months = reliable_checkpoint(active_months(model)) if hazard is None else active_months(model)     # read twice by the table
    now = _open_spells(months, until).withColumn("frequency_class", frequency_class("seen", classes))
    if hazard is not None:
        out = now.select("account", "seen", "idle", _no_purchase(hazard, horizon).alias("churn_probability"))
    else:
        table = reliable_checkpoint(hazard_table(model, as_of, classes, sort=False, _spells=spells(months, until)))
        last = table.groupBy("frequency_class").agg(F.max("month").alias("_last"))
        known = now.join(last, "frequency_class", "left")
        at = table.select("frequency_class", F.col("month").alias("_month"), F.col("survival").alias("_s"))

        def survival(df: DataFrame, month: Column, name: str) -> DataFrame:
            df = df.withColumn("_month", F.least(month, F.col("_last")))
            return df.join(at, ["frequency_class", "_month"], "left") \
                .withColumn(name, F.when(F.coalesce(F.col("_month"), F.lit(0)) == 0, 1.0).otherwise(F.col("_s"))).drop("_month", "_s")

        both = survival(survival(known, F.col("idle"), "_now"), F.col("idle") + horizon, "_then")
        out = both.select("account", "seen", "idle", (F.col("_then") / F.nullif("_now", F.lit(0.0))).alias("churn_probability"))
    return out.orderBy(F.col("churn_probability").desc_nulls_last(), "account") if sort else out


def outcomes(months: DataFrame, at: int, horizon: int) -> DataFrame:
    """account, seen, idle as known in month ``at``, and whether there was no purchase in the ``horizon`` months after it."""
    bought = months.filter((F.col("ym") > at) & (F.col("ym") <= at + horizon)).select("account").distinct().withColumn("_b", F.lit(True))
    return _open_spells(months, at).join(bought, "account", "left").withColumn("churned", F.col("_b").isNull()).drop("_b")


def backtest(model: CrmModel, as_of: str | None = None, horizon: int = 6, bins: int = 5) -> DataFrame:
    """How well the fitted hazard does on a later period: overall (bin NULL) and by predicted probability.

    The hazard is fitted on what was known ``2 * horizon`` months before ``as_of``;
    the base rate is the share that churned in the ``horizon`` months after that; both
    are scored, by log-loss, on the ``horizon`` months up to ``as_of``.
    """
    _, until = _end_month(model, as_of)
    months = reliable_checkpoint(active_months(model))
    fit_at, score_at = until - 2 * horizon, until - horizon
    hazard = fit_hazard(spells(months, fit_at))
    earlier = outcomes(months, fit_at, horizon).agg(F.avg(F.col("churned").cast("double"))).first()[0]
    if earlier is None:
        raise ValueError("no account had bought by the month of the fit")
    base = min(max(earlier, 1e-6), 1 - 1e-6)
    p = F.least(F.greatest(_no_purchase(hazard, horizon), F.lit(1e-6)), F.lit(1 - 1e-6))
    scored = outcomes(months, score_at, horizon).withColumn("p", p)
    loss = lambda q: -F.log(F.when(F.col("churned"), q).otherwise(F.lit(1.0) - q))
    scored = scored.select(F.least((F.col("p") * bins).cast("int"), F.lit(bins - 1)).alias("bin"), "p", "churned",
                           loss(F.col("p")).alias("_l"), loss(F.lit(base)).alias("_b"))
    return scored.cube("bin").agg(F.count(F.lit(1)).alias("accounts"), F.avg("p").alias("predicted"),
                                  F.avg(F.col("churned").cast("double")).alias("churned"), F.avg("_l").alias("log_loss"),
                                  F.avg("_b").alias("base_log_loss")).orderBy(F.col("bin").asc_nulls_first())
