"""Lifetime value from a model of repeat purchases with drop-out.

Time runs in months. While a customer is alive, each month holds a purchase with
probability p; before each month the customer drops out with probability q; p and
q differ between customers by two beta distributions (beta-geometric /
beta-Bernoulli model). What an account says about them is its number of repeat
months, the last of them and the months observed: the fit reads the histogram of
these three, whose size is bounded by the calendar, not by the accounts. The value
of a month follows a gamma distribution whose scale differs between accounts by
another gamma; it is estimated from sums over accounts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..plans.model import CrmModel
from ..session import reliable_checkpoint
from . import _stats as S
from .survival import _end_month

MAX_MONTHS = 1200       # a bound on the histogram: at most MAX_MONTHS**3 / 6 cells, in practice a few thousand


def purchase_history(model: CrmModel, as_of: str | None = None) -> DataFrame:
    """Per account: repeats (active months after the first), last (month of the last one), observed (months
    since the first), value (won value per active month with a value) and its sum of squares and count."""
    _, until = _end_month(model, as_of)
    months = S.per_account(model, ("deal_stage", "close_date", "close_value"), {"_v": ("sum", "close_value")},
                           C.is_won() & F.col("close_date").isNotNull(), {"ym": C.month_index("close_date")}) \
        .filter(F.col("account").isNotNull() & (F.col("ym") <= until))
    v = F.col("_v").cast("double")
    return months.groupBy("account").agg(
        (F.count(F.lit(1)) - 1).alias("repeats"), (F.max("ym") - F.min("ym")).alias("last"),
        (F.lit(until) - F.min("ym")).cast("bigint").alias("observed"), F.sum("_v").alias("_sum"), F.count("_v").alias("valued"),
        F.sum((v * v).cast("decimal(38,4)")).alias("_squares"))


def histogram(history: DataFrame) -> DataFrame:
    """Accounts by (repeats, last, observed)."""
    return history.groupBy("repeats", "last", "observed").agg(F.count(F.lit(1)).alias("accounts"))


def _rising(a: float, n: int) -> np.ndarray:
    """ln(Gamma(a + k) / Gamma(a)) for k = 0..n."""
    return np.concatenate([[0.0], np.cumsum(np.log(a + np.arange(n)))])


@dataclass(frozen=True)
class RepeatBuying:
    """Beta parameters of the purchase probability (alpha, beta) and of the drop-out probability (gamma, delta)."""

    alpha: float
    beta: float
    gamma: float
    delta: float

    def _terms(self, x: np.ndarray, t: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihood of each history, and that part of it in which the customer is alive after month n."""
        top = int(n.max(initial=0)) + 2
        ra, rb, rab = _rising(self.alpha, top), _rising(self.beta, top), _rising(self.alpha + self.beta, top)
        rg, rd, rgd = _rising(self.gamma, top), _rising(self.delta, top), _rising(self.gamma + self.delta, top)
        alive = ra[x] + rb[n - x] - rab[n] + rd[n] - rgd[n]
        total = alive.copy()
        for i in range(int((n - t).max(initial=0))):
            some = np.flatnonzero(i < n - t)       # dropped out before month t + i + 1
            m = t[some] + i
            gone = ra[x[some]] + rb[m - x[some]] - rab[m] + rg[1] + rd[m] - rgd[m + 1]
            total[some] = np.logaddexp(total[some], gone)
        return total, alive

    def log_likelihood(self, x, t, n) -> np.ndarray:
        return self._terms(x, t, n)[0]

    def alive(self, x, t, n) -> np.ndarray:
        """Probability that the customer is still there for the month after the n observed."""
        total, alive = self._terms(x, t, n)
        return np.exp(alive - total) * (self.delta + n) / (self.gamma + self.delta + n)

    def expected(self, x, t, n, months: int, rate: float = 0.0) -> np.ndarray:
        """Purchases expected in the next ``months`` months, discounted by ``rate`` a month."""
        total, alive = self._terms(x, t, n)
        each = (self.alpha + x) / (self.alpha + self.beta + n)      # purchase probability while alive, given the history
        stays, out = np.ones(len(x)), np.zeros(len(x))
        for k in range(1, months + 1):
            # alive for one more month, averaged over the drop-out probabilities that fit the history
            stays = stays * (self.delta + n + k - 1) / (self.gamma + self.delta + n + k - 1)
            out += stays / (1 + rate) ** k
        return np.exp(alive - total) * each * out


def minimise(f: Callable[[np.ndarray], float], start: np.ndarray, steps: int = 2000, tolerance: float = 1e-9) -> np.ndarray:
    """Nelder-Mead simplex search."""
    points = [start, *[start + 0.5 * e for e in np.eye(len(start))]]
    simplex = sorted(((f(p), tuple(p)) for p in points))
    for _ in range(steps):
        best, worst = simplex[0], simplex[-1]
        if worst[0] - best[0] < tolerance * (1 + abs(best[0])):
            break
        centre = np.mean([p for _, p in simplex[:-1]], axis=0)
        at = lambda k: (lambda p: (f(p), tuple(p)))(centre + k * (np.array(worst[1]) - centre))
        new = at(-1.0)
        if new[0] < best[0]:
            new = min(new, at(-2.0))
        elif new[0] >= simplex[-2][0]:
            new = min(new, at(0.5 if new[0] >= worst[0] else -0.5))
            if new[0] >= worst[0]:      # shrink towards the best
                near = [tuple((np.array(p) + best[1]) / 2) for _, p in simplex[1:]]
                simplex = sorted([best, *[(f(np.array(p)), p) for p in near]])
                continue
        simplex = sorted([*simplex[:-1], new])
    return np.array(simplex[0][1])


def _cells(counts: DataFrame) -> tuple[np.ndarray, ...]:
    span = counts.agg(F.max("observed")).first()[0]
    if span is None:
        raise ValueError("no account has a won deal")
    if span > MAX_MONTHS:
        raise ValueError(f"more than {MAX_MONTHS} months of history: use a longer period")
    rows = counts.orderBy("repeats", "last", "observed").toPandas()
    return tuple(rows[c].to_numpy(np.int64) for c in ("repeats", "last", "observed", "accounts"))


def fit(counts: DataFrame) -> RepeatBuying:
    """Maximum likelihood from the histogram."""
    x, t, n, w = _cells(counts)

    def loss(logs: np.ndarray) -> float:
        if np.abs(logs).max() > 12:
            return float("inf")
        return -float(w @ RepeatBuying(*np.exp(logs)).log_likelihood(x, t, n)) / w.sum()

    # several starts: the likelihood is flat where heterogeneity is weak
    found = [minimise(loss, np.log(np.array(s))) for s in ((1.0, 1.0, 1.0, 5.0), (1.0, 4.0, 0.5, 10.0), (3.0, 3.0, 2.0, 2.0))]
    return RepeatBuying(*map(float, np.exp(min(found, key=loss))))


@dataclass(frozen=True)
class Spend:
    """Expected value of an active month: ``weight(m)`` of the account's own mean over m months, the rest the overall mean."""

    mean: float
    shape: float        # of the gamma distribution of a month's value: 1 / its squared relative deviation
    spread: float       # squared relative deviation of accounts' means


def fit_spend(history: DataFrame) -> Spend:
    """From sums over accounts: the mean, and the relative variances within and between accounts."""
    many = F.col("valued") > 1
    own = F.col("_sum").cast("double") / F.col("valued").cast("double")
    inside = (F.col("_squares").cast("double") - own * own * F.col("valued")) / (F.col("valued") - 1)
    term = "decimal(38,6)"
    r = history.filter("valued > 0").agg(
        F.sum("_sum").cast("double").alias("s"), F.sum("valued").alias("n"),
        F.sum(F.when(many, F.greatest(inside, F.lit(0.0))).cast(term)).cast("double").alias("v"),
        F.sum(F.when(many, own * own).cast(term)).cast("double").alias("q"), F.sum(F.when(many, own).cast(term)).cast("double").alias("m"),
        F.sum(F.when(many, F.lit(1.0) / F.col("valued")).cast("decimal(38,12)")).cast("double").alias("h"),
        C.sum_flag(many).alias("k")).first()
    if not r.n:
        return Spend(0.0, 1.0, 0.0)
    mean = r.s / r.n
    if not r.k or mean <= 0:
        return Spend(mean, 1.0, 0.0)
    within = r.v / r.k
    between = max(r.q / r.k - (r.m / r.k) ** 2 - within * r.h / r.k, 0.0)
    spread = between / (mean * mean)
    return Spend(mean, mean * mean * (1 + spread) / within if within > 0 else float("inf"), spread)


def expected_clv(model: CrmModel, as_of: str | None = None, months: int = 36, annual_rate: float = 0.10,
                 fitted: RepeatBuying | None = None, sort: bool = True) -> DataFrame:
    """Per account: its history, the probability of being alive, expected purchases and the discounted value expected
    over the next ``months`` months. All but the value depends on the histogram's cell only, so cells are scored once."""
    history = reliable_checkpoint(purchase_history(model, as_of))
    counts = histogram(history)
    fitted = fitted or fit(counts)
    x, t, n, _ = _cells(counts)
    monthly = (1 + annual_rate) ** (1 / 12) - 1
    scored = list(zip(*[a.tolist() for a in (x, t, n, fitted.alive(x, t, n), fitted.expected(x, t, n, months),
                                             fitted.expected(x, t, n, months, monthly))]))
    cells = history.sparkSession.createDataFrame(
        scored, "repeats long, last long, observed long, p_alive double, expected_purchases double, _discounted double")
    spend = fit_spend(history)
    own = F.coalesce(C.ratio("_sum", "valued"), F.lit(0.0))
    # gamma-gamma: the more months an account has, the more its own mean counts
    pull = F.col("valued") * F.lit(spend.shape * spend.spread) / (F.lit(1.0 + spend.spread) + F.col("valued") * F.lit(spend.shape * spend.spread)) \
        if np.isfinite(spend.shape) else F.when(F.col("valued") > 0, 1.0).otherwise(0.0)
    out = history.join(cells, ["repeats", "last", "observed"]).withColumn("_w", pull).select(
        "account", "repeats", "last", "observed", "p_alive", "expected_purchases",
        (F.col("_w") * own + (F.lit(1.0) - F.col("_w")) * F.lit(spend.mean)).alias("expected_value"), "_discounted")
    out = out.withColumn("expected_clv", F.col("_discounted") * F.col("expected_value")).drop("_discounted")
    return out.orderBy(F.col("expected_clv").desc_nulls_last(), "account") if sort else out
