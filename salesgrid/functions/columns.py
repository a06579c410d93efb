"""Column expressions shared by the metrics.

All arithmetic is in DOUBLE with an explicit operation order, and money is
summed as DECIMAL and cast to DOUBLE once, so results do not depend on how
Spark splits the data into partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import CLOSE_VALUE

WON = "Won"
LOST = "Lost"


def stage_is(stage: str) -> Column:
    return F.col("deal_stage") == F.lit(stage)


def is_won() -> Column:
    return stage_is(WON)


def is_lost() -> Column:
    return stage_is(LOST)


def day_diff(start, end) -> Column:
    """Whole calendar days from ``start`` to ``end`` (dates), as BIGINT."""
    return F.datediff(_col(end), _col(start)).cast("bigint")


def days_since(date_col, as_of) -> Column:
    """Calendar days from ``date_col`` to the fixed as-of date."""
    return F.datediff(F.lit(as_of).cast("date"), _col(date_col)).cast("bigint")


def month_index(date_col) -> Column:
    """Months since year 0: ``year*12 + month - 1``; differences are calendar months."""
    d = _col(date_col)
    return (F.year(d).cast("bigint") * 12 + F.month(d).cast("bigint") - 1)


def nullif_zero(c) -> Column:
    return F.nullif(_col(c), F.lit(0))


def ratio(num, den) -> Column:
    """``num / NULLIF(den, 0)`` in DOUBLE."""
    return _col(num).cast("double") / nullif_zero(den).cast("double")


def percent(num, den) -> Column:
    """``num * 100.0 / NULLIF(den, 0)`` in DOUBLE (multiply first, as written in SQL)."""
    return (_col(num).cast("double") * F.lit(100.0)) / nullif_zero(den).cast("double")


def money_sum(c) -> Column:
    """Exact DECIMAL sum, one cast to DOUBLE."""
    return F.sum(_col(c)).cast("double")


def money_mean(c) -> Column:
    """AVG of a DECIMAL column as DOUBLE: exact sum / non-null count."""
    c = _col(c)
    return F.sum(c).cast("double") / nullif_zero(F.count(c)).cast("double")


def mean(c) -> Column:
    """AVG of an integral column as DOUBLE (exact integer sum / count)."""
    c = _col(c)
    return F.sum(c).cast("double") / nullif_zero(F.count(c)).cast("double")


def won_value() -> Column:
    """``CASE WHEN won THEN close_value ELSE 0 END``."""
    return F.when(is_won(), F.col("close_value")).otherwise(F.lit(0).cast(CLOSE_VALUE))


def won_value_or_null() -> Column:
    """``CASE WHEN won THEN close_value END``."""
    return F.when(is_won(), F.col("close_value"))


def count_when(cond: Column) -> Column:
    """``COUNT(CASE WHEN cond THEN 1 END)`` as BIGINT."""
    return F.count(F.when(cond, F.lit(1))).cast("bigint")


def sum_flag(cond: Column) -> Column:
    """``SUM(CASE WHEN cond THEN 1 ELSE 0 END)`` as BIGINT."""
    return F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0))).cast("bigint")


def tiered(value, tiers: Sequence[tuple[float, str]], default: str, op: str = ">") -> Column:
    """Searched CASE over descending thresholds: first ``value <op> threshold`` wins.

    A NULL value fails every comparison and falls to ``default``, as in SQL.
    """
    v = _col(value)
    expr = None
    for threshold, label in tiers:
        cond = v > F.lit(threshold) if op == ">" else v >= F.lit(threshold)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(default)) if expr is not None else F.lit(default)


def discount_factor_sum(rate: float, years: int, start: int = 0) -> float:
    """``sum(1/(1+rate)^t for t in start..start+years-1)``, in that order."""
    total = 0.0
    for t in range(start, start + years):
        total = total + (1.0 if t == 0 else 1.0 / ((1.0 + rate) ** t))
    return total


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c
