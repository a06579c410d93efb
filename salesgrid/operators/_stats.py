"""Re-aggregatable deal statistics.

``deal_stats`` aggregates the fact table by a key into additive parts (counts
and exact DECIMAL sums); ``rollup`` sums those parts again by a coarser key and
``finish`` turns parts into the reported columns. Metrics grouped by a
dimension attribute (sector, office, manager) aggregate by the dimension key
first, so only one row per key reaches the dimension join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..plans.model import ACCOUNT_KEY, CrmModel

PARTS = ("_rows", "_opps", "_won", "_lost", "_won_value", "_won_v_sum", "_won_v_n",
         "_won_d_sum", "_won_d_n")


def deal_stats(p: DataFrame, keys: list[str], with_cycle: bool = True,
               extra: list[Column] = ()) -> DataFrame:
    won_days = F.when(C.is_won(), C.day_diff("engage_date", "close_date"))
    aggs = [
        F.count(F.lit(1)).alias("_rows"),
        F.count("opportunity_id").alias("_opps"),
        C.count_when(C.is_won()).alias("_won"),
        C.count_when(C.is_lost()).alias("_lost"),
        F.sum(C.won_value()).alias("_won_value"),
        F.sum(C.won_value_or_null()).alias("_won_v_sum"),
        F.count(C.won_value_or_null()).alias("_won_v_n"),
    ]
    if with_cycle:
        aggs += [F.sum(won_days).alias("_won_d_sum"), F.count(won_days).alias("_won_d_n")]
    return p.groupBy(*keys).agg(*aggs, *extra)


def rollup(parts: DataFrame, keys: list[str], extra: list[Column] = ()) -> DataFrame:
    present = [c for c in PARTS if c in parts.columns]
    return parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in present], *extra)


def win_rate() -> Column:
    return C.percent("_won", "_rows")


def total_revenue() -> Column:
    return F.col("_won_value").cast("double")


def avg_deal_size() -> Column:
    return F.col("_won_v_sum").cast("double") / C.nullif_zero("_won_v_n").cast("double")


def avg_sales_cycle() -> Column:
    return F.col("_won_d_sum").cast("double") / C.nullif_zero("_won_d_n").cast("double")


_MERGES = {"sum": (F.sum, F.sum), "count": (F.count, F.sum), "min": (F.min, F.min), "max": (F.max, F.max)}


# Measures that are not plain columns of the fact table, by the name that a stored state knows them by.
MEASURES = {"rows": lambda: F.lit(1), "cycle_days": lambda: C.day_diff("engage_date", "close_date")}


def per_account(model: CrmModel, columns: Sequence[str], parts: Mapping[str, tuple[str, object]],
                where: Column | None = None, keys: Mapping[str, Column] | None = None) -> DataFrame:
    """account, ``keys`` and additive ``parts`` (name -> (sum | count | min | max, column)).

    The fact rows are aggregated by the account's key; names are joined to the
    aggregated rows, and rows of one name (keys without one) are merged. Without
    parts: the distinct (account, keys) rows. A model that keeps such parts
    (``account_parts``) answers itself.
    """
    if hasattr(model, "account_parts"):
        return model.account_parts(parts, where, keys or {})
    p = model.account_keyed_pipeline(*columns)
    if where is not None:
        p = p.filter(where)
    keys = keys or {}
    by = [F.col(ACCOUNT_KEY), *[k.alias(n) for n, k in keys.items()]]
    if not parts:
        return model.account_names(p.select(*by).distinct()).select("account", *keys).distinct()
    col = lambda c: c if isinstance(c, Column) else MEASURES[c]() if c in MEASURES else F.col(c)
    grouped = p.groupBy(*by).agg(*[_MERGES[kind][0](col(c)).alias(n) for n, (kind, c) in parts.items()])
    return model.account_names(grouped).groupBy("account", *keys).agg(
        *[_MERGES[kind][1](n).alias(n) for n, (kind, _) in parts.items()])
