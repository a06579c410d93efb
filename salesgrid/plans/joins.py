"""Join helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def single_row(df: DataFrame) -> DataFrame:
    """Broadcast a global (key-less) aggregate: exactly one row by construction.

    Other explicit broadcasts: frames with one row per partition (ranking
    offsets) and, in the TPC-H star map, dimension tables whose exact row
    count is below a bound. Everything else is left to the planner and AQE,
    which broadcast only below their size thresholds.
    """
    return F.broadcast(df)
