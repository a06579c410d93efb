"""Exact global ranks, NTILE and percentiles without a single-partition stage.

A plain ``Window.orderBy`` (no PARTITION BY) moves every row into one task.
Here rows are range-partitioned on a *total* order, and each partition's rows
are numbered (``positions``) or their counts summed up (``percentiles``);
per-partition totals, one row a partition, give the partitions' offsets. The
partitioned rows are checkpointed to the shared folder first, so that both
uses see the same partitions.

NTILEs of several columns share one sort: the columns are unpivoted into
narrow (column, value, id) rows. Percentiles sort value counts, not rows:
(group, column, value) is counted first, with partial counts before the shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import reliable_checkpoint

_LOCAL_BITS = 33
_LOCAL_MASK = (1 << _LOCAL_BITS) - 1


def _ranged(df: DataFrame, orders: Sequence[Column], partitions: int | None) -> DataFrame:
    return df.repartitionByRange(partitions, *orders) if partitions else df.repartitionByRange(*orders)


def _offsets(parts: DataFrame, size: Column) -> DataFrame:
    """(_part, _offset): what all partitions before hold; one row a partition."""
    per_part = parts.groupBy("_part").agg(size.alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return per_part.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))


def positions(df: DataFrame, orders: Sequence[Column], pos_col: str = "_pos",
              partitions: int | None = None) -> DataFrame:
    """Add each row's exact 0-based position in a total order.

    ``monotonically_increasing_id`` holds the partition in its upper bits and
    the number inside it in its lower 33.
    """
    numbered = _ranged(df, orders, partitions).sortWithinPartitions(*orders) \
        .withColumn("_mid", F.monotonically_increasing_id())
    numbered = reliable_checkpoint(numbered).withColumn("_part", F.shiftright("_mid", _LOCAL_BITS))
    local = F.col("_mid").bitwiseAND(F.lit(_LOCAL_MASK))
    return numbered.join(_offsets(numbered, F.count(F.lit(1))), "_part") \
        .withColumn(pos_col, F.col("_offset") + local).drop("_mid", "_part", "_offset")


def places(df: DataFrame, name: str = "place") -> DataFrame:
    """The rows of a sorted result with their 1-based place in it, as it is written out or shown.

    For exports that must keep an ``ORDER BY``: files and joins do not, a column does. One row a
    partition is summed up; no row moves.
    """
    numbered = reliable_checkpoint(df.withColumn("_mid", F.monotonically_increasing_id())) \
        .withColumn("_part", F.shiftright("_mid", _LOCAL_BITS))
    local = F.col("_mid").bitwiseAND(F.lit(_LOCAL_MASK))
    return numbered.join(_offsets(numbered, F.count(F.lit(1))), "_part") \
        .withColumn(name, F.col("_offset") + local + 1).select(*df.columns, name)


def ntile_from_position(pos: Column, total: Column, n: int) -> Column:
    """SQL NTILE(n) from a 0-based position among ``total`` rows.

    The first ``total % n`` tiles hold one row more than the rest.
    """
    b = F.floor(total / F.lit(n)).cast("bigint")
    r = (total % F.lit(n)).cast("bigint")
    big = r * (b + 1)
    return (F.when(pos < big, F.floor(pos / (b + 1)) + 1)
            .otherwise(r + F.floor((pos - big) / F.greatest(b, F.lit(1))) + 1)).cast("bigint")


def add_ntiles(df: DataFrame, ident: str, tiles: Mapping[str, Column], n: int,
               partitions: int | None = None) -> DataFrame:
    """Add ``NTILE(n) OVER (ORDER BY value, ident)``, NULLs last, for each ``name: value``.

    ``ident`` is unique (one NULL is allowed); values are numbers of up to 18
    whole and 6 decimal digits (negate one for a descending order). ``df``
    should be materialised: it is read for the ranking and for the result.
    """
    long = df.select(F.col(ident).alias("_id"), F.explode(F.array(*[
        F.struct(F.lit(name).alias("name"), value.cast("decimal(38,6)").alias("value"))
        for name, value in tiles.items()])).alias("_t")).select("_id", "_t.name", "_t.value")
    order = [F.col("name"), F.col("value").asc_nulls_last(), F.col("_id").asc_nulls_last()]
    ranked = positions(long, order, partitions=partitions)
    groups = ranked.groupBy("name").agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_total"))
    scored = ranked.join(groups, "name").select(
        "_id", "name", ntile_from_position(F.col("_pos") - F.col("_first"), F.col("_total"), n).alias("_tile"))
    wide = scored.groupBy("_id").agg(*[
        F.max(F.when(F.col("name") == name, F.col("_tile"))).alias(name) for name in tiles])
    return df.join(wide, df[ident].eqNullSafe(wide["_id"])).drop("_id")


def percentiles(df: DataFrame, value_cols: Sequence[str], qs: Sequence[float],
                group_cols: Sequence[str] = (), partitions: int | None = None) -> DataFrame:
    """Exact ``PERCENTILE_CONT(q)`` of each value column, per group.

    Returns long form: ``group_cols..., column, q, value`` (value is DOUBLE,
    NULL when the group has no non-null value). NULLs are ignored, as in SQL.
    """
    gk = [*group_cols, "column"]
    long = df.select(*group_cols, F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))
        for c in value_cols])).alias("_kv")).select(*group_cols, "_kv.column", "_kv.value")
    counts = long.groupBy(*gk, "value").agg(F.count(F.lit(1)).alias("_n"))
    orders = [F.col(c).asc_nulls_last() for c in [*gk, "value"]]
    parts = reliable_checkpoint(_ranged(counts, orders, partitions)
                                .withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part").orderBy(*orders).rowsBetween(Window.unboundedPreceding, -1)
    present = F.when(F.col("value").isNotNull(), F.col("_n")).otherwise(F.lit(0))
    summed = parts.select("*", present.alias("_m")) \
        .withColumn("_inside", F.coalesce(F.sum("_m").over(inside), F.lit(0))) \
        .join(_offsets(parts.select("_part", present.alias("_m")), F.sum("_m")), "_part") \
        .select(*gk, "value", "_m", (F.col("_offset") + F.col("_inside")).alias("_before"))
    names = [f"_g{i}" for i in range(len(gk))]
    rank = F.col("q") * (F.greatest(F.col("_size"), F.lit(1)) - 1).cast("double")
    wanted = summed.groupBy(*gk).agg(F.min("_before").alias("_first"), F.sum("_m").alias("_size")) \
        .select(*[F.col(c).alias(n) for c, n in zip(gk, names)], "_first", "_size",
                F.explode(F.array(*[F.lit(float(q)) for q in qs])).alias("q")) \
        .select(*names, "q", (rank - F.floor(rank)).alias("_d"),
                (F.col("_first") + F.floor(rank)).alias("_lo"), (F.col("_first") + F.ceil(rank)).alias("_hi"))
    covers = lambda p: (F.col("_before") <= F.col(p)) & (F.col(p) < F.col("_before") + F.col("_m"))
    same = reduce(Column.__and__, [F.col(n).eqNullSafe(F.col(c)) for n, c in zip(names, gk)])
    hits = wanted.join(summed.filter("_m > 0"), same & (covers("_lo") | covers("_hi")), "left") \
        .select(*[F.col(n).alias(c) for n, c in zip(names, gk)], "q", "_d",
                F.when(covers("_lo"), F.col("value")).alias("_vlo"),
                F.when(covers("_hi"), F.col("value")).alias("_vhi"))
    ends = hits.groupBy(*gk, "q").agg(F.max("_d").alias("_d"), F.max("_vlo").alias("_vlo"),
                                      F.max("_vhi").alias("_vhi"))
    value = F.when(F.col("_vlo") == F.col("_vhi"), F.col("_vlo")).otherwise(
        F.col("_vlo") + F.col("_d") * (F.col("_vhi") - F.col("_vlo")))
    return ends.select(*gk, "q", value.alias("value"))
