"""Questions about what came before on a key's time line, without one task per key.

Rows are dealt by (key, cell), a cell being a range of time of fixed width, and
ordered only inside a cell. What a cell needs from earlier ones is one row a
(key, cell), so a key that holds a third of all rows is spread over its cells.
Results do not depend on the width; it sets how much of a key one task sorts.

Keys compare by equality: rows with a NULL key or time have nothing before them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400
_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def seconds(time: str) -> Column:
    """Whole seconds of a date or time stamp since 1970, without a time zone's help."""
    return F.expr(f"timestampdiff(SECOND, {_EPOCH}, CAST(`{time}` AS TIMESTAMP_NTZ))")


def _cell(time: str, width: int) -> Column:
    return F.floor(seconds(time) / F.lit(width)).cast("bigint")


def _carry(cells: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """For each (key, cell), the ``value`` of the last earlier cell that has one."""
    before = Window.partitionBy(key).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    return cells.select(key, "_cell", F.last(value, ignorenulls=True).over(before).alias(name))


def asof_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str,
              order: str, columns: Sequence[str], strict: bool = False, width: int = 90 * DAY) -> DataFrame:
    """``left`` with ``columns`` of the latest row of ``right`` with its key at or before its time.

    ``order`` breaks ties of ``right_time`` (the larger wins); ``strict`` leaves out
    rows at the very time. Left rows without such a row get NULLs; all are kept.
    """
    names = left.columns
    found = F.struct(F.col(right_time).alias("_t"), F.col(order).alias("_o"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(columns)])
    r = right.filter(F.col(key).isNotNull() & F.col(right_time).isNotNull()) \
        .select(F.col(key).alias("_key"), _cell(right_time, width).alias("_cell"), seconds(right_time).alias("_s"),
                F.expr(f"CAST(`{right_time}` AS TIMESTAMP_NTZ)").alias("_at"), F.col(order).alias("_tie"), found.alias("_found"))
    own = F.struct(*[F.col(c).alias(f"_l{i}") for i, c in enumerate(names)])
    # rows without a key or time find nothing: they are dealt by their own hash
    apart = F.col(key).isNull() | F.col(left_time).isNull()
    cell = F.when(apart, F.pmod(F.xxhash64(*names), F.lit(1000))).otherwise(_cell(left_time, width))
    l = left.select(F.when(~apart, F.col(key)).alias("_key"), cell.alias("_cell"),  # noqa: E741
                    F.expr(f"CAST(`{left_time}` AS TIMESTAMP_NTZ)").alias("_at"), own.alias("_own"))
    kind = r.schema["_found"].dataType
    both = l.select("_key", "_cell", "_at", F.lit(0 if strict else 1).alias("_side"),
                                   F.lit(None).cast(r.schema["_tie"].dataType).alias("_tie"), "_own",
                                   F.lit(None).cast(kind).alias("_found")) \
        .unionByName(r.select("_key", "_cell", "_at", F.lit(1 if strict else 0).alias("_side"), "_tie",
                              F.lit(None).cast(l.schema["_own"].dataType).alias("_own"), "_found"))
    # the last row of ``right`` in a cell; a cell without one still needs what came before
    last = both.filter(F.col("_key").isNotNull()).groupBy("_key", "_cell").agg(F.max(F.when(F.col("_found").isNotNull(), F.struct("_at", "_tie", "_found"))).alias("_m"))
    carry = _carry(last.select("_key", "_cell", F.col("_m._found").alias("_last")), "_key", "_last", "_before")
    inside = Window.partitionBy("_key", "_cell").orderBy("_at", "_side", F.col("_tie").asc_nulls_first()) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("_in", F.last("_found", ignorenulls=True).over(inside)).filter(F.col("_own").isNotNull())
    joined = seen.join(carry, ["_key", "_cell"], "left").select("_own", F.coalesce("_in", "_before").alias("_found"))
    return joined.select(*[F.col(f"_own._l{i}").alias(c) for i, c in enumerate(names)],
                         *[F.col(f"_found._c{i}").alias(c) for i, c in enumerate(columns)])


def previous_second(rows: DataFrame, key: str, time: str, order: str, name: str = "previous_second",
                    width: int = 90 * DAY) -> DataFrame:
    """``rows`` with the second of the key's row before, by time and ``order``; NULL for the first."""
    r = rows.withColumn("_cell", _cell(time, width)).withColumn("_s", seconds(time))
    carry = _carry(r.filter(F.col(key).isNotNull() & F.col("_s").isNotNull()).groupBy(key, "_cell").agg(F.max("_s").alias("_last")),
                   key, "_last", "_before")
    inside = Window.partitionBy(key, "_cell").orderBy(time, order)
    return r.withColumn("_in", F.when(F.col(key).isNotNull() & F.col("_s").isNotNull(), F.lag("_s").over(inside))) \
        .join(carry, [key, "_cell"], "left").withColumn(name, F.coalesce("_in", "_before")) \
        .select(*rows.columns, name)


def chain_levels(events: DataFrame, key: str, time: str, order: str, kind: str, steps: Sequence[str],
                 within: int) -> DataFrame:
    """(key, level): how many of ``steps`` the key's events match in order, at most ``within`` seconds
    after the event of the first step; 0 where not even that occurs.

    Events follow one another by time and ``order``. A chain that ends in a cell of width
    ``within`` began there or in the cell before, so each event goes to its cell and, as what may
    precede, to the next. Inside, the latest possible start of a chain up to each step is a running
    maximum: no list of a key's events is built. Rows with a NULL key or time match nothing.
    """
    e = events.filter(F.col(key).isNotNull()).select(
        key, F.col(time).alias("_at"), F.col(order).alias("_tie"), seconds(time).alias("_s"), _cell(time, within).alias("_cell"),
        reduce(lambda c, i: c.when(F.col(kind) == steps[i], i + 1), range(1, len(steps)), F.when(F.col(kind) == steps[0], 1)).alias("_step"))
    if len(set(steps)) != len(steps):
        raise ValueError("steps must differ")
    known = e.filter(F.col("_step").isNotNull() & F.col("_s").isNotNull())
    # the last step precedes nothing
    twice = F.when(F.col("_step") < len(steps), F.array(F.col("_cell"), F.col("_cell") + 1)).otherwise(F.array("_cell"))
    spread = known.withColumn("_cell", F.explode(twice)).repartition(key, "_cell")
    before = Window.partitionBy(key, "_cell").orderBy("_at", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    spread = spread.withColumn("_start1", F.when(F.col("_step") == 1, F.col("_s")))
    for j in range(2, len(steps) + 1):
        latest = F.max(f"_start{j - 1}").over(before)
        spread = spread.withColumn(f"_start{j}", F.when((F.col("_step") == j) & (F.col("_s") - latest <= within), latest))
    level = F.greatest(*[F.when(F.col(f"_start{j}").isNotNull(), j).otherwise(0) for j in range(1, len(steps) + 1)],
                       *([F.lit(0)] if len(steps) == 1 else []))
    matched = spread.groupBy(key).agg(F.max(level).alias("level"))
    return e.select(key).distinct().join(matched, key, "left").select(key, F.coalesce("level", F.lit(0)).cast("int").alias("level"))
