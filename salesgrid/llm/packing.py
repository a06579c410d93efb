"""Best-fit packing into bins of several permitted lengths.

Documents are cut into pieces of at most the largest capacity, dealt at random
into groups of about ``GROUP_PIECES`` pieces (so a task's memory is bounded and
no document or length can make a group hot), and each group is packed on its
own, longest piece first: a piece goes into the open bin with the least room
that fits it. If none fits, a bin is opened; its size is the one with the least
cost per token it can be expected to hold: the piece itself and, up to the room
left, the pieces still to come that fit there. At the end each bin shrinks to
the smallest capacity that holds its contents.

Defined results: a null length or a length of 0 gives one row without a bin
(capacity 0); null or repeated ids are packed like others (``copy`` tells
repeated rows apart); an empty table gives an empty result; only the id and the
length are read, so other columns cannot clash.
"""

from __future__ import annotations

import bisect
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch

CAPACITIES = (512, 1024, 2048, 4096, 8192)
GROUP_PIECES = 16_384


def sequence_cost(capacity: int, quadratic: float = 1 / 16_384) -> float:
    """Cost of a training sequence: linear work and attention (``quadratic`` a token pair)."""
    return capacity * (1 + quadratic * capacity)


def best_fit(lengths: Sequence[int], capacities: Sequence[int],
             costs: Sequence[float]) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each piece (lengths in falling order), and each bin's final capacity."""
    ahead = [0]
    for n in reversed(lengths):
        ahead.append(ahead[-1] + n)
    ahead.reverse()                      # tokens of pieces i, i+1, ...
    falling = [-n for n in lengths]
    rooms: list[int] = []                # distinct rooms of open bins, rising
    open_bins: dict[int, list[int]] = {}
    room: list[int] = []
    size: list[int] = []
    where, offset = [], []
    for i, n in enumerate(lengths):
        at = bisect.bisect_left(rooms, n)
        if at < len(rooms):
            left = rooms[at]
            b = open_bins[left].pop()
            if not open_bins[left]:
                del open_bins[left], rooms[at]
        else:
            def per_token(k: int, i: int = i, n: int = n) -> tuple[float, int]:
                spare = capacities[k] - n
                fits = bisect.bisect_left(falling, -spare, i + 1)
                return costs[k] / (n + min(spare, ahead[fits])), k
            k = min((per_token(k) for k in range(len(capacities)) if capacities[k] >= n))[1]
            b, left = len(room), capacities[k]
            room.append(left)
            size.append(capacities[k])
        where.append(b)
        offset.append(size[b] - left)
        room[b] = left - n
        if room[b]:
            if room[b] not in open_bins:
                bisect.insort(rooms, room[b])
                open_bins[room[b]] = []
            open_bins[room[b]].append(b)
    final = [capacities[bisect.bisect_left(capacities, size[b] - room[b])] for b in range(len(room))]
    return where, offset, final


def pack(docs: DataFrame, length: Column, *, doc_id: str = "doc_id",
         capacities: Sequence[int] = CAPACITIES, costs: Sequence[float] | None = None,
         group_pieces: int = GROUP_PIECES) -> DataFrame:
    """A row for each piece: doc_id, copy, piece, piece_start, length, bin_id, capacity, bin_offset."""
    capacities = sorted(set(capacities))
    costs = [sequence_cost(c) for c in capacities] if costs is None else list(costs)
    top = capacities[-1]
    tokens = F.greatest(F.coalesce(length.cast("long"), F.lit(0)), F.lit(0))
    measured, _ = scratch.write(
        docs.select(F.col(f"`{doc_id}`").alias("doc_id"), tokens.alias("tokens"),
                    F.monotonically_increasing_id().alias("copy")), "pack-lengths")
    last = F.greatest(F.ceil(F.col("tokens") / top).cast("int"), F.lit(1)) - 1
    pieces = measured.select("doc_id", "copy", "tokens", F.explode(F.sequence(F.lit(0), last)).alias("piece")) \
        .select("doc_id", "copy", "piece", (F.col("piece").cast("long") * top).alias("piece_start"),
                F.least(F.lit(top).cast("long"), F.col("tokens") - F.col("piece").cast("long") * top)
                .alias("length"))
    filled = pieces.filter("length > 0")
    groups = max(1, -(-filled.count() // group_pieces))

    def one_group(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("copy", "ascending"), ("piece", "ascending")])
        where, offset, final = best_fit(table["length"].to_pylist(), capacities, costs)
        base = table["grp"][0].as_py() << 32
        return table.drop_columns("grp") \
            .append_column("bin_id", pa.array([base + b for b in where], pa.int64())) \
            .append_column("capacity", pa.array([final[b] for b in where], pa.int32())) \
            .append_column("bin_offset", pa.array(offset, pa.int64()))

    kind = measured.schema["doc_id"].dataType.simpleString()
    schema = (f"doc_id {kind}, copy long, piece int, piece_start long, length long, bin_id long, "
              "capacity int, bin_offset long")
    deal = F.pmod(F.xxhash64("doc_id", "copy", "piece"), F.lit(groups)).cast("long")
    packed = filled.withColumn("grp", deal).groupBy("grp").applyInArrow(one_group, schema)
    empty = pieces.filter("length = 0").select(
        "doc_id", "copy", "piece", "piece_start", "length", F.lit(None).cast("long").alias("bin_id"),
        F.lit(0).alias("capacity"), F.lit(None).cast("long").alias("bin_offset"))
    return packed.unionByName(empty)
