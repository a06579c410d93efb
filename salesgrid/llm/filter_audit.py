"""How document filters interact: what each removes, alone and in every order.

``measure`` says for each document which filters it fails (``FILTERS``).
``postings`` range-partitions the rows by (part, id) and keeps, for each part and
id range, the sorted list of failing rows of each filter, and of the rows with a
good or toxic label. ``sizes`` merges the lists of one range: unions of up to all
filters, and what each filter adds to each union, found by galloping; only the
sizes leave a task, and Spark adds them up by part. ``report`` reads every order
of the filters off these sums: what a filter removes in an order depends only on
the set of filters before it.

A range holds at most one Arrow batch of rows, so no list grows with a part, and a
hot part is spread over ranges like any other. A list holds positions among the
range's sorted rows, so that repeated and null ids stay apart.

Defined results: a null text counts as empty, a null part as the empty string.
A text is a copy when a row with a smaller id has the same text; a null id
neither is nor makes a copy, and rows of one id are not copies of one another.
Labels of repeated ids count if any row has them; null labels and ids count as
unlabelled. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import scratch, textops

FILTERS = "ABCDE"       # short, repetitive, capitals, symbols, copy
LEAST_WORDS = 200
LEAST_DISTINCT = 50     # percent of the words
MOST_CAPITALS = 3       # percent of the code points
SYMBOLS = "#$%&*|"
LABELS = ("good", "toxic")
STRIDE = 256            # ids placed at once by a galloping step

_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True


def _failures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Filters A to D and a digest of each text."""
    for batch in batches:
        for piece in textops.slices(batch):
            w = textops.words(piece.column("text"))
            n_words, row = w.counts(), w.row_of()
            distinct = np.zeros(len(w), np.int64)
            if len(row):
                _, first = np.unique(textops.by_row(w.hash, row), return_index=True)
                distinct = np.bincount(row[first], minlength=len(w))
            points = textops.sums((w.data & 0xC0) != 0x80, w.row_start)
            capitals = textops.sums(_CAPITAL[w.data], w.row_start)
            symbols = textops.sums(_SYMBOL[w.data], w.row_start)
            body = w.data.tobytes()
            digests = [hashlib.blake2b(body[a:b], digest_size=16).digest()
                       for a, b in zip(w.row_start[:-1].tolist(), w.row_start[1:].tolist())]
            kept = [c for c in piece.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [*[piece.column(c) for c in kept], pa.array(n_words < LEAST_WORDS),
                 pa.array(100 * distinct < LEAST_DISTINCT * n_words), pa.array(100 * capitals > MOST_CAPITALS * points),
                 pa.array(symbols > 0), pa.array(digests, pa.binary())],
                names=[*kept, *FILTERS[:4], "digest"])


def measure(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text",
            part: str = "lang") -> DataFrame:
    """One row a document: part, doc_id, row (unique), whether it fails A to E, and its labels."""
    rows = docs.select(F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"),
                       F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"),
                       F.monotonically_increasing_id().alias("row"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    flags = ", ".join(f"{f} boolean" for f in FILTERS[:4])
    measured, _ = scratch.write(rows.mapInArrow(_failures, f"part string, doc_id {kind}, row long, {flags}, digest binary"),
                                "filter-failures")
    # A document passes E exactly if it has the smallest id of its text: no join by text alone, which hot copies would skew.
    first = measured.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")) \
        .withColumn("first", F.lit(True))
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id") \
        .agg(*[F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(name) for name, c in zip(LABELS, ("quality", "toxic"))])
    return measured.join(first, ["digest", "doc_id"], "left").join(marks, "doc_id", "left").select(
        "part", "doc_id", "row", *FILTERS[:4], (F.col("first").isNull() & F.col("doc_id").isNotNull()).alias("E"),
        *[F.coalesce(name, F.lit(False)).alias(name) for name in LABELS])


def _lists(names: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column("part").to_pylist()
            cuts = [0, *[i for i in range(1, len(parts)) if parts[i] != parts[i - 1]], len(parts)] if parts else []
            flags = {c: np.asarray(batch.column(c).to_numpy(zero_copy_only=False), bool) for c in names}
            for a, b in zip(cuts, cuts[1:]):
                lists = [pa.array([np.flatnonzero(flags[c][a:b]).astype(np.int32)], pa.list_(pa.int32())) for c in names]
                ids = batch.column("doc_id").slice(a, b - a)
                yield pa.RecordBatch.from_arrays([pa.array([parts[a]]), pa.array([b - a], pa.int64()),
                                                  pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), ids), *lists],
                                                 names=["part", "n", "ids", *names])
    return run


def postings(measured: DataFrame, filters: Sequence[str] = FILTERS, labels: Sequence[str] = LABELS) -> DataFrame:
    """One row a part and id range: the range's sorted ids, and for each filter and label the
    sorted positions in it of the rows that fail, or have, it. Any boolean columns will do."""
    names = [*filters, *labels]
    kind = measured.schema["doc_id"].dataType.simpleString()
    rows = measured.select("part", "doc_id", "row", *names).repartitionByRange("part", "doc_id", "row") \
        .sortWithinPartitions("part", "doc_id", "row").drop("row")
    lists = ", ".join(f"`{c}` array<int>" for c in names)
    return rows.mapInArrow(_lists(names), f"part string, n long, ids array<{kind}>, {lists}")


def places(ids: np.ndarray, into: np.ndarray) -> np.ndarray:
    """Where each of the sorted ``ids`` stands, or would, in the sorted ``into``.

    Some ids at a time, the window in ``into`` doubles until it passes them and is then
    searched, so that a stretch without ids costs the logarithm of its length.
    """
    out = np.empty(len(ids), np.int64)
    low = 0
    for at in range(0, len(ids), STRIDE):
        some = ids[at:at + STRIDE]
        width = len(some)
        while low + width < len(into) and into[low + width - 1] < some[-1]:
            width *= 2
        out[at:at + len(some)] = low + np.searchsorted(into[low:low + width], some)
        low = int(out[at + len(some) - 1])
    return out


def inside(ids: np.ndarray, into: np.ndarray) -> np.ndarray:
    """Which of the sorted ``ids`` are in ``into``."""
    if not len(into):
        return np.zeros(len(ids), bool)
    return into[np.minimum(places(ids, into), len(into) - 1)] == ids


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Ids that both sorted lists hold."""
    return int(inside(*((a, b) if len(a) <= len(b) else (b, a))).sum())


def union(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ids of either sorted list."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    new = short[~inside(short, long)]
    return np.insert(long, places(new, long), new)


def added(failing: Sequence[np.ndarray], labelled: Sequence[np.ndarray]) -> np.ndarray:
    """For each set of filters (bits) and each filter outside it: the size of the union, the filter's
    list, what it adds to the union, and how much of that each label has; -1 where the filter is in the set."""
    m = len(failing)
    unions = [np.zeros(0, np.int64)]
    for s in range(1, 1 << m):
        top = s.bit_length() - 1
        unions.append(union(unions[s ^ 1 << top], failing[top]))
    wanted = [[f, *[f[inside(f, g)] for g in labelled]] for f in failing]
    out = np.full((1 << m, m, 3 + len(labelled)), -1, np.int64)
    for s in range(1 << m):
        for f in range(m):
            if not s >> f & 1:
                out[s, f] = [len(unions[s]), len(failing[f]), *[len(x) - common(x, unions[s]) for x in wanted[f]]]
    return out


def sizes(lists: DataFrame, filters: Sequence[str] = FILTERS, labels: Sequence[str] = LABELS) -> DataFrame:
    """Per part, set of filters (``before``, bits) and filter (number): summed sizes over all id ranges."""
    m = len(filters)
    names = ["n", "gone", "fails", "removed", *[f"{c}_lost" for c in labels], "only"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, total = None, 0, None

        def rows() -> pa.RecordBatch:
            s, f = np.nonzero(total[:, :, 0] >= 0)
            alone = total[(1 << m) - 1 ^ 1 << f, f, 2]
            cols = [pa.array([part] * len(s)), pa.array(s.astype(np.int32)), pa.array(f.astype(np.int32)),
                    pa.array(np.full(len(s), n)), *[pa.array(total[s, f, k]) for k in range(total.shape[2])], pa.array(alone)]
            return pa.RecordBatch.from_arrays(cols, names=["part", "before", "filter", *names])

        for batch in batches:
            for row in batch.select(["part", "n", *filters, *labels]).to_pylist():
                found = added([np.array(row[c], np.int64) for c in filters], [np.array(row[c], np.int64) for c in labels])
                if total is not None and row["part"] != part:
                    yield rows()
                    total = None
                part, n, total = (row["part"], row["n"], found) if total is None else (part, n + row["n"], total + np.where(found < 0, 0, found))
        if total is not None:
            yield rows()

    fields = ", ".join(f"{c} long" for c in names)
    return lists.mapInArrow(run, f"part string, before int, filter int, {fields}") \
        .groupBy("part", "before", "filter").agg(*[F.sum(c).alias(c) for c in names])


def report(summed: DataFrame, filters: Sequence[str] = FILTERS, labels: Sequence[str] = LABELS) -> DataFrame:
    """One row a part, order of the filters and step."""
    m = len(filters)
    steps = [("".join(filters[f] for f in order), k + 1, sum(1 << f for f in order[:k]), order[k])
             for order in permutations(range(m)) for k in range(m)]
    orders = summed.sparkSession.createDataFrame(steps, "filter_order string, step int, before int, filter int")
    # Of all orders, so many have just this set of filters before the filter.
    weights = F.element_at(F.array(*[F.lit(factorial(k) * factorial(m - 1 - k)) for k in range(m)]),
                           F.bit_count("before") + 1)
    shapley = F.sum(F.col("removed") * weights).over(W.partitionBy("part", "filter"))
    return summed.withColumn("shapley", shapley).join(F.broadcast(orders), ["before", "filter"]).select(
        "part", "filter_order", "step", (F.col("n") - F.col("gone") - F.col("removed")).alias("kept"), "removed",
        (F.col("fails") - F.col("removed")).alias("redundant"), F.col("only").alias("unique_fails"),
        *[f"{c}_lost" for c in labels], "shapley")


def audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """All of it: ``report`` of the five filters over ``docs``."""
    return report(sizes(postings(measure(docs, labels, **columns))))
