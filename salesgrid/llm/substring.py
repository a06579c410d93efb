"""Remove words that repeat an earlier passage of ``WINDOW`` words or more.

A window (20 consecutive words of one document) is a repeat if its words also
start earlier: in a smaller doc_id, or earlier in the same document. Words under
repeats go; windows are judged on the input. Every repeat is found:

1. Each window has an anchor, its smallest 8-word hash; equal windows have equal
   anchors. Consecutive windows with one anchor are a run. Anchors are counted
   over all documents (partial counts first); those found once are done.
2. The runs of the others are grouped by anchor and content. All but the first
   run of equal ones are repeats as a whole.
3. Where an anchor has runs of different content (ends of passages, edits,
   periodic text), the first run of each content goes to the reference shard of
   its anchor. A shard builds the suffix automaton of its runs, in order, while
   it streams them: the matching statistic at each word is the length of the
   longest suffix seen before, and spans of 20 words or more are repeats.
   Shards are dealt by anchor, not sent to all tasks, so that the work grows
   with the repeated text and not with its square; an automaton holds one anchor's
   runs, ``MAX_CONTENTS`` at most. Anchors with more are resolved like step 2
   with every window as a run of its own, which needs no automaton.

What steps 2 and 3 read again from the texts is found with bitmaps of at most
``bitmap.MAX_BITS`` bits (a fixed bound); a false hit is dropped
by a join, and a full bitmap costs time, not results.

Defined results: a null text has no words; a null id comes last; rows that
share an id are one document for the order, so equal rows don't remove each
other; repeated rows give repeated rows; an empty table gives an empty result.
Ids must be whole numbers. Only id and text are read, so other columns cannot
clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch, textops
from .bitmap import Bitmap

WINDOW = 20
GRAM = 8
MAX_RUN = 64               # windows of a run
MAX_CONTENTS = 1024        # different runs of an anchor in one automaton
LAST = (1 << 63) - 1       # the order of a null id


class SuffixAutomaton:
    """Of word sequences, grown word by word; each sequence starts at the root."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """The state of the words of ``p`` and ``word`` alone: q, or a copy of it."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def add(self, words: list[int]) -> list[int]:
        """Add a sequence; for each word, the length of the longest suffix that was there before."""
        last, seen = 0, []
        for word in words:
            q = self.next[last].get(word)
            if q is not None:
                last = self._split(last, word, q)
                seen.append(self.length[last])
                continue
            new = self._state(self.length[last] + 1, {}, 0)
            p = last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._split(p, word, self.next[p][word])
            seen.append(self.length[self.link[new]])
            last = new
        return seen


class _Runs:
    """The runs of a slice of rows; positions count words of the slice."""

    def __init__(self, texts: pa.Array):
        self.w = w = textops.words(texts)
        rows = w.row_of()
        n = max(0, len(w.hash) - WINDOW + 1)
        at = np.flatnonzero(rows[:n] == rows[len(rows) - n:]) if n else np.zeros(0, np.int64)
        self.grams = textops.grams(w.hash, GRAM)
        anchor = _sliding_min(self.grams, WINDOW - GRAM + 1)[at] if n else np.zeros(0, np.uint64)
        fresh = np.ones(len(at), bool)
        fresh[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1) | (rows[at[1:]] != rows[at[:-1]])
        begin = np.flatnonzero(fresh)
        place = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
        begin = np.flatnonzero(fresh | (place % MAX_RUN == 0))
        self.count = np.diff(np.append(begin, len(at)))
        self.at, self.anchor = at[begin], anchor[begin]
        self.row = rows[self.at]
        self._sums = None

    def content(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Hashes of word spans."""
        if self._sums is None:
            up, _ = textops._powers(len(self.w.hash) + 1)
            self._sums = np.zeros(len(self.w.hash) + 1, np.uint64)
            np.cumsum(textops.mix(self.w.hash) * up[:len(self.w.hash)], out=self._sums[1:])
        _, down = textops._powers(len(self.w.hash) + 1)
        return textops.mix((self._sums[at + size] - self._sums[at]) * down[at] + size.astype(np.uint64))

    def periodic(self, which: np.ndarray) -> np.ndarray:
        """Whether a run holds a window twice: only where 8 words recur within one window's reach."""
        recur = np.zeros(len(self.grams), bool)
        for d in range(1, WINDOW - GRAM + 2):     # the farthest that an anchor recurs in one run
            recur[:-d] |= self.grams[d:] == self.grams[:-d]
        total = np.concatenate([[0], np.cumsum(recur)])
        end = self.at[which] + self.count[which] + WINDOW - GRAM
        out = total[end] > total[self.at[which]]
        out[out] = self._holds_twice(which[out])
        return out

    def _holds_twice(self, which: np.ndarray) -> np.ndarray:
        count = self.count[which]
        run = np.repeat(np.arange(len(which)), count)
        at = np.repeat(self.at[which] - np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int64), count) \
            + np.arange(count.sum())
        key = textops.by_row(self.content(at, np.full(len(at), WINDOW)), run)
        different = np.bincount(run[np.unique(key, return_index=True)[1]], minlength=len(which))
        return different < count

    def starts(self, which: np.ndarray) -> np.ndarray:
        return self.at[which] - self.w.first[self.row[which]]


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    out, size = x, 1
    while 2 * size <= width:
        out, size = np.minimum(out[:len(out) - size], out[size:]), 2 * size
    rest = width - size
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in textops.slices(batch):
            r = _Runs(piece.column("text"))
            twice = r.anchor[r.periodic(np.arange(len(r.at)))]   # a periodic run repeats itself
            keys, n = np.unique(np.concatenate([r.anchor, twice]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["key", "n"])


def _identity(anchor: np.ndarray, content: np.ndarray, order: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A key of one run of one document (the same for rows that share id and words)."""
    return textops.mix(textops.by_row(content, start) ^ textops.mix(anchor) ^ textops.mix(order.astype(np.uint64)))


_RUN = "anchor long, content long, ord long, row long, start int, size int, periodic boolean"


def _found_runs(rows: DataFrame, repeated: Bitmap) -> DataFrame:
    """The runs whose anchor may occur twice."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in textops.slices(batch):
                r = _Runs(piece.column("text"))
                which = np.flatnonzero(repeated.has(r.anchor))
                if len(which):
                    content = r.content(r.at[which], r.count[which] + WINDOW - 1)
                    row = pa.array(r.row[which])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(r.anchor[which].view(np.int64)), pa.array(content.view(np.int64)),
                         piece.column("ord").take(row), piece.column("row").take(row),
                         pa.array(r.starts(which).astype(np.int32)), pa.array(r.count[which].astype(np.int32)),
                         pa.array(r.periodic(which))],
                        names=["anchor", "content", "ord", "row", "start", "size", "periodic"])
    return rows.mapInArrow(run, _RUN)


def _fragments(rows: DataFrame, wanted: Bitmap, whole: bool) -> DataFrame:
    """Words of the wanted runs (``whole``), or their windows as runs of their own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in textops.slices(batch):
                r = _Runs(piece.column("text"))
                order = piece.column("ord").to_numpy()[r.row]
                content = r.content(r.at, r.count + WINDOW - 1)
                start = r.starts(np.arange(len(r.at)))
                which = np.flatnonzero(wanted.has(_identity(r.anchor, content, order, start)))
                if not len(which):
                    continue
                row = pa.array(r.row[which])
                head = [pa.array(r.anchor[which].view(np.int64)), pa.array(content[which].view(np.int64)),
                        piece.column("ord").take(row), piece.column("row").take(row),
                        pa.array(start[which].astype(np.int32)), pa.array(r.count[which].astype(np.int32))]
                size = r.count[which] + (WINDOW - 1 if whole else 0)
                offsets = np.concatenate([[0], np.cumsum(size)])
                at = np.repeat(r.at[which] - offsets[:-1], size) + np.arange(offsets[-1])
                items = r.w.hash[at] if whole else r.content(at, np.full(len(at), WINDOW))
                yield pa.RecordBatch.from_arrays(
                    [*head, pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)),
                                                     pa.array(items.view(np.int64)))],
                    names=["anchor", "content", "ord", "row", "start", "size", "items"])
    return rows.mapInArrow(run, "anchor long, content long, ord long, row long, start int, size int, "
                                "items array<long>")


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeats among the runs of each anchor, from a stream sorted by (anchor, ord, start, content).

    Rows that share id and words give a run more than once: it is added once, and
    all of them have its repeats.
    """
    anchor, automaton, run, spans = None, None, None, []
    for batch in batches:
        row, start, size = [], [], []
        columns = zip(*[batch.column(c).to_pylist() for c in ("anchor", "ord", "start", "content", "items")])
        for i, (key, order, at, content, words) in enumerate(columns):
            if key != anchor or automaton is None:
                anchor, automaton, run = key, SuffixAutomaton(), None
            if run != (order, at, content):
                run, spans, begin = (order, at, content), [], None
                for j, n in enumerate([*automaton.add(words), 0]):
                    if n >= WINDOW:
                        begin = j - WINDOW + 1 if begin is None else begin
                    elif begin is not None:
                        spans.append((at + begin, j - WINDOW + 1 - begin))
                        begin = None
            for first, count in spans:
                row.append(i)
                start.append(first)
                size.append(count)
        at = pa.array(row, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("ord").take(at), batch.column("row").take(at), pa.array(start, pa.int32()),
             pa.array(size, pa.int32())], names=["ord", "row", "start", "size"])


_SPAN = ["ord", "row", "start", "size"]


def _place(c: str = "ord") -> Column:
    return F.struct(F.col(c), F.col("start"))


def repeats(docs: DataFrame) -> DataFrame:
    """(ord, row, start, size): runs of ``size`` repeated windows of (ord, row, text) rows."""
    spark = docs.sparkSession
    counts = docs.mapInArrow(_anchors, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")) \
        .filter("n > 1").select("key")
    counts, counts_path = scratch.write(counts, "substring-anchors")
    repeated = Bitmap(counts, counts.count())
    found, found_path = scratch.write(_found_runs(docs, repeated).join(
        counts.withColumnRenamed("key", "anchor"), "anchor", "left_semi"), "substring-runs")
    repeated.release()
    scratch.remove(spark, counts_path)
    contents = found.groupBy("anchor", "content").agg(F.min(_place()).alias("first"),
                                                      F.max("periodic").alias("periodic"))
    contents, contents_path = scratch.write(contents, "substring-contents")
    later = found.join(contents.drop("periodic"), ["anchor", "content"]) \
        .filter(_place() > F.col("first")).select(*_SPAN)
    anchors = contents.groupBy("anchor").agg(F.count(F.lit(1)).alias("contents"), F.max("periodic").alias("periodic")) \
        .filter("contents > 1 OR periodic")
    open_runs = contents.join(anchors.drop("periodic"), "anchor").select(
        "anchor", "content", F.col("first.ord").alias("ord"), F.col("first.start").alias("start"), "contents")
    open_runs, _ = scratch.write(open_runs, "substring-open")
    spans, bitmaps = [later], []
    for whole, chosen in ((True, F.col("contents") <= MAX_CONTENTS), (False, F.col("contents") > MAX_CONTENTS)):
        mine = open_runs.filter(chosen)
        n = mine.count()
        if n:
            keys = mine.mapInArrow(_identities, "key long")
            bitmaps.append(Bitmap(keys, n))
            parts = _fragments(docs, bitmaps[-1], whole) \
                .join(mine.drop("contents"), ["anchor", "content", "ord", "start"], "left_semi")
            spans.append(_by_automaton(parts) if whole else _by_window(parts))
    out, _ = scratch.write(_union(spans), "substring-spans")
    for b in bitmaps:
        b.release()
    scratch.remove(spark, found_path, contents_path)
    return out


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _identities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, c, o, s = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("anchor", "content", "ord", "start"))
        key = _identity(a.view(np.uint64), c.view(np.uint64), o, s)
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], names=["key"])


def _by_automaton(parts: DataFrame) -> DataFrame:
    return parts.repartition("anchor").sortWithinPartitions("anchor", "ord", "start", "content") \
        .mapInArrow(_matched, "ord long, row long, start int, size int")


def _by_window(parts: DataFrame) -> DataFrame:
    """Every window as a run of its own: all but the first of equal ones."""
    windows = parts.select("ord", "row", F.col("start").alias("at"), F.posexplode("items").alias("i", "content")) \
        .select("content", "ord", "row", (F.col("at") + F.col("i")).alias("start"))
    first = windows.groupBy("content").agg(F.min(_place()).alias("first"), F.count(F.lit(1)).alias("n")) \
        .filter("n > 1").select("content", "first")
    return windows.join(first, "content").filter(_place() > F.col("first")) \
        .select("ord", "row", "start", F.lit(1).alias("size"))


def remove_repeats(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by one space) of every row."""
    ident = F.col(f"`{doc_id}`").cast("long")
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(ident, F.lit(LAST)).alias("ord"), F.xxhash64(body).alias("row"),
                       body.alias("text"))
    spans = repeats(rows).groupBy("ord", "row").agg(
        F.collect_list("start").alias("starts"), F.collect_list("size").alias("sizes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in textops.slices(batch):
                w = textops.words(piece.column("text"))
                cover = np.zeros(len(w.hash) + 1, np.int64)
                starts, sizes = piece.column("starts"), piece.column("sizes")
                for i in np.flatnonzero(np.asarray(starts.is_valid())).tolist():
                    s = starts[i].values.to_numpy().astype(np.int64) + w.first[i]
                    np.add.at(cover, s, 1)
                    np.add.at(cover, s + sizes[i].values.to_numpy() + WINDOW - 1, -1)
                gone = np.cumsum(cover[:-1]) > 0
                kept = [_joined(w, np.flatnonzero(~gone[a:b]) + a) for a, b in zip(w.first[:-1], w.first[1:])]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(w.counts()), pa.array(textops.sums(gone, w.first)),
                     pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    joined = rows.withColumn("doc_id", F.when(F.col("ord") < LAST, F.col("ord"))) \
        .join(spans, ["ord", "row"], "left").select("doc_id", "text", "starts", "sizes")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def _joined(w: textops.Words, which: np.ndarray) -> str:
    return b" ".join(w.data[a:b].tobytes() for a, b in zip(w.start[which], w.end[which])).decode()


def digests(removed: DataFrame) -> DataFrame:
    """The digest columns of ``remove_repeats``."""
    return removed.select("doc_id", "n_words", "n_removed",
                          F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
