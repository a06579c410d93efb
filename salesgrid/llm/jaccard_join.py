"""Near-duplicate documents by an exact Jaccard join on word shingles.

A document's set is its distinct 5-word shingles (64-bit hashes). Documents with
equal sets are one class, named by a hash of the set; the join is between
classes. It is size-aware, in a heavy-light fashion:

* Under one global order of the shingles, two sets of at least ``t`` common
  elements share at least ``k`` of their first ``size - t + k`` ones (their
  k-prefixes). Small sets enumerate all 2-element subsets of their 2-prefix as
  keys. Large sets put the elements of a longer prefix into inverted lists; a
  scan of the lists counts common elements, and a pair is a candidate only if
  it has as many as its prefixes promise. Sets near the boundary do both.
* The boundary is the size at which enumerating is cheaper than scanning, from
  the histogram of sizes and the mean length of the lists.
* The order puts frequent shingles last (counted over all documents), so shared
  passages don't make lists long. Of frequent shingles the ``MAX_HOT`` most
  frequent ones are broadcast (a fixed bound); any order is right.
* Lists of up to ``HOT`` classes give pairs. Longer ones (large groups of near
  copies) never do: their members are checked against three of the list, and
  lists that still hold several components are compared block against block in
  tasks, which give back spanning links only.
* Candidates are verified with whole sets, first each class with its best
  partner; pairs that are connected by then need no check.

Only links between classes matter for components, so pairs inside a component
are not all listed. Every text is read whole; nothing is capped or sampled.

Defined results: a null text has no words; without words the set is empty and
links with nothing; with fewer than five words the whole sequence is the only
element; equal texts share a component; repeated rows give repeated rows; a
null id is no component's name unless all ids of a component are null; an empty
table gives an empty result. Only id and text are read, so other columns cannot
clash (``representatives`` carries all).
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import scratch, textops
from .bitmap import Bitmap
from .components import connected_components

SHINGLE = 5
THRESHOLD = Fraction(4, 5)
HOT = 64                    # classes in a list that still gives pairs
MAX_HOT = 1 << 20           # frequent shingles that are broadcast
MAX_BOUNDARY = 256          # sizes tried as the boundary
BLOCK_ELEMENTS = 1 << 18    # elements of a block of a long list
TILE_MEMBERS = 1 << 10      # classes of a tile: a task compares two tiles at once, in matrices of classes
SEEN_CLASSES = 1 << 20      # classes a task remembers, so that copies are sent once
SINGLE, SUBSET, HEAVY = 0, 1, 2


def least_overlap(size: int, threshold: Fraction = THRESHOLD) -> int:
    """The smallest overlap that a set of this size can have with any partner."""
    return -(-size * threshold.numerator // threshold.denominator)


def scan_depth(size: int) -> int:
    """k of the scanned prefix: a twentieth of the set, and one."""
    return 1 + size // 20


def prefix_length(size: int, k: int, threshold: Fraction = THRESHOLD) -> int:
    return min(size, size - least_overlap(size, threshold) + k)


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted set of each text."""
    w = textops.words(texts, lower=True)
    g = textops.grams(w.hash, shingle)
    for a, b in zip(w.first[:-1], w.first[1:]):
        if b - a >= shingle:
            yield np.unique(g[a:b - shingle + 1])
        elif b > a:
            yield np.array([textops.sequence(w.hash[a:b])])
        else:
            yield np.zeros(0, np.uint64)


def class_of(s: np.ndarray) -> int:
    """A hash of a sorted set, as a signed 64-bit number."""
    weights = textops.mix(np.arange(1, len(s) + 1, dtype=np.uint64))
    total = np.uint64(0) if not len(s) else (textops.mix(s ^ weights) * (weights | np.uint64(1))).sum()
    return int(textops.mix(np.array([total], np.uint64)).view(np.int64)[0])


def profile(docs: DataFrame, threshold: Fraction = THRESHOLD) -> DataFrame:
    """(doc_id, n, class, low): set size, class, and the lowest shingle hashes for counting.

    ``low`` is half as long again as the scanned prefix, so that what moves up
    when frequent shingles go last has been counted too.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in textops.slices(batch):
                sets = list(shingle_sets(piece.column("text")))
                low = [s[:3 * prefix_length(len(s), scan_depth(len(s)), threshold) // 2 + 1]
                       if len(s) > 3 else s[:0] for s in sets]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in low])]).astype(np.int32)
                flat = np.concatenate(low).view(np.int64) if low else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([class_of(s) for s in sets], pa.int64()),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                    names=["doc_id", "n", "class", "low"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n long, class long, low array<long>")


def frequent(profiled: DataFrame) -> tuple[np.ndarray, float]:
    """Shingles of more than ``HOT`` documents (sorted; at most ``MAX_HOT``, the most frequent),
    and the mean length of the other lists, as a posting sees it."""
    counts, path = scratch.write(
        profiled.select(F.explode("low").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        .filter("n > 1"), "jaccard-counts")
    hot = counts.filter(F.col("n") > HOT).orderBy(F.col("n").desc(), "key").limit(MAX_HOT).select("key")
    keys = hot.toPandas()["key"].to_numpy(np.int64).view(np.uint64)
    light = counts.filter(F.col("n") <= HOT).agg(F.sum(F.col("n") * F.col("n")), F.sum("n")).first()
    scratch.remove(profiled.sparkSession, path)
    return np.sort(keys), (light[0] / light[1] if light[1] else 1.0)


def boundary(profiled: DataFrame, mean_list: float, threshold: Fraction = THRESHOLD) -> int:
    """The size up to which sets enumerate subsets, of least estimated cost."""
    sizes = {r.n: r["count"] for r in profiled.filter(F.col("n").between(4, 2 * MAX_BOUNDARY))
             .groupBy("n").count().collect()}

    def subsets(s: int) -> float:
        p = prefix_length(s, 2, threshold)
        return p * (p - 1) / 2

    def cost(x: int) -> float:
        both = -(-(x + 1) * threshold.numerator // threshold.denominator)
        return sum(n * (subsets(s) if s <= x else 0) for s, n in sizes.items()) \
            + sum(n * prefix_length(s, scan_depth(s), threshold) * (1 + mean_list)
                  for s, n in sizes.items() if s >= both)

    return min(range(3, MAX_BOUNDARY + 1), key=lambda x: (cost(x), x))


def postings(docs: DataFrame, hot: np.ndarray, small: int, threshold: Fraction = THRESHOLD) -> DataFrame:
    """(key, class, n, kind) of the sets of at least four elements (smaller ones link only if equal)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(hot)
    both = -(-(small + 1) * threshold.numerator // threshold.denominator)

    def ordered(s: np.ndarray) -> np.ndarray:
        if not len(shared.value):
            return s
        at = np.minimum(np.searchsorted(shared.value, s), len(shared.value) - 1)
        last = shared.value[at] == s
        return np.concatenate([s[~last], s[last]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for piece in textops.slices(batch):
                keys, classes, sizes, kinds = [], [], [], []
                for s in shingle_sets(piece.column("text")):
                    if len(s) < 4 or (c := class_of(s)) in seen:
                        continue
                    if len(seen) >= SEEN_CLASSES:
                        seen.clear()
                    seen.add(c)
                    o = ordered(s)
                    if len(s) <= small:
                        p = np.sort(o[:prefix_length(len(s), 2, threshold)])
                        i, j = np.triu_indices(len(p), 1)
                        found = [(textops.mix(p[i] * np.uint64(31) + textops.mix(p[j])), SUBSET)]
                    else:
                        found = []
                    if len(s) >= both:
                        found.append((o[:prefix_length(len(s), scan_depth(len(s)), threshold)], SINGLE))
                    for k, kind in found:
                        keys.append(k)
                        classes.append(np.full(len(k), c))
                        sizes.append(np.full(len(k), len(s), np.int32))
                        kinds.append(np.full(len(k), kind, np.int32))
                if keys:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(classes)),
                         pa.array(np.concatenate(sizes)), pa.array(np.concatenate(kinds))],
                        names=["key", "class", "n", "kind"])

    return docs.select("text").mapInArrow(run, "key long, class long, n int, kind int")


def _list_pairs(batches: Iterator[pa.RecordBatch], threshold: Fraction) -> Iterator[pa.RecordBatch]:
    """Pairs of the short lists and members of the long ones, from a stream sorted by (kind, key, class)."""
    names = ("kind", "key", "class", "n")
    num, den = threshold.numerator, threshold.denominator

    def out(kind: np.ndarray, a: np.ndarray, b: np.ndarray, need: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(kind.astype(np.int32)), pa.array(a), pa.array(b), pa.array(need.astype(np.int32))],
            names=["kind", "a", "b", "need"])

    def lists(rows: dict[str, np.ndarray], heavy: tuple | None) -> Iterator[pa.RecordBatch]:
        """Whole lists; ``heavy`` names a list whose earlier members have been sent."""
        kind, key, cls, n = (rows[c] for c in names)
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (kind[1:] != kind[:-1])
        keep = fresh.copy()
        keep[1:] |= cls[1:] != cls[:-1]
        kind, key, cls, n, fresh = kind[keep], key[keep], cls[keep], n[keep], fresh[keep]
        begin = np.flatnonzero(fresh)
        size = np.diff(np.append(begin, len(key)))
        long = size > HOT
        if heavy is not None and len(begin):
            long[0] |= (int(kind[0]), int(key[0])) == heavy
        for length in np.unique(size[~long & (size > 1)]):
            at = begin[~long & (size == length)]
            i, j = np.triu_indices(length, 1)
            x, y = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
            low, high = np.minimum(n[x], n[y]).astype(np.int64), np.maximum(n[x], n[y]).astype(np.int64)
            fit = low * den >= high * num
            x, y, low = x[fit], y[fit], low[fit]
            need = np.where(kind[x] == SINGLE, 1 + low // 20, 1)
            yield out(kind[x], cls[x], cls[y], need)
        member = np.repeat(long, size)
        if member.any():
            yield out(np.full(member.sum(), HEAVY), key[member], cls[member], np.zeros(member.sum()))

    held: dict[str, np.ndarray] | None = None
    heavy = None
    for batch in batches:
        rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
        if held is not None:
            rows = {c: np.concatenate([held[c], rows[c]]) for c in names}
        if not len(rows["key"]):
            continue
        other = np.flatnonzero((rows["key"] != rows["key"][-1]) | (rows["kind"] != rows["kind"][-1]))
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            yield from lists({c: v[:cut] for c, v in rows.items()}, heavy)
            heavy = None
        held = {c: v[cut:] for c, v in rows.items()}
        if len(np.unique(held["class"])) > HOT:     # the open list is long already: send what is here
            yield from lists(held, heavy)
            heavy = (int(held["kind"][0]), int(held["key"][0]))
            held = {c: v[-1:] for c, v in held.items()}
    if held is not None:
        yield from lists(held, heavy)


def candidates(posted: DataFrame, threshold: Fraction = THRESHOLD) -> DataFrame:
    """(kind, a, b, need): pairs of classes from short lists, and (HEAVY, key, class) of long ones."""
    return posted.repartition("kind", "key").sortWithinPartitions("kind", "key", "class") \
        .mapInArrow(lambda batches: _list_pairs(batches, threshold), "kind int, a long, b long, need int")


def sets_of(docs: DataFrame, first: DataFrame) -> DataFrame:
    """(class, items): whole sets of the classes in ``first`` (class, doc_id, n).

    A bitmap of the wanted ids tells the tasks which texts to work on, so that
    texts needn't be shuffled; the join by class drops what it lets through.
    """
    ident = F.xxhash64("doc_id")
    wanted = Bitmap(first.select(ident.alias("key")), first.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy().view(np.uint64)
            for piece in textops.slices(batch.filter(pa.array(wanted.has(keys)))):
                sets = list(shingle_sets(piece.column("text")))
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([class_of(s) for s in sets], pa.int64()),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["class", "items"])

    return docs.select(ident.alias("key"), "text").mapInArrow(run, "class long, items array<long>") \
        .join(first.select("class"), "class", "left_semi") \
        .groupBy("class").agg(F.any_value("items").alias("items"))


def verified(pairs: DataFrame, sets: DataFrame, threshold: Fraction = THRESHOLD) -> DataFrame:
    """The pairs (a, b) whose sets' Jaccard similarity reaches the threshold."""
    num, den = threshold.numerator, threshold.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys = batch.column("x"), batch.column("y")
            xo, yo = xs.offsets.to_numpy(), ys.offsets.to_numpy()
            xv, yv = xs.values.to_numpy().view(np.uint64), ys.values.to_numpy().view(np.uint64)
            good = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                s, t = xv[xo[i]:xo[i + 1]], yv[yo[i]:yo[i + 1]]
                common = len(np.intersect1d(s, t, assume_unique=True))
                good[i] = common * den >= (len(s) + len(t) - common) * num
            yield batch.select(["a", "b"]).filter(pa.array(good))

    right = sets.select(F.col("class").alias("b"), F.col("items").alias("y"))
    left = sets.select(F.col("class").alias("a"), F.col("items").alias("x"))
    return pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "x", "y") \
        .mapInArrow(run, "a long, b long")


def apart(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose classes are not in one component yet."""
    x = parts.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    y = parts.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    return pairs.join(x, "a", "left").join(y, "b", "left") \
        .filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).drop("ca", "cb")


def long_list_pairs(heavy: DataFrame) -> DataFrame:
    """Pairs (a, b) of the members of each long list with three members of it, drawn by hash."""
    drawn = [F.min_by("class", F.xxhash64(F.lit(i), "class")).alias(f"r{i}") for i in range(3)]
    of = heavy.groupBy("key").agg(F.array_distinct(F.array(*[F.min_by(
        "class", F.xxhash64(F.lit(i), "class")) for i in range(len(drawn))])).alias("reps"))
    joined = heavy.join(of, "key").select("class", F.explode("reps").alias("rep")).filter("class <> rep")
    return joined.select(F.least("class", "rep").alias("a"), F.greatest("class", "rep").alias("b")).distinct()


def long_list_links(heavy: DataFrame, parts: DataFrame, sizes: DataFrame, sets: DataFrame,
                    threshold: Fraction = THRESHOLD) -> DataFrame:
    """Spanning links inside long lists that hold several components.

    Lists of equal members count once. A list is cut into blocks of about
    ``BLOCK_ELEMENTS`` elements, and each pair of blocks is compared in one group,
    in tiles of ``TILE_MEMBERS`` classes.
    """
    named = heavy.join(parts.select(F.col("node").alias("class"), "component"), "class", "left") \
        .join(sizes, "class").select("key", "class", F.coalesce("component", "class").alias("component"), "n")
    lists = named.groupBy("key", "component").agg(
        F.count(F.lit(1)).alias("members"), F.sum("n").alias("elements"),
        F.sum(F.xxhash64("class").cast("decimal(38,0)")).alias("digest")) \
        .groupBy("key").agg(F.count(F.lit(1)).alias("components"), F.sum("members").alias("members"),
                            F.sum("elements").alias("elements"), F.sum("digest").alias("digest"))
    open_lists = lists.filter("components > 1").groupBy("members", "digest").agg(
        F.min("key").alias("key"), F.min("elements").alias("elements")) \
        .select("key", F.ceil(F.col("elements") / BLOCK_ELEMENTS).cast("int").alias("blocks"))
    dealt = named.join(open_lists, "key").withColumn("mine", F.pmod(F.xxhash64("class"), "blocks").cast("int"))
    paired = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")) \
        .select(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("pair"),
                (F.col("mine") <= F.col("other")).alias("first"), "class", "component")
    num, den = threshold.numerator, threshold.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _runs(batches, "pair"):
            ids, part = group["class"].to_numpy(), group["component"].to_numpy()
            if len(np.unique(part)) < 2:
                continue
            items = group["items"].combine_chunks()
            root: dict[int, int] = {}
            for at in _tiles(len(ids)):
                a, b = _linked(items.take(pa.array(at)), num, den)
                x, y = _spanning(at[a], at[b], part, root)
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[x]), pa.array(ids[y])], names=["a", "b"])

    return paired.join(sets, "class").repartition("pair").sortWithinPartitions("pair", "class") \
        .mapInArrow(run, "a long, b long")


def _tiles(n: int) -> Iterator[np.ndarray]:
    """Positions of each two tiles of n classes (all at once, if they are two tiles at most)."""
    cuts = np.array_split(np.arange(n), max(2, -(-n // TILE_MEMBERS)))
    for i in range(len(cuts)):
        for j in range(i + 1, len(cuts)):
            yield np.concatenate([cuts[i], cuts[j]])


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if held and held[-1].column(key)[0].as_py() != keys[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _linked(items: pa.ListArray, num: int, den: int, columns: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of similar sets of one group, by counting shared elements in column blocks."""
    offsets = items.offsets.to_numpy()
    size = np.diff(offsets)
    owner = np.repeat(np.arange(len(size)), size)
    _, column, count = np.unique(items.values.to_numpy()[offsets[0]:offsets[-1]], return_inverse=True,
                                 return_counts=True)
    shared = count[column] > 1
    owner, column = owner[shared], column[shared]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    renamed = np.cumsum(np.concatenate([[0], column[1:] != column[:-1]])) if len(column) else column
    common = np.zeros((len(size), len(size)), np.float32)
    for at in range(0, int(renamed[-1]) + 1 if len(renamed) else 0, columns):
        a, b = np.searchsorted(renamed, [at, at + columns])
        block = np.zeros((len(size), columns), np.float32)
        block[owner[a:b], renamed[a:b] - at] = 1
        common += block @ block.T
    overlap = common.astype(np.int64)
    union = size[:, None] + size[None, :] - overlap
    return np.nonzero(np.triu(overlap * den >= union * num, 1))


def _spanning(a: np.ndarray, b: np.ndarray, part: np.ndarray, root: dict[int, int]) -> tuple[list[int], list[int]]:
    """Of the links, those that join components (``part`` names the known ones, ``root`` those joined so far)."""
    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    x, y = [], []
    for i, j in zip(a.tolist(), b.tolist()):
        p, q = find(int(part[i])), find(int(part[j]))
        if p != q:
            root[p] = q
            x.append(i)
            y.append(j)
    return x, y


def near_duplicates(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id",
                    threshold: Fraction = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id, class and component (of classes) of every row."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    profiled, wide = scratch.write(profile(rows, threshold), "jaccard-profile")
    hot, mean_list = frequent(profiled)
    small = boundary(profiled, mean_list, threshold)
    documents, _ = scratch.write(profiled.drop("low"), "jaccard-documents")
    scratch.remove(spark, wide)
    found, found_path = scratch.write(candidates(postings(rows, hot, small, threshold), threshold), "jaccard-lists")
    light = found.filter(F.col("kind") != HEAVY).groupBy("a", "b").agg(
        F.count(F.when(F.col("kind") == SINGLE, 1)).alias("singles"),
        F.max(F.when(F.col("kind") == SINGLE, F.col("need"))).alias("need"),
        F.count(F.when(F.col("kind") == SUBSET, 1)).alias("subsets")) \
        .filter("subsets > 0 OR singles >= need")
    pairs, pairs_path = scratch.write(light.select("a", "b", F.col("singles") + F.col("subsets")).toDF(
        "a", "b", "common"), "jaccard-pairs")
    heavy = found.filter(F.col("kind") == HEAVY).select(F.col("a").alias("key"), F.col("b").alias("class")).distinct()
    heavy, heavy_path = scratch.write(heavy, "jaccard-long")
    scratch.remove(spark, found_path)
    first = documents.filter("n > 3").groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("class")).unionByName(heavy.select("class")).distinct()
    needed, _ = scratch.write(first.join(wanted, "class", "left_semi"), "jaccard-wanted")
    sets, sets_path = scratch.write(sets_of(rows, needed), "jaccard-sets")

    ends = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "common"))
    best = ends.withColumn("place", F.row_number().over(
        W.partitionBy("a").orderBy(F.col("common").desc(), "b"))).filter("place = 1") \
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    opening = best.unionByName(long_list_pairs(heavy)).distinct()
    links, _ = scratch.write(verified(opening, sets, threshold), "jaccard-links")
    parts = connected_components(links.toDF("u", "v"))
    rest = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more, _ = scratch.write(verified(apart(rest, parts), sets, threshold), "jaccard-links")
    last, _ = scratch.write(long_list_links(heavy, parts, needed.select("class", "n"), sets, threshold),
                            "jaccard-links")
    parts = connected_components(links.unionByName(more).unionByName(last).toDF("u", "v"))
    scratch.remove(spark, pairs_path, heavy_path, sets_path)
    grouped = documents.join(parts.select(F.col("node").alias("class"), "component"), "class", "left") \
        .withColumn("component", F.coalesce("component", "class"))
    names = grouped.filter("n > 0").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return grouped.join(names, "component", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "class", "component")


def representatives(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id",
                    threshold: Fraction = THRESHOLD) -> DataFrame:
    """One row of each group, with all columns: that of the smallest id. Rows without words stay.

    Ids decide alone unless some are null or repeated; of the rows with such an
    id, the first by a digest of its columns stays.
    """
    found, _ = scratch.write(near_duplicates(docs, text=text, doc_id=doc_id, threshold=threshold),
                             "jaccard-result")
    ident = F.col(f"`{doc_id}`")
    gone = found.filter("n_shingles > 0 AND doc_id IS NOT NULL AND doc_id <> component_id") \
        .select(F.col("doc_id").alias("gone_id")).distinct()
    odd = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR doc_id IS NULL") \
        .select(F.col("doc_id").alias("odd_id"))
    if odd.isEmpty():
        return docs.join(gone, ident == F.col("gone_id"), "left_anti")
    plain = docs.join(odd, ident.eqNullSafe(F.col("odd_id")), "left_anti") \
        .join(gone, ident == F.col("gone_id"), "left_anti")
    rows = docs.join(odd, ident.eqNullSafe(F.col("odd_id")), "left_semi")
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    classed = _with_class(rows.select(F.struct("*").alias("row"), ident.alias("doc_id"), tie.alias("tie"),
                                      F.col(f"`{text}`").cast("string").alias("text")))
    groups = found.filter("n_shingles > 0").select("class", "component", "component_id").distinct()
    ranked = classed.join(groups, "class", "left").withColumn("place", F.row_number().over(
        W.partitionBy("component").orderBy(F.col("doc_id").asc_nulls_last(), "tie")))
    stays = F.col("component").isNull() \
        | (F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("place") == 1))
    return plain.unionByName(ranked.filter(stays).select("row.*"))


def _with_class(rows: DataFrame) -> DataFrame:
    """(row, doc_id, tie, class); a text without words has no class."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in textops.slices(batch):
                sets = list(shingle_sets(piece.column("text")))
                named = pa.array([class_of(s) if len(s) else None for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*[piece.column(c) for c in ("row", "doc_id", "tie")], named],
                    names=["row", "doc_id", "tie", "class"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"row {kinds['row']}, doc_id {kinds['doc_id']}, tie long, class long")
