"""Near-duplicate vectors by NN-descent.

Vectors that are equal (same label, same components) are one node with a
multiplicity. A neighbour graph (``K`` best neighbours a node, same label only)
starts from blocks of nodes that are adjacent under random sign codes and is
then refined: every node's neighbours and reverse neighbours are compared with
one another, pairs better than a list's worst entry go back to their ends, and
lists keep their best, until less than ``MIN_CHANGE`` of the entries change.

A list that is full of links is saturated: links to other groups may have no
place in it. Nodes of such lists are compared exactly with those of the other
components' saturated lists. The other nodes are audited: portions of them, drawn
by hash, are compared with all nodes, until ``AUDIT_NODES`` nodes with a link are
seen or all nodes are compared (then the result is exact). A link counts as found
if its ends share a component; those that were missing are added. Below
``MIN_RECALL`` another start (new codes) is added and refined, and after the last
one all portions are compared. A portion is broadcast (``ASKED_VALUES`` numbers),
and one link of two components in a batch leaves the tasks.

Inside each component all pairs are then compared exactly, in blocks of ``BLOCK``
nodes, and only counts leave the tasks, so a large group of copies never
becomes rows.

Cosines are computed in double precision. All joins are on ids; hub nodes' list
of reverse neighbours is bounded by ``REVERSE`` a round, drawn anew each round.

Defined results: vectors that are null, zero or hold null or non-finite
components, and vectors with a null label, link with nothing; vectors of
different length don't link; repeated rows (or ids) count as vectors of their
own, a component has the smallest id; a null id is no component's name unless
all of its ids are null; an empty table gives an empty result. Only the three
columns are read, so others cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import scratch
from .components import connected_components

K = 10
REVERSE = 10
START_TABLES = 8
START_BLOCK = 128
MIN_CHANGE = 0.01
MAX_ROUNDS = 6
MAX_STARTS = 4
BLOCK = 1024
AUDIT_NODES = 256
ASKED_VALUES = 1 << 20
TILE = 1 << 22
MIN_RECALL = 0.99
THRESHOLD = 0.98


def _unit(vectors: pa.Array) -> np.ndarray:
    """Rows of unit length, in double precision."""
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    # Scaled by the largest component first: very small and very large ones keep their direction.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def nodes_of(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """(node, grp, vec, mult, vec_id): one row for each distinct usable vector of a label."""
    e = F.col("vec")
    usable = e.isNotNull() & F.col("label").isNotNull() & (F.size(e) > 0) \
        & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) \
        & F.exists(e, lambda x: x != 0)
    rows = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{label}`").alias("label"),
                          F.col(f"`{embedding}`").cast("array<double>").alias("vec")).filter(usable)
    # x + 0.0 makes -0.0 and 0.0 one value, so that equal vectors have equal digests.
    rows = rows.withColumn("vec", F.transform("vec", lambda x: x + F.lit(0.0)))
    grp = F.xxhash64("label", F.size("vec"))
    return rows.groupBy("label", "vec").agg(F.count(F.lit(1)).alias("mult"), F.min("vec_id").alias("vec_id")) \
        .select(F.xxhash64("label", "vec").alias("node"), grp.alias("grp"), "vec", "mult", "vec_id")


def _grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of equal keys of a sorted stream."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        if held and held[-1].column(key)[0].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


_EDGE = "u long, v long, cos double"


def _edges(u: np.ndarray, v: np.ndarray, cos: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(cos)], names=["u", "v", "cos"])


def _best(cos: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k largest entries of each row, the diagonal left out."""
    np.fill_diagonal(cos, -2.0)
    k = min(k, len(cos) - 1)
    cols = np.argpartition(cos, -k, axis=1)[:, -k:]
    return np.repeat(np.arange(len(cos)), k), cols.ravel()


def start(nodes: DataFrame, n: int, seed: int, k: int = K, tables: int = START_TABLES) -> DataFrame:
    """Edges between nodes that are close together under random sign codes."""
    bits = int(np.clip(np.ceil(np.log2(max(n, 2) / 64)), 4, 24))

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            for group in _grouped(iter([batch]), "dim"):
                x = _unit(group["vec"].combine_chunks())
                if x.shape[1] not in planes:
                    planes[x.shape[1]] = np.random.default_rng(seed).standard_normal((tables, bits, x.shape[1]))
                for t in range(tables):
                    value = x @ planes[x.shape[1]][t].T
                    code = (value > 0) @ (1 << np.arange(bits))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(x), t)), group["grp"].combine_chunks(), pa.array(code),
                         pa.array(value[:, 0]), group["node"].combine_chunks(), group["vec"].combine_chunks()],
                        names=["t", "grp", "code", "value", "node", "vec"])

    coded = nodes.select("node", "grp", "vec", F.size("vec").alias("dim")).mapInArrow(
        codes, "t long, grp long, code long, value double, node long, vec array<double>")
    order = ["t", "grp", "code", "value", "node"]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in _grouped(iter([batch.append_column("tg", pa.array(
                    batch.column("t").to_numpy() * 31 + batch.column("grp").to_numpy()))]), "tg"):
                for at in range(0, len(group), START_BLOCK):
                    part = group.slice(at, START_BLOCK)
                    if len(part) > 1:
                        x, ids = _unit(part["vec"].combine_chunks()), part["node"].to_numpy()
                        cos = x @ x.T
                        i, j = _best(cos, k)
                        yield _edges(ids[i], ids[j], cos[i, j])

    return coded.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(blocks, _EDGE)


def keep_best(edges: DataFrame, k: int = K) -> DataFrame:
    """The k best neighbours of each node."""
    once = edges.groupBy("u", "v").agg(F.max("cos").alias("cos"))
    place = F.row_number().over(W.partitionBy("u").orderBy(F.col("cos").desc(), "v"))
    return once.withColumn("place", place).filter(F.col("place") <= k).drop("place")


def refine(nodes: DataFrame, graph: DataFrame, turn: int, reverse: int = REVERSE, k: int = K) -> DataFrame:
    """Edges found by comparing the neighbours (both ways) of each node with one another."""
    back = graph.select(F.col("v").alias("u"), F.col("u").alias("v"))
    drawn = F.row_number().over(W.partitionBy("u").orderBy(F.xxhash64(F.lit(turn), "v")))
    around = graph.select("u", "v").unionByName(
        back.withColumn("place", drawn).filter(F.col("place") <= reverse).drop("place")).distinct()
    worst = graph.groupBy("u").agg(F.min("cos").alias("worst"), F.count(F.lit(1)).alias("size")) \
        .select(F.col("u").alias("v"), F.when(F.col("size") >= k, F.col("worst")).otherwise(-1.0).alias("worst"))
    carried = around.join(worst, "v").join(nodes.select(F.col("node").alias("v"), "vec"), "v")

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches, "u"):
            if len(group) < 2:
                continue
            x, ids = _unit(group["vec"].combine_chunks()), group["v"].to_numpy()
            cos = x @ x.T
            bar = group["worst"].to_numpy()
            better = cos > bar[:, None]
            np.fill_diagonal(better, False)
            i, j = np.nonzero(better)
            if len(i):
                yield _edges(ids[i], ids[j], cos[i, j])

    return carried.repartition("u").sortWithinPartitions("u", "v").mapInArrow(local, _EDGE)


def inside_components(members: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(node, n): multiplicity of each node's links inside its component (component, node, vec, mult in).

    A component is cut into blocks by a hash of the node, so that about ``BLOCK``
    nodes are in one, and each pair of blocks is one group.
    """
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("size") / BLOCK)).cast("int")
    dealt = members.join(sizes, "component").select(
        "component", "node", "vec", "mult", blocks.alias("blocks"),
        F.pmod(F.xxhash64("node"), blocks).cast("int").alias("mine"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    paired = dealt.select("*", other).select(
        "component", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), "mine",
        "node", "vec", "mult").withColumn("pair", F.xxhash64("component", "a", "b"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches, "pair"):
            if len(group) < 2:
                continue
            x, ids = _unit(group["vec"].combine_chunks()), group["node"].to_numpy()
            mult, first = group["mult"].to_numpy(), group["mine"].to_numpy() == group["a"].to_numpy()
            if group["a"][0].as_py() == group["b"][0].as_py():
                linked = x @ x.T >= threshold
                np.fill_diagonal(linked, False)
                out = [(ids, linked @ mult)]
            else:
                linked = x[first] @ x[~first].T >= threshold
                out = [(ids[first], linked @ mult[~first]), (ids[~first], linked.T @ mult[first])]
            for node, n in out:
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(n.astype(np.int64))],
                                                 names=["node", "n"])

    counted = paired.repartition("pair").sortWithinPartitions("pair", "node").mapInArrow(compare, "node long, n long")
    return counted.groupBy("node").agg(F.sum("n").alias("n"))


def marked(nodes: DataFrame, graph: DataFrame, parts: DataFrame, threshold: float = THRESHOLD,
           k: int = K) -> DataFrame:
    """(node, grp, component, vec, full): nodes with their component and whether their list is saturated."""
    full = graph.groupBy("u").agg(F.count(F.lit(1)).alias("size"), F.min("cos").alias("worst")) \
        .filter((F.col("size") >= k) & (F.col("worst") >= threshold)) \
        .select(F.col("u").alias("node"), F.lit(True).alias("full"))
    return nodes.join(parts, "node", "left").join(full, "node", "left").select(
        "node", "grp", F.coalesce("component", "node").alias("component"), "vec",
        F.coalesce("full", F.lit(False)).alias("full"))


def crossing(members: DataFrame, asked: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The asked nodes (few enough to be broadcast) against all members, by brute force.

    Rows (u, v) are links between components, one of two components in each
    batch; rows (u, null, links, missing) are counts of the asked node's links.
    """
    table = asked.select("node", "grp", "component", "vec").toArrow()
    grps = table["grp"].to_numpy()
    held = {}
    for g in np.unique(grps).tolist():
        mine = table.take(pa.array(np.flatnonzero(grps == g))).combine_chunks()
        held[g] = (mine["node"].to_numpy(), mine["component"].to_numpy(), _unit(mine["vec"].combine_chunks()))
    shared = members.sparkSession.sparkContext.broadcast(held)

    def rows(u: np.ndarray, v: pa.Array, links: pa.Array, missing: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(u), v, links, missing], names=["u", "v", "links", "missing"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grp = batch.column("grp").to_numpy(zero_copy_only=False)
            for g in np.unique(grp).tolist():
                if g not in shared.value:
                    continue
                ids, parts, x = shared.value[g]
                mine = batch.take(pa.array(np.flatnonzero(grp == g)))
                other_ids, other_parts = (mine.column(c).to_numpy(zero_copy_only=False) for c in ("node", "component"))
                y = _unit(mine.column("vec"))
                links, missing = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
                step = max(1, TILE // len(ids))
                for at in range(0, len(y), step):
                    i, j = np.nonzero(x @ y[at:at + step].T >= threshold)
                    j += at
                    other = ids[i] != other_ids[j]
                    i, j = i[other], j[other]
                    links += np.bincount(i, minlength=len(ids))
                    apart = parts[i] != other_parts[j]
                    i, j = i[apart], j[apart]
                    missing += np.bincount(i, minlength=len(ids))
                    if len(i):
                        _, one = np.unique(np.stack([parts[i], other_parts[j]], axis=1), axis=0, return_index=True)
                        none = pa.nulls(len(one), pa.int64())
                        yield rows(ids[i[one]], pa.array(other_ids[j[one]]), none, none)
                some = np.flatnonzero(links)
                yield rows(ids[some], pa.nulls(len(some), pa.int64()), pa.array(links[some]), pa.array(missing[some]))

    return members.select("node", "grp", "component", "vec").mapInArrow(
        run, "u long, v long, links long, missing long")


def _portions(asked: DataFrame) -> Iterator[DataFrame]:
    """The nodes in portions of about ``ASKED_VALUES`` vector components, dealt by hash."""
    n = -(-(asked.agg(F.sum(F.size("vec"))).first()[0] or 0) // ASKED_VALUES)
    for i in range(n):
        yield asked.filter(F.pmod(F.xxhash64(F.lit("audit"), "node"), F.lit(n)) == i)


def audit(members: DataFrame, last: bool, threshold: float = THRESHOLD) -> tuple[list[DataFrame], float, bool]:
    """Missing links (u, v) that join components, the share of the audited nodes' links that was found,
    and whether the graph with these links will do (``last``: it must)."""
    out, full = [], members.filter("full")
    several = full.groupBy("grp").agg(F.countDistinct("component").alias("n")).filter("n > 1").select("grp")
    full = full.join(several, "grp", "left_semi")
    for asked in _portions(full):
        out.append(scratch.write(crossing(full, asked, threshold).filter("v IS NOT NULL").select("u", "v"),
                                 "nn-crossing")[0])
    linked = links = missing = 0
    for asked in _portions(members.filter("NOT full")):
        if linked >= AUDIT_NODES and (not last or links - missing >= MIN_RECALL * links):
            break
        found, _ = scratch.write(crossing(members, asked, threshold), "nn-crossing")
        out.append(found.filter("v IS NOT NULL").select("u", "v"))
        seen = found.filter("v IS NULL").groupBy("u").agg(F.sum("links").alias("links"), F.sum("missing").alias("missing")) \
            .agg(F.count(F.lit(1)), F.sum("links"), F.sum("missing")).first()
        linked, links, missing = (a + (b or 0) for a, b in zip((linked, links, missing), seen))
    else:
        return out, 1.0 - missing / max(links, 1), True
    return out, 1.0 - missing / links, links - missing >= MIN_RECALL * links


def near_duplicates(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding",
                    label: str = "label", threshold: float = THRESHOLD, k: int = K) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    spark = vectors.sparkSession
    nodes, _ = scratch.write(nodes_of(vectors, vec_id, embedding, label), "nn-nodes")
    n = nodes.count()
    graph, path, more = None, None, []
    for attempt in range(MAX_STARTS):
        begun = start(nodes, n, seed=attempt + 1, k=k)
        graph, path = _replace(keep_best(begun if graph is None else graph.unionByName(begun), k), path)
        entries = graph.count()
        for turn in range(MAX_ROUNDS):
            found = refine(nodes, graph, turn + attempt * MAX_ROUNDS, k=k)
            after, fresh = scratch.write(keep_best(graph.unionByName(found), k), "nn-graph")
            changed = after.join(graph, ["u", "v"], "left_anti").count()
            scratch.remove(spark, path)
            graph, path = after, fresh
            if changed <= MIN_CHANGE * entries:
                break
        links = graph.filter(F.col("cos") >= threshold).select("u", "v")
        parts, _ = scratch.write(connected_components(_union(links, more)), "nn-components")
        members, members_path = scratch.write(marked(nodes, graph, parts, threshold, k), "nn-marked")
        found, _, settled = audit(members, attempt == MAX_STARTS - 1, threshold)
        found = [f for f in found if not f.isEmpty()]
        more += found
        scratch.remove(spark, members_path)
        if settled:
            break
    if found:
        parts, _ = scratch.write(connected_components(_union(links, more)), "nn-components")
    members = nodes.join(parts, "node")
    counts, _ = scratch.write(inside_components(members.select("component", "node", "vec", "mult"), threshold),
                              "nn-counts")
    names = members.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    verdict = nodes.select("node", "mult", "vec_id").join(parts.join(names, "component"), "node", "left") \
        .join(counts, "node", "left") \
        .select("node", F.coalesce("component_id", "vec_id").alias("component_id"),
                (F.col("mult") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    plain = F.transform(F.col(f"`{embedding}`").cast("array<double>"), lambda x: x + F.lit(0.0))
    rows = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"),
                          F.when(F.col(f"`{label}`").isNotNull(), F.xxhash64(F.col(f"`{label}`"), plain))
                          .alias("node"))
    return rows.join(verdict, "node", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        (F.col("vec_id") == F.coalesce("component_id", "vec_id")).alias("kept"))


def _replace(table: DataFrame, old: str | None) -> tuple[DataFrame, str]:
    fresh, path = scratch.write(table, "nn-graph")
    if old:
        scratch.remove(table.sparkSession, old)
    return fresh, path


def _union(links: DataFrame, more: list[DataFrame]) -> DataFrame:
    for m in more:
        links = links.unionByName(m)
    return links
