"""Alignment of two public tokenizers' ids over a corpus.

A is a byte-level BPE file (``tokenizers``) and sees a space and the text; B is a
piece model with byte fallback (``sentencepiece``) and sees the text, adding the
space itself. Offsets at which tokens of both end cut the bytes into groups;
inside a group every A and B token whose bytes overlap are linked.

Identity map: A's ids are mapped once to the B id of the same bytes (a piece
rather than a byte token). Groups of just such a pair are counted in a vector of
A's vocabulary length for each task; only links of irregular groups enter the
shuffle by id pair. Both sums together give each pair's count, and from them each
B id's highest.

The links of a document are then looked up. Identity pairs are read off a vector
and the highest counts too (both of vocabulary length). A pair with more than one
``HOT``-th of all irregular links is one of fewer than ``HOT`` pairs, which are
broadcast; all other links are joined by pair, so no join key holds more than
that share of the links.

Texts are cut before a space that follows other than white space and is not the
last sign. Neither tokenizer has tokens across that place (checked on the files;
where it does not hold, texts are encoded whole), so each distinct segment is
aligned once per Python worker and cache period (``CACHE``), and groups never
cross it. Texts with a segment that B does not give back are encoded whole.

Defined results: a null or empty text, or one whose bytes either tokenizer does
not give back, has no tokens: zeros and ''. Rows of null or repeated ids are
separate documents. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch, textops

CACHE = 300_000         # distinct segments that a worker remembers
AT_ONCE = 512           # segments that are encoded together
HOT = 1 << 18           # at most so many pairs are broadcast
_PAIR = 1 << 32         # a pair is A's id * _PAIR + B's id

# The end of the UTF-8 form of white space beyond ASCII, as its last two bytes (a cut after anything like it is left out).
_WIDE = [0xC285, 0xC2A0, 0x9A80, *range(0x8080, 0x808B), 0x80A8, 0x80A9, 0x80AF, 0x819F]


class Aligned(NamedTuple):
    """Alignments of some texts, one after the other."""

    good: np.ndarray        # whether both tokenizers give the text's bytes back
    counts: np.ndarray      # A tokens, B tokens, groups, links of each
    shown: list[bytes]      # the groups as text
    same: np.ndarray        # A ids of identity groups, and where each text's begin
    same_at: np.ndarray
    pairs: np.ndarray       # links of other groups, and where each text's begin
    pairs_at: np.ndarray


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _gather(flat: np.ndarray, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries of the texts ``which``, and for each entry its place in ``which``."""
    size = at[which + 1] - at[which]
    begin = _starts(size)
    owner = np.repeat(np.arange(len(which)), size)
    return flat[np.arange(begin[-1]) - begin[owner] + at[which][owner]], owner


class Aligner:
    """The two tokenizers, the identity map and the segments aligned so far."""

    def __init__(self, file_a: str, file_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(file_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=file_b)
        shape = json.loads(self.a.to_str())
        before = shape["pre_tokenizer"] or {}
        if before.get("type") != "ByteLevel" or shape["normalizer"]:
            raise ValueError("the first tokenizer must be a byte-level BPE without a normaliser")
        sign = _byte_signs()
        names = sorted(self.a.get_vocab(with_added_tokens=True).items(), key=lambda x: x[1])
        self.bytes_a = [b""] * (names[-1][1] + 1)
        for name, i in names:
            self.bytes_a[i] = bytes(sign[c] for c in name) if all(c in sign for c in name) else name.encode()
        self.bytes_b, kinds = [], []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            kinds.append(self.b.is_byte(i))
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if kinds[-1] else piece.replace("▁", " ").encode())
        of_bytes: dict[bytes, int] = {}
        for byte in (False, True):
            for i, kind in enumerate(kinds):
                if kind == byte and not (self.b.is_control(i) or self.b.is_unknown(i) or self.b.is_unused(i)):
                    of_bytes.setdefault(self.bytes_b[i], i)
        self.identity = np.array([of_bytes.get(x, -1) for x in self.bytes_a], np.int64)
        self.length_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.length_b = np.array([len(x) for x in self.bytes_b], np.int64)
        inner = any(x.find(b" ", len(x) - len(x.lstrip(b" "))) > 0 for x in self.bytes_b)
        self.cuts = bool(before.get("use_regex")) and not inner and self.b.encode("a  b") == self.b.encode("a") + self.b.encode(" b")
        self.clear()

    def clear(self) -> None:
        self.known: dict[int, int] = {}
        self.table = self.align([])

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, bool]:
        """Ids of both tokenizers for the texts, each after a space; whether their bytes are the texts' own."""
        joined = " ".join(texts)
        (found,) = self.a.encode_batch_fast([f" {joined}"], add_special_tokens=False)     # without offsets
        a = found.ids
        b = self.b.encode(joined)
        want = f" {joined}".encode()
        good = b"".join([self.bytes_a[k] for k in a]) == want and b"".join([self.bytes_b[k] for k in b]) == want
        return np.array(a, np.int64), np.array(b, np.int64), good

    def align(self, texts: list[str]) -> Aligned:
        """Align each text (without the space before it).

        Texts that neither tokenizer has tokens across the end of (see the module) are encoded
        many at a time; if their bytes do not come back, and all others, one at a time.
        """
        good = np.ones(len(texts), bool)
        size = np.array([len(t.encode()) + 1 for t in texts], np.int64)
        parts_a, parts_b = [], []
        ends_well = [self.cuts and not (t[-1:] or " ").isspace() for t in texts]
        at = 0
        while at < len(texts):
            upto = at + 1
            while upto < len(texts) and upto - at < AT_ONCE and ends_well[upto - 1]:
                upto += 1
            a, b, fine = self._ids(texts[at:upto])
            if not fine and upto - at > 1:
                one = [self._ids([t]) for t in texts[at:upto]]
                good[at:upto] = [x[2] for x in one]
                parts_a += [x[0] for x in one if x[2]]
                parts_b += [x[1] for x in one if x[2]]
            elif fine:
                parts_a.append(a)
                parts_b.append(b)
            else:
                good[at] = False
            at = upto
        none = [np.zeros(0, np.int64)]
        a, b = np.concatenate(parts_a or none), np.concatenate(parts_b or none)
        size[~good] = 0
        n, stop = len(texts), np.cumsum(size)
        end_a, end_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        text_of_a, text_of_b = np.searchsorted(stop, end_a), np.searchsorted(stop, end_b)
        ends = np.union1d(end_a, end_b)                              # a link ends at each of these
        both = np.intersect1d(end_a, end_b, assume_unique=True)      # and a group at each of these
        link_a, link_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        last_a, last_b = np.searchsorted(end_a, both), np.searchsorted(end_b, both)
        text_of_group, text_of_link = text_of_a[last_a], text_of_a[link_a]
        plain = (np.diff(last_a, prepend=-1) == 1) & (np.diff(last_b, prepend=-1) == 1) & (self.identity[a[last_a]] == b[last_b])
        rest = ~plain[np.searchsorted(both, ends)]
        per_text = lambda which: np.bincount(which, minlength=n)
        counts = np.stack([per_text(text_of_a), per_text(text_of_b), per_text(text_of_group), per_text(text_of_link)], axis=1)
        return Aligned(good, counts, self._shown(a, b, last_a, last_b, per_text(text_of_group)), a[last_a][plain],
                       _starts(per_text(text_of_group[plain])), a[link_a[rest]] * _PAIR + b[link_b[rest]],
                       _starts(per_text(text_of_link[rest])))

    def _shown(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray, groups: np.ndarray) -> list[bytes]:
        """Each text's groups as ``a1,a2|b1;a3|b2,b3``."""
        words_a, words_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        first_a, first_b = [0, *(last_a[:-1] + 1).tolist()], [0, *(last_b[:-1] + 1).tolist()]
        shown = [f"{words_a[p] if q - p == 1 else ','.join(words_a[p:q])}|{words_b[r] if s - r == 1 else ','.join(words_b[r:s])}"
                 for p, q, r, s in zip(first_a, (last_a + 1).tolist(), first_b, (last_b + 1).tolist())]
        at = _starts(groups).tolist()
        return [";".join(shown[p:q]).encode() for p, q in zip(at, at[1:])]

    def places(self, hashes: np.ndarray, text_of) -> np.ndarray:
        """Where each segment (told by its hash) stands in the table; unknown ones are aligned first."""
        distinct, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        keys = distinct.tolist()
        new = [i for i, k in enumerate(keys) if k not in self.known]
        if len(self.known) + len(new) > CACHE:
            self.clear()
            new = list(range(len(keys)))
        if new:
            old, more = self.table, self.align([text_of(int(first[i])) for i in new])
            self.known.update((keys[i], len(old.good) + j) for j, i in enumerate(new))
            self.table = Aligned(np.concatenate([old.good, more.good]), np.concatenate([old.counts, more.counts]),
                                 old.shown + more.shown, np.concatenate([old.same, more.same]),
                                 np.concatenate([old.same_at, more.same_at[1:] + len(old.same)]),
                                 np.concatenate([old.pairs, more.pairs]),
                                 np.concatenate([old.pairs_at, more.pairs_at[1:] + len(old.pairs)]))
        return np.array([self.known[k] for k in keys], np.int64)[back] if keys else np.zeros(0, np.int64)


def _byte_signs() -> dict[str, int]:
    """The signs that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def segments(data: np.ndarray, rows: np.ndarray, cut: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each segment's bytes, without the space before it, and its row. Empty rows have none."""
    filled = np.flatnonzero(np.diff(rows))
    start = rows[:-1][filled]
    if cut and len(data) > 2:
        space = np.flatnonzero(data[2:] == 32) + 2
        before, two = data[space - 1], (data[space - 2].astype(np.int64) << 8) | data[space - 1]
        space = space[(before > 32) & (before != 127) & ~np.isin(two, _WIDE)]
        edge = np.zeros(len(data) + 1, bool)
        edge[rows] = True                       # not the first or last byte of a row, and two signs before it
        space = space[~edge[space] & ~edge[space - 1] & ~edge[space + 1]]
        start = np.sort(np.concatenate([start, space + 1]))
    row = np.searchsorted(rows, start, side="right") - 1
    end = np.concatenate([start[1:] - 1, [0]]).astype(np.int64) if len(start) else start
    last = np.concatenate([row[1:] != row[:-1], [True]]) if len(row) else np.zeros(0, bool)
    end[last] = rows[row[last] + 1]
    return start, end, row


_ALIGNERS: dict[tuple[str, str], Aligner] = {}      # of this Python worker: one, bounded by CACHE


def _aligner(file_a: str, file_b: str) -> Aligner:
    if (file_a, file_b) not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[file_a, file_b] = Aligner(file_a, file_b)
    return _ALIGNERS[file_a, file_b]


def _tally(owner: np.ndarray, values: np.ndarray, weight: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values of each owner with their summed weights; and where each owner's begin."""
    kinds, kind = np.unique(values, return_inverse=True)
    code, place = np.unique(owner * max(len(kinds), 1) + kind, return_inverse=True)
    owner, kind = np.divmod(code, max(len(kinds), 1))
    return kinds[kind] if len(kinds) else values, np.bincount(place, weight, len(code)).astype(np.int64), \
        _starts(np.bincount(owner, minlength=n))


def _lists(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array(at), pa.array(values)).cast(pa.list_(pa.int64()))


def _documents(file_a: str, file_b: str):
    """Rows of documents (kind 0) and, at the end of a task, its vector of identity groups (kind 1)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from salesgrid.llm import cross_tokenizer       # the worker's own module, which outlives the task
        tool = cross_tokenizer._aligner(file_a, file_b)
        vector = np.zeros(len(tool.identity), np.int64)
        id_type = None
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for piece in textops.slices(batch):
                out = _one(tool, piece)
                vector += out.pop("vector")
                names = list(out)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("row"), *out.values()],
                                                 names=["doc_id", "row", *names])
        if id_type is not None:
            ids = np.flatnonzero(vector)
            zero = pa.array([0], pa.int64())
            one = np.array([0, len(ids)])
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, id_type), pa.array([-1], pa.int64()), pa.array([1], pa.int32()), zero, zero, zero, zero,
                 pa.array([""]), _lists(ids, one), _lists(vector[ids], one), _lists(ids[:0], one * 0), _lists(ids[:0], one * 0)],
                names=["doc_id", "row", *_FIELDS])
    return run


_FIELDS = {"kind": "int", "n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "groups_sha256": "string",
           "same": "array<long>", "same_n": "array<long>", "pairs": "array<long>", "pairs_n": "array<long>"}


def _one(tool: Aligner, piece: pa.RecordBatch) -> dict:
    data, rows = textops.buffers(piece.column("text"))
    n = piece.num_rows
    start, end, row = segments(data, rows, tool.cuts)
    hashes = textops.span_hashes(data, start, end) ^ textops.mix((end - start).astype(np.uint64))
    place = tool.places(hashes, lambda i: data[start[i]:end[i]].tobytes().decode())
    table, bad = tool.table, np.zeros(n, bool)
    bad[row[~table.good[place]]] = True
    whole: dict[int, Aligned] = {}
    for r in np.flatnonzero(bad).tolist():      # a part that does not come back: the text decides as a whole
        found = tool.align([data[rows[r]:rows[r + 1]].tobytes().decode()])
        if found.good[0]:
            whole[r] = found
    place, row = place[~bad[row]], row[~bad[row]]
    first = np.searchsorted(row, np.arange(n + 1))
    sums = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(table.counts[place], axis=0)])
    counts = sums[first[1:]] - sums[first[:-1]]
    first = first.tolist()
    shown = [b";".join([table.shown[k] for k in place[a:b].tolist()]) for a, b in zip(first, first[1:])]
    # equal segments of a document count together before their links are listed
    code, weight = np.unique(row * len(table.good) + place, return_counts=True) if len(place) else (place, place)
    owner, kind = np.divmod(code, max(len(table.good), 1))
    parts = {}
    for name, flat, at in (("same", table.same, table.same_at), ("pairs", table.pairs, table.pairs_at)):
        values, which = _gather(flat, at, kind)
        owners, weights = owner[which], weight[which].astype(np.int64)
        extra = [(r, getattr(found, name)) for r, found in whole.items()]
        if extra:
            owners = np.concatenate([owners, *[np.full(len(v), r) for r, v in extra]])
            values = np.concatenate([values, *[v for _, v in extra]])
            weights = np.concatenate([weights, np.ones(len(values) - len(weights), np.int64)])
        parts[name] = _tally(owners, values, weights, n)
    for r, found in whole.items():
        counts[r], shown[r] = found.counts[0], found.shown[0]
    same, same_n, same_at = parts["same"]
    pairs, pairs_n, pairs_at = parts["pairs"]
    vector = np.bincount(same, same_n, len(tool.identity)).astype(np.int64)
    digests = [hashlib.sha256(s).hexdigest() if s else "" for s in shown]
    return {"kind": pa.array(np.zeros(n, np.int32)), **{c: pa.array(counts[:, i]) for i, c in enumerate(("n_a", "n_b", "n_groups", "n_links"))},
            "groups_sha256": pa.array(digests, pa.string()), "same": _lists(same, same_at), "same_n": _lists(same_n, same_at),
            "pairs": _lists(pairs, pairs_at), "pairs_n": _lists(pairs_n, pairs_at), "vector": vector}


def encode(docs: DataFrame, file_a: str, file_b: str, *, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, str]:
    """The written table of documents' alignments and tasks' vectors, and its path (to be removed)."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.monotonically_increasing_id().alias("row"),
                       F.col(f"`{text}`").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    fields = ", ".join(f"{k} {v}" for k, v in _FIELDS.items())
    path = scratch.folder(docs.sparkSession, "alignment")
    rows.mapInArrow(_documents(file_a, file_b), f"doc_id {kind}, row long, {fields}") \
        .write.partitionBy("kind").option("compression", "zstd").parquet(path)
    schema = f"doc_id {kind}, row long, {fields.replace('kind int, ', '')}, kind int"
    return docs.sparkSession.read.schema(schema).parquet(path), path


def _zipped(df: DataFrame, values: str, weights: str) -> DataFrame:
    pair = F.explode(F.arrays_zip(F.col(values).alias("v"), F.col(weights).alias("w"))).alias("p")
    return df.select(pair).select("p.v", "p.w")


def pair_counts(encoded: DataFrame, identity: np.ndarray) -> DataFrame:
    """Each linked pair (A's id * 2^32 + B's id), how many links hold it (``count``), and how many of
    these are of irregular groups (``irregular``)."""
    spark = encoded.sparkSession
    known = np.flatnonzero(identity >= 0)
    to_b = spark.createDataFrame(list(zip(known.tolist(), (known * _PAIR + identity[known]).tolist())), "v long, pair long")
    vectors = _zipped(encoded.where("kind = 1"), "same", "same_n").groupBy("v").agg(F.sum("w").alias("count"))
    plain = vectors.join(F.broadcast(to_b), "v").select("pair", "count", F.lit(0).cast("long").alias("irregular"))
    links = _zipped(encoded.where("kind = 0"), "pairs", "pairs_n").groupBy(F.col("v").alias("pair")) \
        .agg(F.sum("w").alias("count")).select("pair", "count", F.col("count").alias("irregular"))
    return plain.unionByName(links).groupBy("pair").agg(F.sum("count").alias("count"), F.sum("irregular").alias("irregular"))


def _known(state):
    """Sums over links whose pair's count is known here; the other links go on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        identity, same_count, best, hot, hot_count = state.value
        for batch in batches:
            same, pairs = batch.column("same"), batch.column("pairs")
            n = batch.num_rows

            def flat(name):
                col = batch.column(name)
                at = col.offsets.to_numpy().astype(np.int64)
                return col.values.to_numpy(zero_copy_only=False)[at[0]:at[-1]].astype(np.int64), at - at[0]

            (a, at), (w, _) = flat("same"), flat("same_n")
            owner = np.repeat(np.arange(n), np.diff(at))
            total, top = np.zeros(n, np.int64), np.zeros(n, np.int64)
            np.add.at(total, owner, w * same_count[a])
            np.add.at(top, owner, w * (same_count[a] == best[identity[a]]))
            (pair, at), (w, _) = flat("pairs"), flat("pairs_n")
            owner = np.repeat(np.arange(n), np.diff(at))
            place = np.minimum(np.searchsorted(hot, pair), max(len(hot) - 1, 0))
            seen = hot[place] == pair if len(hot) else np.zeros(len(pair), bool)
            count = hot_count[place[seen]]
            np.add.at(total, owner[seen], w[seen] * count)
            np.add.at(top, owner[seen], w[seen] * (count == best[pair[seen] % _PAIR]))
            rest = _starts(np.bincount(owner[~seen], minlength=n))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(top), pa.array(total), _lists(pair[~seen], rest),
                                              _lists(w[~seen], rest)], names=["row", "n_best", "count_sum", "pairs", "pairs_n"])
    return run


def align(docs: DataFrame, file_a: str, file_b: str, **columns: str) -> DataFrame:
    """One row a document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spark: SparkSession = docs.sparkSession
    encoded, _ = encode(docs, file_a, file_b, **columns)
    tool = Aligner(file_a, file_b)
    counts, _ = scratch.write(pair_counts(encoded, tool.identity), "pair-counts")
    # of vocabulary length: each B id's highest count, and the counts of the identity pairs
    best, same_count = np.zeros(len(tool.length_b), np.int64), np.zeros(len(tool.identity), np.int64)
    for b, n in counts.groupBy((F.col("pair") % _PAIR).alias("b")).agg(F.max("count")).collect():
        best[b] = n
    known = np.flatnonzero(tool.identity >= 0)
    to_a = spark.createDataFrame([(x,) for x in (known * _PAIR + tool.identity[known]).tolist()], "pair long")
    for pair, n in counts.join(F.broadcast(to_a), "pair", "left_semi").select("pair", "count").collect():
        same_count[pair // _PAIR] = n
    links = counts.agg(F.sum("irregular")).first()[0] or 0
    hot = counts.where(F.col("irregular") * HOT > links).select("pair", "count").orderBy("pair").toPandas()
    state = spark.sparkContext.broadcast((tool.identity, same_count, best, hot["pair"].to_numpy(np.int64), hot["count"].to_numpy(np.int64)))
    rows = encoded.where("kind = 0")
    summed, _ = scratch.write(rows.select("row", "same", "same_n", "pairs", "pairs_n").mapInArrow(
        _known(state), "row long, n_best long, count_sum long, pairs array<long>, pairs_n array<long>"), "alignment-sums")
    state.destroy()
    highest = spark.createDataFrame(list(enumerate(best.tolist())), "b long, best long")
    tail = summed.select("row", F.explode(F.arrays_zip("pairs", "pairs_n")).alias("p")).select("row", "p.pairs", "p.pairs_n") \
        .join(counts.where(F.col("irregular") * HOT <= links).select(F.col("pair").alias("pairs"), "count"), "pairs") \
        .join(F.broadcast(highest), F.col("pairs") % _PAIR == F.col("b")) \
        .select("row", F.when(F.col("count") == F.col("best"), F.col("pairs_n")).otherwise(0).alias("n_best"),
                (F.col("pairs_n") * F.col("count")).alias("count_sum"))
    every = summed.select("row", "n_best", "count_sum").unionByName(tail).groupBy("row") \
        .agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return rows.select("doc_id", "row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(every, "row") \
        .select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
