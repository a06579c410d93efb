"""Token ids as Parquet list columns, in id order, for selective reads.

``write_tokens`` range-partitions the rows by id (rows of one id split by a
digest), sorts them inside the partitions, encodes each text with a public
tokenizer file and writes one row a document: ``part`` and ``pos`` (its place:
partition, row), the id, metadata columns, ``n_tokens`` and ``tokens``
(array<int>, end id included). Row-group and page sizes are set, page indexes
are written by the Parquet writer, and ids are dictionary- or delta-encoded, so
metadata reads skip the tokens and token reads skip pages by id.

Texts are cut at ASCII white space, which the tokenizer drops and never merges
across, and before one last sign of ``TAIL`` after an ASCII letter or digit,
which it always splits off. Each distinct piece, A-Z as a-z (it lowers case,
except in the names of special tokens, so pieces with "<" keep theirs), is
encoded once per Python worker and cache period (bounded by ``CACHE_WORDS``)
and ids are gathered with numpy; tests compare this with whole-text encoding.
A slice of rows (or one longer text) is in memory at a time.

``read_back`` derives each document's start (ids before it) from the files:
sums by part (one row a partition), then a running sum inside the part.

Defined results: a null or blank text is only the end id; null ids come first;
rows that share an id are ordered by a digest of their columns; an empty table
gives no rows; input columns other than id, text and metadata are left out.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textops

CACHE_WORDS = 1_200_000
TAIL = ".,;:!?"
ENCODINGS = {
    "dictionary": {"parquet.enable.dictionary": "true"},
    "delta": {"parquet.enable.dictionary": "false", "parquet.writer.version": "PARQUET_2_0"},
}


_TAIL = np.zeros(256, bool)
_TAIL[[ord(c) for c in TAIL]] = True
_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def pieces(texts: pa.Array) -> textops.Words:
    """Words cut before a last sign; hashes of A-Z as a-z, except in pieces with "<"."""
    w = textops.words(texts)
    last = np.maximum(w.end - 1, 0)
    tail = (w.end - w.start > 1) & _TAIL[w.data[last]] & _PLAIN[w.data[np.maximum(last - 1, 0)]]
    size = 1 + tail.astype(np.int64)
    first = np.concatenate([[0], np.cumsum(size)])
    start, end = np.repeat(w.start, size), np.repeat(w.end, size)
    cut = first[:-1][tail]
    end[cut] -= 1
    start[cut + 1] = end[cut]
    marked = np.unique(np.searchsorted(start, np.flatnonzero(w.data == ord("<")), side="right") - 1)
    hashes = textops.span_hashes(w.data, start, end, lower=True)
    if len(marked):
        hashes[marked] = textops.mix(textops.span_hashes(w.data, start[marked], end[marked]) + np.uint64(1))
    return textops.Words(w.data, w.row_start, start, end, hashes, first[w.first])


class _Encoder:
    """Ids of pieces, looked up by hash in an open-addressing table; new ones go through the tokenizer.

    New pieces are encoded many at a time, with a special token between them: it
    is taken out of the text first, so that what stands on either side is encoded
    on its own, and its id shows where each piece ends. A piece that could hold
    special tokens itself (it has "<") is encoded alone.
    """

    AT_ONCE = 512

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(file)
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special}
        self.between, self.between_id = next(((k, i) for k, i in special.items() if "<" in k), (None, None))
        self.clear()

    def clear(self, words: int | None = None) -> None:
        size = 1 << int(np.ceil(np.log2(2 * (words or CACHE_WORDS))))
        self.keys = np.zeros(size, np.uint64)        # 0: a free slot
        self.place = np.zeros(size, np.int32)
        self.ids = np.zeros(1 << 16, np.int32)
        self.ends = np.zeros(1, np.int64)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash, -1 for unknown ones."""
        mask = np.uint64(len(self.keys) - 1)
        out = np.full(len(hashes), -1, np.int64)
        todo, slot = np.arange(len(hashes)), (hashes & mask).astype(np.int64)
        while len(todo):
            seen = self.keys[slot]
            hit = seen == hashes[todo]
            out[todo[hit]] = self.place[slot[hit]]
            more = ~hit & (seen != 0)
            todo, slot = todo[more], (slot[more] + 1) & int(mask)
        return out

    def _put(self, hashes: np.ndarray, place: np.ndarray) -> None:
        """Add distinct new hashes."""
        mask = len(self.keys) - 1
        slot = (hashes & np.uint64(mask)).astype(np.int64)
        while len(slot):
            free = self.keys[slot] == 0
            first = np.zeros(len(slot), bool)
            first[np.unique(slot, return_index=True)[1]] = True     # one of those that want a slot
            fits = free & first
            self.keys[slot[fits]], self.place[slot[fits]] = hashes[fits], place[fits]
            hashes, place, slot = hashes[~fits], place[~fits], (slot[~fits] + 1) & mask

    def _ids_of(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(texts)
        plain = [i for i, t in enumerate(texts) if self.between and "<" not in t]
        for at in range(0, len(plain), self.AT_ONCE):
            some = plain[at:at + self.AT_ONCE]
            joined = self.between.join([texts[i] for i in some])
            ids = np.array(self.tokenizer.encode(joined, add_special_tokens=False).ids, np.int32)
            cuts = np.flatnonzero(ids == self.between_id)
            begins = np.concatenate([[0], cuts + 1])
            for i, a, b in zip(some, begins.tolist(), [*cuts.tolist(), len(ids)]):
                out[i] = ids[a:b]
        known = set(plain)
        for i, t in enumerate(texts):
            if i not in known:
                out[i] = np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.int32)
        return out

    def _learn(self, w: textops.Words, hashes: np.ndarray, at: np.ndarray) -> None:
        distinct, first = np.unique(hashes, return_index=True)
        spans = zip(w.start[at[first]].tolist(), w.end[at[first]].tolist())
        found = self._ids_of([w.data[a:b].tobytes().decode() for a, b in spans])
        flat = np.concatenate(found)
        used = int(self.ends[-1])
        if used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids[:used], np.zeros(used + 2 * len(flat), np.int32)])
        self.ids[used:used + len(flat)] = flat
        self._put(distinct, np.arange(len(self.ends) - 1, len(self.ends) - 1 + len(distinct), dtype=np.int32))
        self.ends = np.concatenate([self.ends, used + np.cumsum([len(x) for x in found])])

    def encode(self, w: textops.Words, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows with the end id after each, and the row offsets."""
        hashes = np.maximum(w.hash, np.uint64(1))
        place = self._find(hashes)
        new = np.flatnonzero(place < 0)
        if len(new):
            if len(self.ends) + len(new) > CACHE_WORDS:     # full, at the worst: start anew with this slice
                distinct = len(np.unique(hashes[new]))
                if len(self.ends) + distinct > CACHE_WORDS:
                    self.clear(max(CACHE_WORDS, len(hashes)))
                    new = np.arange(len(hashes))
            self._learn(w, hashes[new], new)
            place[new] = self._find(hashes[new])
        begin, size = self.ends[place], self.ends[place + 1] - self.ends[place]
        before = np.concatenate([[0], np.cumsum(size)])
        offsets = before[w.first] + np.arange(len(w) + 1)
        gaps = np.repeat(begin - before[:-1], size) + np.arange(before[-1])
        out = np.full(offsets[-1], end_id, np.int32)
        body = np.ones(len(out), bool)
        body[offsets[1:] - 1] = False
        out[body] = self.ids[gaps]
        return out, offsets


_ENCODERS: dict[str, _Encoder] = {}     # of this Python worker: one, bounded by CACHE_WORDS


def _encoder(file: str) -> _Encoder:
    if file not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[file] = _Encoder(file)
    return _ENCODERS[file]


def _encode(file: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from salesgrid.llm import token_output      # the worker's own module, which outlives the task
        pos = 0
        for batch in batches:
            for piece in textops.slices(batch):
                ids, offsets = token_output._encoder(file).encode(pieces(piece.column("text")), end_id)
                n = piece.num_rows
                others = [piece.column(c) for c in piece.schema.names if c != "text"]
                names = [c for c in piece.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(pos, pos + n)), *others, pa.array(np.diff(offsets)),
                     pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))],
                    names=["pos", *names, "n_tokens", "tokens"])
                pos += n
    return run


def write_tokens(docs: DataFrame, path: str, tokenizer_file: str, *, end_id: int = 1,
                 doc_id: str = "doc_id", text: str = "text", metadata: Sequence[str] = (),
                 encoding: str = "dictionary", row_group_bytes: int = 32 << 20,
                 page_bytes: int = 256 << 10) -> None:
    """Write the token files of all rows; see the module's description.

    ``tokenizer_file`` must exist on every executor. ``row_group_bytes`` and
    ``page_bytes`` are the writer's targets.
    """
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"),
                       *[F.col(f"`{m}`").alias(f"meta_{m}") for m in metadata],
                       F.col(f"`{text}`").cast("string").alias("text"), tie.alias("_tie"))
    ordered = rows.repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").drop("_tie")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema if f.name != "text")
    tokens = ordered.mapInArrow(_encode(tokenizer_file, end_id),
                                f"pos long, {fields}, n_tokens long, tokens array<int>")
    writer = tokens.select(F.spark_partition_id().alias("part"), "*").write
    options = ENCODINGS[encoding] | {"parquet.block.size": str(row_group_bytes),
                                     "parquet.page.size": str(page_bytes), "compression": "zstd"}
    for k, v in options.items():
        writer = writer.option(k, v)
    writer.parquet(path)


def starts(tokens: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """The table with ``start``: the ids of all documents before.

    Reads metadata only; ``sizes`` is where (part, n_tokens) are read from, if not there.
    """
    parts = (tokens if sizes is None else sizes).groupBy("part").agg(F.sum("n_tokens").alias("size"))
    offsets = parts.select("part", (F.sum("size").over(W.orderBy("part")) - F.col("size")).alias("offset"))
    inside = F.sum("n_tokens").over(W.partitionBy("part").orderBy("pos")) - F.col("n_tokens")
    return tokens.withColumn("inside", inside).join(offsets, "part") \
        .withColumn("start", F.col("offset") + F.col("inside")).drop("offset", "inside")


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens = batch.column("tokens")
        ids = tokens.values.to_numpy(zero_copy_only=False).astype("<u4")
        offsets = tokens.offsets.to_numpy()
        crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]
        keep = [c for c in batch.schema.names if c != "tokens"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(crc, pa.int64())],
                                         names=[*keep, "ids_crc32"])


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the ids (as little-endian 32-bit) from the files."""
    tokens = spark.read.parquet(path).select("part", "pos", "doc_id", "n_tokens", "tokens")
    kind = tokens.schema["doc_id"].dataType.simpleString()
    summed = tokens.mapInArrow(_checksums, f"part int, pos long, doc_id {kind}, n_tokens long, ids_crc32 long")
    sizes = spark.read.parquet(path).select("part", "n_tokens")
    return starts(summed, sizes).select("doc_id", "start", "n_tokens", "ids_crc32")
