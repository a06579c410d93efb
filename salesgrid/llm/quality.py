"""Quality rules: counted base rules and divergence from language references.

``references`` describes each language of the corpus by two histograms over all
of its documents: character classes, and its ``COMMON_WORDS`` words of the
highest document frequency (and one class for all other words). Each document
counts the same, so long or repetitive texts don't bend a reference. Histograms
are summed per Arrow batch before they are shuffled, as whole numbers, so that
reruns agree. Every language of at least ``MIN_DOCUMENTS`` documents has one.

``judge`` compares a document's two histograms with the reference of its own
language by Jensen-Shannon distance (base 2, 0 to 1). Only what is far from that
is compared with all references, as its language may be a wrong one; the nearest
of each counts. A distance is expected to shrink with the text's length n (in
words), so the limits are ``base + slope / sqrt(n)``. Texts under ``MIN_WORDS``
words are not judged by divergence: their histograms say too little.

Defined results: a null text has no words (all counts 0, base_failed); a null
language is no reference; where a document's language has no reference (too few
documents, or null), only the base rules decide and both distances are 0;
repeated rows give repeated rows; an empty table gives an empty result. Only id,
text and language are read, so other columns cannot clash (``accepted`` carries all).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textops

COMMON_WORDS = 100
MIN_DOCUMENTS = 50
MIN_WORDS = 50
SCALE = 10**9            # shares are summed in whole billionths

# Character classes by the first byte of a character; the last
# class takes all other ASCII characters.
CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\t\n\x0b\x0c\r",
           ".,;:!?'\"()-", "#*$%&|<>")
N_CLASSES = len(CLASSES) + 2


@dataclass(frozen=True)
class Limits:
    """Largest distances that pass, as base + slope / sqrt(words)."""

    char_base: float = 0.16
    char_slope: float = 1.0
    word_base: float = 0.22
    word_slope: float = 2.2
    min_words: int = MIN_WORDS


def _class_table() -> np.ndarray:
    table = np.full(256, N_CLASSES - 1, np.int64)
    table[0x80:0xC0] = N_CLASSES     # inside a character: not counted
    table[0xC0:] = len(CLASSES)
    for i, chars in enumerate(CLASSES):
        table[[ord(c) for c in chars]] = i
    return table


_CLASS = _class_table()
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def class_counts(w: textops.Words) -> np.ndarray:
    """Characters of each class in each row."""
    width = N_CLASSES + 1
    slot = np.repeat(np.arange(len(w)) * width, np.diff(w.row_start)) + _CLASS[w.data]
    return np.bincount(slot, minlength=len(w) * width).reshape(len(w), width)[:, :N_CLASSES]


def base_counts(w: textops.Words, window: int = 8) -> dict[str, np.ndarray]:
    """The counted columns of each row."""
    n, rows = w.counts(), w.row_of()
    inside = np.zeros(len(w.data) + 1, np.int64)
    np.add.at(inside, w.start, 1)
    np.add.at(inside, w.end, -1)
    in_word = np.cumsum(inside[:-1]) > 0
    word_chars = textops.sums(in_word & ((w.data & 0xC0) != 0x80), w.row_start)
    return {"n_words": n, "word_chars": word_chars, "n_symbols": textops.sums(_SYMBOL[w.data], w.row_start),
            "n_dup_lines": _repeated_lines(w), "n_repeat_words": _repeated_words(w, rows, window)}


def _repeated_words(w: textops.Words, rows: np.ndarray, window: int) -> np.ndarray:
    g = textops.grams(w.hash, window)
    at = np.flatnonzero(rows[:len(g)] == rows[window - 1:]) if len(g) else np.zeros(0, np.int64)
    key = textops.by_row(g[at], rows[at])
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    twice = at[count[inverse] > 1]
    cover = np.zeros(len(w.hash) + 1, np.int64)
    cover[twice] += 1                # starts are distinct, and so are ends
    cover[twice + window] -= 1
    return textops.sums(np.cumsum(cover[:-1]) > 0, w.first)


def _repeated_lines(w: textops.Words) -> np.ndarray:
    breaks = np.flatnonzero(w.data == 10)
    start = np.sort(np.concatenate([w.row_start[:-1], breaks + 1]))
    end = np.sort(np.concatenate([w.row_start[1:], breaks]))
    filled = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    start, end = start[filled], end[filled]
    row = np.searchsorted(w.row_start, start, side="right") - 1
    key = textops.by_row(textops.span_hashes(w.data, start, end), row)
    again = np.ones(len(key), bool)
    again[np.unique(key, return_index=True)[1]] = False
    return np.bincount(row[again], minlength=len(w))


_PROFILE = "lang string, kind int, item long, docs long, share long"


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per language: documents, class shares and word shares of a slice of rows."""
    for batch in batches:
        for piece in textops.slices(batch):
            w = textops.words(piece.column("text"), lower=True)
            langs = piece.column("lang").dictionary_encode()
            known = np.asarray(langs.indices.is_valid())
            code = np.where(known, langs.indices.fill_null(0).to_numpy(zero_copy_only=False), -1)
            n = w.counts()
            use = known & (n > 0)
            rows = w.row_of()
            keep = use[rows]
            key = textops.by_row(w.hash, rows)[keep]
            _, first, count = np.unique(key, return_index=True, return_counts=True)
            row, word = rows[keep][first], w.hash[keep][first]
            classes = class_counts(w)
            share = count * SCALE // n[row]
            for lang in np.unique(code[use]):
                name = langs.dictionary[int(lang)].as_py()
                mine = code[row] == lang
                items, inverse, docs = np.unique(word[mine], return_inverse=True, return_counts=True)
                shares = np.bincount(inverse, weights=share[mine].astype(float)).astype(np.int64)
                own = use & (code == lang)
                by_class = (classes[own] * SCALE // classes[own].sum(axis=1)[:, None]).sum(axis=0)
                size = len(items)
                yield pa.RecordBatch.from_arrays([
                    pa.array([name] * (size + N_CLASSES)),
                    pa.array(np.repeat([0, 1], [size, N_CLASSES]).astype(np.int32)),
                    pa.array(np.concatenate([items.view(np.int64), np.arange(N_CLASSES)])),
                    pa.array(np.concatenate([docs, np.full(N_CLASSES, own.sum())])),
                    pa.array(np.concatenate([shares, by_class]))],
                    names=["lang", "kind", "item", "docs", "share"])


@dataclass
class Reference:
    lang: str
    words: np.ndarray       # hashes, sorted
    word_share: np.ndarray  # of each, and of all other words
    class_share: np.ndarray


def _reference(lang: str, n: int, words: pa.Array, classes: pa.Array) -> Reference:
    hashes = words.field("item").to_numpy(zero_copy_only=False).view(np.uint64)
    order = np.argsort(hashes)
    share = words.field("share").to_numpy(zero_copy_only=False).astype(np.float64)[order] / (n * SCALE)
    by_class = classes.field("share").to_numpy(zero_copy_only=False).astype(np.float64)
    return Reference(lang, hashes[order], np.append(share, max(0.0, 1.0 - share.sum())), by_class / by_class.sum())


def references(docs: DataFrame, *, text: str = "text", lang: str = "lang",
               common_words: int = COMMON_WORDS, min_documents: int = MIN_DOCUMENTS) -> list[Reference]:
    """The references of a corpus: ``common_words`` entries for each language of ``min_documents`` documents."""
    rows = docs.select(F.col(f"`{text}`").cast("string").alias("text"),
                       F.col(f"`{lang}`").cast("string").alias("lang"))
    sums = rows.mapInArrow(_profiles, _PROFILE).groupBy("lang", "kind", "item") \
        .agg(F.sum("docs").alias("docs"), F.sum("share").alias("share"))
    ranked = sums.withColumn("place", F.row_number().over(
        W.partitionBy("lang", "kind").orderBy(F.col("docs").desc(), "item")))
    ranked = ranked.filter(F.col("place") <= max(common_words, N_CLASSES)) \
        .filter((F.col("kind") == 1) | (F.col("place") <= common_words))
    entries = lambda kind: F.array_sort(F.collect_list(
        F.when(F.col("kind") == kind, F.struct("item", "share"))))
    table = ranked.groupBy("lang").agg(F.max(F.when(F.col("kind") == 1, F.col("docs"))).alias("n"),
                                       entries(0).alias("words"), entries(1).alias("classes")) \
        .filter(F.col("n") >= min_documents).toArrow()
    columns = (table[c] for c in ("lang", "n", "words", "classes"))
    return sorted((_reference(name.as_py(), n.as_py(), words.values, classes.values)
                   for name, n, words, classes in zip(*columns)), key=lambda r: r.lang)


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distances (base 2) of the rows of p from q."""
    m = (p + q) / 2

    def half(a: np.ndarray) -> np.ndarray:
        ratio = np.divide(a, m, out=np.ones_like(m), where=(a > 0) & (m > 0))
        return (a * np.log2(ratio)).sum(axis=1)

    return np.sqrt(np.clip((half(p) + half(np.broadcast_to(q, p.shape))) / 2, 0.0, 1.0))


def distances(w_lower: textops.Words, ref: Reference) -> tuple[np.ndarray, np.ndarray]:
    """Distance of each row's class and word histogram from the reference."""
    n, rows = w_lower.counts(), w_lower.row_of()
    classes = class_counts(w_lower).astype(float)
    classes /= np.maximum(classes.sum(axis=1), 1)[:, None]
    size = len(ref.words)
    at = np.minimum(np.searchsorted(ref.words, w_lower.hash), size - 1)
    slot = np.where(ref.words[at] == w_lower.hash, at, size)
    counts = np.bincount(rows * (size + 1) + slot, minlength=len(n) * (size + 1))
    shares = counts.reshape(len(n), size + 1) / np.maximum(n, 1)[:, None]
    return distance(classes, ref.class_share), distance(shares, ref.word_share)


def _judged(piece: pa.RecordBatch, n: np.ndarray, refs: dict[str, Reference],
            limits: Limits) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both distances of each row and whether it is too far (0 and no without a reference of its language)."""
    char, word, far = np.zeros(len(n)), np.zeros(len(n)), np.zeros(len(n), bool)
    char_limit, word_limit = ((base + slope / np.sqrt(np.maximum(n, 1))) for base, slope in
                              ((limits.char_base, limits.char_slope), (limits.word_base, limits.word_slope)))
    text, langs = piece.column("text"), piece.column("lang").dictionary_encode()
    code = langs.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    for k, name in enumerate(langs.dictionary.to_pylist()):
        if name in refs:
            mine = np.flatnonzero(code == k)
            char[mine], word[mine] = distances(textops.words(text.take(pa.array(mine)), lower=True), refs[name])
    asked = np.flatnonzero(((char > char_limit) | (word > word_limit)) & (n >= limits.min_words))
    if len(asked):
        w = textops.words(text.take(pa.array(asked)), lower=True)
        for ref in refs.values():
            c, d = distances(w, ref)
            char[asked], word[asked] = np.minimum(char[asked], c), np.minimum(word[asked], d)
        far[asked] = (char[asked] > char_limit[asked]) | (word[asked] > word_limit[asked])
    return char, word, far


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, refs: list[Reference], *, text: str = "text", lang: str = "lang",
          keep: list[str] | None = None, limits: Limits = Limits()) -> DataFrame:
    """Columns ``keep`` (default: all), the counts, both distances, base_failed and kept."""
    added = [*_COUNTS, "char_distance", "word_distance", "base_failed", "kept"]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in added]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(kept)],
                       F.col(f"`{text}`").cast("string").alias("text"),
                       F.col(f"`{lang}`").cast("string").alias("lang"))
    shared = docs.sparkSession.sparkContext.broadcast({r.lang: r for r in refs})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in textops.slices(batch):
                w = textops.words(piece.column("text"))
                counts = base_counts(w)
                n = counts["n_words"]
                char, word, far = _judged(piece, n, shared.value, limits)
                failed = (n < 20) | (100 * counts["n_repeat_words"] > 30 * n)
                good = ~failed & ~far
                yield pa.RecordBatch.from_arrays(
                    [*[piece.column(f"in_{i}") for i in range(len(kept))],
                     *[pa.array(counts[c].astype(np.int64)) for c in _COUNTS], pa.array(char),
                     pa.array(word), pa.array(failed), pa.array(good)],
                    names=[*[f"in_{i}" for i in range(len(kept))], *added])

    fields = [f"in_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(kept)]
    fields += [f"{c} long" for c in _COUNTS] + ["char_distance double", "word_distance double",
                                               "base_failed boolean", "kept boolean"]
    judged = rows.mapInArrow(run, ", ".join(fields))
    return judged.select(*[F.col(f"in_{i}").alias(c) for i, c in enumerate(kept)], *added)


def accepted(docs: DataFrame, *, text: str = "text", lang: str = "lang",
             limits: Limits = Limits()) -> DataFrame:
    """The rows that pass, with the input's columns."""
    refs = references(docs, text=text, lang=lang)
    whole = docs.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"), F.struct("*").alias("row"))
    return judge(whole, refs, keep=["row"], limits=limits).filter("kept").select("row.*")
