"""Toxicity scores: boosted trees over dense features, calibrated by isotonic regression.

The labelled rows are split by CRC-32 of the id (mod ``folds``): remainder 0 is
held out and never learned from; the others are dealt to three parts, one for
the lexicon, one for the trees, one for the calibration, so that no part sees
what another was fitted to. Each part is a hash sample of about ``max_rows``
rows at most; only this fit is bounded, every row is scored from its whole text.

The lexicon is learned: words and word stems, with look-alike digits and signs
mapped to letters, whose documents are toxic far more often than the part's
share (z score). Features of a text: densities of strong and weaker lexicon
hits, their nearness to second-person pronouns, capitals, punctuation and
obfuscation rates, and length. Words are looked up once per task and distinct
word (``CACHE_WORDS``), then counted with numpy.

Defined results: a null or empty text is scored like any other (all densities
0); null ids are held out of the fit; several labels of one id count as their
maximum; null labels don't count; without labels of both kinds every score is
the part's toxic share (0 without labels); repeated rows give repeated rows; an
empty table gives an empty result. Labels, language, source and id are no
features; only id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch, textops

FOLDS = 5
MAX_ROWS = 8_000        # labelled rows of each of the three parts
MAX_TERMS = 2_000       # lexicon size
MIN_TOXIC = 3           # toxic documents of a term
WEAK_Z, STRONG_Z = 5.0, 8.0
STEMS = (4, 5, 6)
NEAR = 5                # words between a hit and a pronoun
CACHE_WORDS = 1_000_000
SEED = 11

# Look-alikes, and second-person pronouns of the corpus' languages.
LOOKALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s",
                           "!": "i"})
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine deinen deiner ihr euch euer eure sie "
    "tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros vuestro vuestra".split())

_EDGES = re.compile(r"^\W+|\W+$")
_SIGNS = re.compile(r"[\W_\d]+")
_INNER = re.compile(r"[^\W\d_][\d@$!*._-]+[^\W\d_]")
FEATURES = ("strong_density", "weak_density", "strong_hits", "distinct_hits", "hidden_hits", "second_person",
            "near_hits", "nearness", "capital_words", "capitals", "exclamations", "questions", "punctuation",
            "obfuscated", "log_words")


def normal_form(word: str) -> str:
    """Lower-case letters of a word: edge signs off, look-alikes mapped, other signs dropped."""
    return _SIGNS.sub("", _EDGES.sub("", word.lower()).translate(LOOKALIKE))


def terms(form: str) -> list[str]:
    return [form, *(form[:n] + "-" for n in STEMS if len(form) > n)] if form else []


def fold(doc_id: Column, folds: int = FOLDS) -> Column:
    """CRC-32 of the id as text, mod ``folds``; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0)).cast("int")


class _Lookup:
    """Codes of words: lexicon level, hidden (found only through look-alikes), pronoun, capitals, obfuscated."""

    def __init__(self, lexicon: dict[str, int]):
        self.lexicon, self.codes = lexicon, {}

    def code(self, word: str) -> int:
        form = normal_form(word)
        plain = _EDGES.sub("", word).lower()
        level = max((self.lexicon.get(t, 0) for t in terms(form)), default=0)
        hidden = level > 0 and form != plain
        return (level | 4 * hidden | 8 * (plain in SECOND_PERSON)
                | 16 * (len(form) > 1 and word.upper() == word) | 32 * bool(_INNER.search(word)))

    def codes_of(self, w: textops.Words) -> np.ndarray:
        distinct, first, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
        if len(self.codes) + len(distinct) > CACHE_WORDS:
            self.codes.clear()
        keys = distinct.tolist()
        for i, k in enumerate(keys):
            if k not in self.codes:
                self.codes[k] = self.code(w.text(first[i], first[i] + 1))
        return np.fromiter((self.codes[k] for k in keys), np.int64, len(keys))[inverse]


def features(w: textops.Words, lookup: _Lookup) -> np.ndarray:
    """One row of ``FEATURES`` for each text."""
    codes, rows, n = lookup.codes_of(w), w.row_of(), w.counts()
    per = lambda mask: np.bincount(rows[mask], minlength=len(n)).astype(float)
    level, person = codes & 3, (codes & 8) > 0
    strong, hit = level == 2, level > 0
    words = np.maximum(n, 1)
    at, spot = np.flatnonzero(hit), np.flatnonzero(person)
    gap = np.full(len(at), np.inf)
    if len(spot):
        for side in (-1, 0):
            k = np.clip(np.searchsorted(spot, at) + side, 0, len(spot) - 1)
            gap = np.where(rows[spot[k]] == rows[at], np.minimum(gap, np.abs(spot[k] - at)), gap)
    key = textops.by_row(w.hash[at], rows[at])
    different = np.unique(key, return_index=True)[1]
    chars = np.maximum(np.diff(w.row_start), 1)
    count = lambda mask: textops.sums(mask, w.row_start).astype(float)
    upper = count((w.data >= 65) & (w.data <= 90))
    letters = np.maximum(upper + count((w.data >= 97) & (w.data <= 122)), 1)
    sign = ((w.data > 32) & (w.data < 48)) | ((w.data > 57) & (w.data < 65)) | ((w.data > 90) & (w.data < 97))
    hits = np.maximum(per(hit), 1)
    columns = [per(strong) / words, per(hit & ~strong) / words, np.log1p(per(strong)),
               np.bincount(rows[at][different], minlength=len(n)), per((codes & 4) > 0) / words,
               per(person) / words, np.bincount(rows[at], weights=gap <= NEAR, minlength=len(n)) / hits,
               np.bincount(rows[at], weights=1 / (1 + gap), minlength=len(n)) / hits,
               per((codes & 16) > 0) / words, upper / letters, count(w.data == 33) / chars,
               count(w.data == 63) / chars, count(sign) / chars, per((codes & 32) > 0) / words, np.log1p(n)]
    return np.stack([np.asarray(c, float) for c in columns], axis=1)


@dataclass
class Model:
    lexicon: dict[str, int]
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    share: float


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        toxic, clean = Counter(), Counter()
        known: dict[str, list[str]] = {}
        for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            mine = set()
            for word in set((text or "").split()):
                if word not in known:
                    known[word] = terms(normal_form(word))
                mine.update(known[word])
            (toxic if label else clean).update(mine)
        names = sorted(toxic)       # a term without toxic documents is never chosen
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([toxic[t] for t in names], pa.int64()),
             pa.array([clean[t] for t in names], pa.int64())], names=["term", "toxic", "clean"])
        names = sorted(set(clean) - set(toxic))
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([0] * len(names), pa.int64()),
             pa.array([clean[t] for t in names], pa.int64())], names=["term", "toxic", "clean"])


def learn_lexicon(rows: DataFrame, share: float) -> dict[str, int]:
    """Level (1 weak, 2 strong) of at most ``MAX_TERMS`` terms from (text, toxic)."""
    counts = rows.mapInArrow(_term_counts, "term string, toxic long, clean long").groupBy("term") \
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).filter(F.col("toxic") >= MIN_TOXIC)
    n = F.col("toxic") + F.col("clean")
    z = (F.col("toxic") - n * share) / F.sqrt(n * F.lit(share * (1 - share)))
    best = counts.withColumn("z", z).filter(F.col("z") >= WEAK_Z).orderBy(F.col("z").desc(), "term") \
        .limit(MAX_TERMS)
    return {r.term: 2 if r.z >= STRONG_Z else 1 for r in best.collect()}


def with_features(docs: DataFrame, lexicon: dict[str, int], keep: list[str]) -> DataFrame:
    """Columns ``keep`` and ``features`` (array<double>) of rows with a string column text."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = _Lookup(shared.value)
        for batch in batches:
            for piece in textops.slices(batch):
                x = features(textops.words(piece.column("text")), lookup)
                offsets = np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)
                values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*[piece.column(c) for c in keep], values],
                                                 names=[*keep, "features"])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, *([] if "text" in keep else ["text"])) \
        .mapInArrow(run, f"{fields}, features array<double>")


def fit(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id",
        label: str = "toxic", folds: int = FOLDS, max_rows: int = MAX_ROWS) -> Model:
    """Learn from the labelled rows that are not held out."""
    spark = docs.sparkSession
    known = labels.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("toxic")) \
        .filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(fold(F.col("doc_id"), folds) != 0) \
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share_of = min(1.0, 3 * max_rows / max(1, known.count()))
    draw = lambda c: F.pmod(F.xxhash64(F.lit("sample"), c), F.lit(1 << 20)) < int(share_of * (1 << 20))
    texts = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    part = F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(3)).cast("int")
    rows, path = scratch.write(
        texts.filter((fold(F.col("doc_id"), folds) != 0) & draw(F.col("doc_id")))
        .join(known.filter(draw(F.col("doc_id"))), "doc_id").select(part.alias("part"), "toxic", "text"),
        "toxicity-sample")
    tally = {r.part: (r.n, r.toxic) for r in rows.groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("toxic")).collect()}
    total, toxic = (sum(v[i] for v in tally.values()) for i in (0, 1))
    share = toxic / total if total else 0.0
    if any(p not in tally or not 0 < tally[p][1] < tally[p][0] for p in range(3)):
        return Model({}, None, None, share)
    lexicon = learn_lexicon(rows.filter("part = 0").select("text", "toxic"), tally[0][1] / tally[0][0])
    ready, features_path = scratch.write(
        with_features(rows.filter("part > 0"), lexicon, ["part", "toxic"])
        .select("part", F.col("toxic").cast("double").alias("label"), "features"), "toxicity-features")
    ready = ready.withColumn("features", array_to_vector("features"))
    trees = GBTClassifier(maxIter=20, maxDepth=3, stepSize=0.2, seed=SEED, minInstancesPerNode=5) \
        .fit(ready.filter("part = 1").select("features", "label"))
    margins = trees.transform(ready.filter("part = 2")) \
        .select("label", vector_to_array("rawPrediction")[1].alias("features"))
    calibration = IsotonicRegression(featuresCol="features", labelCol="label").fit(margins)
    scratch.remove(spark, path, features_path)
    return Model(lexicon, trees, calibration, share)


def score(docs: DataFrame, model: Model, *, text: str = "text", doc_id: str = "doc_id",
          folds: int = FOLDS) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    if model.trees is None:
        scored = rows.select("doc_id", F.lit(float(model.share)).alias("score"))
    else:
        ready = with_features(rows, model.lexicon, ["doc_id"]) \
            .select("doc_id", array_to_vector("features").alias("features"))
        margin = model.trees.transform(ready) \
            .select("doc_id", vector_to_array("rawPrediction")[1].alias("features"))
        scored = model.calibration.transform(margin) \
            .select("doc_id", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("prediction"))).alias("score"))
    return scored.select("doc_id", (fold(F.col("doc_id"), folds) == 0).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
