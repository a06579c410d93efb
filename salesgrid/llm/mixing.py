"""Mix sources to target weights: hash-random order, distributed prefix sums, exact cuts.

Each row gets a hash-random key (MD5 of the seed and its id). Within a source
the rows are ordered by that key in ``BINS`` key ranges; per-(source, range)
sums give each range's offset and a window inside the range gives each row's,
so no task ever holds a whole source. A source with budget ``b`` and size ``s``
takes ``b // s`` whole epochs of all its rows and then, in key order, rows up to
exactly ``b`` words; the row on the cut gives only its first words.

Only DataFrame functions are used.

Defined results: a null text has size 0; null sources form one source, ranked
last; null or repeated ids are ordered by their other columns; rows equal in
every column are interchangeable; a source without words has target 0; an empty
table gives an empty result. Columns of the input that are named like a result
column are replaced by it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLANKS = " \t\n\u000b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
BIN_DIGITS = 3            # hex digits of the key that name its range
BINS = 16 ** BIN_DIGITS
SEED = "mix-1"
RESULT = ("size", "source_size", "target", "taken")


def word_list(text: Column) -> Column:
    """The words of a text that has at least one (otherwise one empty string)."""
    return F.split(F.trim(text, F.lit(BLANKS)), SPACE_RUN)


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text; 0 for null."""
    body = F.coalesce(text, F.lit(""))
    has = F.length(F.trim(body, F.lit(BLANKS))) > 0
    return F.when(has, F.size(word_list(body))).otherwise(0).cast("long")


def source_targets(totals: DataFrame, weights: Sequence[int] = (1, 2, 3),
                   ceiling: float = 3.0) -> DataFrame:
    """Targets of sources from (source, source_size): one row a source, so the
    windows run over as many rows as there are sources.

    Sources by code point (null last) weigh ``weights``, repeating. In order of
    ceiling per weight, a source stays at its ceiling while the level of what is
    left reaches it; the first one above the level sets it for all others.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    ranked = totals.select(
        "source", "source_size",
        F.element_at(cycle, ((rank - 1) % len(weights) + 1).cast("int")).alias("weight"))
    limit = F.lit(float(ceiling)) * F.col("source_size")
    ordered = ranked.select("*", limit.alias("limit"), (limit / F.col("weight")).alias("level"))
    before = W.orderBy("level", F.col("source").asc_nulls_last()).rowsBetween(
        W.unboundedPreceding, -1)
    everything = W.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    place = F.row_number().over(W.orderBy("level", F.col("source").asc_nulls_last()))
    water = ordered.select("*", (left / weight_left).alias("water"), place.alias("place"))
    first_above = F.min(F.when(F.col("level") > F.col("water"), F.struct("place", "water")))
    final = first_above.over(everything)["water"]
    return water.select(
        "source", "source_size",
        F.least("limit", F.coalesce(final * F.col("weight"), F.col("limit"))).alias("target"))


def mix(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", source: str = "source",
        weights: Sequence[int] = (1, 2, 3), ceiling: float = 3.0, seed: str = SEED,
        size: Column | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default: all) of every row, with size, source_size, target and taken.

    ``size`` overrides the word count as the measure of a row. ``taken`` is the
    number of words that the mix takes of the row, repeats counted.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c not in RESULT]
    ident = F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))
    key = F.md5(F.concat(F.lit(seed + ":"), ident))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{source}`").alias("source"),
        F.col(f"`{doc_id}`").alias("ident"), key.alias("key"),
        F.substring(key, 1, BIN_DIGITS).alias("bin"),
        (word_count(F.col(f"`{text}`")) if size is None else size.cast("long")).alias("size"),
        F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("tie"))
    bins = rows.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    by_source = W.partitionBy("source")
    offsets = bins.select(
        "source", "bin", F.sum("bin_size").over(by_source).alias("source_size"),
        (F.sum("bin_size").over(by_source.orderBy("bin")) - F.col("bin_size")).alias("offset"))
    targets = source_targets(bins.groupBy("source").agg(F.sum("bin_size").alias("source_size")),
                             weights, ceiling)
    plan = offsets.alias("o").join(targets.alias("t"), F.col("o.source").eqNullSafe(F.col("t.source"))) \
        .select(F.col("o.source").alias("source"), "o.bin", "o.source_size", "o.offset", "t.target")
    inside = W.partitionBy("source", "bin").orderBy("key", "ident", "size", "tie") \
        .rowsBetween(W.unboundedPreceding, -1)
    placed = rows.select("*", F.coalesce(F.sum("size").over(inside), F.lit(0)).alias("inside")).alias("r") \
        .join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source"))
              & (F.col("r.bin") == F.col("p.bin")))
    budget = F.floor(F.col("p.target")).cast("long")
    # Integer division by the source's size; a source without words takes nothing.
    epochs = F.when(F.col("p.source_size") > 0,
                    F.floor((budget - budget % F.greatest(F.col("p.source_size"), F.lit(1)))
                            / F.greatest(F.col("p.source_size"), F.lit(1)))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("p.source_size")
    cut = F.greatest(F.lit(0), F.least(F.col("r.size"), rest - F.col("p.offset") - F.col("r.inside")))
    return placed.select("r.row.*", F.col("r.size").alias("size"), F.col("p.source_size"),
                         F.col("p.target"), (epochs * F.col("r.size") + cut).cast("long").alias("taken"))


def repeated(mixed: DataFrame, *, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """The mixed corpus itself: a row for each time a text is taken, without the four
    result columns. The row on a source's cut keeps its first words, joined by one space.
    """
    times = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    turns = mixed.filter(times > 0).select("*", F.explode(F.sequence(F.lit(1), times)).alias("_turn"))
    part = F.least(F.col("size"), F.col("taken") - (F.col("_turn") - 1) * F.col("size")).cast("int")
    cut = F.when(part < F.col("size"),
                 F.array_join(F.slice(word_list(F.col(text)), F.lit(1), part), " ")).otherwise(F.col(text))
    out = turns.withColumn(text, cut)
    if n_chars and n_chars in mixed.columns:
        out = out.withColumn(n_chars, F.length(text).cast(dict(mixed.dtypes)[n_chars]))
    return out.drop("_turn", *RESULT)
