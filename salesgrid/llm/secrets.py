"""Secret scan with corpus-wide ownership frequency.

Candidates (the base kinds and the extra kinds below) are found in every whole
text. The digest of each candidate's value is counted over the corpus by
distinct repositories and owners. A value that several owners have is a widely
copied example; one that a single owner has and that looks random is live. The
verdict is by owners alone: the number of repositories plays no part in it.
Base spans are always reported; spans of extra kinds only where live.

Only DataFrame functions are used. Positions come from the pieces between
matches: a match starts after the lengths of all pieces and matches before it,
in code points. Aggregation is partial before every shuffle (value, owner and
repository first), and the verdicts go back by a join that AQE can split, so a
value copied into a third of all texts stays harmless.

Defined results: a null text counts as empty; null owners count as one owner
and null repositories as one repository; repeated rows give repeated rows; an
empty table gives an empty result. Input columns are not carried, so extra
ones cannot clash (``redact`` carries all).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch

# The base kinds, in the order of the report. Runs that are too
# short are left out by the length in the pattern where that finds the same
# spans (a run of one character class is maximal), and afterwards for "assign".
ASSIGN = (r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?"
          r"([A-Za-z0-9+/_.=-]+)")
BASE = (("assign", ASSIGN, 2, 6), ("access", "AKIA[A-Z0-9]{16,}", 0, 20),
        ("hex", "[0-9a-f]{24,}", 0, 24))
# Public token formats. A private key is its whole block, or its header
# and the lines of base64 after it where the end is cut off; the body is its value.
# Repetitions are possessive, so that a text of any length is read once.
PEM = (r"-----BEGIN [A-Z ]*PRIVATE KEY-----((?:[^-]++|-(?!----))*+(?=-----END [A-Z ]*PRIVATE KEY-----)"
       r"|(?:(?:\s|\\[nr])*+[A-Za-z0-9+/=]{16,}+)++)(?:-----END [A-Z ]*PRIVATE KEY-----)?")
BREAKS = r"\s|\\[nr]"    # line breaks of a key's body, also as written in quoted strings
EXTRA = (("github", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
         ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
         ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 28),
         ("pem", PEM, 1, 0))
KINDS = BASE + EXTRA
MIN_DISTINCT = 6   # a live-looking value has so many different characters
MIN_LENGTH = 8


def _spans(text: Column, rank: int, pattern: str, group: int, least: int) -> Column:
    """array<struct<start, end, kind, hash, live>> of one kind."""
    regex = F.lit(pattern)
    plain = lambda v: F.regexp_replace(v, BREAKS, "") if pattern == PEM else v
    zipped = F.arrays_zip(
        F.split(text, pattern, -1).alias("piece"), F.regexp_extract_all(text, regex, F.lit(0)).alias("match"),
        F.regexp_extract_all(text, regex, F.lit(group)).alias("value"))
    empty = F.array().cast("array<struct<start:int,end:int,kind:int,hash:string,random:boolean>>")

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["piece"])
        end = start + F.length(x["match"])
        found = F.struct(start.alias("start"), end.alias("end"), F.lit(rank).alias("kind"),
                         F.md5(plain(x["value"])).alias("hash"), _random(plain(x["value"])).alias("random"))
        fits = x["match"].isNotNull() & (F.length(x["value"]) >= least)
        return F.struct(F.coalesce(end, start).cast("int").alias("at"),
                        F.when(fits, F.concat(state["out"], F.array(found))).otherwise(state["out"])
                        .alias("out"))

    walked = F.aggregate(zipped, F.struct(F.lit(0).alias("at"), empty.alias("out")), step)["out"]
    return F.when(text.rlike(pattern), walked).otherwise(empty)


def _random(value: Column) -> Column:
    return (F.length(value) >= MIN_LENGTH) \
        & (F.size(F.array_distinct(F.split(value, ""))) >= MIN_DISTINCT)


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])
    return F.concat_ws(",", F.transform(spans, one))


def _row_key(docs: DataFrame, text: str, doc_id: str, owner: str, repository: list[str]) -> Column:
    """A digest of what decides a row's verdicts: equal rows share it."""
    parts = [doc_id, owner, *repository, text]
    return F.md5(F.concat_ws("\u0001", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\u0002"))
                                         for c in parts]))


def find_secrets(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", owner: str = "source",
                 repository: list[str] | None = None, max_owners: int = 1) -> DataFrame:
    """A row for each input row: row_key, doc_id, base and all spans, and the live ones.

    ``repository``: columns that with the owner name a repository (default: lang).
    A value of more than ``max_owners`` owners is an example.
    """
    repository = ["lang"] if repository is None else repository
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    found = F.array_sort(F.concat(*[_spans(body, i, p, g, n) for i, (_, p, g, n) in enumerate(KINDS)]))
    rows, _ = scratch.write(docs.select(
        _row_key(docs, text, doc_id, owner, repository).alias("row_key"), F.col(f"`{doc_id}`").alias("doc_id"),
        F.col(f"`{owner}`").alias("owner"),
        F.concat_ws("\u0001", *[F.col(f"`{c}`").cast("string") for c in repository]).alias("repository"),
        found.alias("found")), "secret-spans")
    values = rows.filter(F.size("found") > 0).select(
        "row_key", "owner", "repository", F.explode("found").alias("s")) \
        .select("row_key", "owner", "repository", F.col("s.hash").alias("hash"))
    counts = ownership(values)
    verdicts = values.select("row_key", "hash").distinct().join(counts, "hash") \
        .groupBy("row_key").agg(F.map_from_entries(F.collect_list(F.struct("hash", "n_owners")))
                                .alias("owners"))
    judged = rows.join(verdicts, "row_key", "left")
    own = lambda s: F.coalesce(F.col("owners")[s["hash"]], F.lit(0)) <= max_owners
    live = F.filter("found", lambda s: own(s) & s["random"])
    base = F.filter("found", lambda s: s["kind"] < len(BASE))
    shown = F.filter("found", lambda s: (s["kind"] < len(BASE)) | (own(s) & s["random"]))
    examples = F.filter("found", lambda s: ~own(s))
    return judged.select("row_key", "doc_id", base.alias("base"), shown.alias("shown"),
                         live.alias("live"), examples.alias("examples"))


def ownership(values: DataFrame) -> DataFrame:
    """Distinct repositories and owners of each value hash (hash, owner, repository in)."""
    once = values.groupBy("hash", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    per_owner = once.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repositories"),
                                                  F.sum("n").alias("n"))
    return per_owner.groupBy("hash").agg(
        F.count(F.lit(1)).alias("n_owners"), F.sum("repositories").alias("n_repositories"),
        F.sum("n").alias("n_found"))


def report(found: DataFrame) -> DataFrame:
    """The digest columns of ``find_secrets``."""
    of = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", *[of(i).alias(f"n_{name}") for i, (name, *_) in enumerate(BASE)],
        F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _listed(F.col("shown")).alias("spans"), F.size("live").cast("long").alias("n_live"),
        F.size("examples").cast("long").alias("n_example"))


def redact(docs: DataFrame, *, text: str = "text", mark: str = "[SECRET]", n_chars: str | None = "n_chars",
           doc_id: str = "doc_id", owner: str = "source", repository: list[str] | None = None,
           max_owners: int = 1) -> DataFrame:
    """All rows and columns, live spans in the text replaced by ``mark`` (overlapping ones by one)."""
    repository = ["lang"] if repository is None else repository
    found = find_secrets(docs, text=text, doc_id=doc_id, owner=owner, repository=repository,
                         max_owners=max_owners)
    live = found.filter(F.size("live") > 0).groupBy("row_key").agg(F.first("live").alias("live"))
    names = docs.columns
    rows = docs.select(F.struct("*").alias("row"),
                       _row_key(docs, text, doc_id, owner, repository).alias("row_key"))
    body = F.col("row")[text]

    def step(state: Column, s: Column) -> Column:
        fresh = s["start"] >= state["at"]
        gap = body.substr(state["at"] + 1, s["start"] - state["at"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"),
                        F.when(fresh, F.concat(state["out"], gap, F.lit(mark))).otherwise(state["out"])
                        .alias("out"))

    walked = F.aggregate("live", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
                         lambda z: F.concat(z["out"], body.substr(z["at"] + 1, F.length(body))))
    cleaned = rows.join(live, "row_key", "left").select(
        "row", F.when(F.col("live").isNull(), body).otherwise(walked).alias("body"))
    out = [F.col("body").alias(c) if c == text
           else F.length("body").cast(dict(docs.dtypes)[c]).alias(c) if c == n_chars
           else F.col("row")[c].alias(c) for c in names]
    return cleaned.select(*out)
