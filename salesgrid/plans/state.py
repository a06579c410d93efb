"""Won deals per (account, close day), kept up to date by batches, and metrics answered from them.

A batch of deals is reduced to additive parts per (account, close day) and
written below its id; that is all that ever reads the deals. Parts of different
batches add up, so late deals need no special treatment, and deals that were
wrong are taken back by applying them as ``retracted``. A batch counts once its
files are complete (the writer's ``_SUCCESS``), and an id that counts already is
not applied again: replays change nothing.

``compact`` sums all batches into a snapshot that lists their ids; the list is
written last and makes the snapshot count. ``vacuum`` removes what the newest
snapshot covers. Readers take the newest snapshot and the batches it does not
list, so a crash at any point leaves the state as it was.

``model`` gives a star model whose per-account metrics read the state: Q2 to Q7a,
Q19 and Q20, and whatever else needs only sums, counts and dates of won deals by
account. Metrics that need other columns or stages say so.

An account has at most one row a day in a batch, so a hot account is small by
then (partial sums before the shuffle); nothing is laid out by account alone.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources import files
from .model import CrmModel

SCHEMA = ("account string, close_date date, rows long, deals long, value decimal(38,2), valued long, "
          "days long, timed long")
_KEYS = ("account", "close_date")
_SUMS = ("rows", "deals", "value", "valued", "days", "timed")
DEAL_COLUMNS = ("account", "deal_stage", "engage_date", "close_date", "close_value", "opportunity_id")

# What of the fact table each stored part answers: (aggregate, measure) -> (aggregate, part).
_ANSWERS = {
    ("count", "rows"): ("sum", "rows"), ("count", "opportunity_id"): ("sum", "deals"),
    ("sum", "close_value"): ("sum", "value"), ("count", "close_value"): ("sum", "valued"),
    ("sum", "cycle_days"): ("sum", "days"), ("count", "cycle_days"): ("sum", "timed"),
    ("min", "close_date"): ("min", "close_date"), ("max", "close_date"): ("max", "close_date"),
}


def deltas(deals: DataFrame) -> DataFrame:
    """The additive parts of the won deals among ``deals``, per (account, close day)."""
    cycle = C.day_diff("engage_date", "close_date")
    return deals.filter(C.is_won()).groupBy(*_KEYS).agg(
        F.count(F.lit(1)).alias("rows"), F.count("opportunity_id").alias("deals"),
        F.sum("close_value").cast("decimal(38,2)").alias("value"), F.count("close_value").alias("valued"),
        F.sum(cycle).alias("days"), F.count(cycle).alias("timed"))


def _summed(parts: DataFrame) -> DataFrame:
    return parts.groupBy(*_KEYS).agg(*[F.sum(c).cast(dict(parts.dtypes)[c]).alias(c) for c in _SUMS])


class AccountState:
    """The state below ``path``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # -- what counts --------------------------------------------------------
    def _complete(self, folder: str, marker: str = "_SUCCESS") -> list[str]:
        base = f"{self.path}/{folder}"
        return [n for n in files.children(self.spark, base) if files.exists(self.spark, f"{base}/{n}/{marker}")]

    def _snapshot(self) -> tuple[int, set[str]]:
        """Number of the newest snapshot (0: none) and the batches in it."""
        numbers = [int(n) for n in self._complete("snapshots", "batches/_SUCCESS")]
        if not numbers:
            return 0, set()
        listed = self.spark.read.schema("batch string").parquet(f"{self.path}/snapshots/{max(numbers)}/batches")
        return max(numbers), {r.batch for r in listed.collect()}

    def batches(self) -> set[str]:
        """Names of the batches that count."""
        return self._snapshot()[1] | set(self._complete("batches"))

    # -- changes ------------------------------------------------------------
    def apply(self, deals: DataFrame, batch_id, retracted: DataFrame | None = None) -> bool:
        """Add a batch of deals (``DEAL_COLUMNS``; only won ones count), take the ``retracted`` ones back.

        False if the batch counts already: then nothing changes. One pass over the batch.
        """
        name = f"id-{quote(str(batch_id), safe='')}"
        if name in self.batches():
            return False
        parts = deltas(deals)
        if retracted is not None:
            back = deltas(retracted)
            parts = _summed(parts.unionByName(back.select(*_KEYS, *[(-F.col(c)).cast(back.schema[c].dataType).alias(c)
                                                                    for c in _SUMS])))
        parts.select(*_KEYS, *_SUMS).write.mode("overwrite").parquet(f"{self.path}/batches/{name}")
        return True

    def follow(self, stream: DataFrame, checkpoint: str, prefix: str = "stream", **trigger):
        """Apply each micro-batch of a stream of deals; one that Spark repeats after a failure counts once."""
        def step(batch: DataFrame, number: int) -> None:
            self.apply(batch, f"{prefix}-{number}")

        writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
        return (writer.trigger(**trigger) if trigger else writer).start()

    def compact(self) -> int:
        """Sum all that counts into a new snapshot; its number."""
        number, covered = self._snapshot()
        names = sorted(covered | set(self._complete("batches")))
        base = f"{self.path}/snapshots/{number + 1}"
        if files.exists(self.spark, base):
            files.remove(self.spark, base)      # left by a compaction that did not get to its list
        self.rows(signed=True).write.parquet(f"{base}/rows")
        self.spark.createDataFrame([(n,) for n in names], "batch string").coalesce(1).write.parquet(f"{base}/batches")
        return number + 1

    def vacuum(self) -> None:
        """Remove the batches and snapshots that the newest snapshot covers (not while older plans still read them)."""
        number, covered = self._snapshot()
        for name in self._complete("batches"):
            if name in covered:
                files.remove(self.spark, f"{self.path}/batches/{name}")
        for name in files.children(self.spark, f"{self.path}/snapshots"):
            if int(name) < number:
                files.remove(self.spark, f"{self.path}/snapshots/{name}")

    # -- reading ------------------------------------------------------------
    def rows(self, signed: bool = False) -> DataFrame:
        """One row per account and close day. ``signed`` keeps rows that add up to no deal (for later batches)."""
        number, covered = self._snapshot()
        paths = [f"{self.path}/batches/{n}" for n in self._complete("batches") if n not in covered]
        if number:
            paths.append(f"{self.path}/snapshots/{number}/rows")
        if not paths:
            return self.spark.createDataFrame([], SCHEMA)
        summed = _summed(self.spark.read.schema(SCHEMA).parquet(*paths))
        if signed:
            return summed.filter(" OR ".join(f"coalesce({c}, 0) <> 0" for c in _SUMS))
        known = {"value": "valued", "days": "timed"}    # a sum over nothing is NULL
        return summed.filter("rows > 0").select(*_KEYS, *[
            F.when(F.col(known[c]) > 0, F.col(c)).alias(c) if c in known else F.col(c) for c in _SUMS])

    def model(self, accounts: DataFrame | None = None, **params) -> StateModel:
        return StateModel(self, accounts, **params)


class StateModel(CrmModel):
    """A star model without a fact table: per-account metrics are answered from an ``AccountState``."""

    def __init__(self, state: AccountState, accounts: DataFrame | None = None, **params):
        def missing(*_):
            raise ValueError("the state holds won deals by account and day only; this metric needs the deals")

        super().__init__(missing, accounts if accounts is not None else missing, missing, missing, **params)
        self.state = state

    @property
    def spark(self) -> SparkSession:
        return self.state.spark

    def account_parts(self, parts: Mapping[str, tuple[str, object]], where: Column | None,
                      keys: Mapping[str, Column]) -> DataFrame:
        """See ``operators._stats.per_account``."""
        unknown = [p for p in parts.values() if not (isinstance(p[1], str) and p in _ANSWERS)]
        if unknown or where is None:
            raise ValueError(f"not kept in the state: {unknown or 'deals that are not won'}")
        rows = self.state.rows().withColumn("deal_stage", F.lit(C.WON)).filter(where)
        by = [F.col("account"), *[k.alias(n) for n, k in keys.items()]]
        if not parts:
            return rows.select(*by).distinct()
        merge = {"sum": F.sum, "min": F.min, "max": F.max}
        return rows.groupBy(*by).agg(*[merge[_ANSWERS[p][0]](_ANSWERS[p][1]).alias(n) for n, p in parts.items()])


def build(spark: SparkSession, path: str, batches: Iterable[tuple[object, DataFrame]]) -> AccountState:
    """A state from (id, deals) batches."""
    state = AccountState(spark, path)
    for batch_id, deals in batches:
        state.apply(deals, batch_id)
    return state
