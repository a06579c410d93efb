"""Accounts and their parents: ultimate parent, depth, and won revenue rolled up to it.

Closure by pointer doubling: in each round every account that has not reached
its top takes its pointer's pointer, so depth d needs about log2(d) rounds of
one join, whatever the number of accounts. Only unresolved accounts are joined.
A round that resolves none ends it: what is left leads into a cycle.

Defined results: a parent that is not an account itself is a top of its own
(status ``orphan``, its name is kept); accounts on or leading into a cycle have
no top and no depth (status ``cycle``), and their revenue stays with themselves. An
account that names itself is a cycle of one. Account names are unique (the accounts' key).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..plans.model import CrmModel
from ..session import reliable_checkpoint
from . import _stats as S

TOP, CHILD, ORPHAN, CYCLE = "top", "child", "orphan", "cycle"


def closure(accounts: DataFrame, parent: str = "subsidiary_of") -> DataFrame:
    """account, parent, ultimate_parent, depth and status of every account."""
    own = accounts.select("account", F.col(parent).alias("parent"))
    named = own.select(F.col("account").alias("parent"), F.lit(True).alias("_is_account"))
    links = own.join(named, "parent", "left").select("account", "parent", F.coalesce("_is_account", F.lit(False)).alias("_known"))
    # _up: an ancestor _steps above; resolved once that is a top
    rows = reliable_checkpoint(links.select(
        "account", "parent", F.coalesce("parent", "account").alias("_up"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("bigint").alias("_steps"),
        F.when(F.col("parent").isNull(), TOP).when(~F.col("_known"), ORPHAN).alias("status")))
    left = rows.filter("status IS NULL").count()
    while left:
        # the pointer's own pointer; where that is at its top, so is this one
        ahead = rows.select(F.col("account").alias("_up"), F.col("_up").alias("_up2"), F.col("_steps").alias("_steps2"), F.col("status").alias("_status2"))
        moved = rows.filter("status IS NULL").join(ahead, "_up").select(
            "account", "parent", F.col("_up2").alias("_up"), (F.col("_steps") + F.col("_steps2")).alias("_steps"),
            F.when(F.col("_status2") == ORPHAN, ORPHAN).when(F.col("_status2").isNotNull(), CHILD).alias("status"))
        rows = reliable_checkpoint(rows.filter("status IS NOT NULL").unionByName(moved))
        before, left = left, rows.filter("status IS NULL").count()
        if left == before:
            break
    stuck = F.col("status").isNull()
    return rows.select("account", "parent", F.when(~stuck, F.col("_up")).alias("ultimate_parent"),
                       F.when(~stuck, F.col("_steps")).alias("depth"), F.coalesce("status", F.lit(CYCLE)).alias("status"))


def parent_revenue(model: CrmModel, parent: str = "subsidiary_of", sort: bool = True) -> DataFrame:
    """Won revenue and deals by ultimate parent: its own, its subsidiaries' and both; one row a top.

    Accounts in cycles are tops of themselves here. Deals without an account are left out.
    """
    tree = closure(model.accounts(), parent).select("account", F.coalesce("ultimate_parent", "account").alias("ultimate_parent"), "depth")
    won = S.per_account(model, ("deal_stage", "close_value", "opportunity_id"),
                        {"_sum": ("sum", "close_value"), "_deals": ("count", "opportunity_id")}, C.is_won()).filter(F.col("account").isNotNull())
    own = F.col("account") == F.col("ultimate_parent")
    out = tree.join(won, "account", "left").groupBy("ultimate_parent").agg(
        F.count(F.lit(1)).alias("accounts"), F.max("depth").alias("levels"), F.coalesce(F.sum("_deals"), F.lit(0)).alias("won_deals"),
        F.coalesce(F.sum(F.when(own, F.col("_sum"))), F.lit(0)).cast("double").alias("own_revenue"),
        F.coalesce(F.sum("_sum"), F.lit(0)).cast("double").alias("total_revenue"))
    return out.orderBy(F.col("total_revenue").desc(), "ultimate_parent") if sort else out
