"""The declared relations of the star, and rows that break them or cannot be read.

The fact table names an account, a product and a sales agent; each should be a
row of its dimension. ``orphans`` finds the names that are not, by anti-join on
the distinct names (the fact table is reduced to them first, so a hot name is
one row), and NULL names are counted apart: they are no reference at all.

``read_checked`` reads a CSV table beside FAILFAST: rows that cannot be parsed or
break a rule go to a quarantine of (file, row, reason) instead of ending the job,
and only the others are loaded.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.model import CrmModel
from ..schemas import STAGES
from .csv_files import read_csv

# The fact table's references: name -> (fact column, dimension, its key).
RELATIONS = {
    "pipeline_account": ("account", "accounts", "account"),
    "pipeline_product": ("product", "products", "product"),
    "pipeline_sales_agent": ("sales_agent", "sales_teams", "sales_agent"),
}


def orphans(model: CrmModel, relations: Mapping[str, tuple[str, str, str]] = RELATIONS) -> DataFrame:
    """relation, value, deals: names in the fact table without a row in the dimension; value NULL: deals without a name."""
    # grouping sets over the columns: one pass over the fact table for all relations
    columns = list(dict.fromkeys(c for c, _, _ in relations.values()))
    tagged = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("t")
    names = model.pipeline(*columns).select(tagged).select("t.column", "t.value").groupBy("column", "value") \
        .agg(F.count(F.lit(1)).alias("deals"))
    known = reduce(DataFrame.unionByName, [
        model._dim(d).filter(F.col(k).isNotNull()).select(F.lit(c).alias("column"), F.col(k).cast("string").alias("value"))
        for c, d, k in relations.values()])
    relation = reduce(lambda e, r: e.when(F.col("column") == r[1][0], r[0]), relations.items(), F.when(F.lit(False), ""))
    return names.join(known, ["column", "value"], "left_anti").select(relation.alias("relation"), "value", "deals")


def _blank(column: str) -> Column:
    return F.col(column).isNull() | (F.trim(F.col(column)) == "")


# Rules of the fact table, reason -> what breaks it; the first that holds is given.
PIPELINE_RULES = {
    "no opportunity id": lambda: _blank("opportunity_id"),
    "unknown stage": lambda: F.coalesce(~F.col("deal_stage").isin(*STAGES), F.lit(True)),
    "closed deal without close date": lambda: F.col("deal_stage").isin("Won", "Lost") & F.col("close_date").isNull(),
    "open deal with close date": lambda: F.col("deal_stage").isin("Prospecting", "Engaging") & F.col("close_date").isNotNull(),
    "closed before engaged": lambda: F.col("close_date") < F.col("engage_date"),
    "negative value": lambda: F.col("close_value") < 0,
}


def key_rule(key: str) -> dict:
    """The rule of a dimension: its key is there."""
    return {f"no {key}": lambda: _blank(key)}


def read_checked(spark: SparkSession, path: str, schema: T.StructType, rules: Mapping[str, object] | None = None,
                 **options) -> tuple[DataFrame, DataFrame]:
    """(rows that can be read and break no rule, quarantine of the others: file, row, reason).

    ``row`` is the line as it stands in the file where it could not be parsed, and the parsed row as JSON
    where it breaks a rule. The header is not compared with the schema here: a file with another header has
    every row that does not fit in quarantine. Both results read the file lazily.
    """
    bad = "_unparsed"
    wide = T.StructType([*[T.StructField(f.name, f.dataType, True) for f in schema.fields], T.StructField(bad, T.StringType(), True)])
    rows = read_csv(spark, path, wide, mode="PERMISSIVE", columnNameOfCorruptRecord=bad, enforceSchema="true") \
        .select("*", F.col("_metadata.file_path").alias("_file"))
    reason = F.when(F.col(bad).isNotNull(), "not readable as the declared columns")
    for text, broken in (rules or {}).items():
        reason = reason.when(broken(), text)
    names = [f.name for f in schema.fields]
    judged = rows.withColumn("_reason", reason)
    quarantine = judged.filter(F.col("_reason").isNotNull()).select(
        F.col("_file").alias("file"), F.coalesce(F.col(bad), F.to_json(F.struct(*names))).alias("row"), F.col("_reason").alias("reason"))
    return judged.filter(F.col("_reason").isNull()).select(*names), quarantine
