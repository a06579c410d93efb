"""Views, stored tables, previews, exports and key checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..plans.model import CrmModel, crm_view
from ..schemas import DIMENSION_KEYS

TABLE_NAMES = ("accounts", "products", "sales_pipeline", "sales_teams")


def _frames(model: CrmModel) -> dict[str, DataFrame]:
    return {"accounts": model.accounts(), "products": model.products(),
            "sales_pipeline": model.pipeline(), "sales_teams": model.sales_teams()}


def register_views(model: CrmModel, prefix: str = "") -> list[str]:
    """S6 + S8: temp views of the four tables and of the joined ``crm_data`` view,
    so the same metrics can also be written in Spark SQL."""
    names = []
    for name, df in _frames(model).items():
        df.createOrReplaceTempView(prefix + name)
        names.append(prefix + name)
    crm_view(model).createOrReplaceTempView(prefix + "crm_data")
    names.append(prefix + "crm_data")
    return names


def save_tables(model: CrmModel, path: str | None = None, database: str | None = None,
                mode: str = "overwrite") -> dict[str, str]:
    """Materialise the four tables as Parquet (a path, or managed tables).

    The fact rows keep the layout they have: laid out by account, one hot
    account (or the NULL one) would be one task and one bucket. For repeated
    per-account reports store ``account_days`` instead. They are compressed by
    zstd, which makes them a third smaller. The dimensions keep the default: the
    planner goes by file sizes, and would broadcast tables with twice the rows.
    """
    out = {}
    for name, df in _frames(model).items():
        w = df.write.mode(mode).format("parquet")
        if name == "sales_pipeline":
            w = w.option("compression", "zstd")
        if database:
            w.saveAsTable(f"{database}.{name}")
            out[name] = f"{database}.{name}"
        else:
            w.save(f"{path.rstrip('/')}/{name}")
            out[name] = f"{path.rstrip('/')}/{name}"
    return out


def account_days(model: CrmModel) -> DataFrame:
    """Won deals per (account, close day): additive parts, at most a row for each day of an account."""
    p = model.pipeline("account", "deal_stage", "close_date", "close_value", "opportunity_id")
    return p.filter(C.is_won()).groupBy("account", "close_date").agg(
        F.count("opportunity_id").alias("deals"), F.sum("close_value").alias("value"),
        F.count("close_value").alias("valued_deals"))


def save_csv(model: CrmModel, path: str) -> str:
    """The four tables as CSV folders that ``csv_files.model_from_csv`` reads back (prices in whole units, as declared)."""
    from pyspark.sql import types as T

    from .. import schemas
    declared = {"accounts": schemas.ACCOUNTS, "products": schemas.PRODUCTS, "sales_teams": schemas.SALES_TEAMS,
                "sales_pipeline": schemas.SALES_PIPELINE}
    for name, df in _frames(model).items():
        columns = [F.floor(f.name).cast(f.dataType).alias(f.name) if isinstance(f.dataType, T.IntegerType) else F.col(f.name).cast(f.dataType)
                   for f in declared[name].fields]
        df.select(*columns).write.option("header", True).option("quote", '"').option("escape", '"').csv(f"{path.rstrip('/')}/{name}.csv")
    return path


def model_from_parquet(spark: SparkSession, path: str, validate_keys: bool = True,
                       **params) -> CrmModel:
    """The star model from tables written by ``save_tables(path=...)``."""
    base = path.rstrip("/")
    read = {n: spark.read.parquet(f"{base}/{n}") for n in TABLE_NAMES}
    model = CrmModel.from_frames(read["sales_pipeline"], read["accounts"], read["products"],
                                 read["sales_teams"], **params)
    return require_valid_keys(model) if validate_keys else model


def model_from_tables(spark: SparkSession, database: str | None = None,
                      validate_keys: bool = True, **params) -> CrmModel:
    """The star model from catalog tables (``database.name`` or current database)."""
    t = {n: spark.table(f"{database}.{n}" if database else n) for n in TABLE_NAMES}
    model = CrmModel.from_frames(t["sales_pipeline"], t["accounts"], t["products"],
                                 t["sales_teams"], **params)
    return require_valid_keys(model) if validate_keys else model


def export(df: DataFrame, path: str, mode: str = "overwrite", fmt: str = "parquet") -> str:
    """Write a result out instead of collecting it to the driver."""
    df.write.mode(mode).format(fmt).save(path)
    return path


def preview(df: DataFrame, n: int = 20) -> DataFrame:
    """The first ``n`` rows (a preview is a sample by design)."""
    return df.limit(n)


def key_violations(df: DataFrame, key: str) -> DataFrame:
    """Keys that are NULL or repeated, with their counts (empty when the key is valid).

    One distributed aggregate; nothing is collected.
    """
    return (df.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
            .filter(F.col(key).isNull() | (F.col("rows") > 1)))


def check_keys(model: CrmModel) -> dict[str, bool]:
    """Dimension keys must be unique and non-NULL: that makes the left joins
    row-preserving and licenses aggregating the fact table before joining.
    One job; only the names of failing dimensions reach the driver."""
    dims = {"accounts": model.accounts(), "products": model.products(),
            "sales_teams": model.sales_teams()}
    bad = reduce(DataFrame.unionByName, [
        key_violations(df, DIMENSION_KEYS[name]).select(F.lit(name).alias("name"))
        for name, df in dims.items()]).distinct().collect()
    return {name: name not in {r.name for r in bad} for name in dims}


def require_valid_keys(model: CrmModel) -> CrmModel:
    """Raise ``ValueError`` naming the dimensions whose keys repeat or are NULL."""
    bad = [name for name, ok in check_keys(model).items() if not ok]
    if bad:
        raise ValueError(f"dimension keys not unique / non-NULL in: {', '.join(bad)}")
    return model
