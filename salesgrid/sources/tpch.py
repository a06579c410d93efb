"""Lazy Parquet scans of the driver's TPC-H-like tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TPCH_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

# Declared schemas (DDL) of the driver's tables: no per-read schema inference,
# which would otherwise cost a footer-reading job for every table on every read.
TPCH_SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, "
                "c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, "
            "p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
              "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
                "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
                "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
}
# Loaded only where it is named: no part of the star.
EVENTS_SCHEMA = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


class TableSet(dict):
    """name -> DataFrame, with attribute access."""

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self[name]
        except KeyError as exc:  # pragma: no cover - plain attribute error
            raise AttributeError(name) from exc


def load_tables(spark: SparkSession, directory: str, names=TPCH_TABLES,
                declared_schemas: bool = True) -> TableSet:
    """One lazy scan per table with its declared schema; nothing is read until a query runs.

    Column pruning and filter push-down reach these scans through Catalyst.
    ``declared_schemas=False`` infers each file's schema instead (for inputs
    whose physical types differ, e.g. time-zone-adjusted timestamps).
    """
    base = directory.rstrip("/")

    def scan(name: str) -> DataFrame:
        schema = {**TPCH_SCHEMAS, "events": EVENTS_SCHEMA}.get(name) if declared_schemas else None
        return (spark.read.schema(schema) if schema else spark.read).parquet(f"{base}/{name}.parquet")

    return TableSet({n: scan(n) for n in names})
