"""CSV readers for the CRM tables (explicit schemas, fail-fast parsing).

Files: header row, comma separator, CRLF or LF line ends, quoted fields with
doubled quotes inside, and an empty field read as NULL. Paths may be any
Hadoop file-system path (local, HDFS, object store) or a directory/glob of
part files, so a large pipeline can be split across many files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .. import schemas

DATA_DICTIONARY = T.StructType([
    T.StructField("Table", T.StringType(), False),
    T.StructField("Field", T.StringType(), False),
    T.StructField("Description", T.StringType(), True),
])


def read_csv(spark: SparkSession, path: str, schema: T.StructType, **options) -> DataFrame:
    """Parse ``path`` with ``schema``; malformed rows raise instead of turning NULL.

    The header must name the schema's columns in its order: a file with other or
    swapped columns fails instead of loading into the wrong ones.
    """
    reader = (spark.read.schema(schema)
              .option("header", "true")
              .option("enforceSchema", "false")
              .option("mode", "FAILFAST")
              .option("quote", '"')
              .option("escape", '"')
              .option("nullValue", "")
              .option("dateFormat", "yyyy-MM-dd"))
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.csv(path)


def read_accounts(spark: SparkSession, path: str) -> DataFrame:
    """S2."""
    return read_csv(spark, path, schemas.ACCOUNTS)


def read_products(spark: SparkSession, path: str) -> DataFrame:
    """S3."""
    return read_csv(spark, path, schemas.PRODUCTS)


def read_pipeline(spark: SparkSession, path: str) -> DataFrame:
    """Dates parse straight into DATE columns (day grain, no time zone)."""
    return read_csv(spark, path, schemas.SALES_PIPELINE)


def read_sales_teams(spark: SparkSession, path: str) -> DataFrame:
    """S5."""
    return read_csv(spark, path, schemas.SALES_TEAMS)


def read_data_dictionary(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, DATA_DICTIONARY)


def model_from_csv(spark: SparkSession, directory: str, validate_keys: bool = True, **params):
    """The star model from ``accounts.csv``, ``products.csv``, ``sales_pipeline.csv``
    and ``sales_teams.csv`` in ``directory``.

    ``validate_keys`` checks that every dimension key is unique and
    non-NULL (one aggregate per dimension), which the metrics assume.
    """
    from ..plans.model import CrmModel
    from .catalog import require_valid_keys

    base = directory.rstrip("/")
    model = CrmModel.from_frames(
        read_pipeline(spark, f"{base}/sales_pipeline.csv"),
        read_accounts(spark, f"{base}/accounts.csv"),
        read_products(spark, f"{base}/products.csv"),
        read_sales_teams(spark, f"{base}/sales_teams.csv"),
        **params)
    return require_valid_keys(model) if validate_keys else model
