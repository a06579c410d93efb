"""Explicit schemas of the CRM star schema (no inference anywhere)."""

from pyspark.sql import types as T

ACCOUNTS = T.StructType([
    T.StructField("account", T.StringType(), False, {"comment": "Company name"}),
    T.StructField("sector", T.StringType(), True, {"comment": "Industry"}),
    T.StructField("year_established", T.IntegerType(), True, {"comment": "Year Established"}),
    T.StructField("revenue", T.DoubleType(), True, {"comment": "Annual revenue (in millions of USD)"}),
    T.StructField("employees", T.IntegerType(), True, {"comment": "Number of employees"}),
    T.StructField("office_location", T.StringType(), True, {"comment": "Headquarters"}),
    T.StructField("subsidiary_of", T.StringType(), True, {"comment": "Parent company"}),
])

PRODUCTS = T.StructType([
    T.StructField("product", T.StringType(), False, {"comment": "Product name"}),
    T.StructField("series", T.StringType(), True, {"comment": "Product series"}),
    T.StructField("sales_price", T.IntegerType(), True, {"comment": "Suggested retail price"}),
])

SALES_TEAMS = T.StructType([
    T.StructField("sales_agent", T.StringType(), False, {"comment": "Sales agent"}),
    T.StructField("manager", T.StringType(), True, {"comment": "Respective sales manager"}),
    T.StructField("regional_office", T.StringType(), True, {"comment": "Regional office"}),
])

CLOSE_VALUE = T.DecimalType(15, 2)

SALES_PIPELINE = T.StructType([
    T.StructField("opportunity_id", T.StringType(), False, {"comment": "Unique identifier"}),
    T.StructField("sales_agent", T.StringType(), True, {"comment": "Sales agent"}),
    T.StructField("product", T.StringType(), True, {"comment": "Product name"}),
    T.StructField("account", T.StringType(), True, {"comment": "Company name"}),
    T.StructField("deal_stage", T.StringType(), True,
                  {"comment": "Sales pipeline stage (Prospecting > Engaging > Won / Lost)"}),
    T.StructField("engage_date", T.DateType(), True,
                  {"comment": "Date in which the Engaging deal stage was initiated"}),
    T.StructField("close_date", T.DateType(), True,
                  {"comment": "Date in which the deal was Won or Lost"}),
    T.StructField("close_value", CLOSE_VALUE, True, {"comment": "Revenue from the deal"}),
])

PIPELINE_COLUMNS = tuple(f.name for f in SALES_PIPELINE.fields)

# Columns the joined view adds, per dimension (the dimension key is not repeated).
VIEW_DIMENSION_COLUMNS = {
    "sales_teams": ("manager", "regional_office"),
    "products": ("series", "sales_price"),
    "accounts": ("sector", "year_established", "revenue", "employees",
                 "office_location", "subsidiary_of"),
}

DIMENSION_KEYS = {"accounts": "account", "products": "product", "sales_teams": "sales_agent"}

STAGES = ("Prospecting", "Engaging", "Won", "Lost")
