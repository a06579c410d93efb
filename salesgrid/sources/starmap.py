"""Map the driver's TPC-H-like tables onto the CRM star schema.

Grain of the fact table: one ``lineitem`` row is one opportunity.

    opportunity_id  concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)
    sales_agent     s_name of l_suppkey
    product         'Part#' || l_partkey
    deal_stage      l_returnflag N -> Won, R -> Lost, A + linestatus F -> Engaging,
                    A + linestatus O -> Prospecting
    account         c_name of the order's customer; NULL for Prospecting line 1
    engage_date     least(o_orderdate, l_shipdate) as DATE; NULL for Prospecting
    close_date      greatest(o_orderdate, l_shipdate) as DATE for Won/Lost
    close_value     l_extendedprice as DECIMAL(15,2) for Won, 0 for Lost, else NULL

Interactions, where ``events`` is loaded: one event is one contact with the account
whose customer key is its user id (users without a customer have no account); its
channel is the event type, and its time the event's distance from 2024-01-01
stretched by 84 and counted from 1995-01-01, so that a month of events covers
the years in which deals close.

Dimensions: accounts from customer + nation, products from part, sales teams
from supplier + nation + region.

The fact table is built per request with only the joins the requested columns
need: dimension keys are unique, so a left join whose columns are unused can
be dropped. Catalyst cannot do that on its own (it has no key constraints).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import CLOSE_VALUE, PIPELINE_COLUMNS, VIEW_DIMENSION_COLUMNS

_NEEDS_ORDERS = {"account", "engage_date", "close_date"}


def _stage(rf: Column, ls: Column) -> Column:
    # Nested rather than one CASE: a comparison with a stage then folds to the
    # flags it stands for, which are pushed down to the scan.
    open_stage = F.when(ls == "F", F.lit("Engaging")).when(ls == "O", F.lit("Prospecting"))
    return F.when(rf.eqNullSafe("N"), F.lit("Won")).otherwise(
        F.when(rf.eqNullSafe("R"), F.lit("Lost")).otherwise(F.when(rf == "A", open_stage)))


def _accounts_keyed(tables, attrs=VIEW_DIMENSION_COLUMNS["accounts"]) -> DataFrame:
    """c_custkey, account and the requested account attributes."""
    df = tables["customer"]
    if "office_location" in attrs:
        # nation/region are tiny scans: the planner broadcasts them from their
        # size statistics; no hint, so a large one would not be.
        nation = tables["nation"].select("n_nationkey", "n_name")
        df = df.join(nation, df["c_nationkey"] == nation["n_nationkey"], "left")
    exprs = {
        "sector": lambda: F.col("c_mktsegment"),
        "year_established": lambda: (F.lit(1980) + F.col("c_custkey") % 38).cast("int"),
        "revenue": lambda: F.col("c_acctbal") + F.lit(1000.0),
        "employees": lambda: (F.lit(1) + (F.col("c_custkey") * 37) % 20000).cast("int"),
        "office_location": lambda: F.col("n_name"),
        "subsidiary_of": lambda: F.lit(None).cast("string"),
    }
    return df.select("c_custkey", F.col("c_name").alias("account"),
                     *[exprs[a]().alias(a) for a in attrs])


def _products_keyed(tables) -> DataFrame:
    return tables["part"].select(
        "p_partkey",
        F.concat(F.lit("Part#"), F.col("p_partkey").cast("string")).alias("product"),
        F.col("p_brand").alias("series"),
        F.col("p_retailprice").alias("sales_price"),
    )


def _teams_keyed(tables) -> DataFrame:
    supp = tables["supplier"]
    nation = tables["nation"].select("n_nationkey", "n_name", "n_regionkey")
    region = tables["region"].select("r_regionkey", "r_name")
    df = (supp.join(nation, supp["s_nationkey"] == nation["n_nationkey"], "left")
          .join(region, F.col("n_regionkey") == region["r_regionkey"], "left"))
    return df.select(
        "s_suppkey",
        F.col("s_name").alias("sales_agent"),
        F.col("n_name").alias("manager"),
        F.col("r_name").alias("regional_office"),
    )


def accounts_from_tpch(tables) -> DataFrame:
    return _accounts_keyed(tables).drop("c_custkey")


def products_from_tpch(tables) -> DataFrame:
    return _products_keyed(tables).drop("p_partkey")


def sales_teams_from_tpch(tables) -> DataFrame:
    return _teams_keyed(tables).drop("s_suppkey")


# Surrogate key of the agent on the fact side: the supplier key. Metrics that
# group by agent aggregate by it and attach names to the aggregated rows only.
AGENT_KEY = "_agent_key"
# Likewise of the account: the order's customer key (NULL where there is no account).
ACCOUNT_KEY = "_account_key"

_ACCOUNT_ATTRS = VIEW_DIMENSION_COLUMNS["accounts"]
_TEAM_ATTRS = VIEW_DIMENSION_COLUMNS["sales_teams"]
_PRODUCT_ATTRS = VIEW_DIMENSION_COLUMNS["products"]


def star_from_tpch(tables, columns: Iterable[str]) -> DataFrame:
    """Fact columns plus any view (dimension) columns, joined on integer keys.

    ``orders`` is joined with the accounts first and the fact table with that
    result, so the fact table is shuffled once for the account (by order key)
    rather than once per join; agent and product attributes come through the
    supplier and part keys. Stages, days and values are derived below the joins:
    the shuffles move them instead of the wider columns they come from. A
    dimension is joined only if a requested column needs it (its key is unique, so an unused left join changes nothing). Which
    sides are broadcast is left to the planner and AQE, which go by bytes.
    """
    cols = tuple(columns)
    allowed = (set(PIPELINE_COLUMNS) | set(_ACCOUNT_ATTRS) | set(_TEAM_ATTRS)
               | set(_PRODUCT_ATTRS) | {AGENT_KEY, ACCOUNT_KEY})
    unknown = set(cols) - allowed
    if unknown:
        raise ValueError(f"unknown columns: {sorted(unknown)}")
    wanted = set(cols)
    acc_attrs = [c for c in _ACCOUNT_ATTRS if c in wanted]
    team_attrs = [c for c in _TEAM_ATTRS if c in wanted]
    prod_attrs = [c for c in _PRODUCT_ATTRS if c in wanted]
    need_account = "account" in wanted or bool(acc_attrs)
    need_key = need_account or ACCOUNT_KEY in wanted
    need_orders = need_key or bool(wanted & {"engage_date", "close_date"})
    need_team = "sales_agent" in wanted or bool(team_attrs)

    li_cols = []
    if "opportunity_id" in wanted:
        li_cols += ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    if "product" in wanted or prod_attrs:
        li_cols += ["l_partkey"]
    if need_team or AGENT_KEY in wanted:
        li_cols += ["l_suppkey"]
    if need_key:
        li_cols += ["l_linenumber"]
    if need_orders:
        li_cols += ["l_orderkey"]
    stage = _stage(F.col("l_returnflag"), F.col("l_linestatus"))
    derived = [stage.alias("_stage")]
    if wanted & {"engage_date", "close_date"}:
        derived.append(F.col("l_shipdate").cast("date").alias("_shipped"))
    if "close_value" in wanted:
        derived.append(F.when(stage == F.lit("Won"), F.col("l_extendedprice").cast(CLOSE_VALUE))
                       .when(stage == F.lit("Lost"), F.lit(0).cast(CLOSE_VALUE)).alias("_value"))
    df = tables["lineitem"].select(*dict.fromkeys(li_cols), *derived)

    if need_orders:
        o_cols = ["o_orderkey"]
        if need_key:
            o_cols.append("o_custkey")
        if wanted & {"engage_date", "close_date"}:
            o_cols.append(F.col("o_orderdate").cast("date").alias("_ordered"))
        orders = tables["orders"].select(*o_cols)
        if need_account:
            acc = _accounts_keyed(tables, acc_attrs).select(
                "c_custkey", F.col("account").alias("_acct"),
                *[F.col(c).alias(f"_a_{c}") for c in acc_attrs])
            # name the orders first, so the fact table is shuffled once
            orders = orders.join(acc, orders["o_custkey"] == acc["c_custkey"], "left")
            df = df.join(orders, df["l_orderkey"] == orders["o_orderkey"], "left")
        else:
            df = df.join(orders, df["l_orderkey"] == orders["o_orderkey"], "left")
    if need_team:
        teams = _teams_keyed(tables).select("s_suppkey", *(["sales_agent"] + team_attrs))
        df = df.join(teams, df["l_suppkey"] == teams["s_suppkey"], "left")
    if prod_attrs:
        prods = _products_keyed(tables).select("p_partkey", *prod_attrs)
        df = df.join(prods, df["l_partkey"] == prods["p_partkey"], "left")

    stage = F.col("_stage")
    prospecting = stage == F.lit("Prospecting")
    closed = stage.isin("Won", "Lost")
    # the fact row has no account (and so no account attributes) for Prospecting line 1
    no_account = prospecting & (F.col("l_linenumber") == 1)
    exprs = {
        "opportunity_id": lambda: F.concat_ws(
            "-", *[F.col(c).cast("string") for c in
                   ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]),
        "sales_agent": lambda: F.col("sales_agent"),
        "product": lambda: F.concat(F.lit("Part#"), F.col("l_partkey").cast("string")),
        "account": lambda: F.when(no_account, F.lit(None).cast("string")).otherwise(F.col("_acct")),
        "deal_stage": lambda: stage,
        "engage_date": lambda: F.when(prospecting, F.lit(None).cast("date")).otherwise(
            F.least("_ordered", "_shipped")),
        "close_date": lambda: F.when(closed, F.greatest("_ordered", "_shipped")),
        "close_value": lambda: F.col("_value"),
    }
    exprs[AGENT_KEY] = lambda: F.col("l_suppkey")
    exprs[ACCOUNT_KEY] = lambda: F.when(no_account, F.lit(None)).otherwise(F.col("o_custkey"))
    for c in acc_attrs:
        exprs[c] = (lambda c=c: F.when(no_account, F.lit(None)).otherwise(F.col(f"_a_{c}")))
    for c in team_attrs + prod_attrs:
        exprs[c] = (lambda c=c: F.col(c))
    return df.select(*[exprs[c]().alias(c) for c in cols])


def pipeline_from_tpch(tables, columns: Iterable[str] | None = None) -> DataFrame:
    """The ``sales_pipeline`` fact table, restricted to ``columns``."""
    cols = tuple(columns) if columns else PIPELINE_COLUMNS
    unknown = set(cols) - set(PIPELINE_COLUMNS)
    if unknown:
        raise ValueError(f"unknown pipeline columns: {sorted(unknown)}")
    return star_from_tpch(tables, cols)


def accounts_by_key(tables) -> DataFrame:
    """``_account_key`` (customer key) with the account's name."""
    return tables["customer"].select(F.col("c_custkey").alias(ACCOUNT_KEY), F.col("c_name").alias("account"))


def agents_by_key(tables) -> DataFrame:
    """``_agent_key`` (supplier key) with the agent's name, manager and office."""
    return _teams_keyed(tables).withColumnRenamed("s_suppkey", AGENT_KEY)


def interactions_from_tpch(tables) -> DataFrame:
    """account, contact_id, contact_time (whole seconds), channel, value."""
    since = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts) * 84 DIV 1000000")
    names = tables["customer"].select("c_custkey", F.col("c_name").alias("account"))
    contacts = tables["events"].withColumn("_s", since).select(
        "user_id", F.col("event_id").alias("contact_id"),
        F.expr("TIMESTAMP_NTZ'1995-01-01 00:00:00' + make_dt_interval(0, 0, 0, CAST(_s AS DECIMAL(18, 6)))").alias("contact_time"),
        F.col("event_type").alias("channel"), "value")
    return contacts.join(names, contacts["user_id"] == names["c_custkey"], "left") \
        .select("account", "contact_id", "contact_time", "channel", "value")


def accounts_with_parents(tables) -> DataFrame:
    """The accounts with parents made from the customer key k (the star map itself has none).

    k % 50 = 7 and the key after it name each other; k % 97 = 3 names a company that is no account;
    otherwise k % 5 < 2 makes k // 3 the parent, for k > 0; all others have none.
    """
    k = F.col("c_custkey")
    up = F.when(k % 50 == 7, k + 1).when(k % 50 == 8, k - 1).when((k % 97 != 3) & (k % 5 < 2) & (k > 0), F.floor(k / 3))
    names = tables["customer"].select(F.col("c_custkey").alias("_up"), F.col("c_name").alias("_parent"))
    keyed = _accounts_keyed(tables).drop("subsidiary_of").withColumnRenamed("c_custkey", "_key")
    pairs = tables["customer"].select(F.col("c_custkey").alias("_key"), up.cast("bigint").alias("_up"),
                                      ((k % 97 == 3) & ~(k % 50).isin(7, 8)).alias("_unlisted")).join(names, "_up", "left")
    parent = F.when(F.col("_unlisted"), F.concat(F.lit("Unlisted#"), F.col("_key").cast("string"))).otherwise(F.col("_parent"))
    return keyed.join(pairs, "_key").withColumn("subsidiary_of", parent).drop("_key", "_up", "_unlisted", "_parent")
