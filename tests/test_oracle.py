"""Every operator with a SQL formulation equals its DuckDB oracle (sf0.001)."""

import os

import pytest

import __spark_entry__ as E
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data missing")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(E.oracle.oracle_sql()))
def test_matches_oracle(spark, con, name):
    err = compare(spark, con, SF, name, E.queries()[name], E.oracle_sql()[name])
    assert err is None, err


def test_every_sql_key_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def crm_queries():
    """The queries of the library itself, without the optional ones."""
    optional = set(E.llm_queries.queries()) | {"pipeline"} if E.llm_queries else set()
    return {k: v for k, v in E.queries().items() if k not in optional}


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns[0] == "company_sold_to"


@pytest.mark.parametrize("name", ["crm_view", "customer_lifetime_value", "touchpoints",
                                  "agent_performance", "customer_360", "industry_performance"])
def test_without_broadcasts_matches_oracle(spark, con, name):
    # plan every join as a shuffle join, as the planner does for large dimensions
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        err = compare(spark, con, SF, name, E.queries()[name], E.oracle_sql()[name])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert err is None, err


def with_table(tmp_path, name, df):
    """A new folder with the contents of the tables' files, and ``df`` in the place of one table."""
    import shutil
    sf = tmp_path / "sf"
    sf.mkdir()
    for file in os.listdir(SF):
        if file != f"{name}.parquet":
            shutil.copyfile(os.path.join(SF, file), sf / file)
    df.coalesce(1).write.parquet(str(sf / f"{name}.parquet"))
    return str(sf)


def test_orders_of_unknown_customers_match_oracle(spark, tmp_path):
    """Accounts are aggregated by key and named afterwards: keys without a name are the NULL account."""
    sf = with_table(tmp_path, "customer", spark.read.parquet(f"{SF}/customer.parquet").filter("c_custkey % 3 <> 0"))
    for name in ("churn_status", "customer_360", "touchpoints", "product_performance", "cross_sell", "rfm_segments",
                 "industry_performance", "cohort_retention", "predicted_clv", "account_features"):
        err = compare(spark, duck(sf), sf, name, E.queries()[name], E.oracle_sql()[name])
        assert err is None, (name, err)


def test_oracle_shares_nothing_with_the_library():
    import crm_oracle
    assert "salesgrid" not in open(crm_oracle.__file__).read()


def test_new_input_files_give_new_answers(spark, tmp_path):
    """Nothing is kept by path: a query after the files changed sees the change."""
    items = spark.read.parquet(f"{SF}/lineitem.parquet")
    sf = with_table(tmp_path, "lineitem", items)
    before = E.queries()["account_features"](spark, sf).agg({"total_deals": "sum"}).first()[0]
    items.limit(500).coalesce(1).write.mode("overwrite").parquet(f"{sf}/lineitem.parquet")
    spark.catalog.refreshByPath(sf)
    after = E.queries()["account_features"](spark, sf).agg({"total_deals": "sum"}).first()[0]
    assert before > 500 >= after > 0
