import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

FIXTURES = os.path.join(ROOT, "tests", "fixtures")
TESTDATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from salesgrid.session import build_session
    s = build_session("local[4]", 4, app_name="salesgrid-tests",
                      extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="sg-test-ckpt-"),
                             "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="sg-test-wh-")})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def fixture_model(spark):
    from salesgrid.sources.csv_files import model_from_csv
    return model_from_csv(spark, FIXTURES, as_of="2018-04-15", home="United States",
                          reference_year=2017)


def rows_by(df, key):
    return {r[key]: r.asDict() for r in df.collect()}
