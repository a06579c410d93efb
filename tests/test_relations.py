"""Planted orphans and broken rows are all found; the rest is loaded."""

from decimal import Decimal

from salesgrid import schemas
from salesgrid.plans.model import CrmModel
from salesgrid.sources import relations


def test_orphans(spark):
    deals = spark.createDataFrame([("1", "acme", "p1", "ann"), ("2", "gone", "p1", "ann"), ("3", "gone", "p9", None), ("4", None, "p1", "zed")],
                                  "opportunity_id string, account string, product string, sales_agent string")
    dim = lambda key, names: spark.createDataFrame([(n,) for n in names], f"{key} string")
    model = CrmModel.from_frames(deals, dim("account", ["acme", "other"]), dim("product", ["p1"]), dim("sales_agent", ["ann", "bob"]))
    assert {tuple(r) for r in relations.orphans(model).collect()} == {
        ("pipeline_account", "gone", 2), ("pipeline_account", None, 1), ("pipeline_product", "p9", 1),
        ("pipeline_sales_agent", "zed", 1), ("pipeline_sales_agent", None, 1)}
    whole = CrmModel.from_frames(deals.limit(1), model.accounts(), model.products(), model.sales_teams())
    assert relations.orphans(whole).collect() == []


HEADER = "opportunity_id,sales_agent,product,account,deal_stage,engage_date,close_date,close_value"


def test_quarantine(spark, tmp_path):
    good = ["a,Ann,P,Acme,Won,2017-01-01,2017-02-01,10.5", 'b,Ann,"P, the ""big"" one",Acme,Lost,2017-01-01,2017-02-01,0',
            "c,Ann,P,,Engaging,2017-01-01,,", "d,Ann,P,Acme,Prospecting,,,"]
    bad = {"e,Ann,P,Acme,Won,2017-01-01,2017-02-31,10": "not readable as the declared columns",
           "f,Ann,P,Acme,Won,2017-01-01,2017-02-01,ten": "not readable as the declared columns",
           "g,Ann,P": "not readable as the declared columns",
           "h,Ann,P,Acme,Won,2017-01-01,2017-02-01,10,extra": "not readable as the declared columns",
           ",Ann,P,Acme,Won,2017-01-01,2017-02-01,10": "no opportunity id", "i,Ann,P,Acme,Sold,2017-01-01,2017-02-01,10": "unknown stage",
           "j,Ann,P,Acme,,2017-01-01,2017-02-01,10": "unknown stage", "k,Ann,P,Acme,Won,2017-01-01,,10": "closed deal without close date",
           "l,Ann,P,Acme,Engaging,2017-01-01,2017-02-01,": "open deal with close date",
           "m,Ann,P,Acme,Won,2017-03-01,2017-02-01,10": "closed before engaged", "n,Ann,P,Acme,Won,2017-01-01,2017-02-01,-1": "negative value"}
    folder = tmp_path / "csv"
    folder.mkdir()
    lines = [*good, *bad]
    (folder / "one.csv").write_text("\r\n".join([HEADER, *lines[::2]]) + "\r\n", newline="")
    (folder / "two.csv").write_text("\r\n".join([HEADER, *lines[1::2]]) + "\r\n", newline="")
    rows, quarantine = relations.read_checked(spark, str(folder), schemas.SALES_PIPELINE, relations.PIPELINE_RULES)
    assert sorted(r.opportunity_id for r in rows.collect()) == ["a", "b", "c", "d"]
    assert rows.filter("opportunity_id = 'b'").first().product == 'P, the "big" one'
    assert rows.filter("opportunity_id = 'a'").first().close_value == Decimal("10.50")
    found = quarantine.collect()
    assert sorted(r.reason for r in found) == sorted(bad.values())
    unread = {r.row for r in found if r.reason.startswith("not readable")}
    assert unread == {x for x, why in bad.items() if why.startswith("not readable")}
    assert {r.file.rsplit("/", 1)[1] for r in found} == {"one.csv", "two.csv"}


def test_dimension_without_key_and_empty_file(spark, tmp_path):
    (tmp_path / "p.csv").write_text("product,series,sales_price\nA,S,5\n,S,6\n")
    rows, quarantine = relations.read_checked(spark, str(tmp_path / "p.csv"), schemas.PRODUCTS, relations.key_rule("product"))
    assert [r.product for r in rows.collect()] == ["A"] and [r.reason for r in quarantine.collect()] == ["no product"]
    (tmp_path / "q.csv").write_text("product,series,sales_price\n")
    rows, quarantine = relations.read_checked(spark, str(tmp_path / "q.csv"), schemas.PRODUCTS, relations.key_rule("product"))
    assert rows.collect() == [] and quarantine.collect() == []
