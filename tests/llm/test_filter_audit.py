import random
from itertools import permutations

import numpy as np
import pytest

import __spark_entry__ as E
from salesgrid.llm import filter_audit as fa
from tests.compare import compare, duck

from .helpers import docs, words

SF = "/root/testdata/sf0.001"
LABELS = "doc_id long, quality int, toxic int"


def _plain(table, labels):
    """The report by evaluating every order on every document."""
    good = {r.doc_id for r in labels if r.quality == 1 and r.doc_id is not None}
    toxic = {r.doc_id for r in labels if r.toxic == 1 and r.doc_id is not None}
    first = {}
    for r in table:
        if r.doc_id is not None:
            first[r.text or ""] = min(first.get(r.text or "", r.doc_id), r.doc_id)
    parts = {}
    for r in table:
        t, w = r.text or "", words(r.text)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
                 "D": any(c in "#$%&*|" for c in t), "E": r.doc_id is not None and r.doc_id > first[t]}
        parts.setdefault(r.lang or "", []).append(({f for f in fails if fails[f]}, r.doc_id in good, r.doc_id in toxic))
    out = {}
    for part, rows in parts.items():
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                shapley[f] += len(gone)
                out[part, "".join(order), step + 1] = [len(left), len(gone), sum(f in x[0] for x in rows) - len(gone),
                                                       sum(x[0] == {f} for x in rows), sum(x[1] for x in gone), sum(x[2] for x in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


def _check(rows, table, labels):
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley]
           for r in rows}
    assert len(got) == len(rows) and got == _plain(table, labels)


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_sql(spark, sf):
    con = duck(sf)
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    name = "op12_filter_audit"
    assert compare(spark, con, sf, name, E.queries()[name], E.oracle_sql()[name]) is None


def test_generated_documents(spark):
    rng = random.Random(3)
    pool = [" ".join(rng.choices(["a", "Bb", "c#", "dd", "EE", "é", "w" + str(k)], k=rng.choice([0, 3, 150, 260]))) for k in range(40)]
    pool += [" ".join(f"w{i}" for i in range(300)), "", "  \n", None, "X" * 50_000, "# " * 40_000]
    rows = [(rng.choice([None, *range(300)]), rng.choice(pool), rng.choice(["en", "de", "", None])) for _ in range(500)]
    rows += [(7, "same text"), (7, "same text"), (7, "same text"), (6, "same text", "de")]
    table = docs(spark, rows, "row,digest,good,part,ids")
    labels = spark.createDataFrame([(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 300, 2)]
                                   + [(4, 1, 1), (4, 0, 0), (None, 1, 1)], LABELS)
    _check(fa.audit(table, labels).collect(), table.collect(), labels.collect())
    assert fa.audit(table.limit(0), labels).collect() == []
    assert len(fa.audit(table, labels.limit(0)).collect()) == 3 * 600
    clean = docs(spark, [(1, " ".join(f"w{i}" for i in range(300)), "fr")])
    assert [(r.kept, r.removed, r.shapley) for r in fa.audit(clean, labels).collect()] == [(1, 0, 0)] * 600


def test_a_part_in_many_ranges(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(i, ("# " if i % 3 else "") + "w " * (i % 5) * 60, "en" if i % 10 else "xx") for i in range(400)]
        table = docs(spark, rows)
        measured = fa.measure(table, spark.createDataFrame([(8, 1, 0)], LABELS))
        lists = fa.postings(measured).collect()
        assert max(r.n for r in lists) <= 7 and sum(r.n for r in lists) == 400
        d = {r.ids[k] for r in lists for k in r["D"]}
        assert d == {i for i, t, _ in rows if "#" in t}
        _check(fa.audit(table, spark.createDataFrame([(8, 1, 0)], LABELS)).collect(), table.collect(),
               spark.createDataFrame([(8, 1, 0)], LABELS).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_galloping_merges():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a, b = (np.unique(rng.integers(0, rng.choice([5, 100, 100_000]), rng.integers(0, 900))) for _ in range(2))
        assert fa.places(a, b).tolist() == np.searchsorted(b, a).tolist()
        assert fa.common(a, b) == len(np.intersect1d(a, b)) and fa.union(a, b).tolist() == np.union1d(a, b).tolist()


def test_three_filters_of_ones_own(spark):
    flags = spark.createDataFrame([("p", i, i, bool(i & 1), bool(i & 2), bool(i & 4), i == 7) for i in range(8)],
                                  "part string, doc_id int, row long, x boolean, y boolean, z boolean, gold boolean")
    rows = fa.report(fa.sizes(fa.postings(flags, "xyz", ["gold"]), "xyz", ["gold"]), "xyz", ["gold"]).collect()
    assert len(rows) == 18
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.gold_lost, r.shapley) for r in rows}
    assert got["zyx", 1] == (4, 4, 0, 1, 1, 14) and got["zyx", 3] == (1, 1, 3, 1, 0, 14)
