import zlib

import pyarrow as pa

from salesgrid.llm import queries, textops, toxicity

from .helpers import docs

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy_on_the_whole_table(spark):
    rows = {r.doc_id: r for r in queries.op3_toxicity(spark, SF).collect()}
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(rows) == documents.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows.values())
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    held = [(rows[x.doc_id], x.toxic) for x in labels if rows[x.doc_id].held_out]
    toxic = [r.predicted for r, y in held if y]
    clean = [r.predicted for r, y in held if not y]
    assert sum(toxic) / len(toxic) > 0.85 and sum(clean) / len(clean) < 0.01


def test_normal_form_and_terms():
    assert toxicity.normal_form('"1d!0t!,') == "idiot"
    assert toxicity.normal_form("i.d.i-o_t") == "idiot"
    assert toxicity.terms("moron") == ["moron", "moro-"] and toxicity.terms("") == []


def test_features_count_by_hand():
    lookup = toxicity._Lookup({"idiot": 2, "meanie": 1})
    w = textops.words(pa.array(["You IDIOT, meanie!", "", None, "a id10t b " + "c " * 20 + "you"]))
    x = dict(zip(toxicity.FEATURES, toxicity.features(w, lookup).T))
    assert x["strong_density"].tolist()[0] == 1 / 3 and x["weak_density"][0] == 1 / 3
    assert x["hidden_hits"].tolist() == [0, 0, 0, 1 / 24]
    assert x["near_hits"].tolist() == [1, 0, 0, 0] and x["second_person"][0] == 1 / 3
    assert x["capital_words"][0] == 1 / 3 and x["exclamations"][0] == 1 / 18
    assert x["obfuscated"].tolist() == [0, 0, 0, 1 / 24]


def test_edges(spark):
    table = docs(spark, [(None, None), (1, ""), (2, "x " * 50_000), (2, "x"), (3, "a b")], "score,features,label")
    labels = spark.createDataFrame([(2, 1), (2, None), (None, 1), (3, 0)], "doc_id long, toxic int")
    rows = toxicity.score(table, toxicity.fit(table, labels)).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert [r.held_out for r in rows if r.doc_id is None] == [True]
    none = toxicity.fit(table, labels.limit(0))
    assert {r.score for r in toxicity.score(table, none).collect()} == {0.0}
    assert toxicity.score(table.limit(0), none).collect() == []
