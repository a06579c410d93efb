from collections import Counter

from salesgrid.llm import mixing, queries

from .helpers import docs, words

SF = "/root/testdata/sf0.01"


def _targets(sizes, weights=(1, 2, 3), ceiling=3):
    """Water filling, one source at a time."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, target, free = sum(sizes.values()), {}, set(names)
    while True:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if share[s] > ceiling * sizes[s]]
        if not above:
            return target | share
        for s in above:
            target[s] = ceiling * sizes[s]
            free.discard(s)


def _check(table, rows):
    sizes = Counter()
    for d in table:
        sizes[d.source] += len(words(d.text))
    want, source = _targets(dict(sizes)), {d.doc_id: d.source for d in table}
    taken = Counter()
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        assert 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    assert all(taken[s] == int(want[s] + 1e-9) for s in sizes)


def test_whole_table(spark):
    rows = queries.op6_mixing(spark, SF).collect()
    _check(spark.read.parquet(f"{SF}/documents.parquet").collect(), rows)
    again = {r.doc_id: r.taken for r in queries.op6_mixing(spark, SF).collect()}
    assert again == {r.doc_id: r.taken for r in rows}


def test_layout_does_not_matter(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    one = {r.doc_id: r.taken for r in mixing.mix(table.repartition(7, "source"), keep=["doc_id"]).collect()}
    assert one == {r.doc_id: r.taken for r in queries.op6_mixing(spark, SF).collect()}


def test_edges(spark):
    rows = [(1, "a " * 1000, "en", "b"), (2, "x\x0by z", "en", None), (3, None, "en", "c"), (4, "", "en", "a"),
            (5, "q " * 7, "en", "Z"), (6, " \t\n", "en", "é"), (7, "\xa0", "en", "é")]
    table = docs(spark, rows, "taken,row,bin")
    found = mixing.mix(table)
    _check(table.collect(), found.collect())
    assert [c for c in found.columns if c not in mixing.RESULT] == [*table.columns[:5], "row", "bin"]
    assert mixing.mix(table.limit(0)).collect() == []
    repeated = docs(spark, [(1, "a b c", "en", "s")] * 5 + [(None, "d e", None, None)])
    assert sorted((r.size, r.taken) for r in mixing.mix(repeated).collect())[0][0] == 2


def test_texts_of_the_mix(spark):
    table = docs(spark, [(1, "a b  c d", "en", "s1"), (2, "e f g h", "en", "s2"), (3, "i j k l", "en", "s3")], "size")
    mixed = {r.doc_id: r for r in mixing.mix(table).collect()}
    out = mixing.repeated(mixing.mix(table))
    assert out.columns == table.columns[:5]
    texts = Counter()
    for r in out.collect():
        texts[r.doc_id] += len(words(r.text))
        assert r.n_chars == len(r.text)
    assert dict(texts) == {i: r.taken for i, r in mixed.items() if r.taken}


def test_native_plan(spark):
    plan = queries.op6_mixing(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
