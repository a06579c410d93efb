import re
from collections import Counter

import corpus_pipeline
from salesgrid.llm import packing, quality, queries, scratch, secrets

from .helpers import components, docs, words
from .test_jaccard_join import shingles
from .test_mixing import _targets

SF = "/root/testdata/sf0.001"


def _stages(spark, table):
    out = [table]
    for name, stage in corpus_pipeline.STAGES:
        out.append(scratch.write(stage(spark, out[-1], SF), f"test-{name}")[0])
    return out


def test_each_stage_against_a_plain_version(spark):
    first = spark.read.parquet(f"{SF}/documents.parquet")
    given, rules, unique, clean, mixed, packed = _stages(spark, first)
    for frame in (rules, unique, clean, mixed):
        assert frame.columns == first.columns and dict(frame.dtypes) == dict(first.dtypes)
    verdict = {r.doc_id: r.kept for r in queries.op8_quality(spark, SF).collect()}
    assert {r.doc_id for r in rules.collect()} == {i for i, kept in verdict.items() if kept}

    rows = rules.collect()
    sets = {r.doc_id: shingles(r.text) for r in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = components(sets, links)
    assert sorted(r.doc_id for r in unique.collect()) == sorted(i for i in sets if root[i] == i or not sets[i])

    before = {r.doc_id: r for r in unique.collect()}
    live = {r.doc_id: r.live for r in secrets.find_secrets(unique).collect()}
    for r in clean.collect():
        text = before[r.doc_id].text
        for s in sorted(live[r.doc_id], key=lambda s: -s.start):
            if not any(o.start <= s.start < o.end and o != s and (o.start, o.kind) < (s.start, s.kind)
                       for o in live[r.doc_id]):
                text = text[:s.start] + "[SECRET]" + text[max(o.end for o in live[r.doc_id]
                                                              if o.start < s.end and o.end > s.start):]
        assert r.text == text and r.n_chars == len(text)
    assert clean.count() == len(before)

    source = {r.doc_id: r.source for r in clean.collect()}
    size, taken = Counter(), Counter()
    for r in clean.collect():
        size[r.source] += len(words(r.text))
    for r in mixed.collect():
        taken[source[r.doc_id]] += len(words(r.text))
    want = _targets(dict(size))
    assert all(taken[s] == int(want[s] + 1e-9) for s in size)

    total = Counter()
    for r in packed.collect():
        total[r.doc_id] += r.length
        assert r.length == 0 or r.capacity in packing.CAPACITIES
    words_of = Counter()
    for r in mixed.collect():
        words_of[r.doc_id] += len(words(r.text))
    assert total == words_of


def test_run_is_the_stages_in_order(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "secret_scan", "source_mix",
                                                      "packing"]
    rows = corpus_pipeline.run(spark, SF).collect()
    last = _stages(spark, spark.read.parquet(f"{SF}/documents.parquet"))[-1].collect()
    key = lambda r: (r.doc_id, r.piece, r.length)
    assert sorted(map(key, rows)) == sorted(map(key, last))


def test_stages_with_odd_rows_and_empty_tables(spark):
    long = " ".join(f"w{i % 97}{i % 89}" for i in range(3000))
    rows = [(None, None, None, None), (1, ""), (2, long), (2, long), (3, long, None, None), (None, long + " x")]
    for table in (docs(spark, rows, "class,row,size,live"), docs(spark, [])):
        for (_, stage), frame in zip(corpus_pipeline.STAGES, _stages(spark, table)):
            assert stage(spark, frame, SF).count() >= 0
        for name, stage in corpus_pipeline.STAGES:
            assert stage(spark, table, SF).count() >= 0, name
    assert not re.search("except", open(corpus_pipeline.__file__).read()) and quality.MIN_WORDS == 50
