import random
import re

import pytest

from salesgrid.llm import jaccard_join

from .helpers import components, docs, prose, words


def shingles(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[j:j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def _brute(rows):
    sets = [shingles(t) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a)
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root, low = components(range(len(rows)), links), {}
    for i, r in root.items():
        if rows[i][0] is not None:
            low[r] = min(low.get(r, rows[i][0]), rows[i][0])
    return [(rows[i][0], len(sets[i]), low.get(root[i]) if sets[i] else rows[i][0]) for i in range(len(rows))]


def _found(frame):
    return [(r.doc_id, r.n_shingles, r.component_id) for r in frame.collect()]


def _table(seed, n=160):
    rng = random.Random(seed)
    rows, common = [], prose(rng, 40)
    for i in range(n):
        if rows and rng.random() < 0.6:
            w = rng.choice(rows)[1].split()
            for _ in range(rng.choice([0, 1, 1, 2, 4, 9])):
                if w:
                    w[rng.randrange(len(w))] = f"e{rng.randrange(99)}"
            text = " ".join(w[:rng.choice([len(w), max(0, len(w) - rng.randint(1, 5))])])
        else:
            text = prose(rng, rng.choice([0, 1, 4, 5, 8, 9, 12, 20, 35, 60, 150, 400]))
            if rng.random() < 0.3:
                text = f"{text} {common}"
        rows.append((n - i, text))
    return rows


@pytest.mark.parametrize("seed,hot,small", [(1, 64, None), (2, 3, None), (3, 1, None), (4, 64, 3), (5, 2, 60)])
def test_against_brute_force(spark, monkeypatch, seed, hot, small):
    monkeypatch.setattr(jaccard_join, "HOT", hot)          # long lists, compared in blocks
    monkeypatch.setattr(jaccard_join, "BLOCK_ELEMENTS", 1500)
    if small:
        monkeypatch.setattr(jaccard_join, "boundary", lambda *a: small)
    rows = _table(seed)
    found = jaccard_join.near_duplicates(docs(spark, rows))
    assert sorted(_found(found)) == sorted(_brute(rows))


def test_blocks_of_many_small_sets(spark, monkeypatch):
    linked = jaccard_join._linked

    def bounded(items, num, den):
        assert len(items) <= 2.4 * 1024
        return linked(items, num, den)

    monkeypatch.setattr(jaccard_join, "_linked", bounded)
    template = " ".join(f"t{i}" for i in range(11))
    rows = [(i, f"{template} x{i}") for i in range(4000)]
    rows += [(5000 + i, f"{template} a b c d {x}") for i, x in enumerate("efg")]
    found = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(docs(spark, rows)).collect()}
    assert found == {i: min(i, 5000) for i, _ in rows}


def test_prefixes_keep_every_similar_pair():
    rng = random.Random(11)
    for _ in range(300):
        a = set(rng.sample(range(2000), rng.randint(4, 80)))
        b = set(a)
        for _ in range(rng.randint(0, len(a) // 4)):
            b.discard(rng.choice(sorted(b)))
            if rng.random() < 0.5:
                b.add(rng.randrange(2000))
        if 5 * len(a & b) < 4 * len(a | b):
            continue
        for depth in (lambda s: 1, lambda s: 2, jaccard_join.scan_depth):
            k = min(depth(len(a)), depth(len(b)))
            if k <= len(a & b):
                heads = [set(sorted(s)[:jaccard_join.prefix_length(len(s), depth(len(s)))]) for s in (a, b)]
                assert len(heads[0] & heads[1]) >= k


def test_edges(spark):
    base = " ".join(f"v{i}" for i in range(40))
    rows = [(5, base), (3, base.upper()), (9, None), (1, ""), (2, " \t"), (4, "one two"), (6, "ONE\ntwo"), (7, "one"),
            (8, base.replace(" ", "\xa0")), (10, " ".join(f"q{i}" for i in range(30_000))), (None, base)]
    table = docs(spark, rows, "class,n,component,key")
    key = lambda r: (r[0] is None, r)
    assert sorted(_found(jaccard_join.near_duplicates(table)), key=key) == sorted(_brute(rows), key=key)
    assert _found(jaccard_join.near_duplicates(docs(spark, []))) == []


def test_representatives(spark):
    base = " ".join(f"v{i}" for i in range(40))
    other = " ".join(f"o{i}" for i in range(40))
    table = docs(spark, [(2, base), (1, base + " x"), (3, other), (4, None), (5, "")], "class,row")
    out = jaccard_join.representatives(table)
    assert out.columns == table.columns and sorted(r.doc_id for r in out.collect()) == [1, 3, 4, 5]


def test_representatives_with_repeated_and_null_ids(spark):
    base = " ".join(f"v{i}" for i in range(40))
    other = " ".join(f"o{i}" for i in range(40))
    rows = [(1, base), (1, base), (1, other), (2, base), (None, base), (None, "lone words of its own here"), (7, None),
            (7, None), (3, "plain text of another row")]
    out = jaccard_join.representatives(docs(spark, rows)).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in out) == sorted(
        [("1", base), ("1", other), ("None", "lone words of its own here"), ("7", "None"), ("7", "None"),
         ("3", "plain text of another row")])
    assert jaccard_join.representatives(docs(spark, [])).collect() == []
