import math

import numpy as np

from salesgrid.llm import components, nn_descent

from .helpers import components as brute_components


def _brute(rows):
    good = [(i, np.array(e, float)) for i, (_, e, label) in enumerate(rows)
            if label is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e)]
    links = [(a, b) for a, x in good for b, y in good if a < b and rows[a][2] == rows[b][2] and len(x) == len(y)
             and x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.98]
    root = brute_components(range(len(rows)), links)
    low = {}
    for i, r in root.items():
        low[r] = min(low.get(r, rows[i][0]), rows[i][0])
    n = {i: sum(i in pair for pair in links) for i in root}
    return sorted((rows[i][0], n[i], low[root[i]], rows[i][0] == low[root[i]]) for i in root)


def _found(spark, rows, **extra):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    for name in extra.get("names", ()):
        table = table.selectExpr("*", f"'x' AS {name}")
    return sorted(tuple(r) for r in nn_descent.near_duplicates(table).collect())


def test_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows, base = [], rng.standard_normal((60, 16))
    for i in range(400):
        x = base[i % 60] + rng.standard_normal(16) * rng.choice([0.0, 0.05, 0.12, 1.0])
        rows.append((1000 - i, [float(v) for v in x.astype(np.float32)], int(i % 3)))
    rows += [(2000 + i, rows[0][1], rows[0][2]) for i in range(40)]      # a saturated list
    assert _found(spark, rows) == _brute(rows)


def test_edges(spark):
    one = [1.0, 0.0]
    rows = [(1, None, 1), (2, [0.0, 0.0], 1), (3, [1.0, None], 1), (4, [1.0, float("nan")], 1),
            (5, [float("inf"), 1.0], 1), (6, one, None), (7, one, 1), (8, [2.0, 0.0], 1), (9, one, 2),
            (10, [1.0, 0.0, 0.0], 1), (7, one, 1), (11, [], 1), (12, [-0.0, 1.0], 3), (13, [0.0, 1.0], 3),
            (14, [1e-30, 0.0], 1)]
    assert _found(spark, rows, names=("node", "component", "n_links")) == _brute(rows)
    assert _found(spark, []) == []


def test_null_ids(spark):
    rows = [(None, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (3, [0.0, 1.0], 1), (None, [0.0, 1.0], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    found = nn_descent.near_duplicates(table).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0) for r in found) == \
        [(0, 1, 0), (0, 1, 0), (0, 1, 3), (3, 1, 3)]


def test_blocks_of_a_large_component(spark, monkeypatch):
    monkeypatch.setattr(nn_descent, "BLOCK", 16)
    rng = np.random.default_rng(6)
    base = rng.standard_normal(16)
    rows = [(i, [float(v) for v in (base + rng.standard_normal(16) * 0.08).astype(np.float32)], 1) for i in range(90)]
    assert _found(spark, rows) == _brute(rows)


def test_two_saturated_groups_that_are_linked(spark):
    rng = np.random.default_rng(8)
    base, away = rng.standard_normal((2, 16))
    away -= away @ base / (base @ base) * base
    away *= np.sqrt((base @ base) / (away @ away)) * 0.17          # cosine about 0.986
    rows = [(i, [float(v) for v in (base + (i % 2) * away + rng.standard_normal(16) * 0.003).astype(np.float32)], 1)
            for i in range(60)]
    want = _brute(rows)
    assert {r[1] for r in want} == {59}
    assert _found(spark, rows) == want


def test_rare_links_that_the_search_misses(spark, monkeypatch):
    monkeypatch.setattr(nn_descent, "START_BLOCK", 2)
    monkeypatch.setattr(nn_descent, "MAX_ROUNDS", 1)
    monkeypatch.setattr(nn_descent, "ASKED_VALUES", 1 << 14)        # several portions
    rng = np.random.default_rng(9)
    vectors = rng.standard_normal((1200, 32))
    vectors[:8] = vectors[8:16] + rng.standard_normal((8, 32)) * 0.15
    rows = [(i, [float(v) for v in x.astype(np.float32)], 1) for i, x in enumerate(vectors)]
    want = _brute(rows)
    assert sum(r[1] for r in want) >= 8
    assert _found(spark, rows) == want


def test_components_of_random_graphs(spark):
    rng = np.random.default_rng(7)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (180, 2))] + [(i, i + 1) for i in range(400, 460)]
    got = {r.node: r.component for r in components.connected_components(
        spark.createDataFrame(edges + [(5, None)], "u long, v long")).collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {k: v for k, v in brute_components({x for e in edges for x in e}, edges).items() if k in nodes}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).collect() == []
