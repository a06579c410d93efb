"""Closure over parents, against a walk; cycles, orphans and long chains."""

import random
from decimal import Decimal

import pytest

from salesgrid import operators as O
from salesgrid.operators import hierarchy as H
from salesgrid.plans.model import CrmModel


def walk(parents):
    """account -> (ultimate parent, depth, status)"""
    out = {}
    for a in parents:
        at, seen, depth = a, {a}, 0
        while True:
            up = parents.get(at)
            if up is None:
                out[a] = (at, depth, "orphan" if at not in parents else "child" if depth else "top")
                break
            if up in seen:
                out[a] = (None, None, "cycle")
                break
            at, depth = up, depth + 1
            seen.add(up)
    return out


def closed(spark, parents):
    frame = spark.createDataFrame(list(parents.items()), "account string, subsidiary_of string")
    rows = H.closure(frame).collect()
    assert len(rows) == len(parents) and all(r.parent == parents[r.account] for r in rows)
    return {r.account: (r.ultimate_parent, r.depth, r.status) for r in rows}


@pytest.mark.parametrize("seed", range(3))
def test_random_forests_with_cycles(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i:03}" for i in range(120)]
    parents = {n: rng.choice([None, "gone", *names[:i or 1], *names] if rng.random() < 0.3 else names[max(0, i - 3):i] or [None])
               for i, n in enumerate(names)}
    assert closed(spark, parents) == walk(parents)


def test_rounds_grow_with_the_logarithm_of_the_depth(spark, monkeypatch):
    rounds = []
    keep = H.reliable_checkpoint
    monkeypatch.setattr(H, "reliable_checkpoint", lambda df: rounds.append(1) or keep(df))
    chain = {f"c{i:04}": f"c{i - 1:04}" if i else None for i in range(200)}
    assert closed(spark, chain) == walk(chain) and len(rounds) <= 10


def test_special_cases(spark):
    parents = {"self": "self", "a": "b", "b": "a", "into": "a", "top": None, "kid": "top", "lost": "nobody", "below": "lost"}
    assert closed(spark, parents) == walk(parents)
    assert walk(parents)["below"] == ("nobody", 2, "orphan") and walk(parents)["into"] == (None, None, "cycle")
    assert H.closure(spark.createDataFrame([], "account string, subsidiary_of string")).collect() == []


def test_revenue_goes_to_the_ultimate_parent(spark):
    accounts = spark.createDataFrame([("top", None), ("kid", "top"), ("grandkid", "kid"), ("x", "y"), ("y", "x"), ("lost", "nobody")],
                                     "account string, subsidiary_of string")
    deals = spark.createDataFrame([("1", "top", "Won", Decimal(10)), ("2", "grandkid", "Won", Decimal(5)), ("3", "grandkid", "Lost", Decimal(0)),
                                   ("4", "x", "Won", Decimal(1)), ("5", "lost", "Won", Decimal(2)), ("6", None, "Won", Decimal(99))],
                                  "opportunity_id string, account string, deal_stage string, close_value decimal(15,2)")
    model = CrmModel.from_frames(deals, accounts, accounts, accounts)
    got = {r.ultimate_parent: tuple(r)[1:] for r in O.parent_revenue(model).collect()}
    assert got == {"top": (3, 2, 2, 10.0, 15.0), "x": (1, None, 1, 1.0, 1.0), "y": (1, None, 0, 0.0, 0.0), "nobody": (1, 1, 1, 0.0, 2.0)}
