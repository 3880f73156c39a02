"""Orphans against brute force, and each defined case."""

import datetime as dt
import random

import pytest

from lodestone.operators.joins import join_groups
from lodestone.operators.orphans import orphan_report, orphans

T = lambda d: None if d is None else dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
REFS = "row_id bigint, a string, b string, seen timestamp, at string"
TARGETS = "x string, y string, since timestamp, until timestamp, a string"


def run(spark, refs, targets, **kw):
    kw = {"on": [("a", "x")], "at": "seen", "valid": ("since", "until"), **kw}
    r = spark.createDataFrame([(i, a, b, T(d), "extra") for i, a, b, d in refs], REFS)
    t = spark.createDataFrame([(x, y, T(s), T(u), "clash") for x, y, s, u in targets], TARGETS)
    return {(o["row_id"], o["reason"]) for o in orphans(r, t, row_id="row_id", **kw).collect()}


def test_reasons_nulls_and_key_rule(spark):
    targets = [("K", "y", 10, None), ("gone", "y", 0, 20), ("back", "y", 0, 5), ("Back", "y", 15, None), (None, "y", 0, None), ("undated", "y", None, None)]
    refs = [(1, " k\t", None, 10), (2, "K", None, 9), (3, "gone", None, 20), (4, "GONE", None, 19), (5, "none", None, 1), (6, None, None, 1), (7, "back", None, 7), (8, "back", None, 16), (9, "k", None, None), (10, "undated", None, 3), (11, "", None, 3), (5, "none", None, 1)]
    assert run(spark, refs, targets) == {(2, "early"), (3, "gone"), (5, "missing"), (7, "gone"), (9, "gone"), (10, "gone"), (11, "missing")}


def test_match_semantics(spark):
    targets = [("p", "q", 0, None), ("p", "r", 0, None)]
    refs = [(1, "p", "q", 1), (2, "p", None, 1), (3, None, "z", 1), (4, None, None, 1), (5, "q", "p", 1), (6, None, "r", 1)]
    on = [("a", "x"), ("b", "y")]
    assert run(spark, refs, targets, on=on) == {(5, "missing")}
    assert run(spark, refs, targets, on=on, match="partial") == {(5, "missing"), (3, "missing")}
    assert run(spark, refs, targets, on=on, match="full") == {(5, "missing"), (2, "partial_null"), (3, "partial_null"), (6, "partial_null")}
    with pytest.raises(ValueError):
        run(spark, refs, targets, match="other")


def test_masks_against_brute_force_and_hot_keys(spark, monkeypatch):
    rng = random.Random(7)
    monkeypatch.setattr("lodestone.operators.orphans.join_groups", lambda *x: join_groups(*x, hot=5, most=0, salts=3))
    pick = lambda: rng.choice(["a", "b", "c", None])
    targets = [(pick(), pick(), rng.randrange(5), rng.choice([None, rng.randrange(5, 9)])) for _ in range(5)]
    refs = [(i, pick() if i % 3 else "c", pick() if i % 3 else "b", rng.randrange(10)) for i in range(240)]

    def holds(r, t, columns):
        return all(r[1 + c] == t[c] for c in columns) and t[2] <= r[3] and (t[3] is None or t[3] > r[3])

    for match in ("simple", "partial", "full"):
        want = set()
        for r in refs:
            some = [c for c in (0, 1) if r[1 + c] is not None]
            checked = some if match == "partial" else [0, 1]
            if not some or match == "simple" and len(some) < 2:
                continue
            if match == "full" and len(some) < 2 or not any(holds(r, t, checked) for t in targets):
                want.add(r[0])
        assert {i for i, _ in run(spark, refs, targets, on=[("a", "x"), ("b", "y")], match=match)} == want


def test_empty_tables(spark):
    assert run(spark, [], [("p", "q", 0, None)]) == set()
    assert run(spark, [(1, "p", None, 1), (2, None, None, 1)], []) == {(1, "missing")}
    assert run(spark, [(1, "p", None, 1)], [], at=None, valid=None) == {(1, "missing")}


def test_against_brute_force_with_a_hot_key(spark):
    rng = random.Random(3)
    keys = ["hot"] * 40 + [f"k{i}" for i in range(60)] + [None, "x" * 50_000]
    targets = [(rng.choice(keys[:90]), "y", s := rng.randint(0, 50), rng.choice([None, s + rng.randint(0, 30)])) for _ in range(80)]
    refs = [(i, rng.choice(keys), None, rng.choice([None, *range(90)])) for i in range(900)]
    want = {i for i, a, _, d in refs if a is not None and not any(x == a and d is not None and s <= d and (u is None or u > d) for x, _, s, u in targets)}
    assert {i for i, _ in run(spark, refs, targets)} == want


def test_report_counts_months(spark):
    r = spark.createDataFrame([(1, T(3), "missing"), (2, T(4), "missing"), (3, T(40), "gone"), (4, None, "gone")], "row_id int, at timestamp, reason string")
    assert {tuple(x) for x in orphan_report(r, []).collect()} == {("2024-01", "missing", 2), ("2024-02", "gone", 1), (None, "gone", 1)}
