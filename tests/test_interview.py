"""Semantics of the curated track that are easy to get wrong."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import interview as I
from lodestone.plans.interview import KB
from lodestone.sources.knowledge import Knowledge

ANSWERS = "session int, complaint string, var string, value string"


@pytest.fixture(scope="module")
def kb(spark):
    return Knowledge.of(spark, KB)


def given(spark, **by):
    rows = [(i, "buy", v, x) for i, (_, a) in enumerate(by.items()) for v, x in a.items()]
    s = spark.createDataFrame([(i, "buy", len(a)) for i, (_, a) in enumerate(by.items())], "session int, complaint string, asked int")
    return spark.createDataFrame(rows, ANSWERS), s


def test_unknown_is_no_evidence_and_order_doesnt_matter(spark, kb):
    a, s = given(spark, x={"view": "low", "purchase": "high"}, y={"purchase": "high", "view": "low", "error": "unknown"}, none={})
    r = I.rank(I.scores(kb, a, s)).select("session", "rank", "condition", "confidence", "evidence").orderBy("session", "rank").collect()
    by = lambda k: [tuple(x)[1:] for x in r if x["session"] == k]
    assert by(0) == by(1)
    assert [x[1] for x in by(2)] == sorted(x[1] for x in by(2))


def test_unknown_never_satisfies_and_ordered_operators_raise(spark, kb):
    cols = lambda op, got: I.holds(F.lit(op), F.array(F.lit("low")), F.lit(got).cast("string")).alias("h")
    one = lambda op, got: spark.range(1).select(cols(op, got)).first()["h"]
    assert one("!=", "unknown") is False and one("!=", None) is False and one("!=", "mid") is True and one("in", "low") is True
    assert one(">=", None) is False
    with pytest.raises(Exception, match="numeric"):
        one(">=", "low")


def test_points_threshold_and_counted_rules(spark, kb):
    a, s = given(spark, below={"click": "mid", "view": "low"}, at={"click": "mid", "view": "low", "purchase": "high"}, counted={"purchase": "high", "signup": "low"})
    fired = {(r["session"], r["id"]) for r in I.rules_fired(kb, a, s).collect()}
    assert (1, "r3") in fired and (0, "r3") not in fired and (2, "r2") in fired


def test_flips_equal_scoring_anew(spark, kb):
    a, s = given(spark, x={"view": "low", "purchase": "high", "signup": "low"}, y={"purchase": "mid", "click": "mid", "error": "low"})
    got = {(r["session"], r["var"], r["alt"]): r["new_leader"] for r in I.flips(kb, a, s).collect()}
    lead = lambda a, s: {r["session"]: r["condition"] for r in I.rank(I.scores(kb, a, s)).filter("rank = 1").collect()}
    base, rows = lead(a, s), [tuple(r) for r in a.collect()]
    values = {v[0]: v[5] for v in KB["variable"]}
    probes = [(i, k, v, alt) for i, (k, _, v, x) in enumerate(rows) for alt in values[v] if alt != x]
    probe_rows = [(n, "buy", v2, alt if v2 == v else x2) for n, (_, k, v, alt) in enumerate(probes) for k2, _, v2, x2 in rows if k2 == k]
    led = lead(spark.createDataFrame(probe_rows, ANSWERS), spark.createDataFrame([(n, "buy", 1) for n in range(len(probes))], "session int, complaint string, asked int"))
    assert got == {(k, v, alt): led[n] for n, (_, k, v, alt) in enumerate(probes) if led[n] != base[k]}


def test_undo_loses_a_variable_that_was_answered_twice(spark):
    log = spark.createDataFrame([(1, 1, "a", "x"), (1, 2, "b", "y"), (1, 3, "a", "z")], "session int, seq int, var string, value string")
    assert {(r["var"], r["value"]) for r in I.undone(log).collect()} == {("b", "y")}
    assert {(r["var"], r["value"]) for r in I.latest(log).collect()} == {("a", "z"), ("b", "y")}


def test_nothing_known_ends_without_a_leader(spark, kb):
    a, s = given(spark, none={v[0]: "unknown" for v in KB["variable"]})
    v = I.views(kb, a, s).first()
    assert v["stop"] == "insufficient_information" and v["question"] is None and v["rules"] == ""


def test_evaluation_of_ended_interviews(spark, kb):
    done = [(1, ["bot", "buyer", "victim"], "clear_leader", 3, 2), (2, ["buyer", "bot", "fraudster"], "question_cap_reached", 10, 9), (3, ["bot", "buyer", "tester"], "emergency_escalation", 1, 0), (4, ["bot", "buyer", "tester"], "clear_leader", 4, 1), (5, ["bot"], "insufficient_information", 7, 3), (6, ["bot"], "clear_leader", 2, 3)]
    cases = [(1, "bot", False), (2, "fraudster", False), (3, "victim", False), (4, "victim", None), (5, None, True), (6, None, True)]
    d = spark.createDataFrame(done, "session int, leaders array<string>, stop string, asked long, burden long")
    got = I.evaluated(kb, d, spark.createDataFrame(cases, "session int, truth string, expect_insufficient boolean")).collect()
    want = {"n": 4, "top1": 0.25, "top3": 0.5, "n_insufficient": 2, "insufficient_ok": 1, "median_asked": 3.5, "mean_burden": 3.0, "n_grave": 3, "caught": 2, "p90": 7}
    assert [{k: r[k] for k in want} for r in got] == [want]
    none = I.evaluated(kb, d.limit(0), spark.createDataFrame([], "session int, truth string, expect_insufficient boolean")).collect()
    assert [(r["n"], r["p90"]) for r in none] == [(0, None)]
