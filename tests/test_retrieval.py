"""Questions and narrowing on small link tables, and against a plain loop."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import retrieval as R


def table(spark, links, idf=None):
    rows = [(c, s, float((idf or {}).get(s, 1.0))) for c, ss in links.items() for s in ss]
    return spark.createDataFrame(rows, "condition string, symptom_id int, idf double")


def question(spark, links, candidates, asked, idf=None):
    c = spark.createDataFrame([("q", x) for x in candidates], "query_id string, condition string")
    a = spark.createDataFrame([("q", x) for x in asked], "query_id string, symptom_id int")
    got = R.best_split(R.splits(c, table(spark, links, idf), a)).collect()
    return got[0]["symptom_id"] if got else None


def test_question_choice(spark):
    even = {"a": [1, 2], "b": [1, 2], "c": [1, 3], "d": [1, 3]}
    assert question(spark, even, "abcd", []) == 2
    assert question(spark, even, "abcd", [2]) == 3 and question(spark, even, "abcd", [2, 3]) is None and question(spark, even, "a", []) is None
    tie = {"a": [2, 3], "b": [2, 3], "c": [4], "d": [4]}
    assert question(spark, tie, "abcd", [], {2: 1.0, 3: 5.0, 4: 1.0}) == 3


def loop(links, idf, opening, asked, answer, targets=(5, 1), most=12):
    """The narrowing of one query, a question at a time."""
    length = {c: sum(idf[s] for s in ss) ** 0.25 for c, ss in links.items()}
    total = dict(opening)
    score = lambda c: round(total[c] / length[c], 6)
    cand, asked, n_asked = [c for c, _ in opening], set(asked), 0
    for target in targets:
        for _ in range(most):
            if len(cand) <= target:
                break
            n = len(cand)
            count = {}
            for c in cand:
                for s in links[c]:
                    count[s] = count.get(s, 0) + 1
            h = {s: round(-(k / n * math.log2(k / n) + (1 - k / n) * math.log2(1 - k / n)), 9) for s, k in count.items() if s not in asked and k < n}
            if not h:
                break
            best = min(h, key=lambda s: (-h[s], -round(idf[s], 9), s))
            asked.add(best)
            n_asked += 1
            reply = answer(best)
            if reply is not None:
                for c in total:
                    if best in links[c]:
                        total[c] += idf[best] * (1 if reply else -0.7)
            cand = sorted(cand, key=lambda c: -score(c))[: max(target, n - 2)]
    return [(c, score(c)) for c in sorted((c for c, _ in opening), key=lambda c: -score(c))], n_asked


@pytest.mark.parametrize("most", [12, 1])
def test_narrowing_equals_a_loop(spark, most):
    rng = random.Random(most)
    links = {f"c{i:02}": rng.sample(range(30), rng.randint(3, 12)) for i in range(14)} | {"twin-a": [1, 2], "twin-b": [1, 2]}
    idf = {s: round(rng.uniform(1, 6), 3) for s in range(30)}
    openings, said, answers = {}, {}, {}
    for q in range(8):
        some = rng.sample(sorted(links), 10) if q else ["twin-a", "twin-b"]
        opening = [(c, round(rng.uniform(0, 5), 3)) for c in some]
        length = {c: sum(idf[s] for s in links[c]) ** 0.25 for c in links}
        openings[f"q{q}"] = sorted(opening, key=lambda x: (-round(x[1] / length[x[0]], 6), x[0]))
        said[f"q{q}"] = rng.sample(range(30), 2)
        answers[f"q{q}"] = {s: rng.choice([True, False, None]) for s in range(30)}
    df = spark.createDataFrame([(q, c, t, i + 1) for q, o in openings.items() for i, (c, t) in enumerate(o)], "query_id string, condition string, total double, place int")
    asked = spark.createDataFrame([(q, s) for q, ss in said.items() for s in ss], "query_id string, symptom_id int")
    told = spark.createDataFrame([(q, s, r) for q, a in answers.items() for s, r in a.items()], "query_id string, symptom_id int, reply boolean")
    l = table(spark, links, idf)
    out = R.narrow(df, asked, l, R.lengths(l), lambda b: b.join(told, ["query_id", "symptom_id"]), most=most).collect()
    for q, o in openings.items():
        mine = sorted((r for r in out if r["query_id"] == q), key=lambda r: r["place"])
        want, n = loop(links, idf, o, said[q], answers[q].get, most=most)
        assert [(r["condition"], r["score"]) for r in mine] == want and {r["n_asked"] for r in mine} == {n}


def test_a_denial_demotes_only_who_lists_it(spark):
    l = table(spark, {"a": [1, 2], "b": [1, 3]})
    record = "struct('unspecified' AS onset, 'unspecified' AS duration, '{}' AS polarity)"
    links = l.withColumn("onset", F.lit(None).cast("string")).withColumn("duration", F.lit(None).cast("string"))
    said = lambda i, s, p: spark.range(1).select(F.lit("q").alias("query_id"), F.lit(i).alias("record_id"), F.lit(s).alias("symptom_id"), F.lit(1.0).alias("cosine"), F.expr(record.format(p)).alias("record"))
    first, both = said(1, 1, "present"), said(1, 1, "present").unionByName(said(2, 2, "absent"))
    score = lambda m: {r["condition"]: r["score"] for r in R.idf_rank(R.strengths(m, links), R.lengths(l)).collect()}
    before, after = score(first), score(both)
    assert before["a"] == before["b"] == after["b"] > after["a"]
    assert {(r["condition"], r["record_id"]): r["w"] for r in R.evidence(both, links).collect()} == {(r["condition"], r["record_id"]): r["w"] for r in R.strengths(both, links).collect()}


@pytest.mark.parametrize("rarest", [True, False])
def test_questions_by_blocks_equal_splits(spark, monkeypatch, rarest):
    monkeypatch.setattr(R, "BLOCK", 25)
    monkeypatch.setattr(R, "CHUNK", 4)
    rng = random.Random(5)
    l = table(spark, {f"c{i:02}": rng.sample(range(40), rng.randint(2, 20)) for i in range(15)}, {s: rng.choice([1.0, 2.5, 4.0]) for s in range(40)})
    c = spark.createDataFrame([(f"q{q}", f"c{i:02}", rng.random() < 0.8) for q in range(12) for i in rng.sample(range(17), 10)], "query_id string, condition string, left boolean")
    a = spark.createDataFrame([(f"q{q}", s) for q in range(0, 12, 2) for s in [*rng.sample(range(40), 9), 99]], "query_id string, symptom_id int")
    got = R.best_questions(c, R.question_blocks(l), a, rarest).collect()
    # a candidate without links counts as one that has no symptom
    want = R.best_split(R.splits(c.filter("left"), l, a), rarest).collect()
    assert R.question_blocks(l)[1] > 3 and {(r["query_id"], r["symptom_id"], r["h"]) for r in got} == {tuple(r) for r in want} and len(got) == 12
    has = {(r["condition"], r["symptom_id"]) for r in l.collect()}
    mine = {}
    for r in c.collect():
        mine.setdefault(r["query_id"], []).append(r["condition"])
    assert all(sorted(r["holders"]) == sorted(x for x in mine[r["query_id"]] if (x, r["symptom_id"]) in has) for r in got)


def test_cosine_ranking_equals_a_loop(spark):
    """Also that no row per query and condition is moved: the last shuffle before the ranking is by query alone."""
    links, idf = {"b": [1, 2, 3], "a": [1, 2, 3], "c": [3, 4], "d": [5]}, {1: 1.0, 2: 2.0, 3: 1.5, 4: 3.0, 5: 2.5}
    said = [("p", 1, "present"), ("p", 1, "absent"), ("p", 4, "present"), ("q", 2, None), ("q", 99, "present"), ("r", 99, "present")]
    m = spark.createDataFrame([(q, s, 0.9, (p,)) for q, s, p in said] + [("q", 5, 0.5, ("present",))], "query_id string, symptom_id int, cosine double, record struct<polarity: string>")
    want = set()
    for q, own in {"p": {1: -0.7, 4: 3.0}, "q": {2: 2.0}}.items():
        norm = math.sqrt(sum(x * x for x in own.values()))
        scores = {c: round(sum(own.get(s, 0) * idf[s] for s in ss) / (math.sqrt(sum(idf[s] ** 2 for s in ss)) ** 0.25 * norm), 6) for c, ss in links.items() if own.keys() & set(ss)}
        want |= {(q, i + 1, c, scores[c]) for i, c in enumerate(sorted(scores, key=lambda c: (-scores[c], c))[:2])}
    out = R.cosine_rank_l2(m, table(spark, links, idf), k=2)
    assert {tuple(r) for r in out.collect()} == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id" in plan and not [x for x in plan.split("\n") if "hashpartitioning(query_id" in x and "code" in x]
