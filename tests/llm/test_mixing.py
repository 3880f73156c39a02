import os

import pytest

from lodestone.llm.mixing import TOKENIZER, Mixture

pytestmark = pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no vocabulary files here")
DOCS, TARGETS = "doc_id int, text string, source string, tokens int", "source string, target_share double, max_repeats int"


def mix(spark, docs, targets, **kw):
    return Mixture(spark.createDataFrame([(*d, 1) for d in docs], DOCS), spark.createDataFrame(targets, TARGETS), **kw)


def test_shares_repeats_and_curriculum(spark):
    docs = [(i, "one two three four five", " Big" if i % 2 else "big") for i in range(3000)] + [(5000 + i, "six seven eight nine ten", "small") for i in range(100)]
    docs += [(9000, None, "big"), (9001, "", "big"), (9002, "text", None), (9003, "text", "other")]
    m = mix(spark, docs, [("BIG ", 0.7, 1), ("small", 0.3, 4), ("absent", 0.1, 2), (None, 0.5, 1)])
    rows = m.positions().collect()
    shares = {r["source"]: r for r in m.shares().collect()}
    assert shares["small"]["actual_share"] == pytest.approx(0.3, abs=0.01) and shares["big"]["actual_share"] == pytest.approx(0.7, abs=0.01)
    assert shares["absent"]["tokens"] == 0 and shares["small"]["most_repeats"] == 4 and shares["big"]["most_repeats"] == 1
    pos = [r["position"] for r in rows]
    assert pos == sorted(pos) and 0 <= pos[0] and pos[-1] < 1
    half = len(rows) // 2
    part = lambda rs: sum(r["source"] == "small" for r in rs) / len(rs)
    assert part(rows[:half]) < 0.3 < part(rows[half:])
    assert len({(r["id"], r["repeat"]) for r in rows}) == len(rows)


def test_positions_invert_demand(spark):
    m = mix(spark, [(i, "word " * (1 + i % 7), "a") for i in range(50)] + [(100 + i, "word", "b") for i in range(400)], [("a", 0.5, 3), ("b", 0.5, 1)], tilt={"a": 1.0})
    plan = {r["source"]: r for r in m.plan.collect()}
    offset = {"a": 0, "b": 0}
    for r in m.positions().collect():
        p, t = plan[r["source"]], r["position"]
        assert m.total * p["share"] * (t + p["tilt"] * (t * t - t)) == pytest.approx(offset[r["source"]], abs=1e-6)
        offset[r["source"]] += r["tokens"]


def test_empty_and_fixed_total(spark):
    assert mix(spark, [], [("a", 1.0, 1)]).positions().count() == 0
    assert mix(spark, [(1, "x", "a")], []).positions().count() == 0
    m = mix(spark, [(i, "one two", "a") for i in range(100)], [("a", 1.0, 1)], total_tokens=20)
    assert sum(r["tokens"] for r in m.positions().collect()) == 20
