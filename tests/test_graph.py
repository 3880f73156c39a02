from lodestone.operators import graph as G


def test_no_bound_on_rounds(spark, monkeypatch):
    # a chain beyond 200 rounds takes minutes: a bounded number of rounds is cut to three instead
    monkeypatch.setattr(G, "range", lambda a, b: range(a, min(b, a + 3)), raising=False)
    n = 6
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)], "child int, parent int")
    got = G.ancestors(edges, spark.createDataFrame([(0,)], "node int"))
    assert sorted((r["ancestor"], r["depth"]) for r in got.collect()) == [(i, i) for i in range(1, n + 1)]
    assert G.ancestors(edges, depth=2).filter("depth > 2").count() == 0
