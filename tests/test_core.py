"""Graphs, vectors, order, names, facets and sources against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import facets, markup, names
from lodestone.operators import graph, terminology, vectors
from lodestone.operators.joins import join_groups
from lodestone.operators.order import numbered
from lodestone.sources import files, index, providers
from lodestone.streaming.answers import latest_answers, to_memory


def test_closure_cycles_and_diamonds(spark):
    e = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "b"), ("d", "e"), ("e", "a"), ("d", "b"), (None, "a"), ("x", "y"), ("y", "x"), ("z", "x")], "child string, parent string")
    got = {(r["node"], r["ancestor"]) for r in graph.ancestors(e).collect()}
    assert {("c", "a"), ("d", "a"), ("d", "e"), ("z", "y")} <= got and ("a", "a") not in got and ("x", "x") in got
    assert {r["node"] for r in graph.on_cycles(e).collect()} == {"x", "y"}
    assert graph.ancestors(e.limit(0)).count() == 0
    rows = [("1", "c", "p", "116"), ("0", "d", "p", "116"), ("1", "e", "p", "9")]
    assert [tuple(r) for r in graph.edges_of(spark.createDataFrame(rows, "active string, sourceId string, destinationId string, typeId string"), "116").collect()] == [("c", "p")]


def test_greedy_clusters_equal_the_sequential_pass(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, 8))
    x = np.concatenate([b + rng.normal(scale=0.25, size=(9, 8)) for b in base])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    order = sorted(range(len(x)), key=lambda i: (-round(float(s[i].sum()), 4), i))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, vec array<double>")
    dens = {r["id"]: r["density"] for r in vectors.density(df).collect()}
    order = sorted(range(len(x)), key=lambda i: (-dens[i], i))
    seeds, want = [], {}
    for i in order:
        near = [j for j in seeds if s[i, j] >= 0.88]
        want[i] = near[0] if near else i
        if not near:
            seeds.append(i)
    assert {r["id"]: r["seed"] for r in vectors.greedy_clusters(df).collect()} == want


def test_top_k_ties_and_least(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, [2.0, 0.0]), (5, None), (6, [0.0, 0.0])], "id bigint, v array<double>")
    rows = vectors.usable(df, "id", "v")
    got = [(r["id"], r["other"], r["rank"]) for r in vectors.top_k(rows.filter("id = 1"), rows, 2).orderBy("rank").collect()]
    assert got == [(1, 4, 1), (1, 2, 2)]
    assert vectors.top_k(rows.filter("id = 3"), rows, 2, 0.8).count() == 0


def test_numbers_and_hot_groups(spark):
    df = spark.createDataFrame([(f"p{i % 7}", i) for i in range(500)], "k string, i int")
    assert [r["n"] for r in numbered(df, ["k", "i"], "n").orderBy("k", "i").collect()] == list(range(500))
    groups = df.groupBy("k").agg(F.count(F.lit(1)).alias("size"))
    assert join_groups(df, groups, ["k"], "size", hot=72).count() == 500


def test_variants_and_norm(spark):
    show = ["Actinic keratoses (solar keratoses)", "Arrhythmia, see Heart rhythm problems", "Bowel cancer in adults", "Head lice and body lice", "Kidney stones", "ABC (XYZ)"]
    df = spark.createDataFrame([(s,) for s in show], "n string")
    got = {r["n"]: r["v"] for r in df.select("n", names.variants(F.col("n")).alias("v")).collect()}
    assert got[show[0]][:2] == ["actinic keratoses", "solar keratoses"] and "actinic keratosis" in got[show[0]]
    assert got[show[1]][:2] == ["heart rhythm problems", "arrhythmia"]
    assert "bowel cancer" in got[show[2]] and "malignant neoplasm of bowel" in got[show[2]]
    assert "head lice" in got[show[3]] and "calculus of kidney" in got[show[4]] and got[show[5]] == ["abc"]


def test_facets(spark):
    df = spark.createDataFrame([("days", "days", 0.0), ("hours", "weeks_or_longer", 2 / 3), ("unspecified", "days", None), (None, "days", None)], "a string, b string, want double")
    for r in df.select("want", facets.band_distance(F.col("a"), F.col("b"), facets.ONSETS).alias("d")).collect():
        assert r["d"] == pytest.approx(r["want"]) if r["want"] is not None else r["d"] is None
    m = facets.facet_multiplier(F.lit("hours"), F.lit("under_1_day"), F.lit("weeks_or_longer"), F.lit("over_8_weeks"))
    assert spark.range(1).select(m.alias("m")).first()["m"] == 0.4


def test_term_match_prefers_the_first_unambiguous(spark):
    labels = spark.createDataFrame([("1", "Kidney stone"), ("2", "Cold"), ("3", "Cold"), ("4", "Common cold")], "id string, label string")
    ix = terminology.term_index(labels)
    got = {r["name"]: (r["id"], r["ambiguous"]) for r in terminology.term_match(spark.createDataFrame([("Kidney stones",), ("cold",), ("Cold (common cold)",), ("gout",), (None,)], "name string"), ix).collect()}
    assert got == {"Kidney stones": ("1", False), "cold": (None, True), "Cold (common cold)": ("4", False), "gout": (None, False)}


def test_digest_depends_on_content_and_place(spark):
    d = lambda v: terminology.content_digest(spark.createDataFrame(list(enumerate(v)), "id int, t string"), "t", "id").first()["digest"]
    assert d(["alpha", "beta"]) != d(["beta", "alpha"]) != d(["alpha", "gamma"]) and d(["a"]) != d(["a", "a"])
    rows = spark.createDataFrame([(1, "b"), (0, "a"), (2, None)], "id int, t string")
    assert terminology.content_digest(rows, "t", "id").first() == terminology.content_digest(rows.orderBy("id"), "t", "id").first()


def test_index_refuses_another_vocabulary(spark, tmp_path):
    rows = spark.createDataFrame([(0, "alpha", [1.0, 0.0]), (1, "beta", [0.9, 0.1]), (2, "gamma", [0.0, 2.0]), (3, "delta", None)], "id int, phrase string, vec array<double>")
    index.save(rows, str(tmp_path / "ix"))
    got = index.load(spark, str(tmp_path / "ix"), rows.select("id", "phrase"))
    assert [r["other"] for r in vectors.top_k(got.filter("id = 0"), got, 2).orderBy("rank").collect()] == [1, 2]
    for other in (rows.filter("id < 2"), rows.withColumn("phrase", F.when(F.col("id") == 0, "beta").when(F.col("id") == 1, "alpha").otherwise(F.col("phrase")))):
        with pytest.raises(index.StaleIndex):
            index.load(spark, str(tmp_path / "ix"), other)


def test_code_map_and_index_under_a_root(spark):
    rows = spark.createDataFrame([("1", "a", "X1", 0), ("1", "a", " X1.2 ", 1), ("1", "a", "X1.3", 2), ("0", "b", "Y1.1", 3), ("1", "c", "Z1.1", 4), ("1", "b", None, 5)], "active string, referencedComponentId string, mapTarget string, ord long")
    wanted = spark.createDataFrame([("a",), ("b",)], "id string")
    assert [tuple(r) for r in terminology.code_map(rows, wanted).collect()] == [("a", "X1.2")]
    labels = spark.createDataFrame([("1", "Cold"), ("2", "cold"), ("3", "Flu")], "id string, label string")
    assert {tuple(r) for r in terminology.term_index(labels, labels.filter("id <> '2'")).collect()} == {("cold", 1, "1"), ("flu", 1, "3")}


def test_gaps_by_part(spark):
    docs = spark.createDataFrame([("a", "It LOOKS red. Urgent advice: if gone"), ("a", "gone, looked. Urgent advice: look"), ("b", "press"), (None, "press"), ("b", None)], "condition string, text string")
    asserted = spark.createDataFrame([("b", "click")], "condition string, var string")
    got = terminology.cue_gaps(docs, [("view", "looks"), ("view", "look"), ("refund", "gone"), ("click", "press")], "Urgent advice", asserted)
    assert {tuple(r) for r in got.collect()} == {("a", "view", "describes", 2), ("a", "refund", "red flag", 1), ("a", "refund", "describes", 1)}


def test_tsv_yaml_and_release(spark, tmp_path):
    df = spark.createDataFrame([("a", 'say "x"'), ("b", "")], "k string, v string")
    files.write_tsv(df, str(tmp_path / "t"))
    assert {tuple(r) for r in files.read_tsv(spark, str(tmp_path / "t"), "k string, v string").collect()} == {("a", 'say "x"'), ("b", None)}
    assert spark.range(1).select(markup.yaml_quote(F.lit('a "b"')).alias("y")).first()["y"] == '"a \\"b\\""'
    import zipfile

    with zipfile.ZipFile(tmp_path / "r.zip", "w") as z:
        z.writestr("x/Snapshot/Terminology/sct2_Relationship_a.txt", "id\teffectiveTime\tactive\tmoduleId\tsourceId\tdestinationId\trelationshipGroup\ttypeId\tc\tm\n1\t2\t1\t3\tb\ta\t0\t116\t4\t5\n")
        z.writestr("x/Full/sct2_Relationship_b.txt", "no")
    paths = files.unpack(spark, str(tmp_path / "r.zip"), "sct2_Relationship")
    assert len(paths) == 1 and files.read_relationships(spark, paths).first()["sourceId"] == "b"
    assert files.read_release(spark, str(tmp_path / "r.zip"), "sct2_Relationship").select("sourceId", "ord").collect() == [("b", 0)]


def test_providers_fill_only_misses(spark):
    t = lambda *x: spark.createDataFrame([(v,) for v in x], "text string")
    got = providers.embed(t("a b", "c", "c", None), t("c")).collect()
    assert [r["text"] for r in got] == ["a b"] and len(got[0]["vec"]) == 64


def test_providers_try_again_and_remember(spark, tmp_path):
    waited, calls = [], []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise providers.Busy
        return x

    assert providers.patient(flaky, wait=waited.append)("q") == "q" and waited == [1.0, 2.0]
    with pytest.raises(providers.Busy):
        providers.patient(lambda: (_ for _ in ()).throw(providers.Busy()), tries=2, wait=waited.append)()
    t = lambda *x: spark.createDataFrame([(v,) for v in x], "text string")
    said = lambda p: p.upper() + '"'
    schema, path = "key string, text string, reply string", str(tmp_path / "cache")
    for words in (("a", "b", "a"), ("b", "c")):
        got = providers.remembered(lambda cached, w=words: providers.ask(t(*w), cached, said), path, spark, schema)
    assert sorted(r["text"] for r in got.collect()) == ["a", "b", "c"]
    q = {r["text"]: r["reply"] for r in providers.questions(t("itch", "itch"), t("x").limit(0), lambda p: f'"Is there {p[-4:]}?" ').collect()}
    assert q == {"itch": "Is there itch?"}
    lines = providers.phrases(t("free text"), t("x").limit(0), lambda p: "Sore arm \n\n a rash")
    assert [(r["pos"], r["phrase"]) for r in lines.orderBy("pos").collect()] == [(0, "sore arm"), (1, "a rash")]


def test_clusters_are_named_merged_and_relinked(spark):
    clusters = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 4), (5, 5)], "id int, seed int")
    phrases = spark.createDataFrame([(1, "cough"), (2, "coughing"), (3, "a cough"), (4, "page 4"), (5, "rash")], "id int, phrase string")
    names = providers.label_clusters(clusters, phrases, lambda p: None if "page" in p else " Dry  Cough" if "cough" in p else "Rash")
    assert {tuple(r) for r in names.collect()} == {(1, "dry cough"), (3, "dry cough"), (4, None), (5, "rash")}
    links = spark.createDataFrame([("x", 1), ("x", 3), ("y", 2), ("y", 4), ("z", 5)], "condition string, id int")
    assert {tuple(r) for r in providers.relink(clusters, names, links).collect()} == {("x", "dry cough"), ("y", "dry cough"), ("z", "rash")}


def test_answers_as_a_stream(spark, tmp_path):
    rows = [(1, 2, "v", "new"), (1, 1, "v", "old"), (2, 1, "v", "x")]
    spark.createDataFrame(rows, "session int, seq int, var string, value string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("session int, seq int, var string, value string").parquet(str(tmp_path / "in"))
    to_memory(latest_answers(stream), "latest", str(tmp_path / "cp")).awaitTermination(60)
    assert {(r["session"], r["value"]) for r in spark.table("latest").collect()} == {(1, "new"), (2, "x")}


def test_quotes(spark):
    q = spark.createDataFrame([(1, "one two three four five six seven eight nine"), (2, "too short")], "quote_id int, quote string")
    t = spark.createDataFrame([(10, "x One two. one  two three four\nfive six seven eight nine!"), (11, None), (12, "one two three four five six seven eight ten")], "text_id int, text string")
    assert [tuple(r) for r in terminology.quotes_found(q, t).collect()] == [(1, 10)]


def test_random_names_dont_break_markup(spark):
    rng = random.Random(1)
    junk = ["".join(rng.choice("<>/pli &;a") for _ in range(80)) for _ in range(50)] + [None, ""]
    df = spark.createDataFrame([(j,) for j in junk], "h string")
    assert df.select(markup.plain(F.col("h")), markup.sections(F.col("h")), markup.last_cells(F.col("h"))).count() == 52
