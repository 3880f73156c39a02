import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lodestone.functions.text import bag_of_words
from lodestone.llm import bloom
from lodestone.llm.variants import Variants, record_key


def variants(spark, rows, **kw):
    df = spark.createDataFrame([(t, i, x, "extra", 1) for t, i, x in rows], "tbl string, id bigint, text string, rep string, copies int")
    return Variants(df.withColumn("key", bag_of_words(F.col("text"))), ["tbl"], **kw)


def test_against_brute_force_with_a_hot_group_and_passes(spark):
    rng = random.Random(5)
    words = "red sore itching arm leg left upper".split()

    def write(ws):
        ws = [w.upper() if rng.random() < 0.3 else w for w in rng.sample(ws, len(ws))]
        return rng.choice([" ", "  ", ", ", "-"]).join(ws) + rng.choice(["", "!", " "])

    rows = [(rng.choice("ab"), i, write(["hot", "one"]) if i % 3 == 0 else write(rng.sample(words, rng.randint(2, 4)))) for i in range(900)]
    rows += [("a", 2000, None), ("a", 2001, ""), ("a", 2002, "?!"), ("a", 2003, "don't"), ("a", 2004, "DONT"), ("b", 2005, "word " * 40_000), ("b", 2006, "WORD, " * 40_000), (None, 2007, "x"), (None, 2008, "x")]
    groups = {}
    for t, i, x in rows:
        import re

        key = tuple(sorted(re.findall(r"[^\W_]+", (x or "").lower().replace("'", ""))))
        if t and key:
            groups.setdefault((t, key), []).append(i)
    want = {(t, min(g), i) for (t, _), g in groups.items() for i in g if i != min(g)}
    for per_range in (bloom.PER_RANGE, 20):  # one range of hash, many
        v = variants(spark, rows, per_range=per_range)
        assert {tuple(r) for r in v.surplus().collect()} == want
        got = v.collapsed().select("tbl", "rep", "copies").collect()
        assert sum(r["copies"] for r in got) == len(rows)
        assert {(r["tbl"], r["rep"], r["copies"]) for r in got if r["copies"] > 1} == {(t, min(g), len(g)) for (t, _), g in groups.items() if len(g) > 1}


def test_empty(spark):
    v = variants(spark, [])
    assert v.surplus().count() == 0 and v.collapsed().count() == 0


def test_records(spark):
    rows = [(1, '{"concept": "Red rash", "site": "arm"}'), (2, '{"site":"ARM","concept":"rash red","character":null}'), (3, '{"concept": "red rash", "site'), (4, None), (5, "{}"), (6, "[1]"), (7, "'x'"), (8, '{"concept": "red", "site": "rash arm"}')]
    got = {r["id"]: r["k"] for r in spark.createDataFrame(rows, "id int, json string").select("id", record_key(F.col("json")).alias("k")).collect()}
    assert got[1] == got[2] != got[8] and all(got[i] is None for i in (3, 4, 5, 6, 7))


def test_filters_never_miss_a_repeat():
    rng = np.random.default_rng(3)
    h = rng.integers(0, 1 << 62, 3000).astype(np.uint64)
    parts = [np.unique(rng.choice(h, 900), return_counts=True) for _ in range(7)]
    both = bloom.Filter(sum(len(p) for p, _ in parts))
    for p in parts:
        both.merge(*p)
    all_h = np.concatenate([np.repeat(*p) for p in parts])
    known, n = np.unique(all_h, return_counts=True)
    assert both.repeated(known[n > 1]).all() and both.repeated(known[n == 1]).mean() < 0.02


def test_the_input_is_read_once_whatever_the_number_of_ranges(spark):
    seen = spark.sparkContext.accumulator(0)

    def look(x: pd.Series) -> pd.Series:
        seen.add(len(x))
        return x

    looked = F.pandas_udf(look, "string")
    df = spark.range(4000).repartition(5).select(F.lit("t").alias("tbl"), "id", looked(F.pmod("id", F.lit(3900)).cast("string")).alias("key"))
    v = Variants(df, ["tbl"], per_range=10)
    assert v.surplus().count() == 100 and v.collapsed().count() == 3900
    assert seen.value == 4000


def test_a_hot_group_is_spread(spark, monkeypatch):
    monkeypatch.setattr("lodestone.llm.variants.HOT", 10)
    v = variants(spark, [("a", i, "hot one" if i % 3 else f"cold {i}") for i in range(300)])
    got = v.surplus()
    assert got.count() == 199 and {r["rep"] for r in got.collect()} == {1}
    assert v.groups.first()["_n"] == 200
