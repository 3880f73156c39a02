import random
from collections import Counter, defaultdict

import numpy as np

from lodestone.llm import terms as T


def brute(records, max_n):
    occ, df = Counter(), defaultdict(set)
    for i, r in enumerate(records):
        r = [w for w in (r or []) if w is not None]
        for n in range(1, max_n + 1):
            for k in range(len(r) - n + 1):
                g = (n, " ".join(r[k : k + n]))
                occ[g] += 1
                df[g].add(i)
    return {(n, t, c, len(df[n, t])) for (n, t), c in occ.items()}


def test_against_brute_force_in_small_chunks(spark, monkeypatch):
    rng = random.Random(2)
    records = [[rng.choice("aaabcd") for _ in range(rng.randint(0, 9))] for _ in range(300)] + [None, [], ["a"] * 90, [None, "b", None, "c"]]
    df = spark.createDataFrame([(r, i) for i, r in enumerate(records)], "tokens array<string>, term int")
    assert {tuple(r) for r in T.ngram_counts(df, "tokens", 3).collect()} == brute(records, 3)
    monkeypatch.setattr(T, "CHUNK", 40)
    assert {tuple(r) for r in T.ngram_counts(df.coalesce(1), "tokens", 3).collect()} == brute(records, 3)
    assert {tuple(r) for r in T.ngram_counts(df.coalesce(1), "tokens", None).collect()} == brute(records, 90)
    assert T.ngram_counts(df.limit(0), "tokens").count() == 0


def test_suffix_array_against_sorting():
    rng = random.Random(9)
    for _ in range(40):
        records = [[rng.randrange(3) for _ in range(rng.randint(1, 12))] for _ in range(rng.randint(1, 9))]
        code = np.array([c for r in records for c in r])
        left = np.array([len(r) - i for r in records for i in range(len(r))])
        order, prefix = T.suffix_array(code, left)
        suffixes = [tuple(code[i : i + left[i]]) for i in order]
        assert suffixes == sorted(suffixes)
        common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert prefix[1:].tolist() == [common(a, b) for a, b in zip(suffixes, suffixes[1:])]


def test_spread_with_hot_term_and_record(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "x", "y", None]), rng.choice([7] * 5 + [1, 2, None]), "extra") for _ in range(2000)]
    occ, df = Counter(), defaultdict(set)
    for r, t, _ in rows:
        if t is not None:
            occ[t] += 1
            df[t] |= {r} - {None}
    got = T.spread_counts(spark.createDataFrame(rows, "r string, t int, records string"), "r", "t").collect()
    assert {tuple(x) for x in got} == {(t, n, len(df[t])) for t, n in occ.items()}
    assert T.spread_counts(spark.createDataFrame([], "r string, t int"), "r", "t").count() == 0
