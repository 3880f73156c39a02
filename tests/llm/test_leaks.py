import random
import re

import numpy as np

from lodestone.llm.leaks import Leaks


def grams(t):
    w = re.findall(r"[^\W_]+", re.sub("['’]", "", (t or "").lower()))
    return {tuple(w[i : i + 10]) for i in range(len(w) - 9)}


def run(spark, items, docs, **kw):
    i = spark.createDataFrame(items, "item_id int, text string")
    d = spark.createDataFrame([(*x, "extra") for x in docs], "doc_id int, text string, item string")
    return Leaks(i, d, **kw)


def test_verbatim_against_brute_force(spark):
    rng = random.Random(4)
    vocab = "aged 40 a nurse reports pain of the arm for 3 weeks don't two".split()
    items = [(i, " ".join(rng.choice(vocab) for _ in range(25))) for i in range(12)] + [(90, None), (91, "too short")]
    docs = []
    for i in range(120):
        t = items[rng.randrange(12)][1].split()
        a = rng.randrange(12)
        cut = t[a : a + rng.randint(7, 14)]
        docs.append((i, " ".join(rng.choice(vocab) for _ in range(8)).upper() + "\n" + ", ".join(cut) + "."))
    docs += [(900, None), (901, ""), (902, (items[0][1] + " ") * 500), (903, items[1][1]), (903, items[1][1])]
    want = {(a, b) for a, t in items for b, u in docs if grams(t) & grams(u)}
    assert {tuple(r) for r in run(spark, items, docs).verbatim().collect()} == want
    assert {tuple(r) for r in run(spark, items, docs, names=0).verbatim().collect()} == want


def test_renamed_slots_must_be_consistent(spark):
    items = [(1, "between 3 and 3 tests after 5 days the ward")]
    docs = [(1, "between 7 and 7 tests after 9 days the ward"), (2, "between 7 and 8 tests after 9 days the ward"), (3, items[0][1]), (4, "between 7 and 7 tests after 9 weeks the road")]
    got = {(r["doc"]): (r["verbatim"] > 0, r["renamed"] > 0) for r in run(spark, items, docs).by_slots().collect()}
    assert got == {1: (False, True), 3: (True, False)}


def test_empty(spark):
    assert run(spark, [], [(1, "x")]).verbatim().count() == 0
    assert run(spark, [(1, "a b c d e f g h i j k")], []).verbatim().count() == 0


def test_names_no_item_holds_are_slots(spark):
    items = [(1, "Mr Osmund said that the pain of the left arm began last spring."), (2, "Fenwold walks slowly now and the sister of Fenwold sees that it hurts.")]
    docs = [(1, "Mrs Tavra said that the pain of the left arm began last spring."), (2, "then Quillhay walks slowly now and the sister of Quillhay sees that it hurts."), (3, "Quillhay walks slowly now and the sister of Quillhay sees that it hurts."), (4, "Quillhay walks slowly now and the sister of Thornby sees that it hurts."), (5, items[0][1].upper())]
    got = {(r["item"], r["doc"]): (r["verbatim"], r["renamed"]) for r in run(spark, items, docs).by_slots().collect()}
    want = {(1, 1): (2, 1), (1, 5): (4, 0), (2, 2): (0, 4), (2, 3): (0, 4), (2, 4): (0, 3)}
    assert got == want
    assert {(r["item"], r["doc"]): (r["verbatim"], r["renamed"]) for r in run(spark, items, docs, names=1).by_slots().collect()} == want


def test_all_names_of_the_items_are_slots(spark):
    name = lambda i: "Q" + "".join(chr(97 + int(c)) for c in str(i)) + "z"
    items = [(i, "with " + " ".join(name(j) for j in range(i * 105, i * 105 + 105))) for i in range(100)] + [(900, f"the pain that made {name(9998)} of the ward stay at home")]
    docs = [(1, f"the pain that made {name(9997).lower()} of the ward stay at home")]
    got = {(r["item"], r["doc"]): r["renamed"] for r in run(spark, items, docs).by_slots().collect()}
    assert got == {(900, 1): 2}


def test_templates_of_slots_alone_join_by_their_equal_places(spark):
    items = [(1, "1 2 1 2 3 4 5 6 7 8"), (2, "9 8 7 6 5 4 3 2 1 0")]
    docs = [(1, "10 20 10 20 30 40 50 60 70 80"), (2, "1 2 3 4 5 6 7 8 9 10"), (3, "1 2 1 2 3 4 5 6 7 7"), (4, items[0][1])]
    leaks = run(spark, items, docs)
    assert {(r["item"], r["doc"]) for r in leaks.pairs(own_names=False).collect()} == {(1, 1), (2, 2), (1, 4)}
    assert {tuple(r) for r in leaks.by_slots().collect()} == {(1, 1, 0, 1), (2, 2, 0, 1), (1, 4, 1, 0)}


def test_a_full_sieve_only_costs(spark, monkeypatch):
    monkeypatch.setattr("lodestone.llm.leaks.sieve_of", lambda hashes: np.full(64, 2**64 - 1, np.uint64))
    items = [(1, "one two three four five six seven eight nine ten eleven")]
    docs = [(1, items[0][1].upper()), (2, "two of three or four in five at six to seven by eight")]
    assert {tuple(r) for r in run(spark, items, docs).verbatim().collect()} == {(1, 1)}
