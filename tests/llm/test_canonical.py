import random

import pytest

from lodestone.llm import canonical as C

TERMS = [("1", "Chronic renal stenosis", ["CRS", "Narrowing of the kidney"], "1"), ("2", "Retinal stenosis", [], "1"), ("3", "Renal stenosis", None, "1"), ("4", "Drug-induced oedema", ["DIO"], "1"), ("5", "Fingertip itching", [], "1"), ("6", "Finger itching", [], "0"), ("7", "Plantar haematoma", [], "1")]


def osa(a, b):
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_against_edit_distance():
    rng = random.Random(1)
    for _ in range(60):
        words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(3, 12))) for _ in range(30)})
        trie = C.Trie([(w, 0, [w]) for w in words])
        for _ in range(10):
            q = list(rng.choice(words))
            for _ in range(rng.randint(0, 3)):
                k = rng.randrange(len(q))
                q[k : k + rng.randint(0, 1)] = rng.choice(["x", "a", "b", "ca"])
            q = "".join(q)
            if len(q) < 4:
                continue
            got = {}
            trie._edited(q, 0.0, lambda ws, edits, slip: got.update({w: min(edits, got.get(w, 9)) for w in ws}))
            assert got == {w: d for w in words if (d := osa(q, w)) <= C.limit(len(q))}


def near(value, name, vocabulary):
    """The least distance of a value to a name of the list, over rotations; None beyond."""
    a, words = C.split_words(value), C.entry_words(name)
    best = []
    for turn in range(len(words)):
        b = words[turn:] + words[:turn]
        if len(a) == len(b):
            each = []
            for x, y in zip(a, b):
                y_forms = {y, *(y.replace(p, q) for p, q in C.SPELLINGS)}
                costs = [0.0] if x in y_forms else []
                costs += [0.1] if x + "s" in y_forms or len(x) > 3 and x.endswith("s") and x[:-1] in y_forms else []
                costs += [d for z in y_forms if (d := osa(x, z)) <= C.limit(len(x))]
                costs += [d + 0.1 for z in y_forms if x.endswith("s") and len(x) > 4 and (d := osa(x[:-1], z)) <= C.limit(len(x) - 1)]
                each.append(min(costs, default=None))
            if None not in each:
                best.append(sum(each))
    return round(min(best), 6) if best else None


@pytest.mark.parametrize("most", [C.ENTRIES, 5])
def test_all_entries_within_distance(spark, most):
    names = ["gastric ulcer", "gastrin ulcer", "gastric ulcers of mouth", "mouth gastric ulcer", "card", "cardiomyopathy", "edema", "oedema", "renal edema", "penal edema", "renal colic", "ulcer"]
    values = ["gastric ulcer", "ulcer gastric", "gastrix ulcer", "card", "edema", "oedemas", "renal oedema", "ulcers", "mouth ulcer gastric", "colic", "renal colics", "penal colic"]
    vocabulary = {w for n in names for w in C.entry_words(n)}
    want = {(v, n): d for v in values for n in names if (d := near(v, n, vocabulary)) is not None}
    entries = spark.createDataFrame([(n, 0, [n, None]) for n in names], "id string, rank int, names array<string>")
    found = C.all_matches(spark.createDataFrame([(v,) for v in values], "value string"), entries, abbreviations=False, most=most).collect()
    assert {(r["value"], r["entry"]): round(r["distance"], 6) for r in found if r["entry"]} == want
    assert want["gastric ulcer", "gastrin ulcer"] == 1
    naming = {(r["value"], r["entry"]) for r in found if r["naming"] is not None}
    assert ("gastric ulcer", "gastric ulcer") in naming and ("gastric ulcer", "gastrin ulcer") not in naming and ("gastrix ulcer", "gastrin ulcer") in naming
    assert ("penal colic", "renal colic") not in naming


@pytest.mark.parametrize("most", [C.ENTRIES, 2])
def test_names_placeholders_ties_and_shards(spark, monkeypatch, most):
    monkeypatch.setattr(C.all_matches, "__defaults__", (True, most))
    cases = [("chronic  RENAL stenosis (rare)", None, "1"), ("Stenosis, chronic renal", None, "1"), ("query crs", None, "1"), ("Retinal stenosis", None, None), ("Retnal stenosis", "3", "3"), ("Retnal stenosis", None, "2"), ("Chron. renal stenosiss", None, "1"), ("Druginduced edema", None, "4"), ("Drug-i. oedema", None, "4"), ("Fingertpi itching", None, "5"), ("Finger itching", None, "none"), ("Fnger itching", "5", "none"), ("Toe itching", None, "none"), ("plantar_hematomas", "1", "7"), ("n/a", " 00 3.0", "none"), ("?", "SCTID 7.0", "7"), ("unknown", "6", "none"), ("see notes", None, "none"), (None, "1", None), ("  ", "1", None), ("chronic stenosis", None, "none"), ("x" * 30_000, None, "none")]
    values = spark.createDataFrame([("t", str(i), n, c, "extra") for i, (n, c, _) in enumerate(cases)], "tbl string, row_id string, name string, code string, value string")
    terms = spark.createDataFrame(TERMS, "snomed string, term string, synonyms array<string>, active string")
    got = {r["row_id"]: r["mapped"] for r in C.map_values(values, terms).collect()}
    assert got == {str(i): want for i, (_, _, want) in enumerate(cases) if want is not None}


def test_empty_tables(spark):
    values = spark.createDataFrame([("t", "1", "renal stenosis", None)], "tbl string, row_id string, name string, code string")
    terms = spark.createDataFrame(TERMS, "snomed string, term string, synonyms array<string>, active string")
    assert C.map_values(values.limit(0), terms).count() == 0
    assert [r["mapped"] for r in C.map_values(values, terms.limit(0)).collect()] == ["none"]
