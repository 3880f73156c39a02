import pytest
from pyspark.sql import functions as F

from lodestone.llm import identifiers as I

GIVEN, SURNAMES = ["Osmund", "Pellina", "Tavra", "Ysolt"], ["Brackmoor", "Fenwold", "Thornby", "Quillhay"]


@pytest.fixture(scope="module")
def found(spark):
    texts = []
    for i, (g, s) in enumerate((g, s) for g in GIVEN for s in SURNAMES):
        texts += [f"Dear Dr {g} {s},\nplease call +44 7700 900 {100 + i} today.", f"Next of kin is {g} {s}. Ring +44 7700 900 {200 + i} after six.", f"Signed, {s}, {g}\nThe rash is sore.", f"ID QQ 12 34 {10 + i} C\nnoted.", f"Our patient QQ 12 35 {10 + i} C was seen.", f"Card: QQ 12 36 {10 + i} C", f"ID RK00{10000 + i} x", f"Our patient RK00{20000 + i} x", f"Card: RK00{30000 + i} x", f"Kit lot 42{i} 19 2.", f"Home: {i + 1} Marl Street, Tolmoor, ZZ{i % 9 + 1} 3QX."]
    texts += ["Next of kin is osmund fenwold.", "Rowan Ward is open to visitors.", "mail <a.b+c@mail.tolmoor.test>, or x (at) tolmoor (dot) example.", "we moved to flat 4, 77b marl street\nTolmoor last year", "ID checked (RK0099999) here", "Take 3 tablets @ 80 mg, max 8060 mg per day.", "On 12/03/2024 at 8:30", None, "", "no names " * 50_000]
    df = spark.createDataFrame([(i, t, "extra") for i, t in enumerate(texts)] + [(None, "Dear Dr X", "extra")], "doc_id bigint, text string, kind string")
    x = I.Identifiers(df)
    return texts, x


def test_values(spark, found):
    texts, x = found
    by = {}
    for r in x.found().collect():
        assert r["value"] in texts[r["id"]]
        by.setdefault(texts[r["id"]], set()).add((r["kind"], r["value"]))
    assert by["Next of kin is Osmund Fenwold. Ring +44 7700 900 201 after six."] == {("name", "Osmund Fenwold"), ("phone", "+44 7700 900 201")}
    assert by["Next of kin is osmund fenwold."] == {("name", "osmund fenwold")}
    assert by["Signed, Thornby, Tavra\nThe rash is sore."] == {("name", "Thornby, Tavra")}
    assert by["ID checked (RK0099999) here"] == {("id_number", "RK0099999")}
    assert by["mail <a.b+c@mail.tolmoor.test>, or x (at) tolmoor (dot) example."] == {("email", "a.b+c@mail.tolmoor.test"), ("email", "x (at) tolmoor (dot) example")}
    assert by["we moved to flat 4, 77b marl street\nTolmoor last year"] == {("address", "flat 4, 77b marl street\nTolmoor")}
    for t in ("Rowan Ward is open to visitors.", "Kit lot 421 19 2.", "Take 3 tablets @ 80 mg, max 8060 mg per day.", "On 12/03/2024 at 8:30"):
        assert t not in by


def test_redaction_leaves_the_rest(spark, found):
    texts, x = found
    got = {r["id"]: r["text"] for r in x.redacted().collect()}
    assert set(got) == set(range(len(texts)))
    assert got[1] == "Next of kin is [NAME]. Ring [PHONE] after six." and got[texts.index(None)] is None and got[len(texts) - 1] == texts[-1]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert I.Identifiers(df).found().count() == 0 and I.Identifiers(df).redacted().count() == 0


def test_lists_beyond_the_broadcast_are_whole(spark, found):
    texts, x = found
    want = {tuple(r) for r in x.found().collect()}
    many = spark.range(I.LEXICON + 1).select(F.concat(F.lit("zz"), F.col("id").cast("string")).alias("key"), F.lit(10**6).cast("bigint").alias("n"))
    more = {
        "patterns": many.select(F.lit("name").alias("family"), F.col("key").alias("pattern"), F.lit("name").alias("kind"), F.lit(1.0).alias("precision"), F.col("n").alias("support")),
        "instances": many.select(F.explode(F.array(*map(F.lit, ("name", "code", "street", "town")))).alias("family"), F.col("key").alias("instance"), F.lit("name").alias("kind"), "n"),
        "usual": many.select(F.col("key").alias("instance"), "n"),
        "untitled": many.limit(0).select(F.col("key").alias("pattern"), "n"),
    }
    y = I.Identifiers(x.all, "id")
    y.tables = {k: v.select(*more[k].columns).unionByName(more[k]) for k, v in x.tables.items()}
    assert {tuple(r) for r in y.found().collect()} == want


def test_addresses_of_rare_kinds_and_towns(spark, found):
    _, x = found
    texts = ["Write to 14 Ashen Wynd, Farhollow, QX7 2ZB today.", "Flat 2, 9 Long Ashen Wynd\nFar Hollow QX7 2ZB", "Home: 8 Marl Street, Farhollow QX7 2ZB.", "we moved to 8 marl street, far hollow, qx7 2zb in may", "We met at 8 Marl Street, Tolmoor in May.", "from 8 marl street to 20 beds"]
    finder = I.Finder(I.Learned(x.tables))
    got = [[t[a:b] for a, b, kind in finder.spans(t) if kind == "address"] for t in texts]
    assert got == [["14 Ashen Wynd, Farhollow, QX7 2ZB"], ["Flat 2, 9 Long Ashen Wynd\nFar Hollow QX7 2ZB"], ["8 Marl Street, Farhollow QX7 2ZB"], ["8 marl street, far hollow, qx7 2zb"], ["8 Marl Street, Tolmoor"], ["8 marl street"]]


def test_names_after_a_title_are_whole(spark, found):
    _, x = found
    learned = I.Learned(x.tables)
    learned.lists["usual"] |= {w: "" for w in ("brown", "she", "called", "came")}
    finder = I.Finder(learned)
    want = {
        "Seen by Dr Ng today.": ["Ng"], "Seen by Dr Mei Li, who left.": ["Mei Li"], "Dear Mrs Brown,": ["Brown"], "Dear Mrs de Souza and Mr J. van der Brown.": ["de Souza", "J. van der Brown"],
        "Ask Prof. Dr. Ana Maria Lopes Vidal Brown Quist today": ["Ana Maria Lopes Vidal Brown Quist"], "MR BROWN CALLED": ["BROWN"], "THE NURSE CAME": [], "Ask my sister. She called.": [],
        "Next of kin is Osmund de Fenwold.": ["Osmund de Fenwold"], "brown phlegm": [], "Dr Brown and Dr Ng": ["Brown", "Ng"],
    }
    assert {t: [t[a:b] for a, b, kind in finder.spans(t) if kind == "name"] for t in want} == want


def test_signs_kinds_and_titles_come_from_the_graph(spark):
    texts = [f"Write to jane.{i}@mail.test soon." for i in range(3)] + [f"Write to tom{i}[at]mail.test soon." for i in range(2)] + ["Set x[at]y.test now"]
    texts += [f"Lives at {i} Marl Street, Tolmoor, ZZ{i} 3QX." for i in range(1, 5)] + ["Lives at 7 Old Mill Drift, Tolmoor.", "Lives at 9 New Mill Drift, Wexby."]
    texts += [f"Sister Thing{i} came" for i in range(30)] + [f"Thing{i} is a thing{i}, thing{i} as thing{i} are, thing{i}" for i in range(30) for _ in range(40)]
    x = I.Identifiers(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))
    got = {(r["kind"], r["value"]) for r in x.found().collect()}
    assert {("email", "tom1[at]mail.test"), ("email", "jane.2@mail.test"), ("address", "7 Old Mill Drift, Tolmoor"), ("address", "3 Marl Street, Tolmoor, ZZ3 3QX")} <= got
    alone = I.Identifiers(spark.createDataFrame([(1, "Set x[at]y.test now"), (2, "Lives at 7 Old Mill Drift, Tolmoor.")], "doc_id int, text string"))
    assert alone.found().count() == 0


def test_context_of_any_length():
    assert I.before("call " + " " * 500 + "0", 505) == "call" and I.before("one two, " + "-" * 400 + "x", 409) == "one two" and I.before("a" * 300 + " b x", 303) == "a" * 300 + " b"
