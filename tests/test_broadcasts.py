"""Stored links of many rows are never built in the driver, however small their files are."""

import pytest
from pyspark.sql import functions as F

from lodestone.plans import corpus as C

ROWS, CONDITIONS = 120_000, 40


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Links whose stored form has some bytes a row; the phrases of their symptoms take more."""
    at = str(tmp_path_factory.mktemp("tables"))
    spark.range(ROWS).select(F.col("id").alias("link_id"), F.concat(F.lit("c"), F.col("id") % CONDITIONS).alias("condition"), (F.col("id") / CONDITIONS).cast("int").alias("symptom_id")).write.parquet(f"{at}/links.parquet")
    phrase = F.concat(*(F.sha2(F.concat("id", F.lit(f"-{i}")), 512) for i in range(8)))
    spark.range(ROWS // CONDITIONS).select(F.col("id").cast("int").alias("symptom_id"), phrase.alias("canonical")).write.parquet(f"{at}/symptoms.parquet")
    spark.range(CONDITIONS).select(F.concat(F.lit("c"), "id").alias("slug")).write.parquet(f"{at}/conditions.parquet")
    return at


def broadcast_scans(df):
    """The scans of stored tables under a broadcast in df's plan."""
    found, inside = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = len(line) - len(line.lstrip(" :+-*()0123456789"))
        if inside is not None and depth <= inside:
            inside = None
        if inside is None and "BroadcastExchange" in line:
            inside = depth
        if inside is not None and "FileScan" in line and "lodestone-" in line:
            found.append(line.strip())
    return found


def test_pairs_of_conditions(spark, folder):
    assert not broadcast_scans(C.q_pairs(spark, folder))


def test_lists_of_symptoms(spark, folder):
    assert not broadcast_scans(C.q_lists(spark, folder))


@pytest.mark.parametrize("query", [C.q_lists, C.q_poc_hard])
def test_what_is_stored_on_the_way(spark, folder, monkeypatch, query):
    made, found, store = [], [], C.stored

    def stored(df):
        found.extend(x for x in broadcast_scans(df) if "symptom_id" in x)  # conditions alone are read for their number, one row
        made.append(df)
        return store(df)

    monkeypatch.setattr(C, "stored", stored)
    monkeypatch.setattr(C.R, "narrow", lambda opening, *rest, **kw: opening.withColumn("score", F.lit(0.0)))
    query(spark, folder)
    assert len(made) == 2 and not found


@pytest.mark.parametrize("interview", [C.q_poc, C.q_poc_hard])
def test_replies_of_interviews(spark, folder, monkeypatch, interview):
    seen = []

    def narrow(opening, said, l, norms, reply, **kw):
        seen.append(reply(said))
        return opening

    monkeypatch.setattr(C.R, "narrow", narrow)
    interview(spark, folder)
    assert len(seen) == 1 and not broadcast_scans(seen[0])


def test_two_systems(spark, folder):
    assert not broadcast_scans(C.q_two(spark, folder))


def test_bare_names_have_no_outer_blanks(spark):
    rows = [("Dull ache in the arm", "dull ache"), (" Cough\u00a0", "cough"), ("\u3000Itch\u00a0 in the ear", "itch"), ("\ncold", "\ncold")]
    got = spark.createDataFrame(rows, "canonical string, name string").select(C.bare_name(F.col("canonical")).alias("a"), "name").collect()
    assert [r["a"] for r in got] == [r["name"] for r in got]
