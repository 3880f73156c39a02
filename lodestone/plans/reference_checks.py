"""Problem 3 on the project's tables, and its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.orphans import orphan_report, orphans
from lodestone.sources.tables import table

#: Referring table, its row key, the referring column, target table, target key.
REFERENCES = (
    ("links", "link_id", "condition", "conditions", "slug"),
    ("links", "link_id", "symptom_id", "symptoms", "symptom_id"),
    ("presentation_causes", "cause_id", "presentation", "presentations", "slug"),
)


def _all(spark: SparkSession, folder: str) -> DataFrame:
    parts = []
    for tbl, row, field, target, key in REFERENCES:
        refs, to = table(spark, folder, tbl), table(spark, folder, target)
        number = dict(refs.dtypes)[field] != "string"
        found = orphans(
            refs, to, [(field, key)], row, at="loaded_at", valid=("added_at", "removed_at"),
            **({"key": lambda c: c.cast("bigint")} if number else {}),
        )
        parts.append(found.select(F.lit(tbl).alias("tbl"), F.lit(field).alias("field"), F.col("row_id").cast("bigint").alias("row_id"), "at", "reason"))
    return reduce(DataFrame.unionByName, parts)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _all(spark, folder).select("tbl", "field", "row_id")


def p3_report(spark: SparkSession, folder: str) -> DataFrame:
    """Orphans per table, field and month of loaded_at, with why."""
    return orphan_report(_all(spark, folder), ["tbl", "field"])


MODES = ("simple", "partial", "full")


def p3_composite(spark: SparkSession, folder: str) -> DataFrame:
    """A reference of two columns that may be null in part, symptom_matches (symptom_id, record.character) to symptoms_v2, by each MATCH."""
    m, v2 = table(spark, folder, "symptom_matches"), table(spark, folder, "symptoms_v2")
    refs = m.select(F.concat_ws(":", "query_id", "record_id", "symptom_id").alias("row_id"), "symptom_id", F.col("record.character").alias("character"))
    parts = [orphans(refs, v2, [("symptom_id", "symptom_id"), ("character", "character")], "row_id", match=mode).select(F.lit(mode).alias("mode"), "row_id", "mask", "reason") for mode in MODES]
    return reduce(DataFrame.unionByName, parts)


def _composite_sql() -> str:
    agree = "t.k0 = r.k0 AND t.k1 = r.k1"
    some = "(r.k0 IS NULL OR t.k0 = r.k0) AND (r.k1 IS NULL OR t.k1 = r.k1)"
    none = lambda on: f"NOT EXISTS (SELECT 1 FROM t WHERE {on})"
    both, either = "r.k0 IS NOT NULL AND r.k1 IS NOT NULL", "(r.k0 IS NOT NULL OR r.k1 IS NOT NULL)"
    row = "row_id, (k0 IS NOT NULL)::INT || '' || (k1 IS NOT NULL)::INT AS mask"
    trim = "lower(trim({0}, chr(9)||chr(10)||chr(13)||' '||chr(160)))"
    return f"""WITH r AS (SELECT DISTINCT concat_ws(':', query_id, record_id, symptom_id) AS row_id, symptom_id::VARCHAR AS k0, {trim.format('record.character')} AS k1 FROM symptom_matches),
t AS (SELECT symptom_id::VARCHAR AS k0, {trim.format('character')} AS k1 FROM symptoms_v2),
f AS (SELECT 'simple' AS mode, {row}, 'missing' AS reason FROM r WHERE {both} AND {none(agree)}
UNION ALL SELECT 'partial', {row}, 'missing' FROM r WHERE {either} AND {none(some)}
UNION ALL SELECT 'full', {row}, CASE WHEN {both} THEN 'missing' ELSE 'partial_null' END FROM r WHERE {either} AND (NOT ({both}) OR {none(agree)}))
SELECT mode, row_id, min(mask) AS mask, arg_min(reason, mask) AS reason FROM f GROUP BY 1, 2"""


def _rows_sql() -> str:
    parts = []
    for tbl, row, field, target, key in REFERENCES:
        parts.append(f"""
SELECT '{tbl}' AS tbl, '{field}' AS field, r.{row}::BIGINT AS row_id, min(r.loaded_at) AS seen_at,
       arg_min(CASE WHEN k.key IS NULL THEN 'missing' WHEN r.loaded_at < k.since THEN 'early' ELSE 'gone' END, r.loaded_at) AS reason
FROM {tbl} r
LEFT JOIN (SELECT lower(trim({key}::VARCHAR, chr(9)||chr(10)||chr(13)||' '||chr(160))) AS key, min(added_at) AS since
           FROM {target} WHERE {key} IS NOT NULL GROUP BY 1) k
  ON k.key = lower(trim(r.{field}::VARCHAR, chr(9)||chr(10)||chr(13)||' '||chr(160)))
WHERE r.{field} IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM {target} t
  WHERE lower(trim(t.{key}::VARCHAR, chr(9)||chr(10)||chr(13)||' '||chr(160))) = lower(trim(r.{field}::VARCHAR, chr(9)||chr(10)||chr(13)||' '||chr(160)))
    AND t.added_at <= r.loaded_at AND (t.removed_at IS NULL OR t.removed_at > r.loaded_at))
GROUP BY r.{row}""")
    return " UNION ALL ".join(parts)


QUERIES = {"p3_found": p3_found, "p3_report": p3_report, "p3_composite": p3_composite}
SQL = {
    "p3_found": f"SELECT tbl, field, row_id FROM ({_rows_sql()})",
    "p3_report": f"SELECT tbl, field, strftime(seen_at, '%Y-%m') AS month, reason, count(*) AS n_rows FROM ({_rows_sql()}) GROUP BY ALL",
    "p3_composite": _composite_sql(),
}
