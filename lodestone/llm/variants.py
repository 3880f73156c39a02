"""Problem 1: records that differ only in formatting, collapsed with their number of copies.

Each row has a canonical key, made once in the JVM and stored with its 64-bit hash. Bloom filters of what occurs once and
repeatedly, split by range of hash and merged over the partitions (bloom.occurrences), tell possible repeats. Only those
are shuffled, grouped exactly by the whole key; all others are singletons and stay where they are. The input is read once
and the stored rows twice, whatever their number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import bag_of_words, key_rule
from lodestone.llm import bloom
from lodestone.session import stored
from lodestone.sources.tables import table

HOT = 50_000  # rows of a group for each of its salts

#: The fields of a record, in the order of its contract.
FIELDS = ("concept", "character", "site", "onset", "duration", "duration_text", "severity", "progression", "polarity")
RECORD = ", ".join(f"`{f}` string" for f in FIELDS) + ", _bad string"


def record_key(json: Column) -> Column:
    """Canonical key of a record in JSON: per field its words in sorted order, whatever the order of fields. Null where it is null, can't be parsed, isn't one object or has no word."""
    r = F.from_json(json, RECORD, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "allowSingleQuotes": "false"})
    bags = [F.coalesce(bag_of_words(r[f]), F.lit("")) for f in FIELDS]
    return F.when(r["_bad"].isNull(), F.nullif(F.concat_ws("\x1f", *bags), F.lit("\x1f" * (len(FIELDS) - 1))))


class Variants:
    """Rows of df by canonical key.

    df has the columns `by` (more parts of the key, as tbl; null means no copy), `id` (unique in them) and `key`. A row with
    a null key or by is a copy of nothing. Keys of any length are compared whole. Other columns of df are ignored. Empty
    tables give empty results; the order of rows and ties don't matter, since a group's representative is its smallest id;
    a row that is there twice with one id counts as two copies.
    """

    def __init__(self, df: DataFrame, by: list[str], id: str = "id", key: str = "key", per_range: int = bloom.PER_RANGE):
        self.by, self.keys = by, [*by, "_key"]
        rows = df.select(*by, F.col(id).alias("_id"), F.col(key).alias("_key"))
        usable = reduce(Column.__and__, (F.col(c).isNotNull() for c in self.keys))
        rows = stored(rows.withColumn("_h", F.when(usable, F.xxhash64(*self.keys))).withColumn("_src", F.spark_partition_id()))
        self.null = rows.filter(F.col("_h").isNull())
        self.rows = rows.filter(F.col("_h").isNotNull())
        self.rows = self.rows.withColumn("_n", bloom.occurrences(self.rows, "_src", "_h", per_range))
        self.repeats = stored(self.rows.filter(F.col("_n") > 1).select(*self.keys, "_id", "_n"))
        self.groups = self.repeats.groupBy(*self.keys).agg(F.min("_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.max("_n").alias("_n"))

    def collapsed(self) -> DataFrame:
        """One row per group and one per row without copies: by, rep (its smallest id), copies, key (null only where it was null)."""
        single = self.rows.filter(F.col("_n") == 1)
        alone = single.select(*self.by, F.col("_id").alias("rep"), F.lit(1).cast("bigint").alias("copies"), F.col("_key").alias("key"))
        never = self.null.select(*self.by, F.col("_id").alias("rep"), F.lit(1).cast("bigint").alias("copies"), F.lit(None).cast("string").alias("key"))
        return self.groups.select(*self.by, "rep", "copies", F.col("_key").alias("key")).unionByName(alone).unionByName(never)

    def surplus(self) -> DataFrame:
        """One row for each copy but the representative: by, rep, id. A group is spread over as many salts as it has times HOT rows, which a row's own count tells."""
        salts = F.ceil(F.col("_n") / HOT)
        many = self.groups.filter(F.col("copies") > 1).withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1)))
        rows = self.repeats.withColumn("_salt", F.pmod(F.xxhash64("_id"), salts)).drop("_n")
        return rows.join(many.drop("_n", "copies"), [*self.keys, "_salt"]).filter(F.col("_id") != F.col("rep")).select(*self.by, "rep", F.col("_id").alias("id"))


def project_rows(spark: SparkSession, folder: str) -> DataFrame:
    """(tbl, id, key) of the four tables that repeat themselves."""
    symptoms, v2 = table(spark, folder, "symptoms"), table(spark, folder, "symptoms_v2")
    causes, raw = table(spark, folder, "presentation_causes"), table(spark, folder, "raw_records")
    parts = (
        symptoms.select(F.lit("symptoms").alias("tbl"), F.col("symptom_id").cast("bigint").alias("id"), bag_of_words(F.col("canonical")).alias("key")),
        v2.select(F.lit("symptoms_v2").alias("tbl"), F.col("symptom_id").cast("bigint").alias("id"), bag_of_words(F.col("core_phrase")).alias("key")),
        causes.select(F.lit("presentation_causes").alias("tbl"), F.col("cause_id").alias("id"), F.concat(key_rule(F.col("presentation")), F.lit("\x1e"), bag_of_words(F.col("cause_name"))).alias("key")),
        raw.select(F.lit("raw_records").alias("tbl"), F.col("raw_id").alias("id"), record_key(F.col("json")).alias("key")),
    )
    return reduce(DataFrame.unionByName, parts)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return Variants(project_rows(spark, folder), ["tbl"]).surplus().select("tbl", F.col("rep").alias("id_a"), F.col("id").alias("id_b"))


def p1_collapsed(spark: SparkSession, folder: str) -> DataFrame:
    """Every record once, with its number of copies."""
    return Variants(project_rows(spark, folder), ["tbl"]).collapsed().select("tbl", F.col("rep").alias("id"), F.col("copies").alias("n_copies"))


def _bag(c: str) -> str:
    return f"array_to_string(list_sort(regexp_extract_all(lower(regexp_replace({c}, '[''’]', '', 'g')), '[\\p{{L}}\\p{{N}}]+')), ' ')"


_FIELDS = " || chr(31) || ".join("coalesce(" + _bag(f"json_extract_string(json, '$.{f}')") + ", '')" for f in FIELDS)
_ROWS = f"""
SELECT 'symptoms' AS tbl, symptom_id::BIGINT AS id, nullif({_bag('canonical')}, '') AS key FROM symptoms
UNION ALL SELECT 'symptoms_v2', symptom_id::BIGINT, nullif({_bag('core_phrase')}, '') FROM symptoms_v2
UNION ALL SELECT 'presentation_causes', cause_id, lower(trim(presentation, chr(9)||chr(10)||chr(13)||' '||chr(160))) || chr(30) || nullif({_bag('cause_name')}, '') FROM presentation_causes
UNION ALL SELECT 'raw_records', raw_id, CASE WHEN json_valid(json) THEN nullif(CASE WHEN json_valid(json) THEN {_FIELDS} END, repeat(chr(31), 8)) END FROM raw_records"""
QUERIES = {"p1_found": p1_found, "p1_collapsed": p1_collapsed}
SQL = {
    "p1_found": f"WITH r AS ({_ROWS}), g AS (SELECT tbl, id, min(id) OVER (PARTITION BY tbl, key) AS rep FROM r WHERE key IS NOT NULL) SELECT tbl, rep AS id_a, id AS id_b FROM g WHERE id <> rep",
    "p1_collapsed": f"WITH r AS ({_ROWS}) SELECT tbl, min(id) AS id, count(*) AS n_copies FROM r WHERE key IS NOT NULL GROUP BY tbl, key UNION ALL SELECT tbl, id, 1 FROM r WHERE key IS NULL",
}
