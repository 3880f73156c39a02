"""A vector index in a folder: unit vectors with their ids, and a digest of the vocabulary they were made from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.terminology import content_digest
from lodestone.operators.vectors import dot, usable


class StaleIndex(RuntimeError):
    """The vocabulary isn't the one the index was made from."""


def _digest(phrases: DataFrame) -> tuple:
    return tuple(content_digest(phrases, "phrase", "id").first())


def save(rows: DataFrame, path: str) -> None:
    """Writes an index of (id, phrase, vec); rows without a usable vector are left out of it but belong to the vocabulary."""
    unit = F.transform("vec", lambda x: (x / F.sqrt(dot(F.col("vec"), F.col("vec")))).cast("float"))
    usable(rows, "id", "vec").select("id", unit.alias("vec")).write.mode("overwrite").parquet(f"{path}/vectors")
    n, digest = _digest(rows)
    rows.sparkSession.createDataFrame([(n, digest)], "n_rows bigint, digest string").coalesce(1).write.mode("overwrite").parquet(f"{path}/vocabulary")


def load(spark: SparkSession, path: str, phrases: DataFrame) -> DataFrame:
    """(id, vec) of the index in a folder, for vectors.top_k; StaleIndex unless phrases (id, phrase) are those it was made from, each under its id."""
    have = tuple(spark.read.parquet(f"{path}/vocabulary").first())
    if have != _digest(phrases):
        raise StaleIndex(f"the vocabulary changed since the index in {path} was made")
    return spark.read.parquet(f"{path}/vectors")
