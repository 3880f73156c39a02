"""Joins whose shape is chosen from measured sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows and bytes (of their text form) up to which a table may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 32_000_000


def small_or_shuffled(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it has at most that many rows and bytes, else as it is. It is measured, so hand it one that has been cut."""
    if df.limit(rows + 1).count() > rows:
        return df
    measured = df.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))), F.lit(0))).first()[0]
    return F.broadcast(df) if measured <= size else df


def shuffled_if_large(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a hint against broadcasting it if it has more than that many rows, else as it is.

    For stored tables of many rows: Spark takes their size from their files, which sorted ids and repeated words shrink to two
    bytes a row, and would build in the driver's memory what is many times as large there.
    """
    return df.hint("merge") if df.count() > rows else df


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, hot: int = 50_000, most: int = BROADCAST_ROWS, salts: int = 64) -> DataFrame:
    """Every row with the one row of groups that has its keys (none null).

    groups holds in `size` how many rows its key has. All are broadcast if they are measured small. Else keys with at least
    `hot` rows are joined first, so that no task gets a whole hot group: by broadcast where those are small, else with
    `salts` copies of each, over which rows are spread; all other rows go by an ordinary join. Hand it groups that have been
    cut: they are measured.
    """
    if (whole := small_or_shuffled(groups, most)) is not groups:
        return rows.join(whole, keys)
    is_hot = F.col(size) >= hot
    few, cold = groups.filter(is_hot), groups.filter(~is_hot)
    if (small := small_or_shuffled(few, most)) is not few:
        rest = rows.join(small.select(*keys), keys, "left_anti")
        return rows.join(small, keys).unionByName(rest.join(cold, keys))
    salt = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in rows.columns)), F.lit(salts)).cast("int")
    copies = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumn("_hot", F.lit(True))
    marked = rows.withColumn("_salt", salt).join(copies, [*keys, "_salt"], "left")
    done = marked.filter("_hot").drop("_salt", "_hot")
    return done.unionByName(marked.filter("_hot IS NULL").select(*rows.columns).join(cold, keys), allowMissingColumns=False)
