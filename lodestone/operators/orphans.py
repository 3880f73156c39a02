"""References to records that don't exist: anti-joins by null mask, with validity in time.

A reference is one or more columns that together name a row of another table. Its columns may be null in part; rows are
grouped by which are null (the mask), and each mask is checked on its own non-null columns, as the declared MATCH says:

    simple   a reference with any null is not checked (SQL's default)
    partial  the non-null columns must agree with some target row; all null is not checked
    full     all null is not checked, null in part is an orphan, else all columns must agree

With `at` and `valid` a target counts only if valid_from <= at and (valid_to is null or valid_to > at). A null `at` or a
null valid_from never satisfies that.

What is shuffled: not the referring rows, but their distinct keys per mask with the first and last time each is used, which
Spark combines before the shuffle, so that a key with a third of all rows is one row by then. Keys whose every use a single
target row covers are done. Only rows with one of the other keys are looked at again, one by one; a key that many of them
have is spread. The referring table is read twice, whatever the number of masks.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import key_rule
from lodestone.operators.joins import join_groups, small_or_shuffled
from lodestone.session import cut

FOREVER = "9999-12-31 23:59:59"


def orphans(
    refs: DataFrame,
    targets: DataFrame,
    on: list[tuple[str, str]],
    row_id: str,
    at: str | None = None,
    valid: tuple[str, str] | None = None,
    match: str = "simple",
    key: Callable[[Column], Column] = key_rule,
) -> DataFrame:
    """The rows of refs without a target, as (row_id, at, mask, reason), each row_id once.

    on: pairs of a column of refs and the column of targets it names. mask: a 1 for each non-null column, in that order.
    reason: missing (no such key at all), early (before any target with that key), gone (a key that exists or existed,
    but not then), partial_null. Without at: at is null, reason missing or partial_null.
    Empty tables: no refs, no orphans; no targets, every checked reference is one. Extra columns are ignored, whatever
    their names. Repeated refs (same row_id) come out once if any of them is an orphan; the earliest is kept.
    """
    if match not in ("simple", "partial", "full"):
        raise ValueError(f"match must be simple, partial or full, not {match!r}")
    n = len(on)
    timed = at is not None and valid is not None
    keys = [f"k{i}" for i in range(n)]
    r = refs.select(
        F.col(f"`{row_id}`").alias("row_id"),
        (F.col(f"`{at}`").cast("timestamp") if timed else F.lit(None).cast("timestamp")).alias("at"),
        *(key(F.col(f"`{a}`")).alias(k) for k, (a, _) in zip(keys, on)),
    )
    r = r.withColumn("mask", F.concat(*(F.when(F.col(k).isNull(), "0").otherwise("1") for k in keys)))
    since, until = (F.col(f"`{c}`").cast("timestamp") for c in valid) if timed else (F.lit("0001-01-01").cast("timestamp"), F.lit(None))
    t = targets.select(
        since.alias("since"),
        F.coalesce(until.cast("timestamp"), F.lit(FOREVER).cast("timestamp")).alias("until"),
        *(key(F.col(f"`{b}`")).alias(k) for k, (_, b) in zip(keys, on)),
    )
    whole, nothing = "1" * n, "0" * n
    looked_up = [whole] if match != "partial" else ["".join(bits) for bits in product("10", repeat=n) if "1" in bits]
    found = _unmatched(r, t, keys, looked_up, timed)
    if match == "full" and n > 1:
        found = found.unionByName(r.filter(~F.col("mask").isin(whole, nothing)).select("row_id", "at", "mask", F.lit("partial_null").alias("reason")))
    first = found.groupBy("row_id").agg(F.min(F.struct("at", "mask", "reason")).alias("x"))
    return first.select("row_id", "x.at", "x.mask", "x.reason")


def _unmatched(refs: DataFrame, targets: DataFrame, keys: list[str], masks: list[str], timed: bool) -> DataFrame:
    """refs of these masks without a target that agrees in the mask's columns, as (row_id, at, mask, reason)."""
    uses = refs.filter(F.col("mask").isin(masks)).groupBy("mask", *keys)
    uses = uses.agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count_if(F.col("at").isNull()).alias("undated"), F.count(F.lit(1)).alias("size"))
    uses = cut(uses) if len(masks) > 1 else uses
    parts, spans = [], {}
    for mask in masks:
        some = [k for k, bit in zip(keys, mask) if bit == "1"]
        u = uses.filter(F.col("mask") == mask)
        t = spans[mask] = targets.dropna(subset=some).groupBy(*some, "since").agg(F.max("until").alias("until"))
        covered = reduce(Column.__and__, (u[k] == t[k] for k in some))
        if timed:
            covered &= (t["since"] <= u["first"]) & (t["until"] > u["last"]) & (u["undated"] == 0)
        known = t.groupBy(*some).agg(F.min("since").alias("since"), F.lit(True).alias("known"))
        parts.append(u.join(t, covered, "left_anti").select("mask", *keys, "size").join(known, some, "left").select("mask", *keys, "size", "since", "known"))
    # one column for mask and keys, in which nulls are equal
    of = F.struct("mask", *keys).alias("_of")
    doubtful = cut(reduce(DataFrame.unionByName, parts).select(of, "size", "since", "known"))
    rows = join_groups(refs.filter(F.col("mask").isin(masks)).select("row_id", "at", "mask", *keys, of), doubtful, ["_of"], "size").drop("_of", "size")
    if not timed:
        return rows.select("row_id", "at", "mask", F.lit("missing").alias("reason"))
    rows = cut(rows)
    out = []
    for mask in masks:
        own = [k for k, bit in zip(keys, mask) if bit == "1"]
        some = rows.filter(F.col("mask") == mask)
        t = spans[mask]
        t = small_or_shuffled(cut(t.join(doubtful.filter(F.col("_of.mask") == mask).select(*(F.col(f"_of.{k}").alias(k) for k in own)), own, "left_semi")))
        valid_then = reduce(Column.__and__, (some[k] == t[k] for k in own)) & (t["since"] <= some["at"]) & (t["until"] > some["at"])
        reason = F.when(F.col("known").isNull(), "missing").when(F.col("at") < F.col("first"), "early").otherwise("gone")
        out.append(some.withColumnRenamed("since", "first").join(t, valid_then, "left_anti").select("row_id", "at", "mask", reason.alias("reason")))
    return reduce(DataFrame.unionByName, out)


def orphan_report(found: DataFrame, by: list[str]) -> DataFrame:
    """Counts of orphans per the given columns, month of `at` (null where it is null) and reason."""
    month = F.date_format(F.date_trunc("month", "at"), "yyyy-MM").alias("month")
    return found.groupBy(*by, month, "reason").agg(F.count(F.lit(1)).alias("n_rows"))
