"""Exact search over vectors: cosine, blocked top-k, centroids, density and greedy clusters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.session import cut

BLOCK = 8_192
CLUSTER_AT = 0.88  # fixed value


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision, rounded to 6 decimals."""
    return F.round(dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), 6)


def usable(df: DataFrame, id: str, vec: str) -> DataFrame:
    """(id, vec) of the rows with a vector that is neither null nor all zero."""
    return df.select(F.col(f"`{id}`").cast("bigint").alias("id"), F.col(f"`{vec}`").alias("vec")).filter(F.exists("vec", lambda x: x != 0))


def _unit(vecs: pd.Series) -> np.ndarray:
    x = np.stack(vecs.to_numpy()).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _scan(k: int | None, least: float):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        q, r = group[group["asked"]], group[~group["asked"]]
        if not len(q) or not len(r):
            return pd.DataFrame({"id": np.zeros(0, np.int64), "other": np.zeros(0, np.int64)})
        r = r.sort_values("id")
        x, y, qi, ri = _unit(q["vec"]), _unit(r["vec"]), q["id"].to_numpy(), r["id"].to_numpy()
        ids, others = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo in range(0, len(x), 512):
            s = np.round(x[lo : lo + 512] @ y.T, 6)
            s[qi[lo : lo + 512][:, None] == ri] = -2
            if k is None:
                a, b = np.nonzero(s >= least - 2e-6)
                ids.append(qi[lo + a])
                others.append(ri[b])
                continue
            n = min(k, len(ri))
            bound = np.partition(s, len(ri) - n, axis=1)[:, len(ri) - n]
            for row, (line, edge) in enumerate(zip(s, bound)):
                at = np.flatnonzero(line >= max(edge, least) - 2e-6)  # near ties are decided on exact values
                at = at[np.argsort(-line[at], kind="stable")][: max(n, 4 * k)]
                at = at[line[at] > -2]
                ids.append(np.full(len(at), qi[lo + row]))
                others.append(ri[at])
        return pd.DataFrame({"id": np.concatenate(ids), "other": np.concatenate(others)})

    return run


def candidates(asked: DataFrame, rows: DataFrame, k: int | None, least: float = -2.0) -> DataFrame:
    """(id, other): for each asked vector the k best others (None: all) of at least that cosine, near ties included.

    Both have id, vec. A stated set of vectors is compared with all in a grid of blocks, each a task of bounded size.
    """
    blocks = max(1, -(-asked.count() // BLOCK)), max(1, -(-rows.count() // (2 * BLOCK)))
    block = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")
    q = asked.select(F.lit(True).alias("asked"), "id", "vec", block(blocks[0], 1).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(blocks[1] - 1))).alias("rb"))
    r = rows.select(F.lit(False).alias("asked"), "id", "vec", F.explode(F.sequence(F.lit(0), F.lit(blocks[0] - 1))).alias("qb"), block(blocks[1], 2).alias("rb"))
    return q.unionByName(r).groupBy("qb", "rb").applyInPandas(_scan(k, least), "id bigint, other bigint")


def top_k(asked: DataFrame, rows: DataFrame, k: int, least: float = -2.0) -> DataFrame:
    """(id, other, cosine, rank): the k most similar other rows of each asked one, ties to the smaller id, then those of at least `least`."""
    pairs = candidates(asked, rows, k).join(asked.select("id", F.col("vec").alias("va")), "id").join(rows.select(F.col("id").alias("other"), F.col("vec").alias("vb")), "other")
    scored = pairs.select("id", "other", cosine(F.col("va"), F.col("vb")).alias("cosine"))
    w = Window.partitionBy("id").orderBy(F.desc("cosine"), "other")
    best = scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return best.filter(F.col("cosine") >= least)


def centroids(df: DataFrame, label: str, vec: str) -> DataFrame:
    """(label, vec): mean of the unit vectors of each label, element by element, so that no task holds a label's vectors."""
    unit = df.select(F.col(label).alias("label"), F.transform(vec, lambda x: x.cast("double") / F.sqrt(dot(F.col(vec), F.col(vec)))).alias("u"))
    parts = unit.select("label", F.posexplode("u").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    return parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("vec"))


def density(rows: DataFrame) -> DataFrame:
    """(id, density): sum of the cosines of each row with all, itself included; the sum of all unit vectors is enough for that."""
    unit = rows.select("id", F.transform("vec", lambda x: x.cast("double") / F.sqrt(dot(F.col("vec"), F.col("vec")))).alias("u"))
    sums = unit.select(F.posexplode("u").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))
    whole = sums.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("s"))  # one row, one element per dimension
    return unit.join(F.broadcast(whole)).select("id", F.round(dot(F.col("u"), F.col("s")), 6).alias("density"))


def greedy_clusters(rows: DataFrame, least: float = CLUSTER_AT) -> DataFrame:
    """(id, seed): single-pass greedy clusters, densest first, ties to the smaller id.

    Going through the rows in that order, a row joins the best-placed seed within the threshold or becomes a seed. That is
    the lexicographically first maximal independent set of the threshold graph, found in rounds: an undecided row with no
    undecided neighbour before it becomes a seed, its neighbours are decided. Each round's state is cut; rounds are few
    since whole neighbourhoods are decided at once.
    """
    pairs = candidates(rows, rows, None, least).join(rows.select("id", F.col("vec").alias("va")), "id").join(rows.select(F.col("id").alias("other"), F.col("vec").alias("vb")), "other")
    place = cut(density(rows).select("id", F.struct((-F.col("density")).alias("d"), F.col("id").alias("i")).alias("p")))
    edges = pairs.filter(cosine(F.col("va"), F.col("vb")) >= least).select("id", "other")
    edges = cut(edges.join(place, "id").join(place.select(F.col("id").alias("other"), F.col("p").alias("op")), "other"))
    undecided, seeds = place, None
    while True:
        before = edges.filter("op < p").join(undecided.select(F.col("id").alias("other")), "other", "left_semi").select("id").distinct()
        new = cut(undecided.join(before, "id", "left_anti"))
        if not new.limit(1).count():
            break
        seeds = new if seeds is None else cut(seeds.unionByName(new))
        gone = edges.join(new.select(F.col("id").alias("other")), "other", "left_semi").select("id").distinct()
        undecided = cut(undecided.join(new, "id", "left_anti").join(gone, "id", "left_anti"))
    if seeds is None:
        return place.select("id", F.col("id").alias("seed"))
    near = edges.join(seeds.select(F.col("id").alias("other")), "other", "left_semi").filter("op < p").groupBy("id").agg(F.min_by("other", "op").alias("seed"))
    return place.select("id").join(near.join(seeds, "id", "left_anti"), "id", "left").select("id", F.coalesce("seed", "id").alias("seed"))
