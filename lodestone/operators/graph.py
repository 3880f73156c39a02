"""Is-a graphs as edge tables (child, parent): closures, cycles and what follows from them."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import cut


MOST_PARTS = 8  # rounds kept apart before they are written as one


def edges_of(relationships: DataFrame, is_a: str) -> DataFrame:
    """Distinct (child, parent) of active is-a rows of a release table (active, sourceId, destinationId, typeId)."""
    return relationships.filter((F.col("active") == "1") & (F.col("typeId") == is_a)).select(F.col("sourceId").alias("child"), F.col("destinationId").alias("parent")).distinct()


def ancestors(edges: DataFrame, starts: DataFrame | None = None, depth: int | None = None) -> DataFrame:
    """(node, ancestor, depth): all ancestors of each start (column node; default: every child), by the shortest path.

    A node is its own ancestor only on a cycle. Each round joins only the pairs that are new, and drops those known, so a
    diamond isn't walked twice; it ends when a round finds nothing, or at `depth` where one is given. Null ends are no edges; repeated edges count once.
    """
    e = cut(edges.select("child", "parent").dropna().distinct())
    first = e.select(F.col("child").alias("node"), F.col("parent").alias("ancestor"))
    if starts is not None:
        first = first.join(starts.select("node").distinct(), "node", "left_semi")
    new = cut(first.withColumn("depth", F.lit(1)))
    rounds = [new]
    for step in count(2) if depth is None else range(2, depth + 1):
        found = new.join(e.withColumnRenamed("child", "ancestor"), "ancestor").select("node", F.col("parent").alias("ancestor")).distinct()
        for known in rounds:  # each round is written once; what is known is the union of them
            found = found.join(known, ["node", "ancestor"], "left_anti")
        new = cut(found.withColumn("depth", F.lit(step)))
        if not new.limit(1).count():
            break
        rounds.append(new)
        if len(rounds) > MOST_PARTS:
            rounds = [cut(reduce(DataFrame.unionByName, rounds))]
    return reduce(DataFrame.unionByName, rounds)


def descendants(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, descendant, depth) below each root (column node)."""
    turned = edges.select(F.col("parent").alias("child"), F.col("child").alias("parent"))
    return ancestors(turned, roots).withColumnRenamed("ancestor", "descendant")


def on_cycles(edges: DataFrame) -> DataFrame:
    """Nodes that are on a cycle: what is left after peeling off nodes without parents or children, if it reaches itself."""
    e = cut(edges.select("child", "parent").dropna().distinct())
    while True:
        inner = e.join(e.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi").join(e.select(F.col("parent").alias("child")).distinct(), "child", "left_semi")
        less = cut(inner)
        if less.count() == e.count():
            break
        e = less
    return ancestors(e).filter(F.col("node") == F.col("ancestor")).select("node")


def missing_parents(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose parent is no node."""
    return edges.dropna().join(nodes.select(F.col("node").alias("parent")), "parent", "left_anti").select("child", "parent").distinct()


def first_bucket(closure: DataFrame, nodes: DataFrame, ordered: DataFrame, default: str = "unclassified") -> DataFrame:
    """(node, bucket): of the ordered buckets (ancestor, bucket, ord) the first that a node is below."""
    hit = closure.join(F.broadcast(ordered), "ancestor").groupBy("node").agg(F.min_by("bucket", "ord").alias("bucket"))
    return nodes.select("node").join(hit, "node", "left").select("node", F.coalesce("bucket", F.lit(default)).alias("bucket"))


def shared_ancestors(closure: DataFrame, leaves: DataFrame, k: int = 30) -> DataFrame:
    """(ancestor, n): ancestors over at least two but not all of the leaves (column node), most first."""
    total = F.broadcast(leaves.agg(F.countDistinct("node").alias("total")))
    n = closure.join(leaves.select("node").distinct(), "node", "left_semi").groupBy("ancestor").agg(F.countDistinct("node").alias("n"))
    return n.join(total).filter("n >= 2 AND n < total").orderBy(F.desc("n"), "ancestor").limit(k).select("ancestor", "n")
