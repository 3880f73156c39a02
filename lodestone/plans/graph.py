"""Graph queries: customers and suppliers below nations below regions; a customer's market segment is its second parent."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import graph as G
from lodestone.operators import terminology as T
from lodestone.sources.tables import table

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


def edges(spark, d) -> DataFrame:
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    t = {n: table(spark, d, n) for n in ("customer", "supplier", "nation")}
    parts = (
        t["customer"].select(key("C", "c_custkey").alias("child"), key("N", "c_nationkey").alias("parent")),
        t["customer"].select(key("C", "c_custkey").alias("child"), key("M", "c_mktsegment").alias("parent")),
        t["supplier"].select(key("S", "s_suppkey").alias("child"), key("N", "s_nationkey").alias("parent")),
        t["nation"].select(key("N", "n_nationkey").alias("child"), key("R", "n_regionkey").alias("parent")),
    )
    return reduce(DataFrame.unionByName, parts).dropna().distinct()


E = """WITH RECURSIVE e AS (SELECT DISTINCT * FROM (SELECT 'C' || c_custkey AS child, 'N' || c_nationkey AS parent FROM customer UNION ALL SELECT 'C' || c_custkey, 'M' || c_mktsegment FROM customer
  UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey FROM supplier UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation) WHERE child IS NOT NULL AND parent IS NOT NULL)"""
A = f"{E}, a AS (SELECT child AS node, parent AS ancestor FROM e UNION SELECT a.node, e.parent FROM a JOIN e ON e.child = a.ancestor)"


@query("dag_edges", f"{E} SELECT * FROM e")
def q_edges(spark, d):
    return edges(spark, d)


@query("dag_ancestors", f"{A} SELECT * FROM a")
def q_ancestors(spark, d):
    return G.ancestors(edges(spark, d)).select("node", "ancestor")


@query("dag_descendants", f"{A} SELECT ancestor AS node, node AS descendant FROM a WHERE ancestor LIKE 'R%'")
def q_descendants(spark, d):
    e = edges(spark, d)
    roots = e.filter(F.col("parent").startswith("R")).select(F.col("parent").alias("node")).distinct()
    return G.descendants(e, roots).select("node", "descendant")


LOOP = [("X1", "X2"), ("X2", "X3"), ("X3", "X1"), ("X4", "X1"), ("X1", "R0")]


@query("dag_cycles", f"{E}, f AS (SELECT * FROM e UNION SELECT * FROM (VALUES {', '.join(map(str, LOOP))}) t(child, parent)), a AS (SELECT child AS node, parent AS ancestor FROM f UNION SELECT a.node, f.parent FROM a JOIN f ON f.child = a.ancestor) SELECT node FROM a WHERE node = ancestor")
def q_cycles(spark, d):
    """A loop of three nodes is added to the graph."""
    return G.on_cycles(edges(spark, d).unionByName(spark.createDataFrame(LOOP, "child string, parent string")))


BUCKETS = [("R0", "first region", 1), ("MBUILDING", "builders", 2), ("R2", "third region", 3)]


@query("ancestor_bucket", f"{A}, b AS (SELECT * FROM (VALUES {', '.join(map(str, BUCKETS))}) t(ancestor, bucket, ord)), h AS (SELECT node, arg_min(bucket, ord) AS bucket FROM a JOIN b USING (ancestor) GROUP BY 1) SELECT n.node, coalesce(h.bucket, 'unclassified') AS bucket FROM (SELECT DISTINCT child AS node FROM e) n LEFT JOIN h USING (node)")
def q_bucket(spark, d):
    e = edges(spark, d)
    return G.first_bucket(G.ancestors(e), e.select(F.col("child").alias("node")).distinct(), spark.createDataFrame(BUCKETS, "ancestor string, bucket string, ord int"))


@query("closure_kind", f"{A} SELECT n.node, CASE WHEN EXISTS (SELECT 1 FROM a WHERE a.node = n.node AND a.ancestor = 'R1') THEN 'inside' ELSE 'outside' END AS kind FROM (SELECT DISTINCT child AS node FROM e) n")
def q_kind(spark, d):
    e = edges(spark, d)
    inside = G.descendants(e, spark.createDataFrame([("R1",)], "node string")).select(F.col("descendant").alias("node"), F.lit("inside").alias("kind"))
    return e.select(F.col("child").alias("node")).distinct().join(inside, "node", "left").select("node", F.coalesce("kind", F.lit("outside")).alias("kind"))


@query("subsumption_pairs", f"{A}, c AS (SELECT 'N' || n_nationkey AS node, n_name AS name FROM nation UNION ALL SELECT 'R' || r_regionkey, r_name FROM region) SELECT x.name AS narrower, y.name AS broader FROM a JOIN c x ON x.node = a.node JOIN c y ON y.node = a.ancestor")
def q_subsumption(spark, d):
    """Pairs of coded nodes of which one is below the other."""
    n = table(spark, d, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey")).alias("node"), F.col("n_name").alias("name"))
    r = table(spark, d, "region").select(F.concat(F.lit("R"), F.col("r_regionkey")).alias("node"), F.col("r_name").alias("name"))
    coded = n.unionByName(r)
    closure = G.ancestors(edges(spark, d), coded)
    return closure.join(coded.withColumnRenamed("name", "narrower"), "node").join(coded.select(F.col("node").alias("ancestor"), F.col("name").alias("broader")), "ancestor").select("narrower", "broader")


@query("shared_ancestors", f"{A}, l AS (SELECT DISTINCT child AS node FROM e WHERE child LIKE 'C%'), n AS (SELECT ancestor, count(DISTINCT node) AS n FROM a JOIN l USING (node) GROUP BY 1) SELECT * FROM n WHERE n >= 2 AND n < (SELECT count(*) FROM l) ORDER BY n DESC, ancestor LIMIT 30")
def q_shared(spark, d):
    e = edges(spark, d)
    return G.shared_ancestors(G.ancestors(e), e.filter(F.col("child").startswith("C")).select(F.col("child").alias("node")))


@query("lint_missing_parent", f"{E} SELECT DISTINCT child, parent FROM e WHERE parent LIKE 'N%' AND parent NOT IN (SELECT 'N' || n_nationkey FROM nation WHERE n_regionkey <> 0)")
def q_missing(spark, d):
    """Nations of the first region are taken out of the nodes, so that edges to them are orphans."""
    nodes = table(spark, d, "nation").filter("n_regionkey <> 0").select(F.concat(F.lit("N"), F.col("n_nationkey")).alias("node"))
    return G.missing_parents(edges(spark, d).filter(F.col("parent").startswith("N")), nodes)


_NORM = "trim(regexp_replace(regexp_replace(replace(regexp_replace(lower(name), '\\s*\\([^)]*\\)', ' ', 'g'), '&', ' and '), '[^a-z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("term_index_rooted", f"{A}, lb AS (SELECT 'N' || n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT 'S' || s_suppkey, s_name FROM supplier), ix AS (SELECT DISTINCT {_NORM} AS term, id FROM lb WHERE id IN (SELECT node FROM a WHERE ancestor = 'R1')) SELECT term, count(*) AS n, CASE WHEN count(*) = 1 THEN min(id) END AS id FROM ix WHERE term <> '' GROUP BY 1")
def q_rooted(spark, d):
    """Names of the nations and suppliers below one region."""
    label = lambda t, p, k, n: table(spark, d, t).select(F.concat(F.lit(p), F.col(k)).alias("id"), F.col(n).alias("label"))
    under = G.descendants(edges(spark, d), spark.createDataFrame([("R1",)], "node string")).select(F.col("descendant").alias("id"))
    return T.term_index(label("nation", "N", "n_nationkey", "n_name").unionByName(label("supplier", "S", "s_suppkey", "s_name")), under)
