"""Vector queries on `embeddings`; the label plays the condition. Queries are the rows whose id is divisible by 50, against all."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.operators import vectors as V
from lodestone.session import cut
from lodestone.sources import providers
from lodestone.sources.tables import table

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


def _rows(spark, d):
    return V.usable(table(spark, d, "embeddings"), "vec_id", "embedding")


def _asked(rows):
    return rows.filter("id % 50 = 0")


BASE = "WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0), q AS (SELECT * FROM v WHERE id % 50 = 0)"
NEAR = f"{BASE}, n AS (SELECT q.id, v.id AS other, round(list_cosine_similarity(q.v, v.v), 6) AS cosine FROM q JOIN v ON q.id <> v.id), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cosine DESC, other)::INTEGER AS rank FROM n)"


@query("vector_topk", f"{NEAR} SELECT * FROM r WHERE rank <= 5")
def q_topk(spark, d):
    r = _rows(spark, d)
    return V.top_k(_asked(r), r, 5)


@query("vector_topk_threshold", f"{NEAR} SELECT * FROM r WHERE rank <= 5 AND cosine >= 0.8")
def q_threshold(spark, d):
    """The threshold comes after the five: a sixth neighbour above it isn't seen."""
    r = _rows(spark, d)
    return V.top_k(_asked(r), r, 5, 0.8)


@query("vector_nearest", f"{NEAR} SELECT id, other, cosine FROM r WHERE rank = 1")
def q_nearest(spark, d):
    r = _rows(spark, d)
    return V.top_k(_asked(r), r, 1).drop("rank")


CENTROIDS = f"{BASE}, u AS (SELECT label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM v), e AS (SELECT label, unnest(u) AS x, generate_subscripts(u, 1) AS i FROM u), m AS (SELECT label, i, avg(x) AS x FROM e GROUP BY 1, 2), c AS (SELECT label, list(x ORDER BY i) AS c FROM m GROUP BY 1)"


@query("centroid_knn", f"{CENTROIDS} SELECT q.id, c.label, round(list_cosine_similarity(q.v, c.c), 6) AS cosine, row_number() OVER (PARTITION BY q.id ORDER BY round(list_cosine_similarity(q.v, c.c), 6) DESC, c.label)::INTEGER AS rank FROM q CROSS JOIN c QUALIFY rank <= 10")
def q_centroids(spark, d):
    """One vector per label; labels are a bounded dimension, their centroids are broadcast."""
    r = _rows(spark, d)
    c = V.centroids(table(spark, d, "embeddings").filter(F.exists("embedding", lambda x: x != 0)), "label", "embedding")
    near = _asked(r).join(F.broadcast(c.select("label", F.col("vec").alias("c")))).select("id", "label", V.cosine(F.col("vec"), F.col("c")).alias("cosine"))
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "label"))).filter("rank <= 10")


@query("same_condition_recall", f"{NEAR}, x AS (SELECT r.id, max((a.label = b.label)::INT) FILTER (WHERE rank = 1) AS first, max((a.label = b.label)::INT) AS any5 FROM r JOIN v a ON a.id = r.id JOIN v b ON b.id = r.other WHERE rank <= 5 GROUP BY 1) SELECT count(*) AS n, round(avg(first), 6) AS exact, round(avg(any5), 6) AS same FROM x")
def q_recall(spark, d):
    """Share of queries whose nearest other has their label, and that have one among five."""
    r = _rows(spark, d)
    label = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    near = V.top_k(_asked(r), r, 5).join(label, "id").join(label.select(F.col("id").alias("other"), F.col("label").alias("l")), "other")
    hit = (F.col("label") == F.col("l")).cast("int")
    per = near.groupBy("id").agg(F.max(F.when(F.col("rank") == 1, hit)).alias("first"), F.max(hit).alias("any5"))
    return per.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("first"), 6).alias("exact"), F.round(F.avg("any5"), 6).alias("same"))


@query("density_order", f"{BASE}, u AS (SELECT id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM v), e AS (SELECT unnest(u) AS x, generate_subscripts(u, 1) AS i FROM u), s AS (SELECT list(x ORDER BY i) AS s FROM (SELECT i, sum(x) AS x FROM e GROUP BY 1)) SELECT id, round(list_dot_product(u, s), 6) AS density FROM u CROSS JOIN s")
def q_density(spark, d):
    return V.density(_rows(spark, d)).orderBy(F.desc("density"), "id")


@query("greedy_cluster", None)
def q_cluster(spark, d):
    return V.greedy_clusters(_rows(spark, d))


@query("cluster_relink", None)
def q_relink(spark, d):
    """Clusters named by a stub (the name of their first member), clusters of one name merged, links rebuilt on the names."""
    r = _rows(spark, d)
    clusters = cut(V.greedy_clusters(r))
    t = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("Kind "), F.col("label").cast("string")).alias("phrase"), F.concat(F.lit("c"), (F.col("label") % 7).cast("string")).alias("condition"))
    names = providers.label_clusters(clusters, t.select("id", "phrase"), lambda members: members.split("\n")[0])
    return providers.relink(clusters, names, t.select("condition", "id"))
