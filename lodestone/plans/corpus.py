"""Retrieval queries on the project's tables: links as the vocabulary's statements, symptom_matches as patients' records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.facets import DURATIONS, ONSETS
from lodestone.functions.text import key_rule
from lodestone.operators import retrieval as R
from lodestone.operators.joins import shuffled_if_large, small_or_shuffled
from lodestone.operators.order import numbered
from lodestone.session import cut, stored
from lodestone.sources.tables import table

FACETS = ("onset", "duration", "duration_text", "severity", "progression", "polarity")
#: What ranking reads of a link and of a patient's record.
PLACED, SAID = ("onset", "duration"), ("onset", "duration", "polarity")
SPACES = "chr(9)||chr(10)||chr(13)||' '||chr(160)"


def links(spark: SparkSession, folder: str, facets: tuple[str, ...] = FACETS) -> DataFrame:
    """One row per (condition, symptom_id), with those facets of its smallest link_id. Counted before the shuffle, whatever the condition's size."""
    t = table(spark, folder, "links").select("link_id", key_rule(F.col("condition")).alias("condition"), "symptom_id", *facets).filter("condition IS NOT NULL AND symptom_id IS NOT NULL")
    if not facets:
        return t.select("condition", "symptom_id").distinct()
    first = F.min_by(F.struct(*facets), F.col("link_id")).alias("f")
    return t.groupBy("condition", "symptom_id").agg(first).select("condition", "symptom_id", "f.*")


def matches(spark: SparkSession, folder: str, fields: tuple[str, ...] = ()) -> DataFrame:
    """One row per (query_id, record_id, symptom_id) with a cosine; record has only those fields, if any are named."""
    t = table(spark, folder, "symptom_matches").filter("cosine IS NOT NULL AND query_id IS NOT NULL AND record_id IS NOT NULL AND symptom_id IS NOT NULL")
    if fields:
        t = t.withColumn("record", F.struct(*(f"record.{f}" for f in fields)))
    return t.groupBy("query_id", "record_id", "symptom_id").agg(F.max_by(F.struct("cosine", "record"), "cosine").alias("x")).select("query_id", "record_id", "symptom_id", "x.*")


def weights(spark: SparkSession, folder: str) -> DataFrame:
    return R.idf(links(spark, folder), "condition", "symptom_id")


def corpus(spark: SparkSession, folder: str, facets: tuple[str, ...] = ()) -> DataFrame:
    """links() with the idf of their symptom, stored once for a query that reads it several times."""
    l = shuffled_if_large(stored(links(spark, folder, facets)))
    return shuffled_if_large(stored(R.weighted(l, R.idf(l, "condition", "symptom_id"))))


LINKS = f"""lk AS (SELECT lower(trim(condition, {SPACES})) AS condition, symptom_id, {', '.join(f'first({f} ORDER BY link_id) AS {f}' for f in FACETS)}
  FROM links WHERE condition IS NOT NULL AND symptom_id IS NOT NULL GROUP BY 1, 2)"""
IDF = """wt AS (SELECT symptom_id, count(*) AS n_documents, ln(((SELECT count(DISTINCT condition) FROM lk) + 1)::DOUBLE / (count(*) + 1)) + 1 AS idf FROM lk GROUP BY 1)"""
MATCHES = """mt AS (SELECT query_id, record_id, symptom_id, max(cosine) AS cosine, first(record ORDER BY cosine DESC) AS record FROM symptom_matches
  WHERE cosine IS NOT NULL AND query_id IS NOT NULL AND record_id IS NOT NULL AND symptom_id IS NOT NULL GROUP BY 1, 2, 3)"""


def distance_sql(a: str, b: str, order: list[str]) -> str:
    at = lambda x: f"nullif(list_position({order!r}, {x}), 0)"
    return f"(abs({at(a)} - {at(b)}) / {float(len(order) - 1)!r}::DOUBLE)"


def multiplier_sql(o: str, d: str, po: str, pd: str) -> str:
    x, y = distance_sql(o, po, ONSETS), distance_sql(d, pd, DURATIONS)
    return f"coalesce(greatest(0.4::DOUBLE, 1 - CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN ({x} + {y}) / 2 ELSE coalesce({x}, {y}) END), 1::DOUBLE)"


EVIDENCE = f"""ev0 AS (SELECT m.query_id, l.condition, m.record_id, m.symptom_id,
    (w.idf * m.cosine * {multiplier_sql('l.onset', 'l.duration', 'm.record.onset', 'm.record.duration')}) * CASE WHEN m.record.polarity = 'absent' THEN -0.7::DOUBLE ELSE 1 END AS w
  FROM mt m JOIN lk l USING (symptom_id) JOIN wt w USING (symptom_id) WHERE m.cosine >= 0.8),
ev AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY query_id, condition, record_id ORDER BY round(abs(w), 12) DESC, symptom_id) AS rn FROM ev0) WHERE rn = 1),
ln_ AS (SELECT condition, sum(idf) AS length FROM lk JOIN wt USING (symptom_id) GROUP BY 1)"""
RANKED = """sc AS (SELECT query_id, condition, round(sum(w) / any_value(length) ** 0.25, 6) AS score FROM ev JOIN ln_ USING (condition) GROUP BY 1, 2),
rk AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, condition)::INTEGER AS rank, condition, score FROM sc QUALIFY rank <= 10)"""
WITH = f"WITH {LINKS}, {IDF}"
FULL = f"{WITH}, {MATCHES}, {EVIDENCE}, {RANKED}"
QUERIES, SQL = {}, {}


def query(name: str, sql: str | None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


@query("idf", f"{WITH} SELECT symptom_id, n_documents, round(idf, 6) AS idf FROM wt")
def q_idf(spark, d):
    return weights(spark, d).select("symptom_id", "n_documents", F.round("idf", 6).alias("idf"))


@query("idf_extremes", f"{WITH} SELECT * FROM (SELECT 'commonest' AS side, symptom_id, round(idf, 6) AS idf FROM wt ORDER BY 3, 2 LIMIT 10) UNION ALL SELECT * FROM (SELECT 'rarest', symptom_id, round(idf, 6) AS idf FROM wt ORDER BY 3 DESC, 2 LIMIT 10)")
def q_extremes(spark, d):
    w = weights(spark, d).select("symptom_id", F.round("idf", 6).alias("idf"))
    low = w.orderBy("idf", "symptom_id").limit(10).select(F.lit("commonest").alias("side"), "symptom_id", "idf")
    return low.unionByName(w.orderBy(F.desc("idf"), "symptom_id").limit(10).select(F.lit("rarest").alias("side"), "symptom_id", "idf"))


@query("corpus_links", f"WITH {LINKS} SELECT l.condition, l.symptom_id, s.canonical, l.onset, l.duration, c.name, c.icd10, c.system FROM lk l JOIN symptoms s USING (symptom_id) LEFT JOIN (SELECT lower(trim(slug)) AS condition, name, icd10, system FROM conditions) c USING (condition)")
def q_corpus_links(spark, d):
    s = table(spark, d, "symptoms").select("symptom_id", "canonical")
    c = table(spark, d, "conditions").select(key_rule(F.col("slug")).alias("condition"), "name", "icd10", "system")
    return links(spark, d).join(s, "symptom_id").join(c, "condition", "left").select("condition", "symptom_id", "canonical", "onset", "duration", "name", "icd10", "system")


@query("condition_symptom_lists", f"""{WITH} SELECT c.slug AS condition, coalesce(x.symptoms, '') AS symptoms FROM conditions c LEFT JOIN (
  SELECT condition, string_agg(canonical, ' | ' ORDER BY round(idf, 6) DESC, canonical, symptom_id) AS symptoms FROM lk JOIN symptoms s USING (symptom_id) JOIN wt USING (symptom_id) WHERE s.canonical IS NOT NULL GROUP BY 1) x ON x.condition = lower(trim(c.slug))""")
def q_lists(spark, d):
    """A condition's list is as long as the vocabulary at most; the lists are the result."""
    s = table(spark, d, "symptoms").filter("canonical IS NOT NULL").select("symptom_id", "canonical")
    one = F.struct((-F.round("idf", 6)).alias("o"), "canonical", "symptom_id")
    l = corpus(spark, d).join(s, "symptom_id").groupBy("condition").agg(F.array_sort(F.collect_list(one)).alias("l"))
    c = table(spark, d, "conditions").select(F.col("slug"), key_rule(F.col("slug")).alias("condition"))
    return c.join(l, "condition", "left").select(F.col("slug").alias("condition"), F.array_join(F.coalesce(F.col("l.canonical"), F.array().cast("array<string>")), " | ").alias("symptoms"))


@query("list_join_export", """SELECT condition, string_agg(DISTINCT lower(trim(source)), ' | ' ORDER BY lower(trim(source))) AS sources FROM documents WHERE condition IS NOT NULL AND source IS NOT NULL GROUP BY 1""")
def q_export(spark, d):
    t = table(spark, d, "documents").select("condition", key_rule(F.col("source")).alias("s")).dropna().distinct()
    return t.groupBy("condition").agg(F.array_join(F.array_sort(F.collect_list("s")), " | ").alias("sources"))


@query("vocab_build", """WITH p AS (SELECT DISTINCT lower(trim(canonical)) AS phrase, symptom_id FROM symptoms WHERE canonical IS NOT NULL)
SELECT row_number() OVER (ORDER BY phrase) - 1 AS vocab_id, phrase, count(*) AS n_ids FROM p GROUP BY phrase""")
def q_vocab(spark, d):
    """Ids are a global order: positions inside sorted ranges plus the sizes of the ranges before, so that no task holds all phrases."""
    p = table(spark, d, "symptoms").select(F.lower(F.trim("canonical")).alias("phrase"), "symptom_id").filter("phrase IS NOT NULL").distinct().groupBy("phrase").agg(F.count(F.lit(1)).alias("n_ids"))
    return numbered(p, "phrase", "vocab_id")


@query("matrix_density", f"WITH {LINKS} SELECT count(DISTINCT condition) AS n_conditions, count(DISTINCT symptom_id) AS n_symptoms, count(*) AS n_pairs, round(count(*)::DOUBLE / (count(DISTINCT condition) * count(DISTINCT symptom_id)), 9) AS density FROM lk")
def q_density(spark, d):
    l = links(spark, d)
    n = l.agg(F.countDistinct("condition").alias("n_conditions"), F.countDistinct("symptom_id").alias("n_symptoms"), F.count(F.lit(1)).alias("n_pairs"))
    return n.withColumn("density", F.round(F.col("n_pairs") / (F.col("n_conditions") * F.col("n_symptoms")), 9))


ONSET_COLUMNS = [*ONSETS, "unspecified"]


@query("incidence_pivot", f"WITH {LINKS} SELECT condition, " + ", ".join(f"max(CASE WHEN onset = '{o}' THEN 1 ELSE 0 END)::INTEGER AS {o}" for o in ONSET_COLUMNS) + " FROM lk GROUP BY 1")
def q_pivot(spark, d):
    p = links(spark, d).groupBy("condition").pivot("onset", ONSET_COLUMNS).agg(F.count(F.lit(1)))
    return p.select("condition", *((F.coalesce(o, F.lit(0)) > 0).cast("int").alias(o) for o in ONSET_COLUMNS))


def ranking(spark: SparkSession, d: str, l: DataFrame | None = None) -> DataFrame:
    l = corpus(spark, d, PLACED) if l is None else l
    return R.idf_rank(R.strengths(matches(spark, d, SAID), l), R.lengths(l))


@query("idf_rank", f"{FULL} SELECT * FROM rk")
def q_rank(spark, d):
    return ranking(spark, d)


@query("idf_rank_evidence", f"""{FULL} SELECT query_id, condition, round(sum(w), 6) AS total,
  string_agg(symptom_id || ':' || printf('%.4f', w), ' | ' ORDER BY round(abs(w), 6) DESC, record_id) AS evidence FROM ev GROUP BY 1, 2""")
def q_evidence(spark, d):
    return R.evidence_lists(R.evidence(matches(spark, d, SAID), corpus(spark, d, PLACED)))


@query("cosine_rank_l2", f"""{WITH}, {MATCHES}, q AS (SELECT query_id, symptom_id, idf, idf * CASE WHEN bool_or(record.polarity = 'absent') THEN -0.7::DOUBLE ELSE 1 END AS q FROM mt JOIN wt USING (symptom_id) WHERE cosine >= 0.8 GROUP BY 1, 2, 3),
nq AS (SELECT query_id, sqrt(sum(q * q)) AS nq FROM q GROUP BY 1), nc AS (SELECT condition, sqrt(sum(idf * idf)) AS nc FROM lk JOIN wt USING (symptom_id) GROUP BY 1),
s AS (SELECT query_id, condition, round(sum(q * idf) / (any_value(nc) ** 0.25 * any_value(nq)), 6) AS score FROM q JOIN lk USING (symptom_id) JOIN nq USING (query_id) JOIN nc USING (condition) GROUP BY 1, 2)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, condition)::INTEGER AS rank, condition, score FROM s QUALIFY rank <= 10""")
def q_l2(spark, d):
    return R.cosine_rank_l2(matches(spark, d, ("polarity",)), corpus(spark, d))


@query("condition_cosine_pairs", f"""{WITH}, v AS (SELECT condition, symptom_id, idf FROM lk JOIN wt USING (symptom_id)), n AS (SELECT condition, sqrt(sum(idf * idf)) AS n FROM v GROUP BY 1),
p AS (SELECT a.condition AS a, b.condition AS b, sum(a.idf * b.idf) AS dot FROM v a JOIN v b ON a.symptom_id = b.symptom_id AND a.condition < b.condition GROUP BY 1, 2)
SELECT a, b, round(dot / (x.n * y.n), 6) AS cosine FROM p JOIN n x ON x.condition = a JOIN n y ON y.condition = b""")
def q_pairs(spark, d):
    return R.similar_conditions(corpus(spark, d))


SEEDS = "sd AS (SELECT condition, row_number() OVER (PARTITION BY condition ORDER BY round(idf, 9), symptom_id)::INTEGER AS rank, symptom_id FROM lk JOIN wt USING (symptom_id) QUALIFY rank <= 2)"


@query("seed_commonest", f"{WITH}, {SEEDS} SELECT * FROM sd")
def q_seeds(spark, d):
    return R.seeds(corpus(spark, d))


@query("seed_matched", f"""{WITH}, tg AS (SELECT condition, avg(idf) AS target FROM lk JOIN wt USING (symptom_id) GROUP BY 1)
SELECT condition, row_number() OVER (PARTITION BY condition ORDER BY round(abs(idf - target), 9), symptom_id)::INTEGER AS rank, symptom_id FROM lk JOIN wt USING (symptom_id) JOIN tg USING (condition) QUALIFY rank <= 2""")
def q_seed_matched(spark, d):
    """Target: the condition's mean weight."""
    l = corpus(spark, d)
    return R.seeds(l, l.groupBy("condition").agg(F.avg("idf").alias("target")))


@query("hits_at_k", f"""{WITH}, {SEEDS}, ln_ AS (SELECT condition, sum(idf) AS length FROM lk JOIN wt USING (symptom_id) GROUP BY 1),
sc AS (SELECT sd.condition AS truth, l.condition, round(sum(w.idf) / any_value(length) ** 0.25, 6) AS score FROM sd JOIN lk l USING (symptom_id) JOIN wt w USING (symptom_id) JOIN ln_ n ON n.condition = l.condition GROUP BY 1, 2),
rk AS (SELECT truth, condition, row_number() OVER (PARTITION BY truth ORDER BY score DESC, condition) AS pos FROM sc),
ps AS (SELECT truth, min(pos) FILTER (WHERE condition = truth) AS pos FROM rk GROUP BY 1)
SELECT count(*) AS n, round(avg((pos <= 1)::INT), 6) AS top1, round(avg((pos <= 5)::INT), 6) AS top5, round(avg((pos <= 10)::INT), 6) AS top10 FROM ps""")
def q_hits(spark, d):
    """Held-out retrieval: each condition seeded with two of its own symptoms; every condition is ranked."""
    l = corpus(spark, d)
    places = R.held_out(l, R.seeds(l)).groupBy("truth").agg(F.min(F.when(F.col("truth") == F.col("condition"), F.col("place"))).alias("place"))
    return R.hit_rates(places)


MOST_SYMPTOMS = 20


@query("incidence_matrix", f"{WITH}, tp AS (SELECT symptom_id, row_number() OVER (ORDER BY n_documents DESC, symptom_id) AS pos FROM wt QUALIFY pos <= {MOST_SYMPTOMS}) SELECT condition, " + ", ".join(f"max(CASE WHEN pos = {i} THEN 1 ELSE 0 END)::INTEGER AS s{i}" for i in range(1, MOST_SYMPTOMS + 1)) + " FROM lk LEFT JOIN tp USING (symptom_id) GROUP BY 1")
def q_matrix(spark, d):
    """Conditions by the commonest symptoms, 1 where it has the symptom: the export of a matrix that is kept as pairs."""
    l = stored(links(spark, d))
    top = R.idf(l, "condition", "symptom_id").orderBy(F.desc("n_documents"), "symptom_id").limit(MOST_SYMPTOMS)
    named = top.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("n_documents"), "symptom_id"))).select("symptom_id", "pos")  # MOST_SYMPTOMS rows
    places = list(range(1, MOST_SYMPTOMS + 1))
    p = l.join(F.broadcast(named), "symptom_id", "left").groupBy("condition").pivot("pos", places).agg(F.count(F.lit(1)))
    return p.select("condition", *((F.coalesce(str(i), F.lit(0)) > 0).cast("int").alias(f"s{i}") for i in places))


@query("sample_hash", "SELECT slug FROM conditions ORDER BY md5(slug || ':0'), slug LIMIT 150")
def q_sample(spark, d):
    """A seeded sample of 150 conditions without replacement: the order is that of a hash of key and seed."""
    return table(spark, d, "conditions").select("slug").orderBy(F.md5(F.concat("slug", F.lit(":0"))), "slug").limit(150)


@query("shared_pool", f"""WITH {LINKS}, a AS (SELECT condition FROM lk GROUP BY 1 HAVING count(*) >= 3), b AS (SELECT condition FROM documents WHERE condition IS NOT NULL GROUP BY 1 HAVING count(*) >= 3) SELECT condition FROM a INTERSECT SELECT condition FROM b""")
def q_shared(spark, d):
    """Conditions with at least three symptoms in the links and three documents."""
    a = links(spark, d).groupBy("condition").count().filter("count >= 3").select("condition")
    b = table(spark, d, "documents").filter("condition IS NOT NULL").groupBy("condition").count().filter("count >= 3").select("condition")
    return a.intersect(b)


SPLIT = f"""{FULL}, n AS (SELECT query_id, count(*) AS n FROM rk GROUP BY 1), h AS (SELECT query_id, symptom_id, count(*) AS c FROM rk JOIN lk USING (condition) GROUP BY 1, 2),
sp AS (SELECT query_id, symptom_id, round(-(c::DOUBLE / n * log2(c::DOUBLE / n) + (1 - c::DOUBLE / n) * log2(1 - c::DOUBLE / n)), 9) AS h, idf FROM h JOIN n USING (query_id) JOIN wt USING (symptom_id)
  WHERE c < n AND NOT EXISTS (SELECT 1 FROM mt m WHERE m.query_id = h.query_id AND m.symptom_id = h.symptom_id AND m.cosine >= 0.8))"""


def _next(spark, d, rarest: bool):
    l = corpus(spark, d, PLACED)
    m = stored(matches(spark, d, SAID).filter(F.col("cosine") >= R.MATCH))
    ten = R.idf_rank(R.strengths(m, l), R.lengths(l)).select("query_id", "condition", F.lit(True).alias("left"))
    return R.best_questions(ten, R.question_blocks(l), m, rarest).select("query_id", "symptom_id", "h")


@query("split_entropy", f"{SPLIT} SELECT query_id, symptom_id, h FROM sp QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY h DESC, round(idf, 9) DESC, symptom_id) = 1")
def q_split(spark, d):
    """The next question of each query over its ten candidates; ties to the rarer symptom."""
    return _next(spark, d, rarest=True)


@query("split_entropy_poc", f"{SPLIT} SELECT query_id, symptom_id, h FROM sp QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY h DESC, symptom_id) = 1")
def q_split_poc(spark, d):
    return _next(spark, d, rarest=False)


@query("narrowing_step", f"{FULL}, n AS (SELECT query_id, count(*) AS n FROM rk GROUP BY 1) SELECT query_id, condition, score, rank AS place FROM rk JOIN n USING (query_id) WHERE rank <= greatest(5, n - 2)")
def q_narrow(spark, d):
    """One step from ten candidates towards five: at most two are dropped."""
    return R.narrowed(ranking(spark, d).select("query_id", "condition", "score"), 5).select("query_id", "condition", "score", "place")


def _rounds_sql(first: str, asked: str, truth: str, targets: tuple[int, ...] = (5, 5, 5, 1, 1), gain: str = "idf", tie: str = "round(idf, 9) DESC, ", skip: str = "symptom_id % 7 = 0") -> str:
    """The rounds of questions, written out; at most two candidates go in each, so ten come to five in three and to one in two more. skip: what the patient doesn't know."""
    out = [f"st0 AS ({first})", f"as0 AS ({asked})", f"tr AS ({truth})"]
    for i, target in enumerate(targets):
        out += [
            f"n{i} AS (SELECT query_id, count(*) AS n FROM st{i} WHERE alive GROUP BY 1 HAVING count(*) > {target})",
            f"c{i} AS (SELECT query_id, symptom_id, count(*) AS c FROM st{i} JOIN n{i} USING (query_id) JOIN lk USING (condition) WHERE alive GROUP BY 1, 2)",
            f"""b{i} AS (SELECT query_id, symptom_id, n, CASE WHEN {skip} THEN NULL ELSE EXISTS (SELECT 1 FROM tr JOIN lk ON lk.condition = tr.truth WHERE tr.query_id = x.query_id AND lk.symptom_id = x.symptom_id) END AS reply FROM (
  SELECT c{i}.query_id, symptom_id, n, round(-(c::DOUBLE / n * log2(c::DOUBLE / n) + (1 - c::DOUBLE / n) * log2(1 - c::DOUBLE / n)), 9) AS h, idf FROM c{i} JOIN n{i} USING (query_id) JOIN wt USING (symptom_id)
  WHERE c < n AND NOT EXISTS (SELECT 1 FROM as{i} a WHERE a.query_id = c{i}.query_id AND a.symptom_id = c{i}.symptom_id)) x QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY h DESC, {tie}symptom_id) = 1)""",
            f"as{i + 1} AS (SELECT * FROM as{i} UNION ALL SELECT query_id, symptom_id FROM b{i})",
            f"""t{i} AS (SELECT s.* REPLACE (total + coalesce(CASE WHEN reply THEN 1 WHEN NOT reply THEN -0.7::DOUBLE END * CASE WHEN l.symptom_id IS NOT NULL THEN {gain} END, 0) AS total), b.n FROM st{i} s LEFT JOIN b{i} b USING (query_id) LEFT JOIN wt USING (symptom_id) LEFT JOIN lk l ON l.condition = s.condition AND l.symptom_id = b.symptom_id)""",
            f"u{i} AS (SELECT * REPLACE (CASE WHEN n IS NULL THEN place ELSE row_number() OVER (PARTITION BY query_id ORDER BY alive DESC, round(total / length ** 0.25, 6) DESC, place) END AS place) FROM t{i})",
            f"st{i + 1} AS (SELECT * EXCLUDE (n) REPLACE (alive AND (n IS NULL OR place <= greatest({target}, n - 2)) AS alive) FROM u{i})",
        ]
    k = len(targets)
    out.append(f"fin AS (SELECT query_id, condition, row_number() OVER (PARTITION BY query_id ORDER BY round(total / length ** 0.25, 6) DESC, first)::INTEGER AS place, round(total / length ** 0.25, 6) AS score, (SELECT count(*) FROM as{k} a WHERE a.query_id = s.query_id) - (SELECT count(*) FROM as0 a WHERE a.query_id = s.query_id) AS n_asked FROM st{k} s)")
    return ", ".join(out)


OPENED = "SELECT r.query_id, r.condition, (SELECT sum(w) FROM ev WHERE ev.query_id = r.query_id AND ev.condition = r.condition) AS total, length, rank AS first, rank AS place, true AS alive FROM rk r JOIN ln_ USING (condition)"


@query("narrowing_final", f"{FULL}, {_rounds_sql(OPENED, 'SELECT DISTINCT query_id, symptom_id FROM mt WHERE cosine >= 0.8', 'SELECT query_id, arg_max(condition, CASE WHEN rank <= 3 THEN rank END) AS truth FROM rk GROUP BY 1')} SELECT * FROM fin")
def q_final(spark, d):
    """The ten of the opening after the questions 10 -> 5 -> 1, put to a patient who has the third of them and doesn't know about every seventh symptom."""
    l = corpus(spark, d, PLACED)
    m = stored(matches(spark, d, SAID).filter(F.col("cosine") >= R.MATCH))
    norms = cut(R.lengths(l))
    opening = cut(R.best_totals(R.strengths(m, l), norms).select("query_id", "condition", "total", F.col("rank").alias("place")))
    truth = opening.filter("place <= 3").groupBy("query_id").agg(F.max_by("condition", "place").alias("truth"))
    return R.narrow(opening, m, l, norms, _replies(truth, l, F.col("symptom_id") % 7 == 0))


def _replies(truth: DataFrame, l: DataFrame, unknown=None):
    """Replies of a patient with a condition (query_id, truth): whether it has the symptom; null where `unknown` holds."""
    has = l.select(F.col("condition").alias("truth"), "symptom_id", F.lit(True).alias("has"))

    def reply(best: DataFrame) -> DataFrame:
        told = best.join(truth, "query_id").join(has, ["truth", "symptom_id"], "left")
        known = F.coalesce("has", F.lit(False))
        return told.select("query_id", "symptom_id", (known if unknown is None else F.when(~unknown, known)).alias("reply"))

    return reply


_POC_SEEDS = "SELECT condition, symptom_id FROM lk JOIN wt USING (symptom_id) WHERE condition IN (SELECT condition FROM lk GROUP BY 1 HAVING count(*) >= 3) QUALIFY row_number() OVER (PARTITION BY condition ORDER BY {0}round(idf, 9), symptom_id) <= 2"


def _poc_sql(sign: str) -> str:
    first = """SELECT query_id, condition, total, length, place AS first, place, true AS alive FROM (SELECT sd.condition AS query_id, l.condition, sum(w.idf * w.idf) AS total, any_value(n.length) AS length, row_number() OVER (PARTITION BY sd.condition ORDER BY round(sum(w.idf * w.idf) / any_value(n.length) ** 0.25, 6) DESC, l.condition) AS place
  FROM sd JOIN lk l USING (symptom_id) JOIN wt w USING (symptom_id) JOIN nc n ON n.condition = l.condition GROUP BY 1, 2) WHERE place <= 10"""
    rounds = _rounds_sql(first, "SELECT condition AS query_id, symptom_id FROM sd", "SELECT DISTINCT condition AS query_id, condition AS truth FROM sd", gain="idf * idf", tie="", skip="false")
    return f"""{WITH}, nc AS (SELECT condition, sqrt(sum(idf * idf)) AS length FROM lk JOIN wt USING (symptom_id) GROUP BY 1), sd AS ({_POC_SEEDS.format(sign)}), {rounds}
SELECT count(*) AS n, round(avg(coalesce(place <= 1, false)::INT), 6) AS top1, round(avg(coalesce(place <= 5, false)::INT), 6) AS top5, round(avg(coalesce(place <= 10, false)::INT), 6) AS top10 FROM tr LEFT JOIN fin ON fin.query_id = tr.query_id AND fin.condition = tr.truth"""


def _poc(spark, d, rarest: bool):
    """Interviews of patients who open with two symptoms of their condition (of those with at least three) and answer for it; the final order is scored."""
    l = corpus(spark, d)
    many = l.groupBy("condition").count().filter("count >= 3").select("condition")
    seeds = cut(R.seeds(l, rarest=rarest).join(many, "condition", "left_semi").select("condition", "symptom_id"))
    norms = cut(R.lengths(l, squares=True))
    said = seeds.select(F.col("condition").alias("query_id"), "symptom_id")
    total = small_or_shuffled(said).join(l.select("condition", "symptom_id", "idf"), "symptom_id").groupBy("query_id", "condition").agg(F.sum(F.col("idf") * F.col("idf")).alias("total"))
    scored = total.join(norms, "condition").withColumn("score", F.round(F.col("total") / F.pow("length", F.lit(R.LENGTH_ALPHA)), 6))
    opening = cut(R.ranked(scored, "query_id", "score", "condition", 10).select("query_id", "condition", "total", F.col("rank").alias("place")))
    truth = said.select("query_id", F.col("query_id").alias("truth")).distinct()
    final = R.narrow(opening, said, l, norms, _replies(truth, l), squares=True, rarest=False)
    own = truth.join(final.select("query_id", F.col("condition").alias("truth"), "place"), ["query_id", "truth"], "left")
    return R.hit_rates(own)


@query("poc_eval", _poc_sql("-"))
def q_poc(spark, d):
    """Opened with the two rarest symptoms."""
    return _poc(spark, d, rarest=True)


@query("poc_eval_hard", _poc_sql(""))
def q_poc_hard(spark, d):
    """Opened with the two commonest symptoms."""
    return _poc(spark, d, rarest=False)


_BANK = f"""nm AS (SELECT symptom_id, trim(string_split(lower(canonical), ' in the ')[1]) AS name FROM symptoms WHERE canonical IS NOT NULL),
bl AS (SELECT DISTINCT condition, name AS symptom_id FROM lk JOIN nm USING (symptom_id) WHERE name <> ''), bw AS (SELECT symptom_id, ln(((SELECT count(DISTINCT condition) FROM bl) + 1)::DOUBLE / (count(*) + 1)) + 1 AS idf FROM bl GROUP BY 1),
pl AS (SELECT condition FROM lk GROUP BY 1 HAVING count(*) >= 3 INTERSECT SELECT condition FROM bl GROUP BY 1 HAVING count(*) >= 3)"""


def _system_sql(name: str, l: str, w: str, seeds: str) -> str:
    return f"""SELECT '{name}' AS system, count(*) AS n, round(avg((pos <= 1)::INT), 6) AS top1, round(avg((pos <= 5)::INT), 6) AS top5, round(avg((pos <= 10)::INT), 6) AS top10 FROM (SELECT truth, min(pos) FILTER (WHERE condition = truth) AS pos FROM (
  SELECT truth, condition, row_number() OVER (PARTITION BY truth ORDER BY score DESC, condition) AS pos FROM (SELECT sd.condition AS truth, x.condition, round(sum(y.idf) / any_value(z.length) ** 0.25, 6) AS score FROM ({seeds}) sd JOIN {l} x USING (symptom_id) JOIN {w} y USING (symptom_id) JOIN (SELECT condition, sum(idf) AS length FROM {l} JOIN {w} USING (symptom_id) GROUP BY 1) z ON z.condition = x.condition GROUP BY 1, 2)) GROUP BY 1)"""


def _seeds_sql(l: str, w: str, order: str, more: str = "") -> str:
    return f"SELECT condition, symptom_id, idf FROM {l} JOIN {w} USING (symptom_id) JOIN pl USING (condition) {more} QUALIFY row_number() OVER (PARTITION BY condition ORDER BY {order}, symptom_id) <= 2"


_OWN_BANK = _seeds_sql("bl", "bw", "round(idf, 9)")


def bare_name(canonical):
    """A phrase without its place; outer blanks of any kind go, as in SQL (tabs and ends of lines stay)."""
    return F.regexp_replace(F.substring_index(F.lower(canonical), " in the ", 1), r"^\p{Zs}+|\p{Zs}+$", "")


@query("two_systems", f"""{WITH}, {_BANK}, tg AS (SELECT condition, sum(idf) / 2 AS target FROM ({_OWN_BANK}) GROUP BY 1)
{_system_sql('bank', 'bl', 'bw', _OWN_BANK)} UNION ALL {_system_sql('own', 'lk', 'wt', _seeds_sql('lk', 'wt', 'round(idf, 9)'))} UNION ALL {_system_sql('matched', 'lk', 'wt', _seeds_sql('lk', 'wt', 'round(abs(idf - target), 9)', 'JOIN tg USING (condition)'))}""")
def q_two(spark, d):
    """A bank of bare phrases and the links themselves on the conditions that both know, each by its own commonest seeds, and the links by seeds as common as the bank's."""
    l = corpus(spark, d)
    names = table(spark, d, "symptoms").filter("canonical IS NOT NULL").select("symptom_id", bare_name(F.col("canonical")).alias("name")).filter("name <> ''")
    b = shuffled_if_large(stored(l.select("condition", "symptom_id").join(names, "symptom_id").select("condition", F.col("name").alias("symptom_id")).distinct()))
    b = shuffled_if_large(stored(R.weighted(b, R.idf(b, "condition", "symptom_id"))))
    many = lambda x: x.groupBy("condition").count().filter("count >= 3").select("condition")
    pool = cut(many(l).intersect(many(b)))
    own = lambda x, **kw: R.seeds(x.join(small_or_shuffled(pool), "condition", "left_semi"), **kw)
    mine = cut(own(b))
    targets = mine.join(b, ["condition", "symptom_id"]).groupBy("condition").agg((F.sum("idf") / 2).alias("target"))
    systems = (("bank", b, mine), ("own", l, own(l)), ("matched", l, own(l, targets=targets)))
    places = [R.held_out(x, s).groupBy("truth").agg(F.min(F.when(F.col("truth") == F.col("condition"), F.col("place"))).alias("place")).withColumn("system", F.lit(n)) for n, x, s in systems]
    return R.hit_rates(reduce(DataFrame.unionByName, places), "system")


_CORE = "lower(trim(CASE WHEN coalesce(trim(record.character), '') <> '' THEN trim(record.character) || ' ' ELSE '' END || trim(record.concept) || CASE WHEN coalesce(trim(record.site), '') <> '' THEN ' in the ' || trim(record.site) ELSE '' END))"


@query("paraphrase_recovery", f"""WITH {LINKS}, {MATCHES}, me AS (SELECT lower(trim(core_phrase)) AS phrase, min(symptom_id) AS own FROM symptoms_v2 WHERE core_phrase IS NOT NULL GROUP BY 1),
rc AS (SELECT DISTINCT query_id, record_id, {_CORE} AS phrase FROM mt), pk AS (SELECT query_id, record_id, min(own) AS own FROM rc JOIN me USING (phrase) GROUP BY 1, 2),
gt AS (SELECT query_id, record_id, own, symptom_id FROM pk JOIN mt USING (query_id, record_id) WHERE cosine >= 0.8),
ex AS (SELECT query_id, record_id, bool_or(own = symptom_id) AS exact FROM gt GROUP BY 1, 2), sm AS (SELECT DISTINCT query_id, record_id FROM gt JOIN lk a ON a.symptom_id = own JOIN lk b ON b.symptom_id = gt.symptom_id AND a.condition = b.condition)
SELECT count(*) AS n, round(avg(coalesce(exact, false)::INT), 6) AS exact, round(avg((sm.query_id IS NOT NULL)::INT), 6) AS same FROM pk LEFT JOIN ex USING (query_id, record_id) LEFT JOIN sm USING (query_id, record_id)""")
def q_paraphrase(spark, d):
    """Patients' records whose own phrase is a vocabulary row: how often that row is among their matches, and how often some match shares a condition with it."""
    trimmed = lambda f: F.coalesce(F.trim(f"record.{f}"), F.lit(""))
    phrase = F.lower(F.trim(F.concat(F.when(trimmed("character") != "", F.concat(F.trim("record.character"), F.lit(" "))).otherwise(""), F.trim("record.concept"), F.when(trimmed("site") != "", F.concat(F.lit(" in the "), F.trim("record.site"))).otherwise(""))))
    me = table(spark, d, "symptoms_v2").filter("core_phrase IS NOT NULL").groupBy(F.lower(F.trim("core_phrase")).alias("phrase")).agg(F.min("symptom_id").alias("own"))
    m = stored(matches(spark, d))
    picks = stored(m.select("query_id", "record_id", phrase.alias("phrase")).join(me, "phrase").groupBy("query_id", "record_id").agg(F.min("own").alias("own")))
    got = picks.join(m.filter(F.col("cosine") >= R.MATCH).select("query_id", "record_id", "symptom_id"), ["query_id", "record_id"])
    return R.recovered(picks, got, stored(links(spark, d)))


@query("percentile_report", f"""WITH {LINKS}, n AS (SELECT condition, count(*) AS n FROM lk GROUP BY 1), o AS (SELECT n, row_number() OVER (ORDER BY n, condition) - 1 AS i, count(*) OVER () AS c FROM n)
SELECT median(n)::DOUBLE AS median, max(n) FILTER (WHERE i = c // 2) AS upper_median, max(n) FILTER (WHERE i = round_even(0.9 * (c - 1), 0)::BIGINT) AS p90, round(avg(n), 6) AS mean, max(n) AS most FROM o""")
def q_percentiles(spark, d):
    """Symptoms per condition: median, upper middle, nearest-rank 90th percentile, mean and most; conditions are a bounded dimension."""
    n = links(spark, d).groupBy("condition").agg(F.count(F.lit(1)).alias("n"))
    o = numbered(n, ["n", "condition"], "i").join(F.broadcast(n.agg(F.count(F.lit(1)).alias("c"))))
    at = lambda i: F.max(F.when(F.col("i") == i, F.col("n")))
    return o.agg(F.median("n").alias("median"), at(F.floor(F.col("c") / 2)).alias("upper_median"), at(F.bround(0.9 * (F.col("c") - 1)).cast("bigint")).alias("p90"), F.round(F.avg("n"), 6).alias("mean"), F.max("n").alias("most"))


@query("dedup_first", "SELECT lower(trim(canonical)) AS phrase, min(symptom_id) AS symptom_id FROM symptoms WHERE canonical IS NOT NULL GROUP BY 1")
def q_dedup(spark, d):
    """The first of each phrase by id, case ignored."""
    return table(spark, d, "symptoms").select(F.lower(F.trim("canonical")).alias("phrase"), "symptom_id").filter("phrase IS NOT NULL").groupBy("phrase").agg(F.min("symptom_id").alias("symptom_id"))


@query("link_dedup", f"WITH {LINKS} SELECT * FROM lk")
def q_link_dedup(spark, d):
    return links(spark, d)


@query("kind_counts", "SELECT system, kind, count(*) AS n FROM conditions GROUP BY 1, 2")
def q_kinds(spark, d):
    return table(spark, d, "conditions").groupBy("system", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("cluster_links", f"""WITH {LINKS}, nm AS (SELECT symptom_id, min(symptom_id) OVER (PARTITION BY lower(trim(canonical))) AS cluster_id FROM symptoms WHERE canonical IS NOT NULL)
SELECT DISTINCT condition, cluster_id FROM lk JOIN nm USING (symptom_id)""")
def q_cluster_links(spark, d):
    """Symptoms of the same canonical name are one; links are rebuilt on it."""
    s = table(spark, d, "symptoms").select("symptom_id", F.lower(F.trim("canonical")).alias("name")).filter("name IS NOT NULL")
    names = s.groupBy("name").agg(F.min("symptom_id").alias("cluster_id"))
    return links(spark, d).join(s.join(names, "name"), "symptom_id").select("condition", "cluster_id").distinct()


@query("split_relink", f"""WITH {LINKS}, pt AS (SELECT symptom_id, trim(unnest(string_split(canonical, ' in the '))) AS part FROM symptoms WHERE canonical IS NOT NULL)
SELECT DISTINCT condition, part FROM lk JOIN pt USING (symptom_id) WHERE part <> ''""")
def q_split_relink(spark, d):
    """Each symptom splits into parts; every condition that had it gets all of them."""
    s = table(spark, d, "symptoms").filter("canonical IS NOT NULL").select("symptom_id", F.explode(F.split("canonical", " in the ")).alias("part"))
    return links(spark, d).join(s, "symptom_id").select("condition", F.trim("part").alias("part")).filter("part <> ''").distinct()
