"""Interview queries: `events` as an answer log, with a small invented knowledge base.

A session is a user, a variable an event type, the answer the band of the event's value (unknown where it is null).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import interview as I
from lodestone.sources.knowledge import Knowledge
from lodestone.sources.tables import table

BANDS = ["low", "mid", "high", "unknown"]
KB = {
    "source": [("s1", "guideline", "Guide", "https://example.org/g", "open"), ("s2", "estimate", "Guess", None, None)],
    "variable": [
        ("view", "How often do they view?", "history", "discriminating", 0, BANDS, 1),
        ("click", "How often do they click?", "history", "discriminating", 0, BANDS, 2),
        ("purchase", "How much do they buy?", "examination", "discriminating", 2, BANDS, 3),
        ("signup", "When did they sign up?", "history", "discriminating", 1, BANDS, 4),
        ("error", "How bad was the error?", "examination", "discriminating", 3, BANDS, 5),
        ("refund", "Was a refund asked for?", "history", "discriminating", 1, ["yes", "no", "unknown"], 6),
        ("plan", "What happens next?", "history", "disposition", 0, ["stay", "go", "unknown"], 7),
    ],
    "condition": [
        ("browser", "Browser", ["calm"], "routine", "human", ["refund"]),
        ("buyer", "Buyer", ["calm"], "routine", "human", []),
        ("bot", "Bot", ["odd"], "urgent", "human", ["error"]),
        ("churner", "Churner", ["odd"], "same_day", "human", ["plan", "refund"]),
        ("fraudster", "Fraudster", ["odd"], "emergency", "human", ["purchase", "error"]),
        ("tester", "Tester", ["odd"], "routine", "human", []),
        ("victim", "Victim", ["odd", "calm"], "emergency", "human", ["error"]),
        ("newcomer", "Newcomer", ["calm"], "routine", "human", []),
    ],
    "feature": [
        ("browser", "view", ["high"], 1.0, "s1"), ("browser", "purchase", ["low"], 1.0, "s1"), ("browser", "click", ["mid", "high"], 1.0, "s1"),
        ("buyer", "purchase", ["high", "mid"], 2.0, "s1"), ("buyer", "click", ["mid"], 1.0, "s1"), ("buyer", "error", ["low"], 1.0, "s2"),
        ("bot", "click", ["high"], 1.0, "s1"), ("bot", "view", ["low"], 1.0, "s1"), ("bot", "error", ["mid", "high"], 1.0, "s1"), ("bot", "signup", ["low"], 1.0, "s2"),
        ("churner", "purchase", ["low"], 1.0, "s1"), ("churner", "signup", ["high"], 1.0, "s1"), ("churner", "refund", ["yes"], 1.0, "s1"),
        ("fraudster", "purchase", ["high"], 1.0, "s1"), ("fraudster", "signup", ["low"], 1.0, "s1"), ("fraudster", "view", ["low"], 1.0, "s1"), ("fraudster", "error", ["high"], 1.0, "s1"),
        ("tester", "error", ["high"], 1.0, "s1"), ("tester", "click", ["low", "mid", "high"], 0.5, "s2"), ("tester", "view", ["mid"], 1.0, "s1"),
        ("victim", "error", ["high"], 1.5, "s1"), ("victim", "refund", ["yes"], 1.0, "s1"), ("victim", "purchase", ["mid"], 1.0, "s1"),
        ("newcomer", "signup", ["low", "mid"], 1.0, "s1"), ("newcomer", "purchase", ["low"], 1.0, "s1"), ("newcomer", "view", ["mid", "high"], 1.0, "s1"),
    ],
    "complaint": [("browse", "Browsing", ["browser", "bot", "tester", "newcomer", "victim"]), ("buy", "Buying", ["buyer", "churner", "fraudster", "victim", "newcomer", "browser"])],
    "rule": [
        ("r1", ["browse", "buy"], [("error", "==", ["high"], None)], [], 1, None, "urgent", "s1"),
        ("r2", ["buy"], [], [("purchase", "==", ["high"], None), ("signup", "==", ["low"], None), ("view", "!=", ["high"], None)], 2, None, "same_day", "s1"),
        ("r3", ["browse", "buy"], [], [("click", "in", ["mid", "high"], 1.5), ("error", "==", ["high"], 1.5), ("view", "==", ["low"], 1.5), ("purchase", "==", ["high"], 1.5)], 1, 4.5, "emergency", "s1"),
        ("r4", ["browse"], [], [], 1, None, "routine", "s1"),
    ],
}


def lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, (int, float)):
        return f"{v}::DOUBLE" if isinstance(v, float) else str(v)
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return "[" + ", ".join(map(lit, v)) + "]" + ("::VARCHAR[]" if not v else "")


def values_cte(name: str, columns: str, rows: list[tuple]) -> str:
    return f"{name} AS (SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) t({columns}))"


def kb_ctes(kb: dict[str, list[tuple]]) -> str:
    rules = [(r[0], r[1], r[4], r[5], r[6], r[7], len(r[2]), len(r[3])) for r in kb["rule"]]
    clauses = [(r[0], g, i, c[0], c[1], list(c[2]), c[3]) for r in kb["rule"] for g, cs in (("all_of", r[2]), ("any_of", r[3])) for i, c in enumerate(cs)]
    return ", ".join([
        values_cte("kb_source", "source_id, type, title, url, licence", kb["source"]),
        values_cte("kb_variable", "var, prompt, modality, role, cost, vals, pos", kb["variable"]),
        values_cte("kb_condition", "slug, name, parents, urgency, origin, red_flags", kb["condition"]),
        values_cte("kb_feature", "condition, var, expect, weight, source", kb["feature"]),
        values_cte("kb_complaint", "slug, name, pool", kb["complaint"]),
        values_cte("kb_rule", "id, complaints, min_matches, min_score, urgency, source, n_all, n_any", rules),
        values_cte("kb_clause", "id, grp, pos, var, op, value, points", clauses),
        "kb_pool AS (SELECT slug AS complaint, unnest(pool) AS condition, generate_subscripts(pool, 1) - 1 AS pool_pos FROM kb_complaint)",
    ])


def log(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    band = F.when(v.isNull(), "unknown").when(v < 120, "low").when(v < 300, "mid").otherwise("high")
    t = table(spark, d, "events").filter("user_id IS NOT NULL AND event_type IS NOT NULL")
    return t.select(F.col("user_id").alias("session"), F.struct("ts", "event_id").alias("seq"), F.col("event_type").alias("var"), band.alias("value"))


def complaint():
    return F.when(F.col("session") % 2 == 0, "browse").otherwise("buy").alias("complaint")


def state(spark: SparkSession, d: str) -> tuple[Knowledge, DataFrame, DataFrame]:
    """The knowledge base, the sessions' answers, and the sessions with how often they were asked."""
    entries = log(spark, d)
    answers = I.latest(entries).select("session", complaint(), "var", "value")
    sessions = entries.groupBy("session").agg(F.count(F.lit(1)).alias("asked")).select("session", complaint(), "asked")
    return Knowledge.of(spark, KB), answers, sessions


LOG = "lg AS (SELECT user_id AS session, ts, event_id, event_type AS var, CASE WHEN value IS NULL THEN 'unknown' WHEN value < 120 THEN 'low' WHEN value < 300 THEN 'mid' ELSE 'high' END AS value FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL)"
ANS = f"""{LOG}, ans AS (SELECT session, CASE WHEN session % 2 = 0 THEN 'browse' ELSE 'buy' END AS complaint, var, value FROM lg QUALIFY row_number() OVER (PARTITION BY session, var ORDER BY ts DESC, event_id DESC) = 1),
ses AS (SELECT session, CASE WHEN session % 2 = 0 THEN 'browse' ELSE 'buy' END AS complaint, count(*) AS asked FROM lg GROUP BY 1)"""
TERMS = """tm AS (SELECT a.session, p.condition, a.var, list_contains(f.expect, a.value) AS matched, CASE WHEN list_contains(f.expect, a.value) THEN f.weight ELSE -f.weight END AS w
  FROM ans a JOIN kb_pool p USING (complaint) JOIN kb_feature f ON f.condition = p.condition AND f.var = a.var WHERE a.value <> 'unknown')"""


def finish(source: str) -> str:
    return f"""(SELECT *, evidence < 3 AS insufficient, round(normalised * evidence / (evidence + 2), 9) AS confidence FROM (SELECT *, round(CASE WHEN weights > 0 THEN total / weights ELSE 0 END, 9) AS normalised FROM {source}))"""


SCORES = f"""s0 AS (SELECT s.session, s.complaint, p.condition, coalesce(sum(w), 0)::DOUBLE AS total, coalesce(sum(abs(w)), 0)::DOUBLE AS weights, count(w) AS evidence FROM ses s JOIN kb_pool p USING (complaint) LEFT JOIN tm ON tm.session = s.session AND tm.condition = p.condition GROUP BY 1, 2, 3),
sc AS {finish('s0')},
rk AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY insufficient, confidence DESC, evidence DESC, condition)::INTEGER AS rank FROM sc)"""
RULES = """cl AS (SELECT s.session, r.id, c.grp, c.pos, coalesce(CASE WHEN a.value IS NULL OR a.value = 'unknown' THEN false WHEN c.op = '==' THEN a.value = c.value[1] WHEN c.op = '!=' THEN a.value <> c.value[1] ELSE list_contains(c.value, a.value) END, false) AS holds, coalesce(c.points, 0)::DOUBLE AS points
  FROM ses s JOIN (SELECT id, unnest(complaints) AS complaint FROM kb_rule) r USING (complaint) JOIN kb_clause c ON c.id = r.id LEFT JOIN ans a ON a.session = s.session AND a.var = c.var),
rs AS (SELECT s.session, r.id, coalesce(bool_and(holds) FILTER (WHERE grp = 'all_of'), true) AS all_hold, count(*) FILTER (WHERE grp = 'any_of' AND holds) AS n_hold, round(coalesce(sum(points) FILTER (WHERE grp = 'any_of' AND holds), 0), 6) AS points
  FROM ses s JOIN (SELECT id, unnest(complaints) AS complaint FROM kb_rule) r USING (complaint) LEFT JOIN cl ON cl.session = s.session AND cl.id = r.id GROUP BY 1, 2),
fr AS (SELECT rs.*, all_hold AND CASE WHEN n_any = 0 THEN true WHEN min_score IS NOT NULL THEN points >= min_score ELSE n_hold >= min_matches END AS fires FROM rs JOIN kb_rule USING (id))"""
SPLITS = """op AS (SELECT s.session, v.var, v.cost FROM ses s JOIN (SELECT DISTINCT p.complaint, f.var FROM kb_pool p JOIN kb_feature f USING (condition)) u USING (complaint) JOIN kb_variable v ON v.var = u.var AND v.role <> 'disposition' WHERE NOT EXISTS (SELECT 1 FROM ans a WHERE a.session = s.session AND a.var = v.var)),
gr AS (SELECT op.session, op.var, op.cost, coalesce(array_to_string(list_sort(list_distinct(f.expect)), '|'), '#') AS sig, count(*) AS c FROM op JOIN rk ON rk.session = op.session AND rk.rank <= 5 LEFT JOIN kb_feature f ON f.condition = rk.condition AND f.var = op.var GROUP BY 1, 2, 3, 4),
sq AS (SELECT session, var, cost, round(1 - sum(c * c)::DOUBLE / (sum(c) * sum(c)), 9) AS quality FROM gr GROUP BY 1, 2, 3),
qs AS (SELECT session, var, round(quality / (1 + 0.25 * cost), 9) AS value FROM sq WHERE quality >= 0.25 QUALIFY row_number() OVER (PARTITION BY session ORDER BY value DESC, var) = 1),
rf AS (SELECT rk.session, arg_min(x.var, rk.rank * 1000 + x.flag_pos) AS var FROM rk JOIN (SELECT slug AS condition, unnest(red_flags) AS var, generate_subscripts(red_flags, 1) AS flag_pos FROM kb_condition) x USING (condition) JOIN kb_variable v ON v.var = x.var AND v.role <> 'disposition'
  WHERE rk.rank <= 5 AND rk.normalised >= 0 AND NOT EXISTS (SELECT 1 FROM ans a WHERE a.session = rk.session AND a.var = x.var) GROUP BY 1)"""
FULL = f"WITH {kb_ctes(KB)}, {ANS}, {TERMS}, {SCORES}, {RULES}, {SPLITS}"
OUT = "ou AS (SELECT session, condition FROM sc JOIN kb_condition c ON c.slug = sc.condition WHERE c.urgency = 'emergency' AND (normalised >= 0 OR insufficient))"
QUERIES, SQL = {}, {}


def query(name: str, sql: str | None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


@query("latest_answers", f"WITH {ANS} SELECT session, var, value FROM ans")
def q_latest(spark, d):
    return I.latest(log(spark, d))


@query("undo_last", f"WITH {ANS}, la AS (SELECT session, var FROM lg QUALIFY row_number() OVER (PARTITION BY session ORDER BY ts DESC, event_id DESC) = 1) SELECT session, var, value FROM ans WHERE (session, var) NOT IN (SELECT (session, var) FROM la)")
def q_undo(spark, d):
    return I.undone(log(spark, d))


NARROW = {"variable": [("view", "?", "history", "discriminating", 0, ["low", "mid", "unknown"], 1), ("click", "?", "history", "discriminating", 0, BANDS, 2), ("purchase", "?", "history", "discriminating", 0, BANDS, 3), ("signup", "?", "history", "discriminating", 0, ["high", "unknown"], 4)]}


@query("illegal_answers", f"WITH {values_cte('kv', 'var, prompt, modality, role, cost, vals, pos', NARROW['variable'])}, {LOG} SELECT DISTINCT session, var, value, CASE WHEN vals IS NULL THEN 'unknown_variable' ELSE 'illegal_value' END AS fault FROM lg LEFT JOIN kv USING (var) WHERE vals IS NULL OR NOT list_contains(vals, value)")
def q_illegal(spark, d):
    """Against variables of which one is missing and two lack a value."""
    return I.illegal(Knowledge.of(spark, NARROW), log(spark, d))


@query("signed_match_terms", f"{FULL} SELECT session, condition, var, matched, w FROM tm")
def q_terms(spark, d):
    kb, a, _ = state(spark, d)
    return I.match_terms(kb, a)


@query("signed_lists", f"{FULL} SELECT session, condition, coalesce(string_agg(var, ',' ORDER BY var) FILTER (WHERE matched), '') AS matched, coalesce(string_agg(var, ',' ORDER BY var) FILTER (WHERE NOT matched), '') AS mismatched FROM tm GROUP BY 1, 2")
def q_signed_lists(spark, d):
    kb, a, _ = state(spark, d)
    return I.match_lists(I.match_terms(kb, a)).select("session", "condition", *(F.array_join(c, ",").alias(c) for c in ("matched", "mismatched")))


@query("signed_score", f"{FULL} SELECT session, condition, total, weights, evidence, normalised, confidence FROM sc")
def q_score(spark, d):
    return I.scores(*state(spark, d)).select("session", "condition", "total", "weights", "evidence", "normalised", "confidence")


@query("signed_rank", f"{FULL} SELECT session, rank, condition, confidence, insufficient FROM rk WHERE rank <= 5")
def q_rank(spark, d):
    return I.rank(I.scores(*state(spark, d))).filter("rank <= 5").select("session", "rank", "condition", "confidence", "insufficient")


@query("flip_adjacent", f"""{FULL}, pr AS (SELECT a.session, a.var, a.value, x.alt FROM ans a JOIN (SELECT var, unnest(vals) AS alt FROM kb_variable) x USING (var) WHERE x.alt <> a.value),
f0 AS (SELECT p.session, p.var, p.alt, s.condition,
  s.total - CASE WHEN f.weight IS NULL OR p.value = 'unknown' THEN 0 WHEN list_contains(f.expect, p.value) THEN f.weight ELSE -f.weight END + CASE WHEN f.weight IS NULL OR p.alt = 'unknown' THEN 0 WHEN list_contains(f.expect, p.alt) THEN f.weight ELSE -f.weight END AS total,
  s.weights - CASE WHEN f.weight IS NULL OR p.value = 'unknown' THEN 0 ELSE abs(f.weight) END + CASE WHEN f.weight IS NULL OR p.alt = 'unknown' THEN 0 ELSE abs(f.weight) END AS weights,
  s.evidence - (f.weight IS NOT NULL AND p.value <> 'unknown')::INT + (f.weight IS NOT NULL AND p.alt <> 'unknown')::INT AS evidence
  FROM pr p JOIN s0 s USING (session) LEFT JOIN kb_feature f ON f.condition = s.condition AND f.var = p.var),
f1 AS (SELECT session, var, alt, condition AS new_leader FROM {finish('f0')} QUALIFY row_number() OVER (PARTITION BY session, var, alt ORDER BY insufficient, confidence DESC, evidence DESC, condition) = 1)
SELECT f1.*, rk.condition AS leader FROM f1 JOIN rk USING (session) WHERE rk.rank = 1 AND rk.condition <> new_leader""")
def q_flips(spark, d):
    return I.flips(*state(spark, d))


@query("split_gini", f"{FULL} SELECT session, var, quality FROM sq")
def q_gini(spark, d):
    kb, a, s = state(spark, d)
    return I.split_quality(kb, I.rank(I.scores(kb, a, s)), I.open_variables(kb, a, s)).select("session", "var", "quality")


@query("next_question_split", f"{FULL} SELECT session, var, value FROM qs")
def q_next_split(spark, d):
    kb, a, s = state(spark, d)
    return I.question_by_split(I.split_quality(kb, I.rank(I.scores(kb, a, s)), I.open_variables(kb, a, s)))


@query("next_question_redflag", f"{FULL} SELECT session, var FROM rf")
def q_next_flag(spark, d):
    kb, a, s = state(spark, d)
    return I.question_by_red_flag(kb, I.rank(I.scores(kb, a, s)), a)


@query("burden", f"WITH {kb_ctes(KB)}, {ANS} SELECT session, sum(cost)::BIGINT AS burden FROM ans JOIN kb_variable USING (var) GROUP BY 1")
def q_burden(spark, d):
    kb, a, _ = state(spark, d)
    return I.burden(kb, a)


@query("emergency_outstanding", f"{FULL}, {OUT} SELECT * FROM ou")
def q_outstanding(spark, d):
    kb, a, s = state(spark, d)
    return I.outstanding(kb, I.scores(kb, a, s))


VIEW = f"""{FULL}, {OUT}, vw AS (SELECT s.session, s.complaint, s.asked, l.condition AS leader, l.insufficient AS weak, l.normalised AS n1, l.confidence AS c1, l.evidence AS e1, m.confidence AS c2, coalesce(rf.var, qs.var) AS q,
  coalesce((SELECT sum(cost) FROM ans a JOIN kb_variable USING (var) WHERE a.session = s.session), 0)::BIGINT AS burden, (SELECT count(*) FROM ou WHERE ou.session = s.session) AS n_outstanding,
  coalesce((SELECT bool_or(urgency = 'emergency') FROM fr JOIN kb_rule USING (id) WHERE fr.session = s.session AND fires), false) AS grave, coalesce((SELECT string_agg(id, ',' ORDER BY id) FROM fr WHERE fr.session = s.session AND fires), '') AS rules
  FROM ses s JOIN rk l ON l.session = s.session AND l.rank = 1 LEFT JOIN rk m ON m.session = s.session AND m.rank = 2 LEFT JOIN rf ON rf.session = s.session LEFT JOIN qs ON qs.session = s.session),
st AS (SELECT *, CASE WHEN grave THEN 'emergency_escalation' WHEN q IS NULL THEN CASE WHEN NOT weak AND n1 > 0 THEN 'no_discriminating_question_left' ELSE 'insufficient_information' END
  WHEN asked >= 10 THEN CASE WHEN NOT weak THEN 'question_cap_reached' ELSE 'insufficient_information' END WHEN c1 - c2 >= 0.12 AND e1 >= 3 AND c1 > 0 THEN 'clear_leader' ELSE 'ongoing' END AS stop FROM vw)"""


@query("stop_reason", f"{VIEW} SELECT session, stop FROM st")
def q_stop(spark, d):
    return I.views(*state(spark, d)).select("session", "stop")


@query("session_view", f"{VIEW} SELECT session, complaint, asked, leader, stop, CASE WHEN stop = 'ongoing' THEN q END AS question, burden, n_outstanding, stop = 'emergency_escalation' AND (weak OR n_outstanding > 1) AS provisional, rules FROM st")
def q_view(spark, d):
    return I.views(*state(spark, d)).drop("leaders")


@query("clause_eval", f"{FULL} SELECT session, id, grp, pos::INTEGER AS pos, holds FROM cl")
def q_clause(spark, d):
    return I.clause_values(*state(spark, d)).drop("points")


@query("rules_scored", f"{FULL} SELECT session, id, all_hold, n_hold, points, fires FROM fr")
def q_rules_scored(spark, d):
    return I.rules_scored(*state(spark, d))


@query("rules_fired", f"{FULL} SELECT session, id FROM fr WHERE fires")
def q_rules(spark, d):
    return I.rules_fired(*state(spark, d))


@query("interactive_sim", None)
def q_sim(spark, d):
    """Every user interviewed from nothing, answering as the log ends."""
    kb, a, s = state(spark, d)
    return I.simulate(kb, a.select("session", "var", "value"), s.select("session", "complaint"))


CASES = """tr AS (SELECT session, CASE WHEN bool_or(var = 'purchase' AND value = 'high') THEN 'fraudster' WHEN bool_or(var = 'error' AND value = 'high') THEN 'victim' ELSE 'newcomer' END AS truth,
  count(*) FILTER (WHERE value <> 'unknown') < 3 AS expect_insufficient, bool_or(value = 'unknown') AS adversarial FROM ans GROUP BY 1)"""


def _cases(answers):
    """Vignettes: sessions with a truth read off their answers; those with under three answers should end without enough evidence, those with an unknown one are adversarial."""
    has = lambda v: F.bool_or((F.col("var") == v) & (F.col("value") == "high"))
    truth = F.when(has("purchase"), "fraudster").when(has("error"), "victim").otherwise("newcomer")
    return answers.groupBy("session").agg(truth.alias("truth"), (F.count_if(F.col("value") != "unknown") < 3).alias("expect_insufficient"), F.bool_or(F.col("value") == "unknown").alias("adversarial"))


def _eval(spark, d):
    kb, a, s = state(spark, d)
    pos = I.rank(I.scores(kb, a, s)).join(_cases(a), "session").groupBy("session", "truth", "expect_insufficient", "adversarial").agg(F.min(F.when(F.col("condition") == F.col("truth"), F.col("rank"))).alias("pos"), F.bool_and("insufficient").alias("nothing"))
    grave = I.rules_fired(kb, a, s).join(F.broadcast(kb.rule.filter("urgency = 'emergency'").select("id")), "id").select("session", F.lit(True).alias("escalated")).distinct()
    return kb, pos.join(grave, "session", "left")


EVAL = f"{FULL}, {CASES}, ps AS (SELECT session, truth, expect_insufficient, adversarial, min(rank) FILTER (WHERE condition = truth) AS pos, bool_and(insufficient) AS nothing FROM rk JOIN tr USING (session) GROUP BY 1, 2, 3, 4), eg AS (SELECT DISTINCT session FROM fr JOIN kb_rule USING (id) WHERE fires AND urgency = 'emergency')"


@query("vignette_eval", f"""{EVAL} SELECT truth, count(*) FILTER (WHERE NOT expect_insufficient) AS n, round(avg(coalesce(pos <= 1, false)::INT) FILTER (WHERE NOT expect_insufficient), 6) AS top1, round(avg(coalesce(pos <= 3, false)::INT) FILTER (WHERE NOT expect_insufficient), 6) AS top3,
  count(*) FILTER (WHERE NOT expect_insufficient AND adversarial) AS n_adversarial, round(avg(coalesce(pos <= 3, false)::INT) FILTER (WHERE NOT expect_insufficient AND adversarial), 6) AS adversarial_top3,
  count(*) FILTER (WHERE expect_insufficient) AS n_insufficient, count(*) FILTER (WHERE expect_insufficient AND nothing) AS insufficient_ok FROM ps GROUP BY 1""")
def q_eval(spark, d):
    """Cases that expect no result are checked apart and don't count as scored."""
    _, e = _eval(spark, d)
    scored, hard = ~F.col("expect_insufficient"), ~F.col("expect_insufficient") & F.col("adversarial")
    at = lambda k, some: F.round(F.avg(F.when(some, F.coalesce(F.col("pos") <= k, F.lit(False)).cast("int"))), 6)
    return e.groupBy("truth").agg(
        F.count_if(scored).alias("n"), at(1, scored).alias("top1"), at(3, scored).alias("top3"), F.count_if(hard).alias("n_adversarial"), at(3, hard).alias("adversarial_top3"),
        F.count_if("expect_insufficient").alias("n_insufficient"), F.count_if(F.col("expect_insufficient") & F.col("nothing")).alias("insufficient_ok"),
    )


@query("interactive_eval", None)
def q_interactive(spark, d):
    """The interviews of interactive_sim against the same cases: accuracy, numbers of questions, burden and recall of emergencies."""
    kb, a, s = state(spark, d)
    done = I.simulate(kb, a.select("session", "var", "value"), s.select("session", "complaint"))
    return I.evaluated(kb, done, _cases(a).drop("adversarial"))


@query("red_flag_recall", f"{EVAL} SELECT count(*) AS n, count(*) FILTER (WHERE coalesce(pos <= 3, false) OR eg.session IS NOT NULL) AS caught FROM ps JOIN kb_condition c ON c.slug = ps.truth AND c.urgency = 'emergency' AND NOT ps.expect_insufficient LEFT JOIN eg USING (session)")
def q_recall(spark, d):
    kb, e = _eval(spark, d)
    g = e.filter(~F.col("expect_insufficient")).join(F.broadcast(kb.condition.filter("urgency = 'emergency'").select(F.col("slug").alias("truth"))), "truth")
    return g.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.col("pos") <= 3, F.lit(False)) | F.col("escalated").isNotNull()).alias("caught"))
