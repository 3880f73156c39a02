"""Curated track: signed scores, ranking, rules, next question, stop reason and flips, for all sessions at once.

Answers are a table (session, complaint, var, value), one row per session and variable. The knowledge base is broadcast; the
only shuffles are by session. 'unknown' and an absent answer say nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.session import cut
from lodestone.sources.knowledge import Knowledge

#: Fixed values.
UNKNOWN, UNSTATED = "unknown", "\x00unstated"
EVIDENCE_FLOOR, SHRINK, TOP = 3, 2.0, 5
MIN_SPLIT, COST_WEIGHT = 0.25, 0.25
MAX_QUESTIONS, LEAD_MARGIN = 10, 0.12
URGENCIES = ["routine", "urgent", "same_day", "emergency"]


def said(answers: DataFrame) -> DataFrame:
    return answers.filter(F.col("value").isNotNull() & (F.col("value") != UNKNOWN))


def match_terms(kb: Knowledge, answers: DataFrame) -> DataFrame:
    """(session, condition, var, matched, w): w is the feature's weight, negative where the answer isn't expected."""
    pooled = said(answers).join(kb.pool().select("complaint", "condition"), "complaint")
    hit = F.array_contains("expect", F.col("value"))
    t = pooled.join(F.broadcast(kb.feature.select("condition", "var", "expect", "weight")), ["condition", "var"])
    return t.select("session", "condition", "var", hit.alias("matched"), F.when(hit, F.col("weight")).otherwise(-F.col("weight")).alias("w"))


def match_lists(terms: DataFrame) -> DataFrame:
    """(session, condition, matched, mismatched) of match_terms(): the variables that speak for and against, by name; a condition has a handful."""
    names = lambda x: F.array_sort(F.collect_list(F.when(F.col("matched") == x, F.col("var"))))
    return terms.groupBy("session", "condition").agg(names(True).alias("matched"), names(False).alias("mismatched"))


def _finish(df: DataFrame) -> DataFrame:
    normalised = F.when(F.col("weights") > 0, F.col("total") / F.col("weights")).otherwise(0.0)
    out = df.withColumn("normalised", F.round(normalised, 9))
    out = out.withColumn("confidence", F.round(F.col("normalised") * F.col("evidence") / (F.col("evidence") + SHRINK), 9))
    return out.withColumn("insufficient", F.col("evidence") < EVIDENCE_FLOOR)


def scores(kb: Knowledge, answers: DataFrame, sessions: DataFrame) -> DataFrame:
    """(session, complaint, condition, total, weights, evidence, normalised, confidence, insufficient) over whole pools; sessions (session, complaint)."""
    sums = match_terms(kb, answers).groupBy("session", "condition").agg(F.sum("w").alias("total"), F.sum(F.abs("w")).alias("weights"), F.count(F.lit(1)).alias("evidence"))
    every = sessions.select("session", "complaint").join(kb.pool().select("complaint", "condition"), "complaint")
    z = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    return _finish(every.join(sums, ["session", "condition"], "left").select("session", "complaint", "condition", z("total", 0.0), z("weights", 0.0), z("evidence", 0)))



def rank(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """scored with its rank: sufficient first, then confidence, evidence, name."""
    w = Window.partitionBy(*(by or ["session"])).orderBy("insufficient", F.desc("confidence"), F.desc("evidence"), "condition")
    return scored.withColumn("rank", F.row_number().over(w))


def holds(op: Column, value: Column, got: Column) -> Column:
    """Whether a clause holds; nothing holds for an unknown or absent answer, and ordered operators are an error once there is one."""
    test = F.when(op == "==", got == value[0]).when(op == "!=", got != value[0]).when(op == "in", F.array_contains(value, got)).otherwise(F.raise_error(F.concat(F.lit("operator needs numeric values: "), op)).cast("boolean"))
    return F.when(got.isNull() | (got == UNKNOWN), False).otherwise(F.coalesce(test, F.lit(False)))


def clause_values(kb: Knowledge, answers: DataFrame, sessions: DataFrame) -> DataFrame:
    """(session, id, grp, pos, holds, points) for every clause of the rules of the session's complaint."""
    rules = F.broadcast(kb.rule.select("id", F.explode("complaints").alias("complaint")))
    c = sessions.select("session", "complaint").join(rules, "complaint").join(kb.clauses(), "id")
    got = c.join(answers.select("session", "var", F.col("value").alias("got")), ["session", "var"], "left")
    return got.select("session", "id", "grp", "pos", holds(F.col("op"), F.col("value"), F.col("got")).alias("holds"), F.coalesce("points", F.lit(0.0)).alias("points"))


def rules_scored(kb: Knowledge, answers: DataFrame, sessions: DataFrame) -> DataFrame:
    """(session, id, all_hold, n_hold, points, fires) for every rule of the session's complaint."""
    rules = kb.rule.select("id", F.explode("complaints").alias("complaint"), "min_matches", "min_score", F.size("any_of").alias("n_any"))
    every = sessions.select("session", "complaint").join(F.broadcast(rules), "complaint")
    c = clause_values(kb, answers, sessions)
    any_ = (F.col("grp") == "any_of") & F.col("holds")
    sums = c.groupBy("session", "id").agg(F.bool_and(F.when(F.col("grp") == "all_of", F.col("holds"))).alias("all_hold"), F.count_if(any_).alias("n_hold"), F.sum(F.when(any_, F.col("points")).otherwise(0.0)).alias("points"))
    j = every.join(sums, ["session", "id"], "left")
    all_hold, n, points = F.coalesce("all_hold", F.lit(True)), F.coalesce("n_hold", F.lit(0)), F.coalesce("points", F.lit(0.0))
    enough = F.when(F.col("n_any") == 0, True).when(F.col("min_score").isNotNull(), points >= F.col("min_score")).otherwise(n >= F.col("min_matches"))
    return j.select("session", "id", all_hold.alias("all_hold"), n.alias("n_hold"), F.round(points, 6).alias("points"), (all_hold & enough).alias("fires"))


def rules_fired(kb: Knowledge, answers: DataFrame, sessions: DataFrame) -> DataFrame:
    return rules_scored(kb, answers, sessions).filter("fires").select("session", "id")


def open_variables(kb: Knowledge, answers: DataFrame, sessions: DataFrame) -> DataFrame:
    """(session, var, cost): variables some condition of the pool uses, not for disposition, without any answer."""
    used = kb.pool().select("complaint", "condition").join(F.broadcast(kb.feature.select("condition", "var")), "condition").select("complaint", "var").distinct()
    used = used.join(F.broadcast(kb.variable.filter("role <> 'disposition'").select("var", "cost")), "var")
    return sessions.select("session", "complaint").join(F.broadcast(used), "complaint").join(answers.select("session", "var"), ["session", "var"], "left_anti").select("session", "var", "cost")


def split_quality(kb: Knowledge, ranked: DataFrame, variables: DataFrame) -> DataFrame:
    """(session, var, cost, quality): Gini split of the leaders (rank <= 5) by what they expect of each open variable; unstated is a group of its own."""
    leaders = ranked.filter(F.col("rank") <= TOP).select("session", "condition")
    sig = F.array_join(F.array_sort(F.array_distinct("expect")), "\x1f")
    f = F.broadcast(kb.feature.select("condition", "var", sig.alias("sig")))
    groups = variables.join(leaders, "session").join(f, ["condition", "var"], "left").groupBy("session", "var", "cost", F.coalesce("sig", F.lit(UNSTATED)).alias("sig")).agg(F.count(F.lit(1)).alias("c"))
    share = F.col("sq") / (F.col("n") * F.col("n"))
    return groups.groupBy("session", "var", "cost").agg(F.sum(F.col("c") * F.col("c")).alias("sq"), F.sum("c").alias("n")).select("session", "var", "cost", F.round(1 - share, 9).alias("quality"))


def question_by_split(qualities: DataFrame) -> DataFrame:
    """(session, var, value): the best split per burden; too weak ones are no question."""
    value = F.round(F.col("quality") / (1 + COST_WEIGHT * F.col("cost")), 9)
    q = qualities.filter(F.col("quality") >= MIN_SPLIT).withColumn("value", value)
    first = F.row_number().over(Window.partitionBy("session").orderBy(F.desc("value"), "var"))
    return q.withColumn("rn", first).filter("rn = 1").select("session", "var", "value")


def question_by_red_flag(kb: Knowledge, ranked: DataFrame, answers: DataFrame) -> DataFrame:
    """(session, var): the first red flag nobody answered, of the leaders not argued against, in order of rank and flag."""
    flags = F.broadcast(kb.condition.select(F.col("slug").alias("condition"), F.posexplode("red_flags").alias("flag_pos", "var")).join(kb.variable.filter("role <> 'disposition'").select("var"), "var"))
    open_ = ranked.filter((F.col("rank") <= TOP) & (F.col("normalised") >= 0)).join(flags, "condition").join(answers.select("session", "var"), ["session", "var"], "left_anti")
    return open_.groupBy("session").agg(F.min_by("var", F.struct("rank", "flag_pos")).alias("var"))


def next_question(kb: Knowledge, ranked: DataFrame, answers: DataFrame, sessions: DataFrame) -> DataFrame:
    """(session, question), null where none is left."""
    flag = question_by_red_flag(kb, ranked, answers).withColumnRenamed("var", "flag")
    split = question_by_split(split_quality(kb, ranked, open_variables(kb, answers, sessions))).select("session", F.col("var").alias("split"))
    return sessions.select("session").join(flag, "session", "left").join(split, "session", "left").select("session", F.coalesce("flag", "split").alias("question"))


def burden(kb: Knowledge, answers: DataFrame) -> DataFrame:
    return answers.join(F.broadcast(kb.variable.select("var", "cost")), "var").groupBy("session").agg(F.sum("cost").alias("burden"))


def outstanding(kb: Knowledge, scored: DataFrame) -> DataFrame:
    """(session, condition): emergencies of the whole pool that are not argued against."""
    grave = F.broadcast(kb.condition.filter("urgency = 'emergency'").select(F.col("slug").alias("condition")))
    return scored.join(grave, "condition").filter((F.col("normalised") >= 0) | F.col("insufficient")).select("session", "condition")


def views(kb: Knowledge, answers: DataFrame, sessions: DataFrame) -> DataFrame:
    """One row per session (session, complaint, asked): leader, leaders (the first three), stop, question (only while ongoing), burden, n_outstanding, provisional, rules."""
    ranked = cut(rank(scores(kb, answers, sessions)))  # read by the leaders, the question and the emergencies
    at = lambda k, c: F.max(F.when(F.col("rank") == k, F.col(c)))
    top = ranked.filter(F.col("rank") <= 2).groupBy("session").agg(at(1, "condition").alias("leader"), F.bool_or((F.col("rank") == 1) & F.col("insufficient")).alias("weak"), at(1, "normalised").alias("n1"), at(1, "confidence").alias("c1"), at(2, "confidence").alias("c2"), at(1, "evidence").alias("e1"))
    leaders = ranked.filter(F.col("rank") <= 3).groupBy("session").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "condition"))), lambda x: x["condition"]).alias("leaders"))
    fired = rules_fired(kb, answers, sessions).join(F.broadcast(kb.rule.select("id", "urgency")), "id").groupBy("session").agg(F.bool_or(F.col("urgency") == "emergency").alias("grave"), F.array_join(F.array_sort(F.collect_list("id")), ",").alias("rules"))
    out = outstanding(kb, ranked).groupBy("session").agg(F.count(F.lit(1)).alias("n_outstanding"))
    j = reduce(lambda a, b: a.join(b, "session", "left"), (top, leaders, fired, next_question(kb, ranked, answers, sessions), burden(kb, answers), out), sessions)
    grave = F.coalesce("grave", F.lit(False))
    leads = (F.col("c1") - F.col("c2") >= LEAD_MARGIN) & (F.col("e1") >= EVIDENCE_FLOOR) & (F.col("c1") > 0)
    stop = F.when(grave, "emergency_escalation")
    stop = stop.when(F.col("question").isNull(), F.when(~F.col("weak") & (F.col("n1") > 0), "no_discriminating_question_left").otherwise("insufficient_information"))
    stop = stop.when(F.col("asked") >= MAX_QUESTIONS, F.when(~F.col("weak"), "question_cap_reached").otherwise("insufficient_information"))
    stop = stop.when(F.coalesce(leads, F.lit(False)), "clear_leader").otherwise("ongoing")
    j = j.withColumn("stop", stop).withColumn("n_outstanding", F.coalesce("n_outstanding", F.lit(0)))
    provisional = (F.col("stop") == "emergency_escalation") & (F.col("weak") | (F.col("n_outstanding") > 1))
    return j.select("session", "complaint", "asked", "leader", "leaders", "stop", F.when(F.col("stop") == "ongoing", F.col("question")).alias("question"), F.coalesce("burden", F.lit(0)).alias("burden"), "n_outstanding", provisional.alias("provisional"), F.coalesce("rules", F.lit("")).alias("rules"))


def flips(kb: Knowledge, answers: DataFrame, sessions: DataFrame) -> DataFrame:
    """(session, var, alt, new_leader, leader): every other value of one answer that would change who leads; 'unknown' is one.

    A probe changes one answer, so its scores are those of the session less one term plus another; nothing is scored anew.
    """
    base = scores(kb, answers, sessions)
    leader = rank(base).filter("rank = 1").select("session", F.col("condition").alias("leader"))
    alts = F.broadcast(kb.variable.select("var", F.explode("values").alias("alt")))
    probes = answers.select("session", "var", "value").join(alts, "var").filter(~F.col("alt").eqNullSafe(F.col("value")))
    p = probes.join(base, "session").join(F.broadcast(kb.feature.select("condition", "var", "expect", "weight")), ["condition", "var"], "left")

    def term(v: str) -> tuple[Column, Column, Column]:
        known = F.col("weight").isNotNull() & F.col(v).isNotNull() & (F.col(v) != UNKNOWN)
        w = F.when(known, F.when(F.array_contains("expect", F.col(v)), F.col("weight")).otherwise(-F.col("weight"))).otherwise(0.0)
        return w, F.when(known, F.abs("weight")).otherwise(0.0), known.cast("int")

    old, new = term("value"), term("alt")
    moved = p.select("session", "var", "alt", "condition", *((F.col(c) - o + n).alias(c) for c, o, n in zip(("total", "weights", "evidence"), old, new)))
    first = rank(_finish(moved), ["session", "var", "alt"]).filter("rank = 1").select("session", "var", "alt", F.col("condition").alias("new_leader"))
    return first.join(leader, "session").filter("new_leader <> leader")


def simulate(kb: Knowledge, truths: DataFrame, sessions: DataFrame) -> DataFrame:
    """Interviews to their stop: each round asks every ongoing session its question; truths (session, var, value), unknown where absent.

    At most MAX_QUESTIONS + 1 rounds; answers and open sessions are cut each round, finished sessions leave.
    """
    answers = truths.sparkSession.createDataFrame([], truths.select("session").schema.add("complaint", "string").add("var", "string").add("value", "string"))
    going, done = sessions.select("session", "complaint", F.lit(0).alias("asked")), None
    for _ in range(MAX_QUESTIONS + 1):
        v = cut(views(kb, answers, going))
        over = v.filter("stop <> 'ongoing'")
        done = over if done is None else done.unionByName(over)
        going = v.filter("stop = 'ongoing'")
        if not going.limit(1).count():
            break
        told = going.select("session", "complaint", F.col("question").alias("var")).join(truths, ["session", "var"], "left").select("session", "complaint", "var", F.coalesce("value", F.lit(UNKNOWN)).alias("value"))
        answers = cut(answers.join(going, "session", "left_semi").unionByName(told))
        going = going.select("session", "complaint", (F.col("asked") + 1).alias("asked"))
    return done


def evaluated(kb: Knowledge, done: DataFrame, cases: DataFrame) -> DataFrame:
    """One row on interviews that have ended, done being views(), against cases (session, truth, expect_insufficient).

    n, top1 and top3 are of the cases that expect a condition; n_insufficient and insufficient_ok of the others, which should
    end without enough information; median, p90 (nearest rank) and mean burden are of all; n_grave and caught of emergencies,
    caught if among the first three or escalated.
    """
    grave = F.broadcast(kb.condition.filter("urgency = 'emergency'").select(F.col("slug").alias("truth"), F.lit(True).alias("grave")))
    r = cut(done.join(cases, "session").join(grave, "truth", "left"))
    scored = ~F.coalesce("expect_insufficient", F.lit(False))
    hit = lambda k: F.coalesce(F.array_contains(F.slice("leaders", 1, k), F.col("truth")), F.lit(False))
    rate = lambda x: F.round(F.avg(F.when(scored, x.cast("int"))), 6)
    caught = scored & F.col("grave").isNotNull() & (hit(3) | (F.col("stop") == "emergency_escalation"))
    n = r.count()
    counts = r.groupBy("asked").agg(F.count(F.lit(1)).alias("c"))  # at most MAX_QUESTIONS + 1 rows
    upto = counts.withColumn("upto", F.sum("c").over(Window.orderBy("asked")))
    p90 = upto.filter(F.col("upto") > int(round(0.9 * (n - 1))) if n else F.lit(False)).agg(F.min("asked").alias("p90"))
    sums = r.agg(
        F.count_if(scored).alias("n"), rate(hit(1)).alias("top1"), rate(hit(3)).alias("top3"),
        F.count_if(~scored).alias("n_insufficient"), F.count_if(~scored & (F.col("stop") == "insufficient_information")).alias("insufficient_ok"),
        F.median("asked").alias("median_asked"), F.round(F.avg("burden"), 6).alias("mean_burden"),
        F.count_if(scored & F.col("grave").isNotNull()).alias("n_grave"), F.count_if(caught).alias("caught"),
    )
    return sums.join(F.broadcast(p90))  # one row each


def latest(log: DataFrame) -> DataFrame:
    """(session, var, value): the last answer to each variable of a log (session, seq, var, value)."""
    return log.groupBy("session", "var").agg(F.max_by("value", "seq").alias("value"))


def undone(log: DataFrame) -> DataFrame:
    """Answers after an undo: the variable asked last is gone, even if it had been answered before."""
    last = log.groupBy("session").agg(F.max_by("var", "seq").alias("var"))
    return latest(log).join(last, ["session", "var"], "left_anti")


def illegal(kb: Knowledge, log: DataFrame) -> DataFrame:
    """(session, var, value, fault) of a log's answers to unknown variables or with values they don't have."""
    j = log.join(F.broadcast(kb.variable.select("var", "values")), "var", "left")
    fault = F.when(F.col("values").isNull(), "unknown_variable").when(~F.array_contains("values", F.col("value")), "illegal_value")
    return j.select("session", "var", "value", fault.alias("fault")).filter("fault IS NOT NULL").distinct()
