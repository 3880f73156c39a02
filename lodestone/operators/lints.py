"""Checks of a knowledge base; each gives rows (entity, finding). Tables are small dimensions, joins between them broadcast."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.interview import UNSTATED
from lodestone.sources.knowledge import ENUMS, Knowledge

#: Fixed values.
FORBIDDEN_HOSTS = ("internal.example",)
URGENCY_RANK = {"routine": 0, "urgent": 1, "same_day": 2, "emergency": 3}
PROMPT_WORDS = 15
TWO_CONCEPTS = (" and ", " or ", " perhaps ", " any sort of ", " at all ")
COSTS = (0, 10)


def _rows(df: DataFrame, entity: str | Column, *rules: tuple[str, Column]) -> DataFrame:
    found = F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules)))
    e = F.col(entity) if isinstance(entity, str) else entity
    return df.select(e.alias("entity"), F.explode(found).alias("finding"))


def _blank(c: str) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def source_licence(kb: Knowledge) -> DataFrame:
    real = F.col("type") != "estimate"
    host = reduce(Column.__or__, (F.col("url").contains(h) for h in FORBIDDEN_HOSTS))
    return _rows(kb.source, "source_id", ("no_url", real & _blank("url")), ("no_licence", real & _blank("licence")), ("forbidden_host", host))


def variable_values(kb: Knowledge) -> DataFrame:
    v = F.col("values")
    return _rows(kb.variable, "var", ("single_value", F.size(v) < 2), ("repeated_value", F.size(v) != F.size(F.array_distinct(v))), ("no_unknown", ~F.array_contains(v, "unknown")), ("illegal_modality", ~F.col("modality").isin(*ENUMS["variable", "modality"])))


def prompt_wording(kb: Knowledge) -> DataFrame:
    p = F.col("prompt")
    joined = reduce(Column.__or__, (F.concat(F.lit(" "), F.lower(p), F.lit(" ")).contains(w) for w in TWO_CONCEPTS))
    return _rows(kb.variable, "var", ("no_question_mark", ~p.endswith("?")), ("too_long", F.size(F.split(F.trim(p), r"\s+")) > PROMPT_WORDS), ("compound", joined))


def feature_expect(kb: Knowledge) -> DataFrame:
    return _rows(kb.feature, F.concat_ws(".", "condition", "var"), ("empty", F.size("expect") == 0), ("expects_unknown", F.array_contains("expect", "unknown")))


def pool_size(kb: Knowledge) -> DataFrame:
    return _rows(kb.complaint, "slug", ("too_small", F.size("pool") < 2), ("repeated", F.size("pool") != F.size(F.array_distinct("pool"))))


def illegal_values(kb: Knowledge) -> DataFrame:
    """Values outside what a field may be: enums, the range of a cost, fewer than one match asked for."""
    tables = {"source": (kb.source, "source_id"), "variable": (kb.variable, "var"), "condition": (kb.condition, "slug"), "rule": (kb.rule, "id"), "clause": (kb.clauses(), "id")}
    out = []
    for (name, field), values in ENUMS.items():
        df, key = tables[name]
        out.append(_rows(df, key, (f"illegal_{field}", ~F.col(field).isin(*values))))
    out.append(_rows(kb.variable, "var", ("illegal_cost", ~F.col("cost").between(*COSTS))))
    out.append(_rows(kb.rule, "id", ("illegal_min_matches", F.col("min_matches") < 1)))
    return reduce(DataFrame.unionByName, out).distinct()


def faults(kb: Knowledge) -> DataFrame:
    """What keeps a knowledge base from being loaded: (entity, finding) of all checks of single entries."""
    checks = (illegal_values, source_licence, variable_values, prompt_wording, feature_expect, pool_size, rule_unsatisfiable)
    return reduce(DataFrame.unionByName, (c(kb) for c in checks)).distinct()


def machine_origin(kb: Knowledge) -> DataFrame:
    return _rows(kb.condition, "slug", ("machine_candidate", F.col("origin") == "machine_candidate"))


def undeclared_var(kb: Knowledge) -> DataFrame:
    return kb.feature.join(F.broadcast(kb.variable), "var", "left_anti").select(F.concat_ws(".", "condition", "var").alias("entity"), F.lit("undeclared_variable").alias("finding"))


def illegal_expect(kb: Knowledge) -> DataFrame:
    j = kb.feature.join(F.broadcast(kb.variable.select("var", "values")), "var")
    return j.select(F.concat_ws(".", "condition", "var").alias("entity"), F.explode(F.array_except("expect", "values")).alias("finding"))


def unknown_source(kb: Knowledge) -> DataFrame:
    return kb.feature.withColumnRenamed("source", "source_id").join(F.broadcast(kb.source), "source_id", "left_anti").select(F.concat_ws(".", "condition", "var").alias("entity"), F.col("source_id").alias("finding"))


def red_flag_not_feature(kb: Knowledge) -> DataFrame:
    flags = kb.condition.select(F.col("slug").alias("condition"), F.explode("red_flags").alias("var"))
    return flags.join(F.broadcast(kb.feature), ["condition", "var"], "left_anti").select(F.col("condition").alias("entity"), F.col("var").alias("finding"))


def rule_refs(kb: Knowledge) -> DataFrame:
    bad_source = kb.rule.withColumnRenamed("source", "source_id").join(F.broadcast(kb.source), "source_id", "left_anti").select(F.col("id").alias("entity"), F.concat(F.lit("source "), "source_id").alias("finding"))
    bad_var = kb.clauses().join(F.broadcast(kb.variable), "var", "left_anti").select(F.col("id").alias("entity"), F.concat(F.lit("variable "), "var").alias("finding"))
    return bad_source.unionByName(bad_var).distinct()


def pool_refs(kb: Knowledge) -> DataFrame:
    cond = kb.pool().join(F.broadcast(kb.condition.select(F.col("slug").alias("condition"))), "condition", "left_anti").select(F.col("complaint").alias("entity"), F.concat(F.lit("condition "), "condition").alias("finding"))
    comp = kb.rule.select("id", F.explode("complaints").alias("slug")).join(F.broadcast(kb.complaint), "slug", "left_anti").select(F.col("id").alias("entity"), F.concat(F.lit("complaint "), "slug").alias("finding"))
    return cond.unionByName(comp)


def unpooled(kb: Knowledge) -> DataFrame:
    return kb.condition.join(kb.pool().select(F.col("condition").alias("slug")), "slug", "left_anti").select(F.col("slug").alias("entity"), F.lit("in no pool").alias("finding"))


def no_red_flag(kb: Knowledge, *urgencies: str) -> DataFrame:
    return kb.condition.filter(F.col("urgency").isin(*urgencies) & (F.size("red_flags") < 1)).select(F.col("slug").alias("entity"), F.col("urgency").alias("finding"))


def rule_unsatisfiable(kb: Knowledge) -> DataFrame:
    points = F.aggregate("any_of", F.lit(0.0), lambda s, c: s + F.coalesce(c["points"], F.lit(0.0)))
    scored = F.col("min_score").isNotNull()
    has_points = F.exists("any_of", lambda c: c["points"].isNotNull())
    return _rows(kb.rule, "id", ("no_predicate", (F.size("all_of") == 0) & (F.size("any_of") == 0)), ("score_unreachable", scored & (points < F.col("min_score"))), ("points_without_score", ~scored & has_points), ("too_many_matches", F.col("min_matches") > F.greatest(F.size("any_of"), F.lit(1))))


def signatures(kb: Knowledge) -> DataFrame:
    """(condition, var, sig): what each condition expects of each variable, order and repeats ignored."""
    return kb.feature.select("condition", "var", F.array_join(F.array_sort(F.array_distinct("expect")), ",").alias("sig"))


def signature_pairs(kb: Knowledge) -> DataFrame:
    """(a, b, relation): pairs of conditions whose evidence is identical, or of one a strict subset; a is the smaller name, or the subset."""
    s = signatures(kb)
    n = s.groupBy("condition").agg(F.count(F.lit(1)).alias("n"))
    both = s.select(F.col("condition").alias("a"), "var", "sig").join(F.broadcast(s.select(F.col("condition").alias("b"), "var", "sig")), ["var", "sig"]).filter("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"))
    j = both.join(n.select(F.col("condition").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("condition").alias("b"), F.col("n").alias("nb")), "b")
    relation = F.when((F.col("common") == F.col("na")) & (F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")), "identical").when((F.col("common") == F.col("na")) & (F.col("na") < F.col("nb")), "subset")
    return j.select("a", "b", relation.alias("relation")).filter("relation IS NOT NULL")


def discrimination_floor(kb: Knowledge) -> DataFrame:
    """Variables that all conditions treat alike, unstated being a treatment; not those for disposition or that drive rules."""
    v = kb.variable.filter("role <> 'disposition'").select("var").join(kb.clauses().select("var"), "var", "left_anti")
    grid = v.join(F.broadcast(kb.condition.select(F.col("slug").alias("condition")))).join(F.broadcast(signatures(kb)), ["condition", "var"], "left")
    return grid.groupBy("var").agg(F.countDistinct(F.coalesce("sig", F.lit(UNSTATED))).alias("n")).filter("n < 2").select(F.col("var").alias("entity"), F.lit("cannot discriminate").alias("finding"))


def dead_variables(kb: Knowledge) -> DataFrame:
    """(complaint, var): variables stated by some condition of a pool that all of it treats alike."""
    p = kb.pool().select("complaint", "condition")
    used = p.join(F.broadcast(signatures(kb)), "condition").select("complaint", "var").distinct()
    grid = used.join(p, "complaint").join(F.broadcast(signatures(kb)), ["condition", "var"], "left")
    return grid.groupBy("complaint", "var").agg(F.countDistinct(F.coalesce("sig", F.lit(UNSTATED))).alias("n")).filter("n < 2").select("complaint", "var")


def separators(kb: Knowledge) -> DataFrame:
    """(complaint, a, b, shared, separating): per pair of a pool, the variables both state and those of them they expect differently."""
    p = kb.pool().select("complaint", "condition")
    pairs = p.select("complaint", F.col("condition").alias("a")).join(p.select("complaint", F.col("condition").alias("b")), "complaint").filter("a < b")
    s = signatures(kb)
    x = F.broadcast(s.select(F.col("condition").alias("a"), "var", F.col("sig").alias("sa")))
    y = F.broadcast(s.select(F.col("condition").alias("b"), "var", F.col("sig").alias("sb")))
    shared = pairs.join(x, "a").join(y, ["b", "var"]).groupBy("complaint", "a", "b").agg(F.count(F.lit(1)).alias("shared"), F.count_if(F.col("sa") != F.col("sb")).alias("separating"))
    z = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return pairs.join(shared, ["complaint", "a", "b"], "left").select("complaint", "a", "b", z("shared"), z("separating"))


def unsafe_pairs(kb: Knowledge) -> DataFrame:
    """(complaint, a, b, gap, shared): pairs nothing separates that differ in urgency, the widest gap first."""
    order = F.create_map(*(F.lit(x) for kv in URGENCY_RANK.items() for x in kv))
    u = kb.condition.select("slug", F.element_at(order, F.col("urgency")).alias("u"))
    j = separators(kb).filter("separating = 0").join(F.broadcast(u.select(F.col("slug").alias("a"), F.col("u").alias("ua"))), "a").join(F.broadcast(u.select(F.col("slug").alias("b"), F.col("u").alias("ub"))), "b")
    return j.withColumn("gap", F.abs(F.col("ua") - F.col("ub"))).filter("gap > 0").orderBy(F.desc("gap"), "shared", "complaint", "a", "b").select("complaint", "a", "b", "gap", "shared")


def rule_vars(kb: Knowledge) -> DataFrame:
    return kb.clauses().select("id", "var").distinct()


def unused_variables(kb: Knowledge) -> DataFrame:
    return kb.variable.select("var").join(F.broadcast(kb.feature.select("var")), "var", "left_anti").join(kb.clauses().select("var"), "var", "left_anti")


def duplicate_ids(tables: dict[str, DataFrame], keys: dict[str, str]) -> DataFrame:
    """(entity, finding): ids that a table holds more than once."""
    one = lambda n: tables[n].groupBy(F.col(keys[n]).cast("string").alias("entity")).count().filter("count > 1").select("entity", F.lit(n).alias("finding"))
    return reduce(DataFrame.unionByName, map(one, sorted(keys)))
