"""Lint and audit queries on a knowledge base with one fault of each kind; referential ones also on the project's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import lints as L
from lodestone.plans.interview import KB, kb_ctes
from lodestone.sources.knowledge import Knowledge
from lodestone.sources.tables import table

FAULTY = {
    "source": [*KB["source"], ("s3", "guideline", "No licence", "https://internal.example/x", None), ("s4", "published", "No url", None, "open")],
    "variable": [*KB["variable"], ("compound", "Is it red and sore?", "history", "discriminating", 0, ["yes", "no", "unknown"], 8), ("rambling", "Tell me in one two three four five six seven eight nine ten eleven twelve words", "investigation", "discriminating", 0, ["yes", "yes", "unknown"], 9), ("vague", "Is it perhaps there at all?", "history", "discriminating", 11, ["yes", "no", "unknown"], 12), ("lone", "Only one? ", "history", "discriminating", 0, ["yes"], 10), ("same", "Is it the same?", "history", "discriminating", 0, ["yes", "no", "unknown"], 11)],
    "condition": [*KB["condition"], ("twin-a", "Twin a", ["gone"], "routine", "machine_candidate", []), ("twin-b", "Twin b", ["odd"], "emergency", "human", []), ("part", "Part", ["odd"], "same_day", "human", [])],
    "feature": [*KB["feature"], ("twin-a", "view", ["low", "mid"], 1.0, "s1"), ("twin-a", "click", ["low"], 1.0, "s9"), ("twin-b", "view", ["mid", "low"], 1.0, "s1"), ("twin-b", "click", ["low"], 1.0, "s1"), ("part", "click", ["low"], 1.0, "s1"), ("tester", "ghost", ["low"], 1.0, "s1"), ("bot", "refund", [], 1.0, "s1"), ("buyer", "refund", ["maybe", "unknown"], 1.0, "s1")],
    "complaint": [*KB["complaint"], ("tiny", "Tiny", ["bot"]), ("twins", "Twins", ["twin-a", "twin-b", "twin-b", "nobody"])],
    "rule": [*KB["rule"], ("x1", ["nowhere"], [], [("ghost", "==", ["low"], 1.0)], 1, 4.5, "urgent", "s9"), ("x2", ["buy"], [], [("view", "==", ["low"], 1.0)], 3, None, "urgent", "s1")],
}
WITH = f"WITH {kb_ctes(FAULTY)}, sg AS (SELECT condition, var, array_to_string(list_sort(list_distinct(expect)), ',') AS sig FROM kb_feature)"
QUERIES, SQL = {}, {}


def lint(name: str, f, sql: str) -> None:
    QUERIES[name] = lambda spark, d: f(Knowledge.of(spark, FAULTY))
    SQL[name] = f"{WITH} {sql}"


def findings(entity: str, source: str, **rules: str) -> str:
    return " UNION ALL ".join(f"SELECT {entity} AS entity, '{n}' AS finding FROM {source} WHERE coalesce({c}, false)" for n, c in rules.items())


lint("lint_source_licence", L.source_licence, findings("source_id", "kb_source", no_url="type <> 'estimate' AND coalesce(trim(url), '') = ''", no_licence="type <> 'estimate' AND coalesce(trim(licence), '') = ''", forbidden_host="contains(url, 'internal.example')"))
lint("lint_variable_values", L.variable_values, findings("var", "kb_variable", single_value="len(vals) < 2", repeated_value="len(vals) <> len(list_distinct(vals))", no_unknown="NOT list_contains(vals, 'unknown')", illegal_modality="modality NOT IN ('history', 'examination', 'point_of_care')"))
lint("lint_prompt_wording", L.prompt_wording, findings("var", "kb_variable", no_question_mark="NOT ends_with(prompt, '?')", too_long="len(string_split_regex(trim(prompt), '\\s+')) > 15", compound="regexp_matches(' ' || lower(prompt) || ' ', ' (and|or|perhaps|any sort of|at all) ')"))
lint("lint_feature_expect", L.feature_expect, findings("condition || '.' || var", "kb_feature", empty="len(expect) = 0", expects_unknown="list_contains(expect, 'unknown')"))
lint("lint_pool_size", L.pool_size, findings("slug", "kb_complaint", too_small="len(pool) < 2", repeated="len(pool) <> len(list_distinct(pool))"))
ILLEGAL = [("source", "source_id", "type", ("published", "guideline", "estimate")), ("variable", "var", "modality", ("history", "examination", "point_of_care")), ("variable", "var", "role", ("discriminating", "disposition")), ("condition", "slug", "urgency", ("routine", "urgent", "same_day", "emergency")), ("condition", "slug", "origin", ("human", "machine_candidate")), ("rule", "id", "urgency", ("routine", "urgent", "same_day", "emergency")), ("clause", "id", "op", ("==", "!=", ">=", "<=", ">", "<", "in"))]
lint("lint_illegal_values", L.illegal_values, " UNION ".join(f"SELECT {k} AS entity, 'illegal_{f}' AS finding FROM kb_{t} WHERE {f} NOT IN {v}" for t, k, f, v in ILLEGAL) + " UNION SELECT var, 'illegal_cost' FROM kb_variable WHERE cost NOT BETWEEN 0 AND 10 UNION SELECT id, 'illegal_min_matches' FROM kb_rule WHERE min_matches < 1")
lint("lint_machine_origin", L.machine_origin, findings("slug", "kb_condition", machine_candidate="origin = 'machine_candidate'"))
lint("lint_undeclared_var", L.undeclared_var, "SELECT condition || '.' || var AS entity, 'undeclared_variable' AS finding FROM kb_feature WHERE var NOT IN (SELECT var FROM kb_variable)")
lint("lint_illegal_expect", L.illegal_expect, "SELECT condition || '.' || var AS entity, e AS finding FROM (SELECT condition, var, unnest(list_distinct(expect)) AS e FROM kb_feature) JOIN kb_variable USING (var) WHERE NOT list_contains(vals, e)")
lint("lint_unknown_source", L.unknown_source, "SELECT condition || '.' || var AS entity, source AS finding FROM kb_feature WHERE source NOT IN (SELECT source_id FROM kb_source)")
lint("lint_red_flag_not_feature", L.red_flag_not_feature, "SELECT slug AS entity, v AS finding FROM (SELECT slug, unnest(red_flags) AS v FROM kb_condition) WHERE NOT EXISTS (SELECT 1 FROM kb_feature f WHERE f.condition = slug AND f.var = v)")
lint("lint_rule_refs", L.rule_refs, "SELECT id AS entity, 'source ' || source AS finding FROM kb_rule WHERE source NOT IN (SELECT source_id FROM kb_source) UNION SELECT id, 'variable ' || var FROM kb_clause WHERE var NOT IN (SELECT var FROM kb_variable)")
lint("lint_pool_refs", L.pool_refs, "SELECT complaint AS entity, 'condition ' || condition AS finding FROM kb_pool WHERE condition NOT IN (SELECT slug FROM kb_condition) UNION ALL SELECT id, 'complaint ' || c FROM (SELECT id, unnest(complaints) AS c FROM kb_rule) WHERE c NOT IN (SELECT slug FROM kb_complaint)")
lint("lint_unpooled", L.unpooled, "SELECT slug AS entity, 'in no pool' AS finding FROM kb_condition WHERE slug NOT IN (SELECT condition FROM kb_pool)")
lint("lint_emergency_no_red_flag", lambda kb: L.no_red_flag(kb, "emergency"), "SELECT slug AS entity, urgency AS finding FROM kb_condition WHERE urgency = 'emergency' AND len(red_flags) = 0")
lint("lint_urgent_no_red_flag", lambda kb: L.no_red_flag(kb, "emergency", "same_day"), "SELECT slug AS entity, urgency AS finding FROM kb_condition WHERE urgency IN ('emergency', 'same_day') AND len(red_flags) = 0")
lint("lint_rule_unsatisfiable", L.rule_unsatisfiable, "SELECT r.id AS entity, unnest(list_filter([CASE WHEN n_all = 0 AND n_any = 0 THEN 'no_predicate' END, CASE WHEN min_score IS NOT NULL AND coalesce(p, 0) < min_score THEN 'score_unreachable' END, CASE WHEN min_score IS NULL AND coalesce(np, 0) > 0 THEN 'points_without_score' END, CASE WHEN min_matches > greatest(n_any, 1) THEN 'too_many_matches' END], lambda x: x IS NOT NULL)) AS finding FROM kb_rule r LEFT JOIN (SELECT id, sum(points) AS p, count(points) AS np FROM kb_clause WHERE grp = 'any_of' GROUP BY 1) c USING (id)")
PAIRS = "pr AS (SELECT x.condition AS a, y.condition AS b, count(*) AS common FROM sg x JOIN sg y USING (var, sig) WHERE x.condition <> y.condition GROUP BY 1, 2), nn AS (SELECT condition, count(*) AS n FROM sg GROUP BY 1)"
lint("lint_identical", lambda kb: L.signature_pairs(kb).filter("relation = 'identical'").drop("relation"), f", {PAIRS} SELECT a, b FROM pr JOIN nn p ON p.condition = a JOIN nn q ON q.condition = b WHERE common = p.n AND p.n = q.n AND a < b")
lint("lint_subset", lambda kb: L.signature_pairs(kb).filter("relation = 'subset'").drop("relation"), f", {PAIRS} SELECT a, b FROM pr JOIN nn p ON p.condition = a JOIN nn q ON q.condition = b WHERE common = p.n AND p.n < q.n")
for _n in ("lint_identical", "lint_subset"):
    SQL[_n] = SQL[_n].replace(") , pr AS", "), pr AS")
lint("lint_discrimination_floor", L.discrimination_floor, "SELECT v.var AS entity, 'cannot discriminate' AS finding FROM kb_variable v CROSS JOIN kb_condition c LEFT JOIN sg ON sg.var = v.var AND sg.condition = c.slug WHERE role <> 'disposition' AND v.var NOT IN (SELECT var FROM kb_clause) GROUP BY v.var HAVING count(DISTINCT coalesce(sig, '#')) < 2")
lint("dead_variables", L.dead_variables, "SELECT u.complaint, u.var FROM (SELECT DISTINCT complaint, var FROM kb_pool JOIN sg USING (condition)) u JOIN kb_pool p USING (complaint) LEFT JOIN sg ON sg.var = u.var AND sg.condition = p.condition GROUP BY 1, 2 HAVING count(DISTINCT coalesce(sig, '#')) < 2")
SEP = "sp AS (SELECT x.complaint, x.condition AS a, y.condition AS b, count(s.var) AS shared, count(*) FILTER (WHERE s.sig <> t.sig) AS separating FROM kb_pool x JOIN kb_pool y ON x.complaint = y.complaint AND x.condition < y.condition LEFT JOIN (sg s JOIN sg t ON s.var = t.var) ON s.condition = x.condition AND t.condition = y.condition GROUP BY 1, 2, 3)"
QUERIES["pair_separators"] = lambda spark, d: L.separators(Knowledge.of(spark, KB))
SQL["pair_separators"] = f"WITH {kb_ctes(KB)}, sg AS (SELECT condition, var, array_to_string(list_sort(list_distinct(expect)), ',') AS sig FROM kb_feature), {SEP} SELECT * FROM sp"
QUERIES["unsafe_pairs"] = lambda spark, d: L.unsafe_pairs(Knowledge.of(spark, KB))
SQL["unsafe_pairs"] = f"WITH {kb_ctes(KB)}, sg AS (SELECT condition, var, array_to_string(list_sort(list_distinct(expect)), ',') AS sig FROM kb_feature), {SEP}, ur AS (SELECT slug, CASE urgency WHEN 'routine' THEN 0 WHEN 'urgent' THEN 1 WHEN 'same_day' THEN 2 ELSE 3 END AS u FROM kb_condition) SELECT complaint, a, b, abs(p.u - q.u)::INTEGER AS gap, shared FROM sp JOIN ur p ON p.slug = a JOIN ur q ON q.slug = b WHERE separating = 0 AND p.u <> q.u"
lint("rule_vars", L.rule_vars, "SELECT DISTINCT id, var FROM kb_clause")
lint("unused_variables", L.unused_variables, "SELECT var FROM kb_variable WHERE var NOT IN (SELECT var FROM kb_feature) AND var NOT IN (SELECT var FROM kb_clause)")
lint("pool_cover", lambda kb: kb.pool(), "SELECT complaint, pool_pos::INTEGER AS pool_pos, condition FROM kb_pool")
lint("pool_density", lambda kb: kb.pool().select("complaint", "condition").distinct().join(F.broadcast(kb.feature.groupBy("condition").agg(F.countDistinct("var").alias("n"))), "condition").groupBy("complaint").agg(F.count(F.lit(1)).alias("n_conditions"), F.round(F.avg("n"), 6).alias("features_each")), "SELECT complaint, count(*) AS n_conditions, round(avg(n), 6) AS features_each FROM (SELECT DISTINCT complaint, condition FROM kb_pool) JOIN (SELECT condition, count(DISTINCT var) AS n FROM kb_feature GROUP BY 1) USING (condition) GROUP BY 1")
lint("multi_pool", lambda kb: kb.pool().groupBy("condition").agg(F.countDistinct("complaint").alias("n_pools")).filter("n_pools > 1"), "SELECT condition, count(DISTINCT complaint) AS n_pools FROM kb_pool GROUP BY 1 HAVING count(DISTINCT complaint) > 1")
lint("rules_per_pool", lambda kb: kb.rule.select("id", F.explode("complaints").alias("complaint")).groupBy("complaint").agg(F.count(F.lit(1)).alias("n_rules")), "SELECT complaint, count(*) AS n_rules FROM (SELECT unnest(complaints) AS complaint FROM kb_rule) GROUP BY 1")
lint("provenance_mix", lambda kb: kb.feature.join(F.broadcast(kb.source), kb.feature["source"] == kb.source["source_id"], "left").groupBy(F.coalesce("type", F.lit("unknown")).alias("type")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "type"), "SELECT coalesce(type, 'unknown') AS type, count(*) AS n FROM kb_feature LEFT JOIN kb_source ON source = source_id GROUP BY 1")
QUERIES["coverage_report"] = lambda spark, d: table(spark, d, "conditions").agg(F.count(F.lit(1)).alias("n"), *(F.round(F.count(c) / F.count(F.lit(1)), 6).alias(c) for c in ("snomed", "icd10", "removed_at")))
SQL["coverage_report"] = "SELECT count(*) AS n, round(count(snomed)::DOUBLE / count(*), 6) AS snomed, round(count(icd10)::DOUBLE / count(*), 6) AS icd10, round(count(removed_at)::DOUBLE / count(*), 6) AS removed_at FROM conditions"
KEYS = {"links": "link_id", "presentations": "slug", "symptoms": "symptom_id", "terms": "snomed"}
QUERIES["kb_duplicate_ids"] = lambda spark, d: L.duplicate_ids({n: table(spark, d, n) for n in KEYS}, KEYS)
SQL["kb_duplicate_ids"] = " UNION ALL ".join(f"SELECT {k}::VARCHAR AS entity, '{n}' AS finding FROM {n} GROUP BY {k} HAVING count(*) > 1 AND {k} IS NOT NULL" for n, k in KEYS.items())
