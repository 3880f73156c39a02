"""Knowledge bases as YAML folders: what loads, what is refused, and sessions on a loaded one."""

import pytest

from lodestone.operators import interview as I
from lodestone.sources import knowledge as K

SOURCES = "sources:\n  s1: {type: guideline, title: Guide, url: https://example.org/g, licence: open, attribution: them}\n  s2: {type: estimate, title: Guess}\n"
VARIABLES = "variables:\n  fever: {prompt: \"Is there a fever?\", hint: above 38, modality: history, cost: 1, values: [high, none, unknown]}\n  pain: {prompt: \"Does it hurt?\", modality: examination, values: [much, little, unknown]}\n"
CONDITIONS = """conditions:
- slug: flu
  name: Flu
  parents: [viral, seasonal]
  urgency: routine
  codes: {icd10: X11}
  features:
    fever: {expect: [high], source: s1}
    pain: {expect: [much, little], weight: 2, source: s2}
- {slug: sprain, name: Sprain, urgency: emergency, prior: 1, red_flag_features: [pain], features: {pain: {expect: [much], source: s1}}}
"""
COMPLAINTS = "complaints:\n  hot: {name: Hot, pool: [flu, sprain]}\n  sore: {name: Sore, pool: [sprain, flu]}\n"
RULES = """rules:
  scored:
    complaints: [hot, sore]
    any_of:
    - {var: fever, op: ==, value: high, points: 3}
    - {var: pain, op: in, value: [much, little], points: 1.5}
    min_score: 4.5
    emit: {kind: referral, urgency: urgent, text_verbatim: Go now, source: s1}
  counted:
    complaints: [hot]
    any_of: [{var: fever, op: ==, value: high}, {var: pain, op: '!=', value: much}]
    min_matches: 2
    emit: {kind: safety_net, urgency: routine, text_verbatim: Wait, source: s1}
"""


def folder(tmp_path, **change):
    parts = {"sources": SOURCES, "variables": VARIABLES, "conditions": CONDITIONS, "complaints": COMPLAINTS, "rules": RULES} | change
    for name, text in parts.items():
        (tmp_path / "deep").mkdir(exist_ok=True)
        (tmp_path / "deep" / f"{name}.yaml").write_text(text)
    return tmp_path


def test_mappings_and_lists_load_with_all_fields(spark, tmp_path):
    kb, digest = K.load(spark, folder(tmp_path, notes="other: [1, 2]\n"))
    assert digest == K.load(spark, tmp_path)[1] and len(digest) == 16
    c = {r["slug"]: r for r in kb.condition.collect()}
    assert c["flu"]["codes"]["icd10"] == "X11" and c["flu"]["prior"] is None and c["flu"]["parents"][0] == "viral" and c["sprain"]["prior"] == 1.0 and c["sprain"]["red_flags"] == ["pain"]
    f = {(r["condition"], r["var"]): r for r in kb.feature.collect()}
    assert f["flu", "fever"]["weight"] == 1.0 and f["flu", "pain"]["weight"] == 2.0 and len(f) == 3
    assert {r["var"]: (r["hint"], r["cost"], r["role"]) for r in kb.variable.collect()} == {"fever": ("above 38", 1, "discriminating"), "pain": (None, 0, "discriminating")}
    assert kb.pool().filter("condition = 'flu'").count() == 2 and kb.source.filter("attribution = 'them'").count() == 1
    r = {r["id"]: r for r in kb.rule.collect()}
    assert r["scored"]["kind"] == "referral" and r["counted"]["text_verbatim"] == "Wait" and r["counted"]["any_of"][1]["value"] == ["much"]
    K.write_yaml(kb.complaint, tmp_path / "again.txt", "complaints", "slug")
    assert "pool" in (tmp_path / "again.txt").read_text()


def test_rules_of_a_loaded_base(spark, tmp_path):
    kb, _ = K.load(spark, folder(tmp_path))
    said = {1: {"fever": "high"}, 2: {"fever": "high", "pain": "little"}, 3: {"fever": "unknown", "pain": "unknown"}, 4: {"fever": "high", "pain": "much"}}
    answers = spark.createDataFrame([(s, "hot", v, x) for s, a in said.items() for v, x in a.items()], "session int, complaint string, var string, value string")
    sessions = spark.createDataFrame([(s, "hot") for s in said], "session int, complaint string")
    assert {tuple(r) for r in I.rules_fired(kb, answers, sessions).collect()} == {(2, "scored"), (2, "counted"), (4, "scored")}


@pytest.mark.parametrize("section, old, new, why", [
    ("variables", "cost: 1", "cost: much", "another type"),
    ("variables", "hint: above", "hunt: above", "unknown fields"),
    ("variables", 'prompt: "Does it hurt?", ', "", "prompt is missing"),
    ("conditions", "icd10", "icd12", "unknown fields"),
    ("conditions", "- slug: flu\n  name", "- name", "without slug"),
    ("rules", "value: high, points", "points", "value is missing"),
])
def test_entries_that_dont_fit(spark, tmp_path, section, old, new, why):
    text = {"variables": VARIABLES, "conditions": CONDITIONS, "rules": RULES}[section]
    assert old in text
    with pytest.raises(ValueError, match=why):
        K.load(spark, folder(tmp_path, **{section: text.replace(old, new, 1)}))


FAULTS = {
    "sources": """
  no_url: {type: guideline, title: t, licence: open}
  no_licence: {type: published, title: t, url: https://example.org}
  forbidden_host: {type: estimate, title: t, url: https://internal.example/x}
  illegal_type: {type: rumour, title: t, url: u, licence: l}
""",
    "variables": """
  compound: {prompt: "Is there fever or cough?", modality: history, values: [a, unknown]}
  no_question_mark: {prompt: "Fever present", modality: history, values: [a, unknown]}
  too_long: {prompt: "Is there very very very very very very very very very very very very very very much?", modality: history, values: [a, unknown]}
  no_unknown: {prompt: "Is it?", modality: history, values: [a, b]}
  repeated_value: {prompt: "Is it?", modality: history, values: [a, a, unknown]}
  single_value: {prompt: "Is it?", modality: history, values: [unknown]}
  illegal_modality: {prompt: "Is it?", modality: investigation, values: [a, unknown]}
  illegal_role: {prompt: "Is it?", modality: history, role: other, values: [a, unknown]}
  illegal_cost: {prompt: "Is it?", modality: history, cost: 11, values: [a, unknown]}
""",
    "conditions": """
- {slug: illegal_urgency, name: n, urgency: later}
- {slug: illegal_origin, name: n, urgency: routine, origin: elsewhere}
- {slug: c, name: n, urgency: routine, features: {empty: {expect: [], source: s1}, expects_unknown: {expect: [unknown], source: s1}}}
""",
    "complaints": """
  too_small: {name: n, pool: [flu]}
  repeated: {name: n, pool: [flu, flu]}
""",
    "rules": """
  no_predicate: {complaints: [hot], emit: &e {kind: referral, urgency: urgent, text_verbatim: Go, source: s1}}
  score_unreachable: {complaints: [hot], any_of: [{var: fever, op: ==, value: high, points: 1}], min_score: 2, emit: *e}
  points_without_score: {complaints: [hot], any_of: [{var: fever, op: ==, value: high, points: 1}], emit: *e}
  too_many_matches: {complaints: [hot], any_of: [{var: fever, op: ==, value: high}], min_matches: 2, emit: *e}
  illegal_min_matches: {complaints: [hot], any_of: [{var: fever, op: ==, value: high}], min_matches: 0, emit: *e}
  illegal_op: {complaints: [hot], any_of: [{var: fever, op: like, value: high}], emit: *e}
  illegal_kind: {complaints: [hot], any_of: [{var: fever, op: ==, value: high}], emit: {kind: other, urgency: urgent, text_verbatim: Go, source: s1}}
""",
}


def test_faults_are_all_named(spark, tmp_path):
    """Each entry is called as its fault; there is no other."""
    parts = {"sources": SOURCES, "variables": VARIABLES, "conditions": CONDITIONS, "complaints": COMPLAINTS, "rules": RULES}
    with pytest.raises(ValueError) as e:
        K.load(spark, folder(tmp_path, **{k: v + FAULTS[k].lstrip("\n") for k, v in parts.items()}))
    got = {tuple(x.split(": ")) for x in str(e.value).split(": ", 1)[1].split("; ")}
    names = [line.split(":")[0].strip() for k in ("sources", "variables", "complaints", "rules") for line in FAULTS[k].strip().split("\n")]
    want = {(n, n) for n in [*names, "illegal_urgency", "illegal_origin"]} | {("c.empty", "empty"), ("c.expects_unknown", "expects_unknown")}
    assert got == want | {("single_value", "single_value")}


def test_no_files_and_ids_in_two_files(spark, tmp_path):
    with pytest.raises(ValueError, match="no YAML"):
        K.load(spark, tmp_path)
    with pytest.raises(ValueError, match="another file"):
        K.load(spark, folder(tmp_path, zz=COMPLAINTS))
