"""Knowledge bases as tables: schemas, a loader of YAML folders that checks what it loads, and content digests."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLAUSE = "array<struct<var:string,op:string,value:array<string>,points:double>>"
CODES = "struct<snomed:string,icd10:string,icd11:string,icpc2:string>"
SCHEMAS = {
    "source": "source_id string, type string, title string, url string, licence string, attribution string, note string",
    "variable": "var string, prompt string, modality string, role string, cost int, `values` array<string>, pos int, hint string",
    "category": "slug string, name string, parents array<string>",
    "condition": f"slug string, name string, parents array<string>, urgency string, origin string, red_flags array<string>, codes {CODES}, prior double",
    "feature": "condition string, var string, expect array<string>, weight double, source string",
    "complaint": "slug string, name string, pool array<string>",
    "rule": f"id string, complaints array<string>, all_of {CLAUSE}, any_of {CLAUSE}, min_matches int, min_score double, urgency string, source string, kind string, text_verbatim string",
}
#: What a field may be, and must hold.
ENUMS = {
    ("source", "type"): ("published", "guideline", "estimate"),
    ("variable", "modality"): ("history", "examination", "point_of_care"),
    ("variable", "role"): ("discriminating", "disposition"),
    ("condition", "urgency"): ("routine", "urgent", "same_day", "emergency"),
    ("condition", "origin"): ("human", "machine_candidate"),
    ("rule", "urgency"): ("routine", "urgent", "same_day", "emergency"),
    ("rule", "kind"): ("referral", "escalation", "investigation", "safety_net", "must_ask"),
    ("clause", "op"): ("==", "!=", ">=", "<=", ">", "<", "in"),
}
#: A section's entries in YAML: what names one, and of each field its type (kind of value), and its default where it has one.
_TEXT, _TEXTS, _REQUIRED = str, [str], object()
SECTIONS = {
    "sources": ("id", {"type": (_TEXT, _REQUIRED), "title": (_TEXT, _REQUIRED), "url": (_TEXT, None), "licence": (_TEXT, None), "attribution": (_TEXT, None), "note": (_TEXT, None)}),
    "variables": ("name", {"prompt": (_TEXT, _REQUIRED), "hint": (_TEXT, None), "modality": (_TEXT, _REQUIRED), "role": (_TEXT, "discriminating"), "cost": (int, 0), "values": (_TEXTS, _REQUIRED)}),
    "categories": ("slug", {"name": (_TEXT, _REQUIRED), "parents": (_TEXTS, ())}),
    "conditions": ("slug", {"name": (_TEXT, _REQUIRED), "parents": (_TEXTS, ()), "codes": (dict, None), "urgency": (_TEXT, _REQUIRED), "prior": (float, None), "origin": (_TEXT, "human"), "features": (dict, None), "red_flag_features": (_TEXTS, ())}),
    "complaints": ("slug", {"name": (_TEXT, _REQUIRED), "pool": (_TEXTS, _REQUIRED)}),
    "rules": ("id", {"complaints": (_TEXTS, _REQUIRED), "all_of": ([dict], ()), "any_of": ([dict], ()), "min_matches": (int, 1), "min_score": (float, None), "emit": (dict, _REQUIRED)}),
}
PARTS = {
    "feature": {"expect": (_TEXTS, _REQUIRED), "weight": (float, 1.0), "source": (_TEXT, _REQUIRED)},
    "codes": {"snomed": (_TEXT, None), "icd10": (_TEXT, None), "icd11": (_TEXT, None), "icpc2": (_TEXT, None)},
    "clause": {"var": (_TEXT, _REQUIRED), "op": (_TEXT, _REQUIRED), "value": (object, _REQUIRED), "points": (float, None)},
    "emit": {"kind": (_TEXT, _REQUIRED), "urgency": (_TEXT, _REQUIRED), "text_verbatim": (_TEXT, _REQUIRED), "source": (_TEXT, _REQUIRED)},
}


@dataclass(frozen=True)
class Knowledge:
    """A knowledge base; every table is a small dimension, written by hand, and is joined by broadcast."""

    source: DataFrame
    variable: DataFrame
    category: DataFrame
    condition: DataFrame
    feature: DataFrame
    complaint: DataFrame
    rule: DataFrame

    @classmethod
    def of(cls, spark: SparkSession, rows: dict[str, list[tuple]]) -> Knowledge:
        """Tables of rows; columns at the end of a table that its rows leave out are null."""
        tables = {}
        for f in fields(cls):
            empty = spark.createDataFrame([], SCHEMAS[f.name])
            full = len(empty.columns)
            tables[f.name] = spark.createDataFrame([(*r, *[None] * (full - len(r))) for r in rows.get(f.name, [])], empty.schema)
        return cls(**tables)

    def pool(self) -> DataFrame:
        """(complaint, condition), in the pool's order; pools overlap."""
        return F.broadcast(self.complaint.select(F.col("slug").alias("complaint"), F.posexplode("pool").alias("pool_pos", "condition")))

    def clauses(self) -> DataFrame:
        """(id, grp, pos, var, op, value, points): all_of and any_of of all rules."""
        one = lambda g: self.rule.select("id", F.lit(g).alias("grp"), F.posexplode(g).alias("pos", "c")).select("id", "grp", "pos", "c.*")
        return F.broadcast(one("all_of").unionByName(one("any_of")))


def digest(folder: str | Path, pattern: str = "*.yaml") -> str:
    """First 16 hex digits of SHA-256 over relative path and bytes of all files, in sorted order."""
    h = hashlib.sha256()
    for p in sorted(Path(folder).rglob(pattern)):
        h.update(str(p.relative_to(folder)).encode())
        h.update(p.read_bytes())
    return h.hexdigest()[:16]


def _fits(value, kind) -> bool:
    if isinstance(kind, list):
        return isinstance(value, (list, tuple)) and all(_fits(v, kind[0]) for v in value)
    if kind is float:
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    return isinstance(value, kind) and not (kind is int and isinstance(value, bool))


def _read(where: str, entry: dict, fields_: dict) -> dict:
    """An entry with all its fields; ValueError for one that is unknown, missing or of another type."""
    if not isinstance(entry, dict):
        raise ValueError(f"{where}: not a mapping")
    if extra := set(entry) - set(fields_):
        raise ValueError(f"{where}: unknown fields {sorted(map(str, extra))}")
    out = {}
    for name, (kind, default) in fields_.items():
        if name not in entry or entry[name] is None and default is None:
            if default is _REQUIRED:
                raise ValueError(f"{where}: {name} is missing")
            out[name] = list(default) if isinstance(default, tuple) else default
        elif not _fits(entry[name], kind):
            raise ValueError(f"{where}: {name} has a value of another type")
        else:
            out[name] = float(entry[name]) if kind is float else entry[name]
    return out


def _clause(where: str, entry: dict) -> tuple:
    c = _read(where, entry, PARTS["clause"])
    value = c["value"] if isinstance(c["value"], list) else [c["value"]]
    if not all(isinstance(v, (str, int, float)) and not isinstance(v, bool) for v in value):
        raise ValueError(f"{where}: value must be text, a number or a list of texts")
    return c["var"], c["op"], [str(v) for v in value], c["points"]


def _rows(section: str, id: str, entry: dict, pos: int) -> dict[str, list[tuple]]:
    """The rows of one entry by table."""
    where = f"{section} {id!r}"
    key, fields_ = SECTIONS[section]
    e = _read(where, {k: v for k, v in entry.items() if k != key}, fields_)
    if section == "sources":
        return {"source": [(id, e["type"], e["title"], e["url"], e["licence"], e["attribution"], e["note"])]}
    if section == "variables":
        return {"variable": [(id, e["prompt"], e["modality"], e["role"], e["cost"], e["values"], pos, e["hint"])]}
    if section == "categories":
        return {"category": [(id, e["name"], e["parents"])]}
    if section == "complaints":
        return {"complaint": [(id, e["name"], e["pool"])]}
    if section == "conditions":
        codes = _read(f"{where}.codes", e["codes"] or {}, PARTS["codes"])
        features = []
        for var, f in (e["features"] or {}).items():
            f = _read(f"{where}.{var}", f, PARTS["feature"])
            features.append((id, var, f["expect"], f["weight"], f["source"]))
        row = (id, e["name"], e["parents"], e["urgency"], e["origin"], e["red_flag_features"], tuple(codes.values()), e["prior"])
        return {"condition": [row], "feature": features}
    emit = _read(f"{where}.emit", e["emit"], PARTS["emit"])
    all_of, any_of = ([_clause(f"{where}.{g}", c) for c in e[g]] for g in ("all_of", "any_of"))
    return {"rule": [(id, e["complaints"], all_of, any_of, e["min_matches"], e["min_score"], emit["urgency"], emit["source"], emit["kind"], emit["text_verbatim"])]}


def load(spark: SparkSession, folder: str | Path) -> tuple[Knowledge, str]:
    """The knowledge base in a folder of YAML files and its digest.

    Sections are mappings by id or lists of entries that hold it; other sections are ignored. An id may repeat inside a list
    (the last wins), not across files. ValueError, with all that is wrong in the first file or table that has a fault: no
    files, unknown, missing or ill-typed fields, illegal values, and what lints.faults() finds.
    """
    import yaml

    from lodestone.operators.lints import faults

    paths = sorted(Path(folder).rglob("*.yaml"))
    if not paths:
        raise ValueError(f"no YAML under {folder}")
    seen: dict[str, dict[str, dict]] = {s: {} for s in SECTIONS}
    for path in paths:
        content = yaml.safe_load(path.read_text()) or {}
        for section, (key, _) in SECTIONS.items():
            entries = content.get(section)
            if entries is None:
                continue
            if isinstance(entries, list):
                if any(not isinstance(e, dict) or key not in e for e in entries):
                    raise ValueError(f"{path}: an entry of {section} without {key}")
                entries = {e[key]: e for e in entries}
            if twice := set(entries) & set(seen[section]):
                raise ValueError(f"{path}: {section} {sorted(map(str, twice))} defined in another file")
            seen[section].update(entries)
    rows: dict[str, list[tuple]] = {k: [] for k in SCHEMAS}
    for section, entries in seen.items():
        for pos, (id, entry) in enumerate(entries.items()):
            for name, found in _rows(section, id, entry, pos).items():
                rows[name] += found
    kb = Knowledge.of(spark, rows)
    if found := [f"{r['entity']}: {r['finding']}" for r in faults(kb).orderBy("entity", "finding").collect()]:  # of hand-made tables
        raise ValueError(f"{folder}: " + "; ".join(found))
    return kb, digest(folder)


def write_yaml(df: DataFrame, path: str | Path, section: str, key: str) -> None:
    """A hand-made table as one section of a YAML file, a mapping by `key`; nulls are left out. The rows go through the driver: for dimensions."""
    import yaml

    rows = {r[key]: {k: v for k, v in r.asDict(recursive=True).items() if k != key and v is not None} for r in df.orderBy(key).collect()}
    Path(path).write_text(yaml.safe_dump({section: rows}, allow_unicode=True, sort_keys=False))
