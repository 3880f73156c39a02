"""Ordinal facets of a symptom record, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The bands in order; `unspecified` says nothing and has no place in the order.
DURATIONS = ["under_1_day", "one_to_7_days", "one_to_3_weeks", "three_to_8_weeks", "over_8_weeks"]
ONSETS = ["seconds_to_minutes", "hours", "days", "weeks_or_longer"]
SEVERITIES = ["mild", "moderate", "severe"]
PROGRESSIONS = ["improving", "stable", "worsening"]
POLARITIES = ["present", "absent"]
UNSPECIFIED = "unspecified"
FACET_FLOOR = 0.4
BANNED = (" and ", " or ", " with ", "you ", "your ", " a bit ", " sometimes ")


def band(value: Column, order: list[str]) -> Column:
    """Place of a band in its order from 0; null for null, unspecified or unknown."""
    return F.nullif(F.array_position(F.array(*map(F.lit, order)), value), F.lit(0)) - 1


def band_distance(a: Column, b: Column, order: list[str]) -> Column:
    """Distance in [0, 1]; null if either side says nothing."""
    return F.abs(band(a, order) - band(b, order)) / F.lit(float(len(order) - 1))


def place_multiplier(onset: Column, duration: Column, other_onset: Column, other_duration: Column) -> Column:
    """What a match keeps of its weight, from places in the order: 1 less the mean known distance, at least the floor; 1 if no distance is known."""
    o = F.abs(onset - other_onset) / F.lit(float(len(ONSETS) - 1))
    d = F.abs(duration - other_duration) / F.lit(float(len(DURATIONS) - 1))
    known = F.when(o.isNotNull() & d.isNotNull(), (o + d) / 2).otherwise(F.coalesce(o, d))
    return F.coalesce(F.greatest(F.lit(FACET_FLOOR), 1 - known), F.lit(1.0))


def facet_multiplier(onset: Column, duration: Column, other_onset: Column, other_duration: Column) -> Column:
    return place_multiplier(band(onset, ONSETS), band(duration, DURATIONS), band(other_onset, ONSETS), band(other_duration, DURATIONS))


def core_phrase(concept: Column, character: Column, site: Column) -> Column:
    """[character ]concept[ in the site]; blanks count as absent."""
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    head = F.concat_ws(" ", some(character), some(concept))
    return F.concat(head, F.when(some(site).isNotNull(), F.concat(F.lit(" in the "), some(site))).otherwise(""))


def record_faults(r) -> Column:
    """Codes of the contract's rules that a record (a mapping of field to column) breaks, in a fixed order; empty if it holds."""
    words = lambda c: F.size(F.regexp_extract_all(c, F.lit(r"\S+"), 0))
    rules = []
    for field, order in (("onset", ONSETS), ("duration", DURATIONS), ("severity", SEVERITIES), ("progression", PROGRESSIONS)):
        rules.append((field, ~r[field].isin([*order, UNSPECIFIED])))
    rules.append(("polarity", ~r["polarity"].isin(POLARITIES)))
    for slot in ("concept", "character", "site"):
        rules.append((f"{slot}_case", r[slot] != F.lower(r[slot])))
        padded = F.concat(F.lit(" "), r[slot], F.lit(" "))
        rules.append((f"{slot}_bundle", F.lit(False) if not BANNED else _any([padded.contains(b) for b in BANNED])))
    rules += [("concept_missing", r["concept"] == ""), ("concept_long", words(r["concept"]) > 2), ("character_long", words(r["character"]) > 1), ("site_long", words(r["site"]) > 2)]
    return F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in rules)))


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out
