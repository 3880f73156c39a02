"""Problem 4: freely typed values mapped to a reference list.

The words of the reference list lie in a trie, letter by letter, with alias paths for other spellings; the entries lie in a
second one, word by word, with alias paths for synonyms and every rotation of the word order ("effusion, chronic renal"). A
value is split into words; each is run through the first trie by a Levenshtein automaton that allows as many edits (a swap
of neighbours is one) as a word of that length may have, and a plural s; what it finds are the branches of the second trie
that are followed. All entries within distance come out with their distance, exact ones or not.

Two rules stand beside the distance. A word cut short ("chron.") stands for all words that begin with it, at 0.5, where
`abbreviations` is set. And what counts as naming an entry: a path on which a word that stands in the list itself is taken
for another, or a remark of the list is left out, gives the entry its distance, but no naming distance.

The list is searched in shards of at most ENTRIES entries, whose tries are made in the tasks that search them; nothing of it
goes to the driver. Which words the list knows is put together over all shards. Values are searched once for each distinct
writing, which Spark finds with partial aggregation, so a value in a third of the rows costs one search; the join back
splits hot values.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.joins import join_groups, small_or_shuffled
from lodestone.session import cut
from lodestone.sources.tables import table

ENTRIES = 50_000
#: Fixed values. Words that carry no name: they are skipped on both sides.
SKIPPED = frozenset("a an and at by for from in of on or the to with".split())
#: Remarks people write around a name; skipped in a value unless the reference list uses them.
REMARKS = frozenset("adults children confirmed diagnosis dx especially eg ddx harmless hx history known leaflet maybe nd nos notes opinion poss possible possibly prev previous probable query rare resolved see st suspected unconfirmed usually".split())
#: Values that say nothing.
PLACEHOLDERS = frozenset("above as causes miscellaneous misc multiple n na nil none not other others page sure tba tbc unclear unknown unsure unspecified various xx xxx".split())
SPELLINGS = (("ae", "e"), ("oe", "e"), ("our", "or"), ("ising", "izing"), ("isation", "ization"), ("yse", "yze"))
END = ""


def plain(text: str) -> str:
    """Lower case, without accents and apostrophes."""
    text = unicodedata.normalize("NFKD", text.lower())
    return re.sub(r"['’̀-ͯ]", "", text)


def split_words(text: str, joined: bool = False) -> list[str]:
    """Words of a text without skipped ones; a point after a word stays with it. joined: hyphens join."""
    text = plain(text).replace("-", "") if joined else plain(text)
    return [w for w in re.findall(r"[^\W_]+\.?", text) if w.rstrip(".") not in SKIPPED]


def entry_words(name: str) -> list[str]:
    return [w.rstrip(".") for w in split_words(name, joined=True)]


def limit(length: int) -> int:
    """Edits a word of that length may have."""
    return 0 if length < 4 else 1 if length < 9 else 2


class Trie:
    """Entries (id, rank, names); rank 0 is preferred to 1 at equal distance."""

    def __init__(self, entries: Iterable[tuple[str, int, list[str]]], abbreviations: bool = True):
        self.letters, self.root, self.memo, self.abbreviations = {}, {}, {}, abbreviations
        for id, rank, names in entries:
            for name in names:
                words = entry_words(name)
                for turn in range(len(words)):
                    node = self.root
                    for word in words[turn:] + words[:turn]:
                        node = node.setdefault(word, {})
                    node.setdefault(END, {})[id] = rank
        self.vocabulary = frozenset(w for w in self.root if w != END)  # every word begins a rotation
        for word in self.vocabulary:
            for spelt in {word, *(word.replace(a, b) for a, b in SPELLINGS)}:
                node = self.letters
                for c in spelt:
                    node = node.setdefault(c, {})
                node.setdefault(END, set()).add(word)

    def matches(self, word: str) -> list[tuple[str, float, bool]]:
        """(word of the list, distance, whether it is taken for another): all that a word may stand for."""
        if word not in self.memo:
            self.memo[word] = self._automaton(word)
        return self.memo[word]

    def _automaton(self, given: str) -> list[tuple[str, float, bool]]:
        word, dotted = given.rstrip("."), given.endswith(".")
        found: dict[str, tuple[float, bool]] = {}

        def put(words: Iterable[str], cost: float, slip: bool) -> None:
            for w in words:
                if (cost, slip) < found.get(w, (99, True)):
                    found[w] = (cost, slip)

        put(self._follow(word).get(END, ()), 0.0, False)
        put(self._follow(word + "s").get(END, ()), 0.1, False)
        if len(word) > 3 and word.endswith("s"):
            put(self._follow(word[:-1]).get(END, ()), 0.1, False)
        if not is_remark(word):
            self._edited(word, 0.0, put)
            if word.endswith("s") and len(word) > 4:
                self._edited(word[:-1], 0.1, put)
            for stem in {word, word.removesuffix("s")} if self.abbreviations else ():
                if len(stem) >= (3 if dotted else 4):
                    stack = [self._follow(stem)]
                    while stack:
                        for c, child in stack.pop().items():
                            put(child, 0.5, not dotted) if c == END else stack.append(child)
        return [(w, cost, slip) for w, (cost, slip) in found.items()]

    def _follow(self, text: str) -> dict:
        node = self.letters
        for c in text:
            node = node.get(c)
            if node is None:
                return {}
        return node

    def _edited(self, stem: str, cost: float, put) -> None:
        """Words within limit(len(stem)) edits.

        The automaton is kept as one number for each count of edits e = 0, 1, 2: its bit j is set if the letters of the path
        so far can be the first j of the stem with e edits. All its states move at once, by shifts, along the path.
        """
        most, size = limit(len(stem)), len(stem)
        if not most:
            return
        at: dict[str, int] = {}  # bit j + 1 for each place j of a letter
        for j, c in enumerate(stem):
            at[c] = at.get(c, 0) | 2 << j
        whole, end = (2 << size) - 1, 1 << size
        two = most > 1
        stack = [(self.letters, 1, 3, 7 & whole, 0, 0, 0)]
        while stack:
            node, r0, r1, r2, p0, p1, last = stack.pop()
            for c, child in node.items():
                if c == END:
                    if (r0 | r1 | r2 if two else r0 | r1) & end:
                        put(child, (0 if r0 & end else 1 if r1 & end else 2) + cost, True)
                    continue
                b = at.get(c, 0)
                swapped = b << 1 & last
                n0 = r0 << 1 & b
                n1 = (r1 << 1 & b | r0 | (r0 | n0) << 1 | p0 << 2 & swapped) & whole
                if two:
                    n2 = (r2 << 1 & b | r1 | (r1 | n1) << 1 | p1 << 2 & swapped) & whole
                    if n2 or n1:
                        stack.append((child, n0, n1, n2, r0, r1, b))
                elif n1:
                    stack.append((child, n0, n1, 0, r0, r1, b))

    def search(self, words: list[str]) -> dict[tuple[str, frozenset[int]], tuple[float, int]]:
        """All entries whose path the words may be: (id, places of words taken for another or left out) -> (distance, rank)."""
        states: dict[int, tuple[dict, dict[frozenset[int], float]]] = {id(self.root): (self.root, {frozenset(): 0.0})}
        for i, word in enumerate(words):
            after: dict[int, tuple[dict, dict[frozenset[int], float]]] = {}
            for node, costs in states.values():
                steps = [(child, more, slip) for w, more, slip in self.matches(word) if (child := node.get(w)) is not None]
                if is_remark(word.rstrip(".")):
                    steps.append((node, 0.0, True))
                for child, more, slip in steps:
                    kept = after.setdefault(id(child), (child, {}))[1]
                    for slips, cost in costs.items():
                        at = slips | {i} if slip else slips
                        if cost + more < kept.get(at, 99):
                            kept[at] = cost + more
            states = after
        out: dict[tuple[str, frozenset[int]], tuple[float, int]] = {}
        for node, costs in states.values():
            if node is self.root:
                continue
            for entry, rank in node.get(END, {}).items():
                for slips, cost in costs.items():
                    out[entry, slips] = min(out.get((entry, slips), (99, 0)), (cost, rank))
        return out

    def rows(self, value: str) -> list[tuple]:
        """(empty, known, entry, joined, distance, rank, slips) of a value: known are the places of words of the list, joined whether two neighbours were read as one, where else nothing is named."""
        words = split_words(value)
        bare = [w.rstrip(".") for w in words]
        known = [i for i, w in enumerate(bare) if w in self.vocabulary]
        if all(w in PLACEHOLDERS or is_remark(w) and w not in self.vocabulary for w in bare):
            return [(True, known, None, None, None, None, None)]
        found = [(False, known, entry, False, cost, rank, sorted(slips)) for (entry, slips), (cost, rank) in self.search(words).items()]
        if not any(known_not_taken(f[6], known) for f in found):
            kept = [i for i, w in enumerate(bare) if not is_remark(w) or w in self.vocabulary]
            for a, b in zip(kept, kept[1:]):
                one = [*words[:a], bare[a] + words[b], *words[b + 1 :]]
                place = lambda i: i if i <= a else i + b - a  # noqa: B023, E731
                found += [(False, known, entry, True, cost, rank, sorted(map(place, slips))) for (entry, slips), (cost, rank) in self.search(one).items()]
        return found or [(False, known, None, None, None, None, None)]


def is_remark(word: str) -> bool:
    """Whether a word may be left out of a value, unless the list knows it."""
    return word in REMARKS or len(word) == 1 or any(c.isdigit() for c in word)


def known_not_taken(slips: Iterable[int], known: list[int]) -> bool:
    return not set(slips) & set(known)


PATHS = "value string, empty boolean, known array<int>, entry string, joined boolean, distance double, rank int, slips array<int>"


def _search(abbreviations: bool):
    def run(values: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        trie = Trie(zip(entries["id"], entries["rank"], entries["names"]), abbreviations)
        rows = [(value, *row) for value in values["value"] for row in trie.rows(value)]
        return pd.DataFrame(rows, columns=[c.split(" ")[0] for c in PATHS.split(", ")]).astype({"rank": "Int32"})

    return run


def all_matches(values: DataFrame, entries: DataFrame, abbreviations: bool = True, most: int = ENTRIES) -> DataFrame:
    """(value, empty, entry, distance, naming, rank): for each distinct value (column `value`, not null) all entries within distance, one row with a null entry if none.

    entries: (id, rank, names array<string>). empty: the value says nothing. naming: the distance over paths that name the
    entry, null if there is none; of a value that names something otherwise, paths with two neighbours read as one don't
    count. Null ids and names are ignored; an empty list matches nothing.
    """
    sc = values.sparkSession.sparkContext
    entries = cut(entries.filter("id IS NOT NULL").select("id", "rank", F.array_compact("names").alias("names")))
    shards = max(1, -(-entries.count() // most))
    # a stated number of slices, since sizes in bytes say little of what a search costs
    slices = max(1, -(-2 * sc.defaultParallelism // shards))
    span = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    v = values.select("value").distinct().withColumn("shard", span(shards)).withColumn("slice", part("value", slices))
    e = entries.withColumn("shard", part("id", shards)).withColumn("slice", span(slices))
    v, e = (x.repartition(2 * sc.defaultParallelism, "shard", "slice") for x in (v, e))
    paths = v.groupBy("shard", "slice").cogroup(e.groupBy("shard", "slice")).applyInPandas(_search(abbreviations), PATHS)
    one = F.struct("entry", "joined", "distance", "rank", "slips")
    per_value = paths.groupBy("value").agg(F.bool_and("empty").alias("empty"), F.array_distinct(F.flatten(F.collect_set("known"))).alias("known"), F.collect_list(F.when(F.col("entry").isNotNull(), one)).alias("paths"))
    names = F.filter("paths", lambda p: F.size(F.array_intersect(p["slips"], F.col("known"))) == 0)
    # two words are read as one only if nothing is named otherwise
    direct = F.exists(names, lambda p: ~p["joined"])
    named = F.transform(F.filter(names, lambda p: ~p["joined"] | ~direct), lambda p: F.struct(p["entry"], p["distance"]))
    rows = per_value.select("value", "empty", F.explode_outer("paths").alias("p"), named.alias("named"))
    mine = F.array_min(F.transform(F.filter("named", lambda x: x["entry"] == F.col("p.entry")), lambda x: x["distance"]))
    rows = rows.select("value", "empty", "p.entry", "p.distance", mine.alias("naming"), "p.rank")
    return rows.groupBy("value", "entry").agg(F.first("empty").alias("empty"), F.min("distance").alias("distance"), F.min("naming").alias("naming"), F.min("rank").alias("rank")).select("value", "empty", "entry", "distance", "naming", "rank")


def map_values(values: DataFrame, terms: DataFrame) -> DataFrame:
    """values (tbl, row_id, name, code) with the code of the term each name stands for: (tbl, row_id, mapped).

    terms: (snomed, term, synonyms, active). Inactive terms are known, so that their names aren't taken for slips of others,
    but never the result. Of the entries that a name names the nearest decides; at equal distance the one that the row's own
    code names, else the smallest code. A name that says nothing takes its own code, cleaned of blanks, labels and a decimal
    part, if that is active: the contract asks for it, no search is done. All else is 'none'. Null or blank names, and names
    that are an active term letter by letter, give no row.
    """
    entries = terms.select(F.col("snomed").alias("id"), F.when(F.col("active") == "1", 0).otherwise(1).alias("rank"), F.concat(F.array("term"), F.coalesce("synonyms", F.array().cast("array<string>"))).alias("names"))
    active = cut(terms.filter(F.col("active") == "1").select("snomed", "term"))
    own = F.regexp_replace(F.regexp_replace("code", r"\.0*\s*$", ""), r"\D", "")
    rows = values.select("tbl", "row_id", F.col("name").alias("value"), own.alias("code"))
    rows = rows.filter(F.col("value").isNotNull() & F.regexp_like("value", F.lit(r"[^\s\p{Z}]")))
    literal = small_or_shuffled(cut(active.select(F.col("term").alias("value")).dropna().distinct()))
    rows = cut(rows.join(literal, "value", "left_anti"))
    found = all_matches(rows, entries).withColumn("names", F.col("naming").isNotNull())
    per_value = found.groupBy("value").agg(F.first("empty").alias("empty"), F.min(F.when(F.col("names"), F.struct("naming", "rank"))).alias("least"), F.collect_list(F.struct("naming", "rank", "entry")).alias("all"))
    counts = rows.groupBy("value").agg(F.count(F.lit(1)).alias("size"))
    nearest = F.array_sort(F.transform(F.filter("all", lambda x: (x["naming"] == F.col("least.naming")) & (x["rank"] == F.col("least.rank"))), lambda x: x["entry"]))
    best = F.when(F.col("least.rank") == 0, nearest).alias("best")
    decided = cut(per_value.select("value", "empty", best).join(counts, "value"))
    codes = small_or_shuffled(cut(active.select(F.col("snomed").alias("code"), F.lit(True).alias("valid")).dropna().dropDuplicates(["code"])))
    joined = join_groups(rows, decided, ["value"], "size").join(codes, "code", "left")
    named = F.when(F.array_contains("best", F.col("code")), F.col("code")).otherwise(F.try_element_at("best", F.lit(1)))
    mapped = F.when(F.col("empty"), F.when(F.col("valid"), F.col("code"))).otherwise(named)
    return joined.select("tbl", "row_id", F.coalesce(mapped, F.lit("none")).alias("mapped"))


def _values(spark: SparkSession, folder: str) -> DataFrame:
    causes, names = table(spark, folder, "presentation_causes"), table(spark, folder, "presentations")
    return causes.select(F.lit("presentation_causes").alias("tbl"), F.col("cause_id").cast("string").alias("row_id"), F.col("cause_name").alias("name"), F.col("snomed").alias("code")).unionByName(
        names.select(F.lit("presentations").alias("tbl"), F.col("slug").alias("row_id"), "name", F.col("snomed").alias("code"))
    )


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return map_values(_values(spark, folder), table(spark, folder, "terms")).withColumnRenamed("mapped", "snomed")


def p4_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """Values that stand for no term, with the rows that hold them."""
    values = _values(spark, folder)
    none = map_values(values, table(spark, folder, "terms")).filter(F.col("mapped") == "none")
    return values.select("tbl", "row_id", "name").join(none.select("tbl", "row_id"), ["tbl", "row_id"]).groupBy("tbl", "name").agg(F.count(F.lit(1)).alias("n_rows"))


QUERIES = {"p4_found": p4_found, "p4_unmatched": p4_unmatched}
SQL: dict[str, str] = {}
