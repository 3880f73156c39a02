"""Problem 8: personal information in free text, by bootstrapped contextual extraction.

1. One pass over the texts finds candidates by shape alone: e-mail addresses however their signs are written, codes and
   numbers, capitalised name spans, house numbers with capitalised words. Each gives an edge between a lexical pattern (the
   words before it; for a town the kind of street before it) and an instance (the sign an e-mail address is written with,
   the format of a number, the words of a name, the kind of street, the town); edges are summed before they leave a task.
2. Seeds (e-mail addresses with an @ or a dot in brackets, numbers written as telephone numbers or national insurance numbers, names after a title,
   addresses that end in a postcode) make the patterns they stand in trusted, as far as most of what a pattern holds is
   trusted; trusted patterns make the instances trusted that stand mostly in such patterns, and so on for ROUNDS rounds, in
   Spark, over the sums. Titles are patterns trusted from the start, until the sums tell that most of what follows one is
   no name.
3. A second pass extracts every occurrence of what is trusted: e-mail addresses by their sign, numbers by their format, names
   in trusted patterns or made of trusted words, addresses built of trusted street kinds and towns; and addresses that their
   shape tells from house number to postcode.

Whole texts are read in both passes. What was learned is broadcast for the second pass as far as a list has at most LEXICON
entries; of a longer list the commonest are, and the texts' own words, patterns and formats are joined to the rest of it, so
that every text meets the whole of what was learned, whatever the corpus' size.
"""

from __future__ import annotations

import re
from collections import ChainMap, Counter
from collections.abc import Iterable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import cut
from lodestone.sources.tables import table

ROUNDS, LEXICON = 3, 200_000
#: Fixed values.
TITLES = "mr mrs ms miss mx dr prof professor sister nurse sr sir dame herr frau".split()
#: Titles that are no words of other meaning; words between the parts of a name.
ABBREVIATIONS = frozenset("mr mrs ms mx dr prof".split())
PARTICLES = frozenset("de da di do dos das du del della der den van von zu zum zur ter ten la le bin ibn bint al el".split())
UNITS = "flat apt apartment unit suite room".split()
GERMAN_STREETS = "weg straße strasse str platz allee gasse ring damm ufer".split()
EMAIL = r"(?<![\w.+-])[A-Za-z0-9][\w.+-]*(?:@|\s?[\(\[]at[\)\]]\s?)[A-Za-z0-9-]+(?:(?:\.|\s?[\(\[]dot[\)\]]\s?)[A-Za-z0-9-]+)+"
CODES = r"(?<![\w.@/+-])(?:[A-Z]{2} \d{2} \d{2} \d{2} [A-Z]|[A-Z]{1,4}-?\d[\d-]{3,}\d[A-Z]?|(?:\+|\(\+)?\(?\d+\)?(?:[ .\-/]?\(?\d+\)?)+)(?![\w@])"
NINO = r"(?:[A-Z]{2} \d{2} \d{2} \d{2} [A-D]|[A-Z]{2}\d{6}[A-D])"
POSTCODE = r"(?:[A-Z]{1,2}\d[A-Z\d]?\s\d[A-Z]{2}|[A-Z]{2}\s\d{5})"
_NAME_WORD = r"[^\W\d_a-z][^\W\d_]*(?:['’-][^\W\d_]+)*"
NAME_SPAN = rf"(?<![\w'’-])(?:[A-Z]\.\s?)*{_NAME_WORD}(?:[^\S\n]+[A-Z]\.)*(?:,?[^\S\n]+{_NAME_WORD})+(?![\w])|(?<![\w'’-])(?:[A-Z]\.[^\S\n]?)+{_NAME_WORD}(?![\w])"
TITLE = rf"(?<![\w'’-])(?:{'|'.join(TITLES)})(?:\.?[^\S\n]+)(?=\S)"
STRICT_ADDRESS = rf"(?<![\w-])\d{{1,4}}[A-Z]?\s((?:[A-Z][\w'’.-]*\s){{1,3}}?)([A-Z][a-z]+)(?:,?\s(?:Apt|Flat|Unit)\s\d+[A-Z]?)?(?:,\s|\n)([A-Z][\w-]+(?:\s[A-Z][\w-]+)?),?\s{POSTCODE}(?!\w)"
LOOSE_ADDRESS = r"(?<![\w-])\d{1,4}[A-Z]?\s(?:[A-Z][\w'’.-]*\s){1,3}?([A-Z][a-z]+)(?:(?:,\s|\n)([A-Z][\w-]+(?:\s[A-Z][\w-]+)?))?(?=[,.;\n]|$)"
STREET_LIKE = re.compile(rf"\d[A-Z]?(?: [A-Z][\w'’.-]*){{2,4}}(?:, [A-Z][\w-]+(?: [A-Z][\w-]+)?)?|(?i:\d[a-z]?(?: [\w'’.-]+){{2,4}},\s[\w-]+(?: [\w-]+)?,?\s{POSTCODE})")


_BEFORE = re.compile(r"[^\W_]+|@")


def before(text: str, start: int) -> str:
    """The up to two words before a place, lower case, on its own line."""
    span = 48
    while True:  # back to the line's or a tag's end, or until two words lie whole in what is looked at
        at = max(0, start - span)
        line = text[at:start].rsplit("\n", 1)[-1]
        whole = len(line) < start - at or at == 0
        if (tag := line.rfind(">")) >= 0:
            line, whole = line[tag + 1 :], True
        found = _BEFORE.findall(line.lower())
        if whole or len(found) > 2:
            return " ".join(found[-2:])
        span *= 4


def may_mail(text: str) -> bool:
    """Whether a text holds any sign that EMAIL asks for."""
    return "@" in text or "at)" in text or "at]" in text


def email_sign(address: str) -> str:
    """What an e-mail address has in place of its @."""
    return re.search(r"@|[\[(]at[\])]", address).group()


def formats(code: str) -> tuple[str, str]:
    """The format of a code with its first three digits, and without."""
    bare = re.sub(r"\d", "d", code)
    if code[0].isalpha():
        return bare, bare
    n = [m.start() for m in re.finditer(r"\d", code)][:3][-1] + 1
    return code[:n] + bare[n:], bare


def codes_in(text: str, codes: re.Pattern) -> Iterator[tuple[int, int, str]]:
    """Codes of at least six digits, without a bracket around the whole."""
    for m in codes.finditer(text):
        code, start = m.group(), m.start()
        if code.startswith("(") and code.find(")") in (-1, len(code) - 1):
            code, start = code[1:], start + 1
        if code.endswith(")") and "(" not in code:
            code = code[:-1]
        if sum(c.isdigit() for c in code) >= 6:
            yield start, start + len(code), code


def seed_kind(code: str) -> str | None:
    if re.fullmatch(NINO, code):
        return "id_number"
    n = sum(c.isdigit() for c in code)
    if (code[0] == "+" or code.startswith(("(+", "00"))) and 10 <= n <= 15 or re.match(r"\(0\d+\)|\(\d{3}\) \d{3}-\d{4}$|07\d{3} ?\d{3} ?\d{3}$", code) and 10 <= n <= 11:
        return "phone"
    return None


def _edges(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(family, pattern, instance, broad, seed, n) of a task's texts."""
    emails, codes, names, strict, loose = (re.compile(p) for p in (EMAIL, CODES, NAME_SPAN, STRICT_ADDRESS, LOOSE_ADDRESS))
    titles, words = re.compile(TITLE, re.I), re.compile(r"[^\W\d_][\w'’-]+")
    titled = re.compile(rf"(?:[A-Z]\.[^\S\n]?)*{_NAME_WORD}(?:[^\S\n]+[A-Z]\.)*(?:,?[^\S\n]+{_NAME_WORD})?")
    title = re.compile(rf"(?:{'|'.join(TITLES)})$", re.I)
    for batch in batches:
        n: Counter = Counter()
        every: Counter = Counter()
        for text in batch["text"]:
            for m in emails.finditer(text) if may_mail(text) else ():
                n["email", before(text, m.start()), (sign := email_sign(m.group())), "", "email" if sign == "@" or "dot" in re.findall(r"[\[(](\w+)[\])]", m.group()) else None] += 1
            free = emails.sub(lambda m: " " * len(m.group()), text) if may_mail(text) else text
            for start, _, code in codes_in(free, codes):
                exact, broad = formats(code)
                n["code", before(text, start), exact, broad, seed_kind(code)] += 1
            # how often a word stands anywhere, but for what looks like a street's name
            every.update(words.findall(STREET_LIKE.sub(" ", free).lower()))
            whole = set()
            for m in strict.finditer(free):
                whole.add(m.start())
                n["street", before(text, m.start()), m.group(2).lower(), "", "address"] += 1
                n["town", m.group(2).lower(), " ".join(m.group(3).lower().split()), "", "address"] += 1
            for m in loose.finditer(free):
                if m.start() not in whole:
                    n["street", before(text, m.start()), m.group(1).lower(), "", None] += 1
                    if m.group(2):
                        n["town", m.group(1).lower(), " ".join(m.group(2).lower().split()), "", None] += 1
            for m in titles.finditer(free):
                got = titled.match(free, m.end())
                if got:
                    for w in re.findall(r"[^\W\d_][\w'’-]+", got.group()):
                        n["name", before(text, m.end()), w.lower(), "", "name" if "," not in got.group() else None] += 1
            for m in names.finditer(free):
                left = before(text, m.start())
                if title.search(left) or re.search(r"\d$", left):
                    continue
                for w in re.findall(r"[^\W\d_][\w'’-]+", m.group()):
                    n["name", left, w.lower(), "", None] += 1
                comma = m.group().find(",")
                if comma > 0:  # "Surname, Given" or a word before a name: what follows the comma counts by itself too
                    left = before(text, m.start() + comma + 1)
                    for w in re.findall(r"[^\W\d_][\w'’-]+", m.group()[comma:]):
                        n["name", left, w.lower(), "", None] += 1
        rows = [(*k, v) for k, v in n.items()] + [("word", "", w, "", None, v) for w, v in every.items()]
        yield pd.DataFrame(rows, columns=["family", "pattern", "instance", "broad", "seed", "n"]).astype({"n": "int64"})


EDGES = "family string, pattern string, instance string, broad string, seed string, n bigint"
#: By family: least part of a pattern's occurrences that must be trusted (an identity number has many formats, of which a
#: seed is one); least number of trusted patterns that an instance stands in; least number of times that a seed must occur.
PATTERN_AT = {"code": 0.1, "name": 0.5, "email": 0.5, "street": 0.5, "town": 0.5}
PATTERNS = {"code": 3, "name": 1, "email": 1, "street": 1, "town": 1}
SEEDED = {"code": 3, "name": 3, "email": 1, "street": 3, "town": 3}
#: Least part of an instance's occurrences in trusted patterns; times a title must be followed by something before it can lose its trust.
INSTANCE_AT, TITLE_SEEN = 0.4, 10
#: A name's word is a seed if so much of it follows a title.
SEED_AT = 0.03


def learn(texts: DataFrame) -> dict[str, DataFrame]:
    """patterns (family, pattern, kind, precision, support), instances (family, instance, kind, n), usual: words that are no names (instance, n), untitled: titles that mostly stand before no name (pattern, n)."""
    found = texts.select("text").mapInPandas(_edges, EDGES).groupBy("family", "pattern", "instance", "broad", "seed").agg(F.sum("n").alias("n"))
    found = cut(found)
    graph = found.filter("family <> 'word'")
    last = F.concat(F.lit("* "), F.element_at(F.split("pattern", " "), -1)).alias("last")  # the pattern's last word alone is a pattern too
    exact = cut(graph.groupBy("family", "pattern", last, "instance").agg(F.sum("n").alias("n")))
    broad = graph.filter("family = 'code' AND broad <> instance").groupBy("family", "pattern", last, F.col("broad").alias("instance")).agg(F.sum("n").alias("n"))
    edges = cut(exact.unionByName(broad))
    every = found.filter("family = 'word'").select(F.lit("name").alias("family"), "instance", F.col("n").alias("every"))
    totals = edges.groupBy("family", "instance").agg(F.sum("n").alias("total")).join(every, ["family", "instance"], "left")
    totals = cut(totals.select("family", "instance", F.greatest("total", F.coalesce("every", F.lit(0))).alias("total")))
    exact = cut(exact.drop("last").unionByName(exact.select("family", F.col("last").alias("pattern"), "instance", "n")))
    # what doesn't change from round to round is put beside the edges once
    exact = cut(exact.join(exact.groupBy("family", "pattern").agg(F.sum("n").alias("all")), ["family", "pattern"]))
    edges = cut(edges.join(totals, ["family", "instance"]))
    by_family = lambda of: reduce(lambda c, x: c.when(F.col("family") == x[0], x[1]), of.items(), F)
    seeds = graph.filter(F.col("seed").isNotNull()).groupBy("family", "instance", F.col("seed").alias("kind")).agg(F.sum("n").alias("seeded"))
    seeds = seeds.join(totals, ["family", "instance"]).filter((F.col("seeded") >= by_family(SEEDED)) & (F.col("seeded") >= SEED_AT * F.col("total"))).select("family", "instance", "kind")
    seeds = cut(seeds)
    trusted, patterns = cut(seeds.dropDuplicates(["family", "instance"])), None
    for _ in range(ROUNDS):
        good = exact.join(trusted, ["family", "instance"]).groupBy("family", "pattern", "kind").agg(F.sum("n").alias("good"), F.count(F.lit(1)).alias("support"), F.first("all").alias("all"))
        scored = good.withColumn("precision", F.col("good") / F.col("all"))
        scored = scored.filter((F.col("precision") >= by_family(PATTERN_AT)) & (F.col("good") >= by_family(SEEDED)))
        # a pattern of two kinds is one of the kind that it mostly holds
        patterns = cut(scored.groupBy("family", "pattern").agg(F.max_by(F.struct("kind", "precision", "support"), "good").alias("x")).select("family", "pattern", "x.*"))
        two, one = patterns.select("family", "pattern", "kind"), patterns.select("family", F.col("pattern").alias("last"), F.col("kind").alias("kind1"))
        held = edges.join(two, ["family", "pattern"], "left").join(one, ["family", "last"], "left").withColumn("kind", F.coalesce("kind", "kind1"))
        held = held.filter(F.col("kind").isNotNull()).groupBy("family", "instance", "kind").agg(F.sum("n").alias("held"), F.countDistinct("last").alias("patterns"), F.first("total").alias("total"))
        share = held.withColumn("share", F.col("held") / F.col("total"))
        sure = share.filter((F.col("share") >= INSTANCE_AT) & (F.col("patterns") >= by_family(PATTERNS)))
        best = sure.groupBy("family", "instance").agg(F.max_by("kind", "share").alias("kind"))
        trusted = cut(seeds.join(best, ["family", "instance"], "left_anti").unionByName(best.select("family", "instance", "kind")))
    usual = every.withColumnRenamed("every", "n").filter("n >= 5").join(trusted, ["family", "instance"], "left_anti")
    titled = exact.select("family", "pattern", "all").distinct().filter((F.col("family") == "name") & F.col("pattern").isin([f"* {t}" for t in TITLES]) & (F.col("all") >= TITLE_SEEN))
    untitled = titled.join(patterns, ["family", "pattern"], "left_anti").select(F.substring("pattern", 3, 40).alias("pattern"), F.col("all").alias("n"))
    return {"usual": usual, "patterns": patterns, "instances": trusted.join(totals.withColumnRenamed("total", "n"), ["family", "instance"]), "untitled": untitled}


#: What the second pass looks up: a list's name, its table and rows among what was learned, and the columns of key and count, the same for all lists of a table.
LISTS = {
    "pattern": ("patterns", "family = 'name' AND pattern <> ''", "pattern", "support"),
    "word": ("instances", "family = 'name'", "instance", "n"),
    "code": ("instances", "family = 'code'", "instance", "n"),
    "usual": ("usual", "true", "instance", "n"),
    "street": ("instances", "family = 'street'", "instance", "n"),
    "town": ("instances", "family = 'town'", "instance", "n"),
    "email": ("instances", "family = 'email'", "instance", "n"),
    "untitled": ("untitled", "true", "pattern", "n"),
}


class Learned:
    """What the second pass needs: key to kind of every list, and which lists are longer (their rest is `more`: list, key, kind; None if all are whole)."""

    def __init__(self, tables: dict[str, DataFrame], most: int = LEXICON):
        parts = []
        for at in dict.fromkeys(x[0] for x in LISTS.values()):  # each table once, whatever the number of its lists
            own = {name: x for name, x in LISTS.items() if x[0] == at}
            _, _, key, by = next(iter(own.values()))
            name = reduce(lambda c, x: c.when(F.expr(x[1][1]), x[0]), own.items(), F)
            kind = F.col("kind") if at in ("patterns", "instances") else F.lit("")
            parts.append(tables[at].select(name.alias("list"), F.col(key).alias("key"), kind.alias("kind"), F.col(by).alias("n")).filter("list IS NOT NULL"))
        every = cut(reduce(DataFrame.unionByName, parts).withColumn("b", F.floor(F.log2("n")).cast("int")))
        # of a list its rows above the least count that leaves at most `most`; sizes has a few dozen rows for each list
        least, kept = dict.fromkeys(LISTS, 0), dict.fromkeys(LISTS, 0)
        for r in every.groupBy("list", "b").count().orderBy(F.desc("b")).collect():
            kept[r["list"]] += r["count"]
            if kept[r["list"]] > most:
                least[r["list"]] = max(least[r["list"]], r["b"] + 1)
        self.long = frozenset(x for x, b in least.items() if b)
        shown = F.col("b") >= F.element_at(F.create_map(*(F.lit(v) for kv in least.items() for v in kv)), F.col("list"))
        self.lists: dict[str, dict[str, str]] = {x: {} for x in LISTS}
        for r in every.filter(shown).select("list", "key", "kind").collect():
            self.lists[r["list"]][r["key"]] = r["kind"]
        self.more = every.filter(~shown).select("list", "key", "kind") if self.long else None

    def __getstate__(self):
        return self.__dict__ | {"more": None}


_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*\.?")


def _places(text: str, of: str) -> set[str]:
    """The words of a text that may be a street kind or a town, pairs of them too for towns."""
    text = text.lower()
    words = list(re.finditer(r"[^\W_][\w-]*", text))
    heads = lambda w: [w[:i] for i in range(1, len(w) + 1) if w[i : i + 1] in ("", "-")]
    pairs = {f"{a.group()} {b}" for a, b in zip(words, words[1:]) if text[a.end() : b.start()].isspace() for b in heads(b.group())} if of == "town" else set()
    return {x for w in words for x in heads(w.group())} | pairs


def _looked_up(text: str, learned: Learned, codes: re.Pattern) -> set[tuple[str, str]]:
    """(list, key) that the second pass may ask of this text, of lists that are longer than what was broadcast."""
    asked: set[tuple[str, str]] = set()
    if learned.long & {"word", "usual"}:
        for w in {w.rstrip(".").lower() for w in _WORD.findall(text)}:
            cuts = [m.start() for m in re.finditer("['’-]", w)]  # a finding beside it may cut a word there
            asked |= {(x, w[a:b]) for x in ("word", "usual") for a in (0, *(c + 1 for c in cuts)) for b in (*cuts, len(w)) if a < b}
    if "pattern" in learned.long:
        left = {before(text, m.start()) for m in _WORD.finditer(text)}
        last = {x.rpartition(" ")[2] for x in left} | {""}  # all that is left beside a finding
        asked |= {("pattern", x) for x in left | last | {"* " + x for x in last}}
    if "code" in learned.long:
        asked |= {("code", x) for _, _, code in codes_in(text, codes) for x in formats(code)}
    if learned.long & {"street", "town"}:
        asked |= {(x, key) for x in ("street", "town") for key in _places(text, x)}
    return {(x, key) for x, key in asked if x in learned.long and key not in learned.lists[x]}


def _asked(shared):
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = re.compile(CODES)
        for batch in batches:
            rows = {(id, *x) for id, text in zip(batch["id"], batch["text"]) for x in _looked_up(text, shared.value, codes)}
            yield pd.DataFrame(sorted(rows), columns=["id", "list", "key"]).astype({"id": "int64"})

    return run


class Finder:
    """Spans (start, end, kind) of personal information in a text; they don't overlap."""

    def __init__(self, learned: Learned, more: Iterable[str] = (), text: str = ""):
        """more: entries beside those broadcast, each "list, key, kind" with tabs between, as they were joined to this one text."""
        own: dict[str, dict[str, str]] = {x: {} for x in LISTS}
        for entry in more:
            x, key, kind = entry.split("\t")
            own[x][key] = kind
        if learned.long & {"street", "town"}:  # then only this text's places are in the expression
            lists = learned.lists | {x: {k: "" for k in _places(text, x) if k in learned.lists[x]} for x in ("street", "town")}
        else:
            lists = learned.lists
        lists = {x: ChainMap(own[x], lists[x]) if own[x] else lists[x] for x in LISTS}
        self.patterns, self.words, self.usual, self.codes, self.towns = (lists[x] for x in ("pattern", "word", "usual", "code", "town"))
        self.email, self.code = re.compile(EMAIL), re.compile(CODES)
        units = "|".join(UNITS)
        kinds = "|".join(map(re.escape, sorted(lists["street"]))) or r"(?!)"
        towns = "|".join(re.escape(t).replace(r"\ ", r"\s+") for t in sorted(self.towns, key=len, reverse=True)) or r"(?!)"
        gap = r"(?:,?[^\S\n]+|,?[^\S\n]*\n[^\S\n]*)"
        street = rf"(?:(?:{units})\.?\s+\d+[a-z]?{gap})?\d{{1,4}}[a-z]?[^\S\n]+(?:(?:st\.|[\w'’-]+)[^\S\n]+){{1,3}}?(?:{kinds})(?!\w)(?:{gap}(?:{units})\.?\s+\d+[a-z]?(?!\w))?"
        german = rf"[^\W\d_]+(?:{'|'.join(GERMAN_STREETS)})\.?[^\S\n]+\d{{1,4}}[a-z]?(?!\w)(?:{gap}\d{{5}}[^\S\n]+[^\W\d_]+)"
        town = r"[^\W\d_][\w'’-]*(?:[^\S\n]+[^\W\d_][\w'’-]*){0,2}"  # not learned: a postcode closes the address
        self.address = re.compile(rf"(?<![\w-])(?:{street}(?:{gap}{town}{gap}{POSTCODE}(?!\w)|(?:{gap}(?:{towns})(?!\w))?(?:{gap}{POSTCODE}(?!\w))?))", re.I)
        self.german, self.five = re.compile(rf"(?<![\w-]){german}", re.I), re.compile(r"\d{5}")
        self.strict = re.compile(rf"(?:(?<![\w-])(?i:{units})\.?\s+\d+[A-Za-z]?{gap})?{STRICT_ADDRESS}")
        self.signs = lists["email"]
        titles = [t for t in TITLES if t not in lists["untitled"]]  # fixed and few, so that these lists never are longer than what is broadcast
        self.title = re.compile(rf"(?<![\w'’-])(?:{'|'.join(titles) or '(?!)'})\.?[^\S\n]+(?=\S)", re.I)
        self.word = _WORD
        self.begins: dict[str, tuple] = {}  # by word, whether a name may begin with it: known, initial; empty if not

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        taken: list[tuple[int, int, str]] = [(m.start(), m.end(), "email") for m in (self.email.finditer(text) if may_mail(text) else ()) if email_sign(m.group()) in self.signs]

        def free(a: int, b: int) -> bool:
            return all(b <= x or a >= y for x, y, _ in taken)

        for start, end, code in codes_in(text, self.code):
            if free(start, end):
                exact, broad = formats(code)
                kind = self.codes.get(exact) or self.codes.get(broad)
                if kind:
                    taken.append((start, end, kind))
        taken += [(a, b, "address") for a, b in self._addresses(text, free)]
        rest, last = [], 0
        for start, end, _ in sorted(taken):
            rest += [text[last:start], "\n" * (end - start)]
            last = end
        for start, end in self._names("".join(rest) + text[last:]):
            if free(start, end):
                taken.append((start, end, "name"))
        return sorted(taken)

    def _addresses(self, text: str, free) -> list[tuple[int, int]]:
        """Addresses of learned kinds, and those that their shape alone tells, whatever was learned; where two overlap, all that they hold."""
        out: list[tuple[int, int]] = []
        for a, b in sorted(m.span() for r in (self.address, self.strict, *([self.german] if self.five.search(text) else [])) for m in r.finditer(text) if free(*m.span())):
            if out and a < out[-1][1] and free(out[-1][0], max(b, out[-1][1])):
                out[-1] = out[-1][0], max(b, out[-1][1])
            elif not out or a >= out[-1][1]:
                out.append((a, b))
        return out

    def _known(self, word: str) -> bool:
        return len(word) > 2 and word.lower() in self.words

    def _name_at(self, text: str, at: int, announced: bool, title: str | None = None) -> tuple[int, int] | None:
        """A name that begins at that place: initials and words that are known, or capitalised where a name is announced; after a title any capitalised ones."""
        parts, end = [], at
        # a title in words (sister, nurse) tells no name where it is written small or all in capitals, or where its full stop may end the sentence
        sure = title is not None and (title.rstrip(".").lower() in ABBREVIATIONS or title.istitle() and not title.endswith("."))
        while True:
            m = self.word.match(text, end)
            if not m:
                break
            w = m.group()
            initial = len(w.rstrip(".")) == 1 and w[0].isupper() and w.endswith(".")
            bare = w.rstrip(".")
            known = not initial and (self._known(bare) or title is not None and bare.lower() in self.words)
            rare = bare.lower() not in self.usual or bare.lower() in self.towns
            likely = announced and not initial and len(bare) > 2 and bare[0].isupper() and rare and all(p[0] for p in parts)
            if announced and not initial and not known and len(bare) > 4 and [p[1] for p in parts if not p[0]] == [True]:
                # an unknown word after a known one, written alike: not one that other sentences use, unless also a place
                likely = bare[0].isupper() == text[parts[0][2]].isupper() and rare
            if sure and not initial and bare[0].isupper():
                long = [text[p[2] : p[3]] for p in parts if not p[0] and p[3] - p[2] > 1]
                # words all in capitals go on as long as other sentences don't use them
                likely = bare.lower() not in TITLES and (not long or len(bare) == 1 or not bare.isupper() and not long[0].isupper() or bare.isupper() and rare)
            particle = not (initial or known or likely) and bare == w and bare.lower() in PARTICLES and (bool(parts) or sure)
            if not (initial or known or likely or particle):
                break
            initial |= particle  # no word by itself: dropped at the end of a name
            stop = m.end() if initial else m.start() + len(bare)
            parts.append((initial, known, m.start(), stop))
            after = re.compile(r",[^\S\n]+|[^\S\n]+").match(text, stop) if initial or not w.endswith(".") else None
            if after is None and initial and stop < len(text) and text[stop : stop + 1].isalpha():
                end = stop
                continue
            if after is None:
                break
            if "," in after.group():
                n = self.word.match(text, after.end())
                if not (n and self._known(n.group().rstrip(".")) and sum(1 for p in parts if not p[0]) == 1):
                    break
            end = after.end()
        while parts and parts[-1][0]:
            parts.pop()
        words = [p for p in parts if not p[0]]
        if not words:
            return None
        return parts[0][2], parts[-1][3]

    def _names(self, text: str) -> Iterator[tuple[int, int]]:
        seen = 0
        for m in self.title.finditer(text):
            got = self._name_at(text, m.end(), True, m.group().strip())
            if got:
                yield got
        for m in self.word.finditer(text):
            w = m.group()
            kind = self.begins.get(w)
            if kind is None:
                initial = len(w) == 2 and w[0].isupper() and w[1] == "."
                first = self._known(w.rstrip("."))
                kind = self.begins[w] = (first, initial) if first or initial or w[0].isupper() else ()
            at = m.start()
            if not kind or at < seen:
                continue
            first, initial = kind
            left = before(text, at)
            announced = left in self.patterns or "* " + left.rpartition(" ")[2] in self.patterns
            if not announced and not first and not initial:
                continue
            got = self._name_at(text, at, announced)
            if not got:
                continue
            value = text[got[0] : got[1]]
            words = [x.rstrip(".") for x in self.word.findall(value) if len(x.rstrip(".")) > 1]
            known = sum(map(self._known, words))
            if len(words) >= 2 and known >= 2 or initial and known >= 1 or announced and (len(words) >= 2 and known or initial):
                yield got
                seen = got[1]


def _finder(shared, redact: bool):
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder(shared.value)
        for batch in batches:
            finder.begins.clear()
            rows = []
            for id, text, more in zip(batch["id"], batch["text"], batch["more"] if "more" in batch else [None] * len(batch)):
                spans = (Finder(shared.value, () if more is None else more, text) if "more" in batch else finder).spans(text)
                if redact:
                    out, last = [], 0
                    for a, b, kind in spans:
                        out += [text[last:a], f"[{kind.upper()}]"]
                        last = b
                    rows.append((id, "".join(out) + text[last:], len(spans)))
                else:
                    rows += sorted({(id, kind, text[a:b]) for a, b, kind in spans})
            yield pd.DataFrame(rows, columns=["id", "text", "n_found"] if redact else ["id", "kind", "value"])

    return run


class Identifiers:
    """Personal information in a table of texts.

    Rows with a null id or text hold none (redacted() keeps null texts as they are). Repeated rows are read as they come,
    their findings come out once; other columns are ignored; empty tables give empty results. Where spans of two kinds would
    overlap, e-mail comes before numbers, numbers before address, address before names.
    """

    def __init__(self, docs: DataFrame, id: str = "doc_id", text: str = "text"):
        self.all = docs.select(F.col(f"`{id}`").cast("bigint").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).filter(F.col("id").isNotNull())
        self.docs = self.all.filter(F.col("text").isNotNull() & (F.col("text") != ""))
        self.tables = learn(self.docs)

    def _read(self, redact: bool, schema: str) -> DataFrame:
        """The second pass; where a list is longer than what is broadcast, each text comes with the entries of the rest that it may ask for."""
        learned, docs = Learned(self.tables), self.docs
        shared = docs.sparkSession.sparkContext.broadcast(learned)
        if learned.more is not None:
            asked = docs.mapInPandas(_asked(shared), "id bigint, list string, key string")
            more = asked.join(learned.more, ["list", "key"]).groupBy("id").agg(F.collect_set(F.concat_ws("\t", "list", "key", "kind")).alias("more"))
            docs = docs.join(more, "id", "left")
        return docs.mapInPandas(_finder(shared, redact), schema)

    def found(self) -> DataFrame:
        """(id, kind, value), each once."""
        return self._read(False, "id bigint, kind string, value string").distinct()

    def redacted(self) -> DataFrame:
        """(id, text, n_found): the text with [KIND] in place of each finding and otherwise unchanged."""
        none = self.all.filter(F.col("text").isNull() | (F.col("text") == "")).withColumn("n_found", F.lit(0).cast("bigint"))
        return self._read(True, "id bigint, text string, n_found bigint").unionByName(none)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return Identifiers(table(spark, folder, "documents")).found().withColumnRenamed("id", "doc_id")


def p8_redacted(spark: SparkSession, folder: str) -> DataFrame:
    return Identifiers(table(spark, folder, "documents")).redacted().withColumnRenamed("id", "doc_id")


def p8_patterns(spark: SparkSession, folder: str) -> DataFrame:
    """The lexical patterns the last round trusted."""
    return learn(table(spark, folder, "documents").filter(F.col("text").isNotNull()))["patterns"]


QUERIES = {"p8_found": p8_found, "p8_redacted": p8_redacted, "p8_patterns": p8_patterns}
SQL: dict[str, str] = {}
