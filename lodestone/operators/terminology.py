"""Names and codes against a terminology: indexes, matches, crosswalks, quotes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.markup import squeeze
from lodestone.functions.names import norm, variants
from lodestone.functions.text import words
from lodestone.operators.joins import small_or_shuffled
from lodestone.session import cut

ANCHOR = 8  # most words of a quote that are looked up before it is compared whole


def term_index(labels: DataFrame, under: DataFrame | None = None) -> DataFrame:
    """(term, n, id): normal forms of (id, label) with the number of ids they name, and the id where it is one; of the ids below a root (column id) where those are given."""
    if under is not None:
        labels = labels.join(under.select("id").distinct(), "id", "left_semi")
    t = labels.select(norm(F.col("label")).alias("term"), "id").filter("term <> ''").distinct()
    return t.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).select("term", "n", F.when(F.col("n") == 1, F.col("id")).alias("id"))


def code_map(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, target): of each wanted id the first (by ord) active target with a point, blanks dropped, of a release's map (active, referencedComponentId, mapTarget, ord)."""
    target = F.trim("mapTarget")
    good = rows.filter((F.col("active") == "1") & F.contains(target, F.lit("."))).select(F.col("referencedComponentId").alias("id"), target.alias("label"), "ord")
    return first_label(good, wanted).withColumnRenamed("label", "target")


def term_match(names: DataFrame, index: DataFrame) -> DataFrame:
    """(name, id, variant, ambiguous): each distinct name's first variant that names one id; ambiguous if only others match."""
    tried = names.select("name").filter("name IS NOT NULL").distinct().select("name", F.posexplode(variants(F.col("name"))).alias("pos", "term"))
    hit = tried.join(index, "term")
    best = hit.groupBy("name").agg(F.min(F.when(F.col("n") == 1, F.struct("pos", "id", F.col("term").alias("variant")))).alias("b"))
    return names.select("name").filter("name IS NOT NULL").distinct().join(best, "name", "left").select("name", "b.id", "b.variant", F.col("b").isNull().alias("none")).join(hit.select("name", F.lit(True).alias("hit")).distinct(), "name", "left").select("name", "id", "variant", (F.col("none") & F.coalesce("hit", F.lit(False))).alias("ambiguous"))


def with_fallback(matched: DataFrame, backup: DataFrame) -> DataFrame:
    """(name, id, origin): the term's id, else that of a backup index (term, id) by the name's normal form, else null."""
    b = backup.select("term", F.col("id").alias("backup"))
    j = matched.withColumn("term", norm(F.col("name"))).join(b, "term", "left")
    return j.select("name", F.coalesce("id", "backup").alias("id"), F.when(F.col("id").isNotNull(), "term").when(F.col("backup").isNotNull(), "backup").alias("origin"))


def first_label(labels: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, label): of each wanted id the first label (id, ord, label)."""
    return labels.join(wanted.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.min_by("label", "ord").alias("label"))


def crosswalk(ours: DataFrame, targets: DataFrame) -> DataFrame:
    """(key, code, class): our code (key, code) against the targets of the key: EXACT, NARROWER, NEARBY, MISMATCH or NO MAP; points are ignored."""
    flat = lambda c: F.replace(F.col(c), F.lit("."), F.lit(""))
    a, b = flat("code"), flat("target")
    j = ours.join(targets, "key", "left")
    grade = F.when(F.col("target").isNull(), 0).when(a == b, 4).when(F.startswith(a, b), 3).when(F.substring(a, 1, 3) == F.substring(b, 1, 3), 2).otherwise(1)
    names = F.array(*map(F.lit, ("NO MAP", "MISMATCH", "NEARBY", "NARROWER", "EXACT")))
    return j.groupBy("key", "code").agg(F.max(grade).alias("g")).select("key", "code", F.element_at(names, F.col("g") + 1).alias("class"))


def quotes_found(quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """(quote_id, text_id) for each quote that stands verbatim, white space squeezed, in a text; of any length, but empty ones.

    The words inside a quote, at most ANCHOR of them (its first and last may be parts of a text's words), are hash-joined
    with all runs of so many words of the texts; only texts that hold them are compared whole. Quotes without a word
    inside are compared with every text. Quotes are few and hand-made: they are broadcast if their number allows.
    """
    q = quotes.select("quote_id", squeeze(F.col("quote")).alias("quote"), words(F.col("quote")).alias("w")).filter("quote <> ''")
    q = cut(q.select("quote_id", "quote", F.slice("w", 2, F.greatest(F.least(F.size("w") - 2, F.lit(ANCHOR)), F.lit(0))).alias("a")))
    sizes = sorted(r["n"] for r in q.select(F.size("a").alias("n")).distinct().collect())  # at most ANCHOR + 1
    t = texts.select("text_id", squeeze(F.col("text")).alias("text"))
    found = []
    if sizes and sizes[-1]:
        w = t.withColumn("w", words(F.col("text"))).withColumn("n", F.size("w"))
        runs = lambda k: F.when(F.col("n") >= k, F.transform(F.sequence(F.lit(1), F.size("w") - k + 1), lambda i: F.xxhash64(F.slice("w", i, k)))).otherwise(F.array().cast("array<bigint>"))
        anchored = cut(q.filter(F.size("a") > 0).select("quote_id", "quote", F.xxhash64("a").alias("h")))
        held = w.select("text_id", F.explode(F.array_distinct(F.concat(*(runs(k) for k in sizes if k)))).alias("h")).join(small_or_shuffled(anchored), "h").select("quote_id", "quote", "text_id")
        found.append(held.join(t, "text_id").filter(F.contains("text", F.col("quote"))).select("quote_id", "text_id"))
    if not sizes or not sizes[0]:
        short = cut(q.filter(F.size("a") == 0).select("quote_id", "quote"))
        found.append(t.join(small_or_shuffled(short), F.contains("text", F.col("quote"))).select("quote_id", "text_id"))
    return reduce(DataFrame.unionByName, found).distinct()


def cue_gaps(docs: DataFrame, cues: list[tuple[str, str]], advice: str, asserted: DataFrame) -> DataFrame:
    """(condition, var, part, n_documents): variables whose cues (var, cue) a condition's documents hold and the condition doesn't assert (condition, var).

    A text is split at the first advice marker: part is 'describes' where a cue stands before it, 'red flag' where one stands
    only after it. Cues are a list written by hand; letter case doesn't matter.
    """
    at = F.locate(advice, F.col("text"))
    own = F.lower(F.when(at > 0, F.substring("text", F.lit(1), at - 1)).otherwise(F.col("text")))
    flags = F.lower(F.when(at > 0, F.substring("text", at, F.length("text"))).otherwise(""))
    by_var: dict[str, list[str]] = {}
    for var, cue in cues:
        by_var.setdefault(var, []).append(cue)
    held = lambda text, some: reduce(lambda x, y: x | y, (F.contains(text, F.lit(c)) for c in some))
    part = lambda some: F.when(held(own, some), "describes").when(held(flags, some), "red flag")
    found = F.filter(F.array(*(F.struct(F.lit(v).alias("var"), part(some).alias("part")) for v, some in by_var.items())), lambda x: x["part"].isNotNull())
    rows = docs.filter("condition IS NOT NULL AND text IS NOT NULL").select("condition", F.explode(found).alias("x")).groupBy("condition", "x.var", "x.part").agg(F.count(F.lit(1)).alias("n_documents"))
    return rows.join(small_or_shuffled(cut(asserted.select("condition", "var").distinct())), ["condition", "var"], "left_anti")


def content_digest(df: DataFrame, column: str, key: str) -> DataFrame:
    """(n_rows, digest): SHA-256 over the number of rows and the sum of the rows' own hashes, so that no task holds them all.

    A row's hash is over its key and its text, so that texts that change places give another digest; the order in which
    rows come doesn't matter, since the key is what pairs a text with its place. Rows with a null text don't count.
    """
    h = F.conv(F.substring(F.sha2(F.concat_ws(":", F.col(key).cast("string"), F.col(column).cast("string")), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    s = df.filter(F.col(column).isNotNull()).agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(h), F.lit(0).cast("decimal(38,0)")).alias("s"))
    return s.select("n_rows", F.sha2(F.concat_ws(":", F.col("n_rows").cast("string"), F.col("s").cast("string")), 256).alias("digest"))


def cache_misses(wanted: DataFrame, cached: DataFrame, model: str, dims: int) -> DataFrame:
    """(key, text): distinct texts without an entry under sha256(model:dims:text)."""
    key = F.sha2(F.concat(F.lit(f"{model}:{dims}:"), F.col("text")), 256)
    keyed = lambda df: df.filter("text IS NOT NULL").select(key.alias("key"), "text").dropDuplicates(["key"])
    return keyed(wanted).join(keyed(cached).select("key"), "key", "left_anti")
