"""Ranking conditions by matched symptoms: frequency weights, evidence, length norm, seeds and narrowing."""

from __future__ import annotations

from collections.abc import Callable
from math import ceil, log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.facets import DURATIONS, ONSETS, band, place_multiplier
from lodestone.operators.joins import join_groups, small_or_shuffled
from lodestone.operators.order import numbered
from lodestone.session import cut, stored

#: Fixed values.
MATCH, ABSENT_WEIGHT, LENGTH_ALPHA, MOST_QUESTIONS = 0.80, 0.7, 0.25, 12
#: Links of a block and queries of a chunk that one task of best_questions() holds.
BLOCK, CHUNK = 1_000_000, 100_000


def idf(pairs: DataFrame, document: str, term: str) -> DataFrame:
    """(term, n_documents, idf) of distinct (document, term) pairs: ln((n + 1) / (c + 1)) + 1."""
    n = F.broadcast(pairs.agg(F.countDistinct(document).alias("n")))  # one row
    counts = pairs.groupBy(term).agg(F.count(F.lit(1)).alias("n_documents"))
    return counts.join(n).select(term, "n_documents", (F.log((F.col("n") + 1) / (F.col("n_documents") + 1)) + 1).alias("idf"))


def weighted(links: DataFrame, weights: DataFrame) -> DataFrame:
    """links with the idf of their symptom_id, which the operators below take as `links`; store it, since most read it more than once."""
    return links.join(weights.select("symptom_id", "idf"), "symptom_id")


def _hits(matches: DataFrame, links: DataFrame, threshold: float) -> DataFrame:
    """(query_id, record_id, condition, symptom_id, size, denied) of every match with every link of its symptom.

    A symptom's links are one row, as many as there are conditions at most, so that symptoms with very many matches are split.
    """
    places = lambda o, d: (band(F.col(o), ONSETS).cast("byte"), band(F.col(d), DURATIONS).cast("byte"))
    o, d = places("record.onset", "record.duration")
    m = matches.filter(F.col("cosine") >= threshold).select("query_id", "record_id", "symptom_id", "cosine", o.alias("o"), d.alias("d"), F.coalesce(F.col("record.polarity") == "absent", F.lit(False)).alias("denied"))
    o, d = places("onset", "duration")
    stated = links.groupBy("symptom_id").agg(F.collect_list(F.struct("condition", o.alias("lo"), d.alias("ld"))).alias("l"), F.first("idf").alias("idf"))
    stated = cut(stated.join(m.groupBy("symptom_id").agg(F.count(F.lit(1)).alias("n_matches")), "symptom_id"))
    # whole lists are moved, to their query; they become rows only there
    hits = join_groups(m, stated, ["symptom_id"], "n_matches").repartition("query_id").withColumn("l", F.explode("l"))
    kept = place_multiplier(F.col("l.lo"), F.col("l.ld"), F.col("o"), F.col("d"))
    return hits.select("query_id", "record_id", "l.condition", "symptom_id", (F.col("idf") * F.col("cosine") * kept).alias("size"), "denied")


def evidence(matches: DataFrame, links: DataFrame, threshold: float = MATCH) -> DataFrame:
    """(query_id, condition, record_id, symptom_id, w): per patient record the strongest thing it says about a condition.

    matches (query_id, record_id, symptom_id, cosine, record struct), links (condition, symptom_id, onset, duration, idf). A
    denial counts -0.7 times. Of equally strong ones the smallest symptom_id stays.
    """
    w = F.when(F.col("denied"), -ABSENT_WEIGHT * F.col("size")).otherwise(F.col("size"))
    best = F.max_by(F.struct("symptom_id", w.alias("w")), F.struct(F.round(F.abs(w), 12), -F.col("symptom_id")))
    return _hits(matches, links, threshold).groupBy("query_id", "condition", "record_id").agg(best.alias("b")).select("query_id", "condition", "record_id", "b.symptom_id", "b.w")


def strengths(matches: DataFrame, links: DataFrame, threshold: float = MATCH) -> DataFrame:
    """(query_id, condition, record_id, w): evidence() without its symptom, from maxima alone, which are aggregated by hash and not by sorting."""
    said, denied = (F.coalesce(F.max(F.when(F.col("denied") == x, F.col("size"))), F.lit(0.0)) for x in (False, True))
    w = F.when(said >= ABSENT_WEIGHT * denied, said).otherwise(-ABSENT_WEIGHT * denied)
    return _hits(matches, links, threshold).groupBy("query_id", "condition", "record_id").agg(w.alias("w"))


def lengths(links: DataFrame, squares: bool = False) -> DataFrame:
    """(condition, length): sum of the weights of all its symptoms, or the root of the sum of their squares."""
    total = F.sqrt(F.sum(F.col("idf") * F.col("idf"))) if squares else F.sum("idf")
    return links.groupBy("condition").agg(total.alias("length"))


def ranked(scores: DataFrame, by: str, score: str, tie: str, k: int) -> DataFrame:
    """The k best rows of each `by`, with rank from 1."""
    w = Window.partitionBy(by).orderBy(F.desc(score), tie)
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def best_totals(found: DataFrame, norms: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, condition, score, total) from evidence() or strengths(), and lengths(): total / length ** 0.25."""
    total = found.groupBy("query_id", "condition").agg(F.sum("w").alias("total"))
    scored = total.join(small_or_shuffled(cut(norms)), "condition").withColumn("score", F.round(F.col("total") / F.pow("length", F.lit(LENGTH_ALPHA)), 6))
    return ranked(scored, "query_id", "score", "condition", k).select("query_id", "rank", "condition", "score", "total")


def idf_rank(found: DataFrame, norms: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, condition, score) of best_totals()."""
    return best_totals(found, norms, k).drop("total")


def evidence_lists(found: DataFrame) -> DataFrame:
    """(query_id, condition, total, evidence): evidence strongest first, as 'symptom:weight' joined by ' | '. A query has a handful of records."""
    one = F.struct((-F.round(F.abs("w"), 6)).alias("o"), "record_id", F.concat_ws(":", "symptom_id", F.format_string("%.4f", F.col("w"))).alias("s"))
    lists = found.groupBy("query_id", "condition").agg(F.round(F.sum("w"), 6).alias("total"), F.array_sort(F.collect_list(one)).alias("l"))
    return lists.select("query_id", "condition", "total", F.array_join(F.col("l.s"), " | ").alias("evidence"))


def cosine_rank_l2(matches: DataFrame, links: DataFrame, k: int = 10) -> DataFrame:
    """Dot product of sparse weight vectors over |condition|_2 ** alpha * |query|_2; the query has each symptom once, denied if any of its records denies it.

    A symptom's conditions go to a query's task as one list of numbers, and become rows only there; place 0 of a list stands for the query's own norm.
    """
    m = stored(matches.filter(F.col("cosine") >= MATCH).groupBy("query_id", "symptom_id").agg(F.bool_or(F.col("record.polarity") == "absent").alias("denied")))
    norms = stored(numbered(lengths(links, squares=True), "condition", "code").withColumn("code", (F.col("code") + 1).cast("int")))
    stated = links.join(small_or_shuffled(norms.select("condition", "code")), "condition").groupBy("symptom_id").agg(F.array_sort(F.collect_list("code")).alias("l"), F.first("idf").alias("idf"))
    stated = stored(stated.join(m.groupBy("symptom_id").agg(F.count(F.lit(1)).alias("n_matches")), "symptom_id"))
    q = F.col("idf") * F.when(F.col("denied"), -ABSENT_WEIGHT).otherwise(1.0)
    said = join_groups(m, stated, ["symptom_id"], "n_matches").select("query_id", q.alias("q"), "idf", "l").repartition("query_id")
    each = said.select("query_id", "q", "idf", F.explode(F.concat(F.array(F.lit(0)), "l")).alias("code"))
    dot = each.groupBy("query_id", "code").agg(F.sum(F.col("q") * F.when(F.col("code") == 0, F.col("q")).otherwise(F.col("idf"))).alias("dot"))
    dot = dot.withColumn("nq", F.sqrt(F.max(F.when(F.col("code") == 0, F.col("dot"))).over(Window.partitionBy("query_id")))).filter("code > 0")
    scored = dot.join(small_or_shuffled(norms.select("code", "length")), "code").withColumn("score", F.round(F.col("dot") / (F.pow("length", F.lit(LENGTH_ALPHA)) * F.col("nq")), 6))
    best = ranked(scored.select("query_id", "code", "score"), "query_id", "score", "code", k)  # numbers are in the order of names
    return best.join(small_or_shuffled(norms.select("code", "condition")), "code").select("query_id", "rank", "condition", "score")


def seeds(links: DataFrame, targets: DataFrame | None = None, k: int = 2, rarest: bool = False) -> DataFrame:
    """(condition, rank, symptom_id): the k commonest (or rarest) symptoms of each condition, or the k whose weight is nearest its target (condition, target)."""
    s = links.select("condition", "symptom_id", "idf")
    if targets is None:
        order = F.round("idf", 9) * (-1 if rarest else 1)
    else:
        s = s.join(targets, "condition")
        order = F.round(F.abs(F.col("idf") - F.col("target")), 9)
    w = Window.partitionBy("condition").orderBy("o", "symptom_id")
    return s.withColumn("o", order).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("condition", "rank", "symptom_id")


def held_out(links: DataFrame, seeds: DataFrame) -> DataFrame:
    """(truth, condition, total, score, place): all conditions ranked for an opening of each condition's seeds (condition, symptom_id), equal ones by name."""
    s = small_or_shuffled(cut(seeds.select(F.col("condition").alias("truth"), "symptom_id")))
    sums = s.join(links.select("condition", "symptom_id", "idf"), "symptom_id").groupBy("truth", "condition").agg(F.sum("idf").alias("total"))
    scored = sums.join(small_or_shuffled(cut(lengths(links))), "condition").withColumn("score", F.round(F.col("total") / F.pow("length", F.lit(LENGTH_ALPHA)), 6))
    return scored.withColumn("place", F.row_number().over(Window.partitionBy("truth").orderBy(F.desc("score"), "condition")))


def hit_rates(places: DataFrame, *by: str) -> DataFrame:
    """(by, n, top1, top5, top10) of rows that hold the place of the truth, null where it isn't found."""
    at = lambda k: F.round(F.avg(F.coalesce(F.col("place") <= k, F.lit(False)).cast("int")), 6).alias(f"top{k}")
    return places.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), at(1), at(5), at(10))


def recovered(picks: DataFrame, got: DataFrame, links: DataFrame) -> DataFrame:
    """(n, exact, same): of picks (query_id, record_id, own), the shares that got (the same columns and symptom_id) leads back to the row itself, and to one that shares a condition with it."""
    key = ["query_id", "record_id"]
    exact = got.groupBy(*key).agg(F.bool_or(F.col("own") == F.col("symptom_id")).alias("exact"))
    # a symptom's conditions are one row of at most as many as there are
    carriers = cut(links.groupBy("symptom_id").agg(F.collect_set("condition").alias("carriers")))
    mine = got.join(carriers.select(F.col("symptom_id").alias("own"), F.col("carriers").alias("mine")), "own").join(carriers, "symptom_id")
    same = mine.groupBy(*key).agg(F.bool_or(F.arrays_overlap("mine", "carriers")).alias("same"))
    z = lambda c: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("int")), 6).alias(c)
    return picks.join(exact, key, "left").join(same, key, "left").agg(F.count(F.lit(1)).alias("n"), z("exact"), z("same"))


def entropy(p: Column) -> Column:
    return -(p * F.log2(p) + (1 - p) * F.log2(1 - p))


def splits(candidates: DataFrame, links: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, symptom_id, h, idf): how evenly each symptom not asked splits the candidates (query_id, condition); none that all have.

    The links of one query's candidates stay with that query; nothing of other queries is compared.
    """
    n = candidates.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    held = candidates.select("query_id", "condition").join(links.select("condition", "symptom_id", "idf"), "condition").groupBy("query_id", "symptom_id").agg(F.count(F.lit(1)).alias("c"), F.first("idf").alias("idf"))
    held = held.join(asked.select("query_id", "symptom_id").distinct(), ["query_id", "symptom_id"], "left_anti")
    p = F.col("c") / F.col("n")
    return held.join(n, "query_id").filter(F.col("c") < F.col("n")).select("query_id", "symptom_id", F.round(entropy(p), 9).alias("h"), "idf")


def best_split(options: DataFrame, rarest: bool = True) -> DataFrame:
    """(query_id, symptom_id, h): the most even split of each query; ties to the rarer symptom (or not), then the smaller id."""
    order = F.struct("h", *([F.round("idf", 9).alias("idf")] if rarest else []), (-F.col("symptom_id")).alias("id"))
    return options.groupBy("query_id").agg(F.max_by(F.struct("symptom_id", "h"), order).alias("b")).select("query_id", "b.symptom_id", "b.h")


def question_blocks(links: DataFrame) -> tuple[DataFrame, int]:
    """links by blocks of symptoms, and the number of blocks: a row per block and condition with its symptoms, and one per block, without condition, with all its symptoms and their idf."""
    n = max(1, ceil(links.count() / BLOCK))
    l = links.select(F.pmod(F.xxhash64("symptom_id"), F.lit(n)).cast("int").alias("block"), "condition", "symptom_id", "idf")
    ids = F.array_sort(F.collect_list("symptom_id")).alias("ids")
    held = l.groupBy("block", "condition").agg(ids).withColumn("idf", F.lit(None).cast("array<double>")).withColumn("rounded", F.col("idf"))
    one = l.groupBy("block", "symptom_id").agg(F.first("idf").alias("idf"))
    own = one.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("symptom_id", "idf", F.round("idf", 9).alias("rounded")))).alias("l"))
    own = own.select("block", F.lit(None).cast("string").alias("condition"), F.col("l.symptom_id").alias("ids"), F.col("l.idf").alias("idf"), F.col("l.rounded").alias("rounded"))
    return stored(held.unionByName(own)), n


def _ask(rarest: bool) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """For a chunk of queries and a block of symptoms: each query's best split in the block, and which of its conditions have that symptom."""

    def run(queries: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(links):
            whole = links[links["condition"].isna()].iloc[0]
            ids, idf = np.asarray(whole["ids"]), np.asarray(whole["idf"])
            order = np.lexsort((ids, -np.asarray(whole["rounded"]))) if rarest else np.arange(len(ids))  # the first of equal ones is the best
            place = np.empty(len(ids), np.int64)
            place[order] = np.arange(len(ids))
            held = {c: place[np.searchsorted(ids, x)] for c, x in zip(links["condition"], links["ids"]) if c is not None}
            levels: dict[int, list[list[int]]] = {}
            count = np.zeros(len(ids), np.uint16)
            for query, left, dropped, asked in zip(*(queries[c] for c in ("query_id", "left", "dropped", "asked"))):
                n = len(left)
                if n not in levels:
                    levels[n] = _levels(n)
                mine = [held[c] for c in left if c in held]
                for x in mine:
                    count[x] += 1
                at = np.searchsorted(ids, asked := np.asarray(asked, ids.dtype))
                at, asked = at[at < len(ids)], asked[at < len(ids)]
                count[place[at[ids[at] == asked]]] = 0
                for ks in levels[n]:
                    hit = count == ks[0]
                    for k in ks[1:]:
                        hit |= count == k
                    if hit[best := int(hit.argmax())]:
                        i = order[best]
                        out.append((query, ids[i], int(count[best]), n, idf[i], [c for c in (*left, *dropped) if c in held and (held[c] == best).any()]))
                        break
                for x in mine:
                    count[x] = 0
        return pd.DataFrame(out, columns=["query_id", "symptom_id", "c", "n", "idf", "holders"])

    return run


def _levels(n: int) -> list[list[int]]:
    """Numbers of candidates from 1 to n - 1, the most even split first; equal ones together."""
    by: dict[float, list[int]] = {}
    for k in range(1, n):
        p = k / n
        by.setdefault(round(-(p * log(p) + (1 - p) * log(1 - p)) / log(2), 9), []).append(k)
    return [by[h] for h in sorted(by, reverse=True)]


def best_questions(candidates: DataFrame, blocks: tuple[DataFrame, int], asked: DataFrame, rarest: bool = True) -> DataFrame:
    """(query_id, symptom_id, h, idf, holders): best_split(splits(candidates, links, asked)), with the conditions of the query that have the symptom.

    candidates: (query_id, condition, left), of which those with `left` are split; blocks: question_blocks(links). No row is
    made for a link of a candidate: a task counts, query by query, in how many candidates' lists each symptom of its block
    stands. Queries, of a handful of conditions each, go to every block, and a block to every chunk of queries.
    """
    links, n_blocks = blocks
    mine = candidates.groupBy("query_id").agg(*(F.collect_list(F.when(F.col("left") == x, F.col("condition"))).alias(c) for x, c in ((True, "left"), (False, "dropped"))))
    said = asked.groupBy("query_id").agg(F.collect_set("symptom_id").alias("asked"))
    id_type = links.schema["ids"].dataType.elementType.simpleString()
    q = cut(mine.join(said, "query_id", "left").withColumn("asked", F.coalesce("asked", F.array().cast(f"array<{id_type}>"))))
    # as many chunks as keep some two dozen tasks busy, or as bound them
    n = max(ceil((rows := q.count()) / CHUNK), min(ceil(24 / n_blocks), ceil(rows / 1000)), 1)
    spread = lambda df, c, k: df.withColumn(c, F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    q = spread(q.withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.lit(n)).cast("int")), "block", n_blocks)
    schema = f"query_id {q.schema['query_id'].dataType.simpleString()}, symptom_id {id_type}, c int, n int, idf double, holders array<string>"
    found = q.groupBy("block", "chunk").cogroup(spread(links, "chunk", n).groupBy("block", "chunk")).applyInPandas(_ask(rarest), schema)
    found = found.withColumn("h", F.round(entropy(F.col("c") / F.col("n")), 9))
    order = F.struct("h", *([F.round("idf", 9).alias("o")] if rarest else []), (-F.col("symptom_id")).alias("id"))
    return found.groupBy("query_id").agg(F.max_by(F.struct("symptom_id", "h", "idf", "holders"), order).alias("b")).select("query_id", "b.*")


def narrowed(scores: DataFrame, target: int) -> DataFrame:
    """The candidates that stay after one question: max(target, n - 2) of each query by score (missing last), ties by condition."""
    w = Window.partitionBy("query_id")
    n = F.count(F.lit(1)).over(w)
    place = F.row_number().over(w.orderBy(F.desc(F.coalesce("score", F.lit(float("-inf")))), "condition"))
    return scores.withColumn("keep", F.greatest(F.lit(target), n - 2)).withColumn("place", place).filter(F.col("place") <= F.col("keep")).drop("keep")


def narrow(opening: DataFrame, asked: DataFrame, links: DataFrame, norms: DataFrame, reply: Callable[[DataFrame], DataFrame], targets: tuple[int, ...] = (5, 1), most: int = MOST_QUESTIONS, squares: bool = False, rarest: bool = True) -> DataFrame:
    """(query_id, condition, place, score, n_asked): the candidates of an opening, in the order they have after questioning.

    opening: (query_id, condition, total, place); asked: (query_id, symptom_id), what the opening has said. For each target
    in turn, at most `most` times: the symptom that splits the remaining candidates most evenly is asked, the reply is added
    to all totals as a statement of its own (idf, or its square, times -0.7 for no; none if the reply is null), and at most
    two candidates are dropped, whatever the reply, until `target` are left or nothing splits them. reply takes (query_id,
    symptom_id) and adds the boolean column `reply`. Equal scores keep their order. All queries go on together; each round's
    state, of as many rows as the opening, is cut.
    """
    state = cut(opening.join(norms, "condition").select("query_id", "condition", F.col("total").cast("double").alias("total"), "length", F.col("place").alias("first"), "place", F.lit(True).alias("left")))
    score = F.round(F.col("total") / F.pow("length", F.lit(LENGTH_ALPHA)), 6)
    asked = cut(asked.select("query_id", "symptom_id").distinct())
    blocks = question_blocks(links)
    questions = None
    for target in targets:
        for _ in range(most):
            open_ = state.filter("left").groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > target)
            best = cut(best_questions(state.join(open_, "query_id").select("query_id", "condition", "left"), blocks, asked, rarest))
            told = cut(reply(best.select("query_id", "symptom_id")).select("query_id", "reply").join(best, "query_id").join(open_, "query_id").select("query_id", "symptom_id", "reply", "n", "idf", "holders"))
            if not told.limit(1).count():
                break
            mine = told.select("query_id", "symptom_id")
            asked = asked.unionByName(mine)
            questions = mine if questions is None else questions.unionByName(mine)
            gain = F.when(F.col("reply"), 1.0).when(~F.col("reply"), -ABSENT_WEIGHT) * F.when(F.array_contains("holders", F.col("condition")), F.col("idf") * F.col("idf") if squares else F.col("idf"))
            after = state.join(told, "query_id", "left")
            after = after.withColumn("total", F.col("total") + F.coalesce(gain, F.lit(0.0)))
            place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("left"), F.desc(score), "place"))
            after = after.withColumn("place", F.when(F.col("n").isNull(), F.col("place")).otherwise(place))
            stays = F.col("n").isNull() | (F.col("place") <= F.greatest(F.lit(target), F.col("n") - 2))
            state = cut(after.withColumn("left", F.col("left") & stays).select(*state.columns))
    last = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "first"))
    out = state.withColumn("score", score).withColumn("place", last).select("query_id", "condition", "place", "score")
    if questions is None:
        return out.withColumn("n_asked", F.lit(0).cast("bigint"))
    n = questions.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_asked"))
    return out.join(n, "query_id", "left").withColumn("n_asked", F.coalesce("n_asked", F.lit(0)))


def similar_conditions(links: DataFrame) -> DataFrame:
    """(a, b, cosine) of weight vectors for all pairs of conditions with a symptom in common.

    The join goes through the symptom. A symptom in c conditions gives c * c / 2 products, which partial aggregation folds
    into at most one row per pair of conditions and task; conditions are a dimension of bounded size.
    """
    v = links.select("condition", "symptom_id", "idf")
    norm = cut(lengths(v, squares=True))
    a = v.select(F.col("condition").alias("a"), "symptom_id", "idf")
    b = v.select(F.col("condition").alias("b"), "symptom_id")
    dot = a.join(b, "symptom_id").filter("a < b").groupBy("a", "b").agg(F.sum(F.col("idf") * F.col("idf")).alias("dot"))
    side = lambda c: small_or_shuffled(norm.select(F.col("condition").alias(c), F.col("length").alias(f"n{c}")))
    return dot.join(side("a"), "a").join(side("b"), "b").select("a", "b", F.round(F.col("dot") / (F.col("na") * F.col("nb")), 6).alias("cosine"))
