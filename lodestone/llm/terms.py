"""Problem 5: occurrences and record counts of every n-gram, from suffix arrays with common-prefix intervals.

The suffixes of the token sequences of whole records are sorted by prefix doubling; a run of neighbours whose common prefix
is at least n tokens is the interval of one n-gram. Its length is the number of occurrences. The number of records is that
less the number of neighbours-in-order of one record that lie in the same interval. Both are sums over disjoint sets of
records, so every task sorts only the records it has read, in chunks of whole records, and what is shuffled are sums per
n-gram: a word in every record is one row per chunk.

Where a record's tokens lie in many rows (links: the record is the condition, the token the symptom), equal (token,
record) become one weighted token before the shuffle and are spread by both, so that neither a hot token nor a hot record
is one task's; a pair lies in one task only, so each task builds the suffix array of its share of the records' tokens, and
its intervals are summed as those of any chunk.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import key_rule, words
from lodestone.sources.tables import table

CHUNK = 2_000_000  # tokens sorted at once; a longer record is a chunk of its own


def suffix_array(code: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, prefix): the suffixes of records in order, and how many first tokens each has in common with the one before it.

    code: number of each token; left: how many tokens its record has from there on. Ranks by the first 1, 2, 4, ... tokens
    are kept, and common prefixes are put together from them, longest steps first.
    """
    size, longest = len(code), int(left.max(initial=0))
    ranks, k = [np.unique(code, return_inverse=True)[1].astype(np.int64)], 1
    at = np.arange(size)
    while k < longest and ranks[-1].max(initial=0) < size - 1:
        last = ranks[-1]
        ahead = np.where(left > k, last[np.minimum(at + k, size - 1)] + 1, 0)
        ranks.append(np.unique(last * (size + 1) + ahead, return_inverse=True)[1].astype(np.int64))
        k *= 2
    order = np.argsort(ranks[-1], kind="stable")
    a, b = order[:-1], order[1:]
    both, common = np.minimum(left[a], left[b]), np.zeros(max(0, size - 1), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        open_ = np.flatnonzero(common < both)
        x, y = a[open_] + common[open_], b[open_] + common[open_]
        same = ranks[level][x] == ranks[level][y]
        common[open_[same]] += 1 << level
    # equal ranks of suffixes that end tell that they end alike
    return order, np.concatenate([[0], np.minimum(common, both)]) if size else np.zeros(0, np.int64)


def _intervals(tokens: pa.Array, record: np.ndarray, max_n: int | None, weight: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """(n, term, occurrences, records) of token sequences that lie one after another; record: the number of each token's record, not falling; weight: how often a token stands at its place."""
    coded = tokens.dictionary_encode()
    names = np.array(coded.dictionary.to_pylist(), dtype=object)
    code = coded.indices.to_numpy().astype(np.int64)
    size = len(code)
    weight = np.ones(size, np.int64) if weight is None else weight
    left = np.searchsorted(record, record, side="right") - np.arange(size)
    most = int(left.max(initial=0)) if max_n is None else max_n
    order, prefix = suffix_array(code, np.minimum(left, most))
    for n in range(1, most + 1):
        # suffixes of fewer than n tokens hold no n-gram; the least of the prefixes passed over is what is common
        long = left[order] >= n
        if not long.any():
            return
        whole = np.flatnonzero(long)
        least = np.minimum.reduceat(prefix[: whole[-1] + 1], np.concatenate([[0], whole[:-1] + 1]))
        order, prefix = order[whole], least
        interval = np.cumsum(prefix < n) - 1
        by_doc = np.lexsort((np.arange(len(order)), interval, record[order]))
        r, i = record[order][by_doc], interval[by_doc]
        again = np.zeros(len(order), np.int64)
        again[by_doc[1:]] = (r[1:] == r[:-1]) & (i[1:] == i[:-1])
        starts = order[np.flatnonzero(np.concatenate([[True], interval[1:] != interval[:-1]]))]
        occurrences = np.bincount(interval, weights=weight[order]).astype(np.int64)
        repeated = np.bincount(interval, weights=again + weight[order] - 1).astype(np.int64)
        term = names[code[starts]] if n == 1 else np.array([" ".join(names[code[p : p + n]]) for p in starts], dtype=object)
        yield pa.RecordBatch.from_pydict({"n": pa.array(np.full(len(starts), n, np.int32)), "term": pa.array(term, pa.string()), "occurrences": pa.array(occurrences), "records": pa.array(occurrences - repeated)})


def _count(max_n: int | None):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, total = [], [], 0
        for batch in batches:
            lists = batch.column(0)
            at = 0
            ends = np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)) if len(lists) else np.zeros(0)
            while at < len(lists):
                base = ends[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(ends, base + CHUNK - total, side="right")))
                part = lists.slice(at, to - at)
                held.append(part.flatten())
                count.append(pc.list_value_length(part).fill_null(0).to_numpy(zero_copy_only=False))
                total += len(held[-1])
                at = to
                if total >= CHUNK or at < len(lists):
                    yield from _intervals(*_joined(held, count), max_n)
                    held, count, total = [], [], 0
        if total:
            yield from _intervals(*_joined(held, count), max_n)

    return run


def _joined(held: list, count: list) -> tuple[pa.Array, np.ndarray]:
    n = np.concatenate(count)
    return pa.concat_arrays([x.cast(pa.string()) for x in held]), np.repeat(np.arange(len(n)), n)


def ngram_counts(records: DataFrame, tokens: str, max_n: int | None = 1) -> DataFrame:
    """(n, term, occurrences, records) of every n-gram of up to max_n tokens (None: of any length); each row is a record, `tokens` an array of strings.

    Null or empty arrays count nothing; null tokens are dropped, their neighbours then being neighbours; n-grams don't
    reach across records. The tokens of a term are joined by one blank. Repeated rows are records of their own. Other
    columns are ignored; an empty table gives an empty result.
    """
    if max_n is not None and max_n < 1:
        raise ValueError("max_n must be at least 1")
    lists = records.select(F.array_compact(F.col(f"`{tokens}`").cast("array<string>")).alias("t")).filter(F.size("t") > 0)
    parts = lists.mapInArrow(_count(max_n), "n int, term string, occurrences bigint, records bigint")
    return parts.groupBy("n", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def _spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Intervals of rows (term, record, n), in chunks; a record's tokens in a chunk are put side by side."""

    def send(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        record = rows.column(1).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        order = np.argsort(record, kind="stable")
        term = rows.column(0).cast(pa.string()).combine_chunks().take(pa.array(order))
        for part in _intervals(term, record[order], 1, rows.column(2).to_numpy()[order]):
            yield part.select(["term", "occurrences", "records"])

    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size >= CHUNK:
            yield from send(held)
            held, size = [], 0
    if size:
        yield from send(held)


def spread_counts(df: DataFrame, record: str, term: str) -> DataFrame:
    """(term, occurrences, records) of single terms, where a record's terms lie in many rows.

    A row with a null term counts nothing; with a null record it counts as an occurrence in no record. Other columns are
    ignored; repeated rows are occurrences of their own; an empty table gives an empty result.
    """
    kind = dict(df.select(F.col(f"`{term}`").alias("t")).dtypes)["t"]
    rows = df.select(F.col(f"`{term}`").alias("term"), F.col(f"`{record}`").cast("string").alias("record")).filter(F.col("term").isNotNull())
    counted = rows.groupBy("term", "record").agg(F.count(F.lit(1)).alias("n"))
    parts = counted.filter(F.col("record").isNotNull()).mapInArrow(_spread, "term string, occurrences bigint, records bigint")
    none = counted.filter(F.col("record").isNull()).select(F.col("term").cast("string").alias("term"), F.col("n").alias("occurrences"), F.lit(0).cast("bigint").alias("records"))
    sums = parts.unionByName(none).groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    return sums.withColumn("term", F.col("term").cast(kind))


def _symptoms(symptoms: DataFrame, links: DataFrame) -> DataFrame:
    counts = spread_counts(links.select("symptom_id", key_rule(F.col("condition")).alias("condition")), "condition", "symptom_id")
    found = symptoms.select("symptom_id", "n_conditions").join(counts.withColumnRenamed("term", "symptom_id"), "symptom_id", "left")
    n = F.coalesce("records", F.lit(0))
    mark = F.when(n <= 1, "rare").when(n >= 100, "common")
    return found.select(F.lit("symptom").alias("kind"), F.col("symptom_id").cast("string").alias("term"), F.coalesce("occurrences", F.lit(0)).alias("n_occurrences"), n.alias("n_records"), F.col("n_conditions").cast("bigint").alias("n_stated"), mark.alias("mark"))


def _words(symptoms: DataFrame) -> DataFrame:
    texts = symptoms.filter(F.col("canonical").isNotNull())
    counts = ngram_counts(texts.select(words(F.col("canonical")).alias("t")), "t")
    total = F.broadcast(texts.agg(F.count(F.lit(1)).alias("total")))  # one row
    mark = F.when(F.col("records") < 3, "rare").when(F.col("records") > 0.08 * F.col("total"), "common")
    return counts.join(total).select(F.lit("word").alias("kind"), "term", F.col("occurrences").alias("n_occurrences"), F.col("records").alias("n_records"), F.lit(None).cast("bigint").alias("n_stated"), mark.alias("mark"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    symptoms, links = table(spark, folder, "symptoms"), table(spark, folder, "links")
    return _symptoms(symptoms, links).unionByName(_words(symptoms)).filter(F.col("mark").isNotNull()).select("kind", "term", "mark")


def p5_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Every symptom with its link rows and conditions, and every word with its occurrences and symptoms, marked or not."""
    symptoms, links = table(spark, folder, "symptoms"), table(spark, folder, "links")
    once = links.select("link_id", "symptom_id", "condition").dropDuplicates(["link_id"])
    return _symptoms(symptoms, once).unionByName(_words(symptoms))


def p5_ngrams(spark: SparkSession, folder: str) -> DataFrame:
    """Every sequence of words of symptoms.canonical, of any length."""
    return ngram_counts(table(spark, folder, "symptoms").select(words(F.col("canonical")).alias("t")), "t", None)


_W = "regexp_extract_all(lower(regexp_replace(canonical, '[''’]', '', 'g')), '[\\p{L}\\p{N}]+')"
_KEY = "lower(trim(condition, chr(9)||chr(10)||chr(13)||' '||chr(160)))"
_TERMS = f"""
WITH l AS (SELECT symptom_id, count(DISTINCT link_id) AS n_occurrences, count(DISTINCT {_KEY}) AS n_records FROM links WHERE symptom_id IS NOT NULL GROUP BY 1),
s AS (SELECT 'symptom' AS kind, s.symptom_id::VARCHAR AS term, coalesce(l.n_occurrences, 0) AS n_occurrences, coalesce(l.n_records, 0) AS n_records, s.n_conditions::BIGINT AS n_stated FROM symptoms s LEFT JOIN l USING (symptom_id)),
t AS (SELECT symptom_id, unnest({_W}) AS term FROM symptoms WHERE canonical IS NOT NULL),
w AS (SELECT 'word' AS kind, term, count(*) AS n_occurrences, count(DISTINCT symptom_id) AS n_records, NULL::BIGINT AS n_stated FROM t GROUP BY term),
a AS (SELECT *, CASE WHEN n_records <= 1 THEN 'rare' WHEN n_records >= 100 THEN 'common' END AS mark FROM s
  UNION ALL SELECT *, CASE WHEN n_records < 3 THEN 'rare' WHEN n_records > 0.08 * (SELECT count(canonical) FROM symptoms) THEN 'common' END FROM w)"""
_GRAMS = f"SELECT n::INTEGER AS n, array_to_string(w[i:i+n-1], ' ') AS term, symptom_id FROM (SELECT symptom_id, w, i, unnest(range(1, len(w) - i + 2)) AS n FROM (SELECT symptom_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT symptom_id, {_W} AS w FROM symptoms WHERE canonical IS NOT NULL)))"
QUERIES = {"p5_found": p5_found, "p5_terms": p5_terms, "p5_ngrams": p5_ngrams}
SQL = {
    "p5_found": f"{_TERMS} SELECT kind, term, mark FROM a WHERE mark IS NOT NULL",
    "p5_terms": f"{_TERMS} SELECT * FROM a",
    "p5_ngrams": f"SELECT n, term, count(*) AS occurrences, count(DISTINCT symptom_id) AS records FROM ({_GRAMS}) GROUP BY n, term",
}
