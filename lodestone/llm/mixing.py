"""Problem 7: sources mixed to target weights along a time-varying curriculum.

Each source has a weight w(t) over training time t in [0, 1]; its integral is the source's share. With T tokens in all, a
source's cumulative demand is T times the integral of w up to t. The documents of a source are laid one after another, in
as many passes as demand needs (at most max_repeats, each pass in an order of its own), and the offset at which a document
begins is turned into the time at which demand reaches it. Sorting all documents by that time gives the mixture: at any
point of it each source has about its weight, and over the whole its share.

    w(t) = share * (1 + tilt * (2t - 1)),   integral = share * (t + tilt * (t * t - t)),   |tilt| <= 1

T is the most that all sources with documents can serve without exceeding max_repeats. The offsets are prefix sums over
buckets of a hash (a table of sums per bucket) and inside each bucket, so that no task holds a source.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.text import key_rule
from lodestone.session import cut
from lodestone.sources.tables import table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published splitting pattern of that vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
BUCKET = 20_000  # documents of a bucket, on average


def token_counter(spark: SparkSession, path: str = TOKENIZER):
    """A pandas UDF: tokens of a text by the byte-level BPE vocabulary at path (on the driver, from where it is sent along; a vocabulary has a few MB); 0 for null. Whole texts are encoded, whatever their length."""
    with open(path, "rb") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())

    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.value.splitlines())}
        encoding = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in texts:
            yield batch.map(lambda t: len(encoding.encode_ordinary(t)) if isinstance(t, str) else 0).astype("int64")

    return F.pandas_udf(count, "bigint")


class Mixture:
    """A mixture of documents by targets (source, target_share, max_repeats).

    Source names are compared by the key rule. Documents with null or unknown source, or without a token, are not used.
    Targets that repeat a source add their shares and take the larger max_repeats; those with a null or non-positive share
    or repeats get nothing. Shares are of the sources that have documents, scaled to 1; the report names the others, with
    share 0. total_tokens lowers T. tilt: source -> number; higher comes later in training. By default sources that may be
    repeated more often, the scarce ones, come later. Copies of a document are told apart by `repeat`, from 0. Rows with the
    same id are documents of their own; equal hashes are ordered by id. Empty documents or targets give an empty mixture.
    """

    def __init__(self, docs: DataFrame, targets: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", total_tokens: int | None = None, tilt: dict[str, float] | None = None, tokenizer: str = TOKENIZER, seed: int = 0):
        spark = docs.sparkSession
        named = targets.select(key_rule(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("int").alias("repeats"))
        named = named.filter(F.col("source").isNotNull()).groupBy("source").agg(F.sum("share").alias("share"), F.max("repeats").alias("repeats"))
        self.targets = rows = named.orderBy("source").collect()  # the list of sources, as stated by the caller
        wanted = [r["source"] for r in rows if (r["share"] or 0) > 0 and (r["repeats"] or 0) > 0]
        own = docs.select(F.col(f"`{id}`").alias("id"), key_rule(F.col(f"`{source}`")).alias("source"), F.col(f"`{text}`").alias("text"))
        own = own.filter(F.col("source").isin(wanted) & F.col("text").isNotNull() & (F.col("text") != "")) if wanted else own.filter(F.lit(False))
        self.docs = cut(own.select("id", "source", token_counter(spark, tokenizer)("text").alias("tokens")).filter("tokens > 0"))
        supply = {r["source"]: (r["tokens"], r["n"]) for r in self.docs.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).collect()}
        have = [r for r in rows if r["source"] in supply]
        whole = sum(r["share"] for r in have)
        share = {r["source"]: r["share"] / whole for r in have}
        most = min((supply[r["source"]][0] * r["repeats"] / share[r["source"]] for r in have), default=0)
        self.total = min(most, total_tokens) if total_tokens is not None else most
        raw = {r["source"]: float((tilt or {}).get(r["source"], 0) if tilt is not None else r["repeats"]) for r in have}
        mean = sum(share[s] * raw[s] for s in raw)
        widest = max((abs(v - mean) for v in raw.values()), default=0) or 1.0
        plan = [(s, share[s], (raw[s] - mean) / widest, float(self.total * share[s]), supply[s][0], int(-(-self.total * share[s] // supply[s][0]))) for s in share]
        self.plan = spark.createDataFrame(plan, "source string, share double, tilt double, demand double, supply bigint, passes int")
        self.buckets = max(1, -(-sum(n for _, n in supply.values()) // BUCKET))
        self.seed = seed

    def positions(self) -> DataFrame:
        """(id, source, repeat, tokens, position), sorted by position, the time in [0, 1) at which the document is due."""
        used = self.docs.join(F.broadcast(self.plan), "source")  # one row per source
        copies = used.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)))
        copies = copies.withColumn("h", F.xxhash64("id", "repeat", F.lit(self.seed))).withColumn("bucket", F.pmod(F.shiftright("h", 20), F.lit(self.buckets)))
        sums = copies.groupBy("source", "repeat", "bucket").agg(F.sum("tokens").alias("sum"))
        before = Window.partitionBy("source", "repeat").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        starts = sums.select("source", "repeat", "bucket", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("start"))
        within = Window.partitionBy("source", "repeat", "bucket").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, -1)
        laid = copies.withColumn("inner", F.coalesce(F.sum("tokens").over(within), F.lit(0))).join(starts, ["source", "repeat", "bucket"])
        laid = laid.withColumn("offset", F.col("repeat") * F.col("supply") + F.col("start") + F.col("inner")).filter(F.col("offset") < F.col("demand"))
        u, a = F.col("offset") / F.col("demand"), F.col("tilt")
        due = F.when(F.abs(a) < 1e-9, u).otherwise((F.sqrt((1 - a) * (1 - a) + 4 * a * u) - (1 - a)) / (2 * a))
        return laid.select("id", "source", "repeat", "tokens", (due + 0.0).alias("position")).orderBy("position", "source", "id", "repeat")

    def shares(self) -> DataFrame:
        """Per source of the targets: target_share, actual_share, tokens, documents used, rows (with repeats), most_repeats."""
        spark = self.docs.sparkSession
        stated = spark.createDataFrame([(r["source"], r["share"]) for r in self.targets], "source string, target_share double")
        rows = self.positions().groupBy("source", "id").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))
        sums = rows.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("documents"), F.sum("n").alias("rows"), F.max("n").alias("most_repeats"))
        z = lambda c: F.coalesce(c, F.lit(0)).alias(c)
        out = stated.join(sums, "source", "left").select("source", "target_share", z("tokens"), z("documents"), z("rows"), z("most_repeats"))
        total = F.sum("tokens").over(Window.partitionBy(F.lit(1)))  # one row per source
        return out.withColumn("actual_share", F.coalesce(F.try_divide(F.col("tokens"), total), F.lit(0.0)))


def _mixture(spark: SparkSession, folder: str) -> Mixture:
    return Mixture(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    return _mixture(spark, folder).positions().withColumnRenamed("id", "doc_id")


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _mixture(spark, folder).shares()


QUERIES = {"p7_mix": p7_mix, "p7_shares": p7_shares}
SQL: dict[str, str] = {}
