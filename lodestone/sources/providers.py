"""Embedding and extraction providers as interfaces, with a cache by content and a stub that needs no network."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.terminology import cache_misses
from lodestone.session import cut

TRIES = 5


class Busy(Exception):
    """What a provider raises where trying again may help."""


def patient(call: Callable, tries: int = TRIES, wait: Callable[[float], None] = time.sleep):
    """A call that waits 1, 2, 4, ... seconds and tries again while the provider is Busy; the last failure is raised."""

    def run(*args):
        for attempt in range(tries):
            try:
                return call(*args)
            except Busy:
                if attempt == tries - 1:
                    raise
                wait(2.0**attempt)

    return run


def hashed_vectors(texts: list[str], dims: int = 64) -> np.ndarray:
    """A deterministic stand-in for an embedding: the sum of a fixed random direction for each word, of unit length."""
    out = np.zeros((len(texts), dims), np.float32)
    for i, text in enumerate(texts):
        for w in text.lower().split() or [""]:
            seed = int.from_bytes(hashlib.sha256(w.encode()).digest()[:8], "big")
            out[i] += np.random.default_rng(seed).normal(size=dims)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def embed(wanted: DataFrame, cached: DataFrame, provider: Callable[[list[str]], np.ndarray] = hashed_vectors, model: str = "hashed", dims: int = 64, batch: int = 100) -> DataFrame:
    """(key, text, vec) of the distinct texts of wanted that cached (text) lacks; the provider gets lists of at most `batch` texts."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lo in range(0, len(frame), batch):
                part = frame.iloc[lo : lo + batch]
                yield part.assign(vec=list(patient(provider)(list(part["text"]))))

    return cache_misses(wanted.select(F.col("text")), cached.select("text"), model, dims).mapInPandas(run, "key string, text string, vec array<float>")


def ask(wanted: DataFrame, cached: DataFrame, provider: Callable[[str], str | None], prompt: str = "{text}", model: str = "stub") -> DataFrame:
    """(key, text, reply) of the distinct texts of wanted (text) that cached (text) lacks; the provider gets the prompt with the text in it, each text once."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(reply=[patient(provider)(prompt.replace("{text}", t)) for t in frame["text"]])

    return cache_misses(wanted.select("text"), cached.select("text"), model, 0).mapInPandas(run, "key string, text string, reply string")


def remembered(misses: Callable[[DataFrame], DataFrame], path: str, spark: SparkSession, schema: str) -> DataFrame:
    """What is cached in a folder and what misses(cached) adds to it; the answers are written back before they are used, so that each is paid for once."""
    spark.createDataFrame([], schema).write.mode("append").parquet(path)
    cut(misses(spark.read.schema(schema).parquet(path))).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


#: What turns a description into phrases, a symptom into a question.
PHRASES = "Split this description into separate symptoms, one short phrase each, one to a line: {text}"
QUESTION = "Write one short question that finds out whether someone has this symptom, and nothing else: {text}"


def phrases(texts: DataFrame, cached: DataFrame, provider: Callable[[str], str | None]) -> DataFrame:
    """(text, pos, phrase) of free texts (text), by the provider's lines; blank ones are no phrases."""
    lines = F.filter(F.transform(F.split("reply", "\\n"), lambda x: F.lower(x)), lambda x: F.trim(x) != "")
    return ask(texts, cached, provider, PHRASES).select("text", F.posexplode(lines).alias("pos", "phrase")).select("text", "pos", F.trim("phrase").alias("phrase"))


def questions(symptoms: DataFrame, cached: DataFrame, provider: Callable[[str], str | None]) -> DataFrame:
    """(text, reply): a question for each distinct phrase (text), asked for once."""
    return ask(symptoms, cached, provider, QUESTION).select("text", F.regexp_replace(F.trim("reply"), '^"+|"+$', "").alias("reply"))


def label_clusters(clusters: DataFrame, phrases: DataFrame, provider: Callable[[str], str | None], shown: int = 6) -> DataFrame:
    """(seed, name): a name for each cluster (id, seed) of phrases (id, phrase), from its first members; null where the provider gives none.

    The text asked about is the members' list, so that a cluster whose members are the same is asked for once.
    """
    members = clusters.join(phrases, "id").groupBy("seed").agg(F.array_sort(F.collect_list(F.struct("id", "phrase"))).alias("m"))
    listed = cut(members.select("seed", F.array_join(F.slice(F.col("m.phrase"), 1, shown), "\n").alias("text")))
    named = ask(listed, listed.limit(0), provider)
    return listed.join(named, "text").select("seed", F.nullif(F.lower(F.trim(F.regexp_replace("reply", r"\s+", " "))), F.lit("")).alias("name"))


def relink(clusters: DataFrame, names: DataFrame, links: DataFrame) -> DataFrame:
    """(condition, name), each once: links (condition, id) by the name of the id's cluster; clusters of one name are one, those without drop out."""
    return links.join(clusters, "id").join(names.filter("name IS NOT NULL"), "seed").select("condition", "name").distinct()
