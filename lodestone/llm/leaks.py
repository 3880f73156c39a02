"""Problem 6: passages of held-out items inside a corpus, found by their template.

Every word gets a template form: numbers (in digits or spelt), units and names become a typed placeholder, other words
stay. There are two forms of a text. In the first a name is what stands like one in this text, item or document:
capitalised inside a sentence or after a title, and elsewhere in the text if it is capitalised there and never small. In
the second a name is any word that the items write so anywhere, so that equal words always have equal templates.

Windows of consecutive words are hash-joined by their template and by which of their places hold equal words, in which any
two windows agree that one renaming of slots, one to one, turns into each other. A joined pair of windows is then compared
word by word: it is verbatim if every word is the same (the identity is such a renaming), and re-parameterised if one
renaming explains all slots. verbatim() gives the former, by_slots() both.

Documents are read once. Their words are split in the JVM; window hashes are sums over arrays of words' hashes, and looked
up in a bit set of the items' windows, of at most SIEVE bits whatever their number, so that only windows some item may have
leave the task, with their words. The sieve lets some others pass; the join that follows does not.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import APOSTROPHES, WORD, words
from lodestone.llm.identifiers import TITLES
from lodestone.operators.joins import small_or_shuffled
from lodestone.session import cut
from lodestone.sources.tables import table

SIEVE = 1 << 27  # bits: 16 MB to broadcast
NAMES = 200_000  # learned names up to which they are broadcast; more are joined to the texts
#: A sign for private use, put before words that stand like names.
MARK = ""
NAME_LIKE = rf"(?=\p{{Lu}}\p{{Ll}})(?:(?<=[\p{{L}}\p{{N}},;] )|(?<=(?<![\p{{L}}\p{{N}}])(?i:{'|'.join(TITLES)})\.?\s))"
#: Spelt numbers and units that a template leaves open.
NUMBERS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand once twice".split())
UNITS = frozenset("second seconds minute minutes hour hours day days week weeks month months year years mg g kg mcg ml l litre litres cm mm m km degree degrees bpm mmhg mmol unit units percent".split())
SLOTS = ("<number>", "<unit>", "<name>")
HITS = "id {id}, at int, h bigint, p bigint, w array<string>"


def marked_words(text: Column) -> Column:
    """words(), each with a mark before it if it is capitalised inside a sentence or after a title, with "^" if it is capitalised elsewhere."""
    bare = F.regexp_replace(F.translate(text, MARK + "^", "  "), APOSTROPHES, "")
    named = F.regexp_replace(bare, NAME_LIKE, MARK)
    named = F.regexp_replace(named, rf"(?=\p{{Lu}}\p{{Ll}})(?<![\p{{L}}\p{{N}}{MARK}])", "^")
    return F.regexp_extract_all(F.lower(named), F.lit(rf"[{MARK}^]?{WORD}"), 0)


def slot_of(word: str) -> int:
    """The place in SLOTS of a word that is a slot wherever it stands, else -1."""
    if word in NUMBERS or any(unicodedata.category(c)[0] == "N" for c in word):
        return 0
    return 1 if word in UNITS else -1


def _hashes(values: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(values, dtype=object), categorize=False) if len(values) else np.zeros(0, np.uint64)


def _multipliers(size: int) -> np.ndarray:
    return np.random.default_rng(6).integers(1, 1 << 63, size, dtype=np.uint64) | np.uint64(1)


def _in(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether both places of a hash are set; bits is a set of a power of two of bits, 64 in each element."""
    most = np.uint64(len(bits) * 64 - 1)
    at = lambda p: (bits[(p & most) >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1)
    return (at(h) & at(h >> np.uint64(32))).astype(bool)


class _Reader:
    """Windows of a batch of texts: (id, marked words, words of it that are learned names; null if those are in `names`)."""

    def __init__(self, size: int, own_names: bool, names: frozenset[str], sieve: np.ndarray | None):
        self.size, self.own_names, self.names, self.sieve = size, own_names, names, sieve
        self.mult, self.slots = _multipliers(size), _hashes(list(SLOTS))

    def read(self, batch: pa.RecordBatch) -> pa.RecordBatch | None:
        lists = batch.column(1)
        flat = lists.flatten().dictionary_encode()
        if len(flat) < self.size:
            return None
        doc = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        marked = flat.dictionary.to_pylist()
        mark = np.array([1 if x[0] == MARK else 2 if x[0] == "^" else 0 for x in marked], np.int8)
        bare, kept = pd.factorize(np.array([x[1:] if m else x for x, m in zip(marked, mark)], dtype=object))
        kept = list(kept)
        token = flat.indices.to_numpy(zero_copy_only=False)
        code, mark = bare[token], mark[token]
        slot = np.array([slot_of(w) for w in kept], np.int8)
        plain = np.where(slot >= 0, self.slots[slot], _hashes(kept))
        pair = doc * np.int64(len(kept)) + code

        def templates(name: np.ndarray) -> np.ndarray:
            return np.where(name & (slot[code] < 0), self.slots[2], plain[code])

        listed = batch.column(2)
        if listed.null_count == len(listed):
            known = np.array([w in self.names for w in kept], bool)[code]
        else:
            index = pd.Index(kept)
            of = index.get_indexer(listed.flatten().to_pylist())
            rows = np.repeat(np.arange(len(listed)), listed.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            known = np.isin(pair, (rows * np.int64(len(kept)) + of)[of >= 0])
        forms = [templates(known)]
        if self.own_names:
            only = np.setdiff1d(pair[mark == 1], pair[mark == 0])
            forms.append(templates((mark == 1) | (mark == 2) & np.isin(pair, only)))
        n = len(code) - self.size + 1
        whole = doc[:n] == doc[self.size - 1 :]
        first = np.searchsorted(doc, doc)
        at, hashes = [], []
        for t in forms:
            h = np.zeros(n, np.uint64)
            for k in range(self.size):
                h += t[k : n + k] * self.mult[k]
            h ^= h >> np.uint64(29)
            here = np.flatnonzero(whole & (h != hashes[0][1] if hashes else True) & (True if self.sieve is None else _in(self.sieve, h)))
            at.append(here)
            hashes.append((h[here], h))
        at = np.concatenate(at)
        if not len(at):
            return None
        window = code[at[:, None] + np.arange(self.size)]
        equal = (window[:, :, None] == window[:, None, :]).argmax(axis=2).astype(np.uint64)  # of each place the first that holds its word
        pattern = (equal * self.mult).sum(axis=1, dtype=np.uint64)
        text = pa.array(kept, pa.string()).take(pa.array(window.ravel()))
        offsets = pa.array(np.arange(len(at) + 1, dtype=np.int32) * self.size)
        columns = {
            "id": batch.column(0).take(pa.array(doc[at])),
            "at": pa.array((at - first[at] + 1).astype(np.int32)),
            "h": pa.array(np.concatenate([h for h, _ in hashes]).view(np.int64)),
            "p": pa.array(pattern.view(np.int64)),
            "w": pa.ListArray.from_arrays(offsets, text),
        }
        return pa.RecordBatch.from_pydict(columns)


def _reading(shared, size: int, own_names: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(size, own_names, *shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                if (out := reader.read(batch.slice(lo, 2000))) is not None:
                    yield out

    return run


def item_names(items: DataFrame, text: str = "text") -> DataFrame:
    """(n): words capitalised inside sentences of the items, or after a title."""
    m = items.select(F.explode(marked_words(F.col(text))).alias("m")).filter(F.col("m").startswith(MARK))
    return m.select(F.substring("m", 2, 1_000_000).alias("n")).distinct()


def sieve_of(hashes: DataFrame, most: int = SIEVE) -> np.ndarray:
    """A bit set of the distinct values of the bigint column h, two bits each, of at most `most` bits; put together by 64 bits in the JVM."""
    bits = min(most, 1 << max(12, (hashes.count() * 64).bit_length()))
    place = F.explode(F.array(F.col("h"), F.shiftrightunsigned("h", 32))).alias("at")
    at = hashes.select(place).select(F.col("at").bitwiseAND(F.lit(bits - 1)).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 AS int))")).alias("bits")).toPandas()  # at most bits / 64 rows
    out = np.zeros(bits // 64, np.uint64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def _ready(df: DataFrame, id: str, text: str) -> DataFrame:
    return df.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text")).filter(F.col("id").isNotNull() & F.col("text").isNotNull())


class Leaks:
    """Windows that items and documents share.

    Texts that are null or shorter than the window hold none. Repeated ids count as one document. Ties don't arise; other
    columns are ignored; empty tables give empty results. A text's words are all read, whatever its length.
    """

    def __init__(self, items: DataFrame, docs: DataFrame, item_id: str = "item_id", doc_id: str = "doc_id", text: str = "text", size: int = 10, names: int = NAMES):
        self.size, self.items, self.docs = size, _ready(items, item_id, text), _ready(docs, doc_id, text)
        self.names = cut(item_names(self.items))
        self.few = self.names.limit(names + 1).count() <= names
        self.known = frozenset(r["n"] for r in self.names.collect()) if self.few else frozenset()

    def _read(self, texts: DataFrame, own_names: bool, sieve: np.ndarray | None) -> DataFrame:
        m = marked_words(F.col("text")) if own_names else words(F.col("text"))
        rows = texts.select("id", m.alias("m"))
        if self.few:
            rows = rows.withColumn("listed", F.lit(None).cast("array<string>"))
        else:
            one = rows.select("id", F.explode(F.array_distinct(F.transform("m", lambda x: F.translate(x, MARK + "^", "")))).alias("n"))
            held = one.join(self.names, "n").groupBy("id").agg(F.collect_set("n").alias("listed"))
            rows = rows.join(held, "id", "left").withColumn("listed", F.coalesce("listed", F.array().cast("array<string>")))
        shared = texts.sparkSession.sparkContext.broadcast((self.known, sieve))
        return rows.mapInArrow(_reading(shared, self.size, own_names), HITS.format(id=dict(texts.dtypes)["id"]))

    def pairs(self, own_names: bool) -> DataFrame:
        """(item, doc, at, same, slots): windows of documents with a window of an item of the same template and the same equal places."""
        mine = cut(self._read(self.items, own_names, None).distinct())
        found = self._read(self.docs, own_names, sieve_of(mine.select("h").distinct()))
        mine = small_or_shuffled(mine.select(F.col("id").alias("item"), "h", "p", F.col("w").alias("a")))
        both = found.select(F.col("id").alias("doc"), "at", "h", "p", F.col("w").alias("b")).join(mine, ["h", "p"])
        return both.select("item", "doc", "at", (F.col("a") == F.col("b")).alias("same"), F.array_distinct(F.arrays_zip("a", "b")).alias("slots"))

    def verbatim(self) -> DataFrame:
        """(item, doc) with a window whose slots are all the same."""
        return self.pairs(own_names=False).filter("same").select("item", "doc").distinct()

    def by_slots(self) -> DataFrame:
        """(item, doc, verbatim, renamed): numbers of the document's windows that an item's window explains, word by word or after one renaming of slots."""
        s = F.col("slots")
        one_to_one = (F.size(F.array_distinct(s["a"])) == F.size(s)) & (F.size(F.array_distinct(s["b"])) == F.size(s))
        kinds = self.pairs(own_names=True).filter(F.col("same") | one_to_one).select("item", "doc", "at", F.when(F.col("same"), "verbatim").otherwise("renamed").alias("kind")).distinct()
        n = lambda k: F.count_if(F.col("kind") == k).alias(k)
        return kinds.groupBy("item", "doc").agg(n("verbatim"), n("renamed"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    found = Leaks(table(spark, folder, "eval_items"), table(spark, folder, "documents")).verbatim()
    return found.select(F.col("item").alias("item_id"), F.col("doc").alias("doc_id"))


def p6_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Items and the documents that hold windows of them, as they stand or re-parameterised."""
    found = Leaks(table(spark, folder, "eval_items"), table(spark, folder, "documents")).by_slots()
    return found.select(F.col("item").alias("item_id"), F.col("doc").alias("doc_id"), F.col("verbatim").alias("n_verbatim"), F.col("renamed").alias("n_renamed"))


def _grams(tbl: str, key: str) -> str:
    w = "regexp_extract_all(lower(regexp_replace(text, '[''’]', '', 'g')), '[\\p{L}\\p{N}]+')"
    return f"SELECT DISTINCT {key}, array_to_string(w[i:i+9], ' ') AS gram FROM (SELECT {key}, w, unnest(range(1, len(w) - 8)) AS i FROM (SELECT {key}, {w} AS w FROM {tbl} WHERE text IS NOT NULL))"


QUERIES = {"p6_found": p6_found, "p6_leaks": p6_leaks}
SQL = {"p6_found": f"SELECT DISTINCT item_id, doc_id FROM ({_grams('eval_items', 'item_id')}) JOIN ({_grams('documents', 'doc_id')}) USING (gram)"}
