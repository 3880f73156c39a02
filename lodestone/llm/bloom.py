"""Which hashes occur at least twice in a table too large for one filter: Bloom filters split by range of hash.

Every source part of the table (a partition as it was written) sends each range its share as a partial filter in sparse
form: the distinct hashes it holds there, with how often, since a part holds few of a range's hashes and their list is
smaller than the bits they set. The task of a range merges the partial filters into a pair of bit sets, once and twice: a
hash sets its bits in once; if the part holds it several times or once holds all its bits already, also in twice. What
twice never lacks is a hash that occurs twice anywhere, in whatever order parts come. The hashes that twice holds are the
possible repeats; of these, and of no others, the task adds up the occurrences, and sends what is left back to the
parts that hold it. A hash in a third of all rows is one entry per part by then.

A range holds about PER_RANGE rows, whatever the table's size; nothing goes to the driver, nothing is broadcast, and rows
stay where they are: the answer to each part lies in the shared folder under the part's number, and whoever reads rows of
that part looks it up there.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.session import new_folder

HASHES, BITS_PER_HASH = 4, 16  # with 16 bits a hash about 2 singletons in 1,000 pass as possible repeats
PER_RANGE = 1 << 21
CHUNK = 1 << 20  # rows of a part that are gathered before they are sent
PARTIAL = "range long, src int, h binary, n binary"
ANSWER = "src int, h binary, n binary"


def positions(h: np.ndarray, bits: int) -> np.ndarray:
    """HASHES bit positions for each 64-bit hash, a row for each of them; bits is a power of two."""
    with np.errstate(over="ignore"):
        a = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        b = ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) | np.uint64(1)
        return np.stack([((a + np.uint64(i) * b) >> np.uint64(20)) & np.uint64(bits - 1) for i in range(HASHES)])


class Filter:
    """The bit sets once and twice of one range; a bit is a byte in memory."""

    def __init__(self, hashes: int):
        self.bits = 1 << max(10, (max(1, hashes) * BITS_PER_HASH - 1).bit_length())
        self.once, self.twice = np.zeros(self.bits, bool), np.zeros(self.bits, bool)

    def merge(self, h: np.ndarray, n: np.ndarray) -> None:
        """Adds a partial filter: distinct hashes and how often each occurs."""
        at = positions(h, self.bits)
        self.twice[at[:, (n > 1) | self.once[at].all(axis=0)]] = True
        self.once[at] = True

    def repeated(self, h: np.ndarray) -> np.ndarray:
        return self.twice[positions(h, self.bits)].all(axis=0)


def _pack(x: np.ndarray) -> bytes:
    return zlib.compress(x.tobytes(), 1)


def _unpack(x: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zlib.decompress(x), kind)


def _partials(range_bits: int):
    def send(srcs: np.ndarray, hashes: np.ndarray) -> Iterator[pa.RecordBatch]:
        for src in np.unique(srcs):
            h, n = np.unique(hashes[srcs == src], return_counts=True)
            of = h >> np.uint64(64 - range_bits) if range_bits else np.zeros(len(h), np.uint64)
            ranges, first = np.unique(of, return_index=True)
            ends = [*first[1:], len(h)]
            columns = {
                "range": pa.array(ranges.astype(np.int64)),
                "src": pa.array(np.full(len(ranges), src, np.int32)),
                "h": pa.array([_pack(h[a:b]) for a, b in zip(first, ends)], pa.binary()),
                "n": pa.array([_pack(n[a:b].astype(np.int64)) for a, b in zip(first, ends)], pa.binary()),
            }
            yield pa.RecordBatch.from_pydict(columns)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)])
            size += batch.num_rows
            if size >= CHUNK:
                yield from send(np.concatenate([s for s, _ in held]), np.concatenate([h for _, h in held]).view(np.uint64))
                held, size = [], 0
        if size:
            yield from send(np.concatenate([s for s, _ in held]), np.concatenate([h for _, h in held]).view(np.uint64))

    return run


def _answers(partials: pd.DataFrame) -> pd.DataFrame:
    """What one range sends back: for each part its hashes that occur more than once in the range, with how often."""
    parts = [(src, _unpack(h, np.uint64), _unpack(n, np.int64)) for src, h, n in zip(partials["src"], partials["h"], partials["n"])]
    both = Filter(sum(len(h) for _, h, _ in parts))
    for _, h, n in parts:
        both.merge(h, n)
    sieved = [(src, h[keep], n[keep]) for src, h, n in parts if (keep := both.repeated(h)).any()]
    if not sieved:
        return pd.DataFrame({"src": np.zeros(0, np.int32), "h": [], "n": []})
    known, inverse = np.unique(np.concatenate([h for _, h, _ in sieved]), return_inverse=True)
    total = np.zeros(len(known), np.int64)
    np.add.at(total, inverse, np.concatenate([n for _, _, n in sieved]))
    out = []
    for src, h, _ in sieved:
        n = total[np.searchsorted(known, h)]
        if (n > 1).any():
            out.append((src, _pack(h[n > 1]), _pack(n[n > 1])))
    return pd.DataFrame(out, columns=["src", "h", "n"]).astype({"src": "int32"})


def _read(folder: str, src: int) -> tuple[np.ndarray, np.ndarray]:
    """A part's repeated hashes in order, and how often each occurs."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    files, at = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    mine = [f.path for f in files.get_file_info(fs.FileSelector(f"{at}/src={src}", allow_not_found=True)) if f.path.endswith(".parquet")]
    rows = [r for f in mine for r in pq.read_table(files.open_input_file(f)).select(["h", "n"]).to_pylist()]
    h = np.concatenate([np.zeros(0, np.uint64), *(_unpack(r["h"], np.uint64) for r in rows)])
    n = np.concatenate([np.zeros(0, np.int64), *(_unpack(r["n"], np.int64) for r in rows)])
    h, first = np.unique(h, return_index=True)  # a part of several chunks was answered several times
    return h, n[first]


def _looker(folder: str):
    def look(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        have, known, n = None, None, None
        for srcs, hashes in batches:
            s, h = srcs.to_numpy(), hashes.to_numpy(np.int64).view(np.uint64)
            out = np.ones(len(h), np.int64)
            for src in np.unique(s):
                if src != have:
                    have, (known, n) = src, _read(folder, int(src))
                mine = np.flatnonzero(s == src)
                if len(known):
                    at = np.minimum(np.searchsorted(known, h[mine]), len(known) - 1)
                    out[mine] = np.where(known[at] == h[mine], n[at], 1)
            yield pd.Series(out)

    return look


def occurrences(rows: DataFrame, src: str, h: str, per_range: int = PER_RANGE) -> Column:
    """A column for the rows of this table: how often its hash occurs in it, counted for possible repeats only (all others are 1).

    rows must be stored: src is the number of the part in which a row was written, h its hash, never null. The table is
    read once, in these two columns.
    """
    ranges = -(-rows.count() // per_range)
    bits = (max(1, ranges) - 1).bit_length()
    partials = rows.select(src, h).mapInArrow(_partials(bits), PARTIAL)
    answers = partials.groupBy("range").applyInPandas(_answers, ANSWER)
    folder = new_folder(rows.sparkSession)
    answers.repartition("src").write.partitionBy("src").parquet(folder)
    return F.pandas_udf(_looker(folder), "bigint")(F.col(src), F.col(h))
