"""Tab-separated tables and zipped terminology releases."""

from __future__ import annotations

import shutil
import zipfile

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import new_folder

RF2 = "id string, effectiveTime string, active string, moduleId string, sourceId string, destinationId string, relationshipGroup string, typeId string, characteristicTypeId string, modifierId string"


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A tab-separated file with a header; quotes are ordinary characters, an empty field is null, as null and empty are written alike."""
    return spark.read.csv(path, schema=schema, sep="\t", header=True, quote="")


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=True, quote="\u0000", escapeQuotes=False, emptyValue="", nullValue="")


def unpack(spark: SparkSession, archive: str, prefix: str, kind: str = "/Snapshot/") -> list[str]:
    """The members of a release of that kind whose name begins with prefix, unpacked into the folder all executors share (a zip can't be split): their paths. Lists of concrete values are left out."""
    folder = new_folder(spark)
    out = []
    with zipfile.ZipFile(archive) as z:
        for name in sorted(z.namelist()):
            base = name.rsplit("/", 1)[-1]
            if kind in f"/{name}" and base.startswith(prefix) and "ConcreteValues" not in base:
                to = f"{folder}/{base}"
                with z.open(name) as a, open_shared(to) as b:
                    shutil.copyfileobj(a, b)
                out.append(to)
    return out


def open_shared(path: str):
    """A new file at a path or address in the shared folder."""
    files, at = fs.FileSystem.from_uri(path) if path.startswith("file:") or "://" in path else (fs.LocalFileSystem(), path)
    files.create_dir(at.rsplit("/", 1)[0])
    return files.open_output_stream(at)


def read_release(spark: SparkSession, archive: str, prefix: str) -> DataFrame:
    """The rows of a release's lists of that prefix, all columns text, with `ord`, their order. Quotes are ordinary characters."""
    rows = spark.read.csv(unpack(spark, archive, prefix), sep="\t", header=True, quote="")
    return rows.withColumn("ord", F.monotonically_increasing_id())


def read_relationships(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.csv(paths, schema=RF2, sep="\t", header=True, quote="")
