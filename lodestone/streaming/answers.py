"""The latest answer per session and variable of a stream of answers.

Answers are ordered by seq, the larger wins; late and repeated ones change nothing once a later one is there. State is one
row per session and variable. With a watermark on a time column, `within` drops state and answers older than that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def latest_answers(stream: DataFrame, at: str | None = None, within: str = "1 day") -> DataFrame:
    """(session, var, seq, value) of a stream (session, seq, var, value and, for a watermark, the time column `at`)."""
    if at is None:
        return stream.groupBy("session", "var").agg(F.max(F.struct("seq", "value")).alias("x")).select("session", "var", "x.*")
    windowed = stream.withWatermark(at, within).groupBy(F.window(at, within), "session", "var")
    return windowed.agg(F.max(F.struct("seq", "value")).alias("x")).select("window", "session", "var", "x.*")


def to_memory(answers: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Runs the stream over what is there now, into a table in memory; for tests and notebooks."""
    return answers.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
