"""Global row numbers without a single task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.session import cut


def numbered(df: DataFrame, by: str | list[str], name: str) -> DataFrame:
    """df with a number from 0 in the order of `by`: rows are sorted by range, numbered inside each, and each range starts where the sizes of those before end."""
    keys = [by] if isinstance(by, str) else by
    ranged = cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # one row per range
    starts = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))
    inner = F.row_number().over(Window.partitionBy("_part").orderBy(*keys)) - 1
    return ranged.withColumn("_i", inner).join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_i")).drop("_part", "_i", "_start")
