"""Numbers in a global order without one task that sees all rows, and how many tasks share a table's rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with its place in the order, from 1 on. Rows are dealt by ranges of the order; a range's numbers start after
    the counts of those before it. One row per range is all that meets in one place. `order` must have no ties."""
    dealt = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__range", F.spark_partition_id()))
    sizes = dealt.groupBy("__range").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row per range
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return dealt.withColumn(name, inside).join(F.broadcast(before.select("__range", "__before")), "__range").withColumn(name, (F.col(name) + F.col("__before")).cast("long")).drop("__range", "__before")


STORED = 4 << 20


def parts(stored: DataFrame) -> int:
    """Over how many partitions to deal what is made of a stored table: one for 4 MB of its files, one a core at least.

    To be given to `repartition` by number: partitions that Spark asks for itself are made fewer and larger as it sees fit.
    """
    size = int(str(stored._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(stored.sparkSession.sparkContext.defaultParallelism, math.ceil(size / STORED))
