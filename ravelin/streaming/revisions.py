"""Streams of changes kept as tables in the shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import shared_folder


def drain(stream: DataFrame, key: list[str]) -> DataFrame:
    """Everything that is there now, as a table with the last state of each key.

    The stream runs in update mode: a batch gives the rows that it changed. Each batch writes under its own
    number, so one that runs again replaces its own rows.
    """
    base = f"{shared_folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    query = stream.writeStream.outputMode("update").option("checkpointLocation", f"{base}/state").foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    spark = stream.sparkSession
    if query.lastProgress is None:
        return spark.createDataFrame([], stream.schema)
    out = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema.fields)}, batch long").parquet(f"{base}/out")
    rest = [c for c in stream.columns if c not in key]
    last = out.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("last"))
    return last.select(*key, *[F.col(f"last.{c}").alias(c) for c in rest]).select(stream.columns)


def activity(events: DataFrame, width: str = "1 day", late: str | None = None) -> DataFrame:
    """(start, event_type, n) per tumbling window; times without a zone are in the session's.

    The state has a row for each window and type. With `late`, a watermark on `ts` drops
    windows that old from the state, and rows that come later than that with them; without,
    every row counts, in whatever order files are read.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if late else timed
    w = timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n")
