"""Crawled items as a stream: first occurrence of each, exported as it comes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def first_items(stream: DataFrame, key: str, time: str, late: str = "1 day") -> DataFrame:
    """The first record per key; keys are forgotten once ``late`` has passed, so the state is bounded."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def export(stream: DataFrame, folder: str, checkpoint: str, item: str) -> StreamingQuery:
    """Append the records of every micro-batch to the item type's JSON lines; a batch run again after a failure replaces its own files."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").option("ignoreNullFields", "true").json(f"{folder}/item_type={item}/batch={epoch}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def windowed_activity(stream: DataFrame, time: str, by: str, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events per ``by`` and tumbling window, emitted once the watermark has passed it."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), by).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), "n")


def co_reviews(left: DataFrame, right: DataFrame, window: str = "7 days", late: str = "1 day") -> DataFrame:
    """Pairs of members reviewing one product within ``window``, as a stream-stream join whose state the watermarks bound.

    Both sides have m, p and ts; the pair comes out as (m1, m2, p).
    """
    a = left.select(F.col("m").alias("m1"), "p", F.col("ts").alias("t1")).withWatermark("t1", late)
    b = right.select(F.col("m").alias("m2"), F.col("p").alias("p2"), F.col("ts").alias("t2")).withWatermark("t2", late)
    near = (F.col("p") == F.col("p2")) & (F.col("m1") < F.col("m2")) & (F.col("t2") > F.col("t1") - F.expr(f"interval {window}")) & (F.col("t2") < F.col("t1") + F.expr(f"interval {window}"))
    return a.join(b, near).select("m1", "m2", "p")
