"""Scoring of generations that arrive in a folder (an extension: batch runs are the model).

``dropDuplicatesWithinWatermark`` keeps the first arrival of a pair within the
watermark; ``upsert`` then lets a later file win, as a batch run does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

ARRIVING = "sample_id string, gen_idx int, generation string, ts timestamp"


def arrivals(spark: SparkSession, folder: str, *, watermark: str | None = None, per_trigger: int = 100) -> DataFrame:
    """New JSON Lines files as a stream; with a watermark repeated pairs are dropped within it."""
    rows = spark.readStream.schema(ARRIVING).option("maxFilesPerTrigger", per_trigger).json(folder)
    return rows.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["sample_id", "gen_idx"]) if watermark else rows


def running_accuracy(scored: DataFrame, window: str = "1 hour", watermark: str | None = None) -> DataFrame:
    """(window, n, accuracy) by event time; late rows beyond the watermark, of the arrivals or given here, are left out."""
    own = scored.withWatermark("ts", watermark) if watermark else scored
    return own.groupBy(F.window("ts", window)).agg(F.count("*").alias("n"), F.avg("score").alias("accuracy"))


def upsert(stream: DataFrame, score: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Score each batch and add it under its batch id; readers keep the last of each pair with ``latest``. A batch that is run again replaces itself."""

    def save(batch: DataFrame, batch_id: int) -> None:
        score(batch).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, target: str) -> DataFrame:
    from gradeloom.operators.plan import keep_last

    return keep_last(spark.read.option("recursiveFileLookup", "true").parquet(target), F.struct("batch_id", "ts"))
