"""An extension: dots that arrive as a stream are scored or counted in micro-batches. The reference has no streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_gate(stream: DataFrame, judge: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Run `judge` (rows in, verdict rows out) on every micro-batch and append its rows with the batch's number."""
    def each(batch: DataFrame, n: int) -> None:
        judge(batch).withColumn("batch", F.lit(n)).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
