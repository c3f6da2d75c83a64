"""Streams of deltas into a leveled table: each micro-batch is one version."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.table import LeveledTable


def ingest_deltas(stream: DataFrame, table: LeveledTable, checkpoint: str, repartition_every: int | None = None, name: str = "deltas") -> StreamingQuery:
    """Runs until what is there is read. The table's map keeps the number of the last batch of the stream `name`, so a
    batch that is run again after a failure is not taken in again. repartition_every: batches between cascades."""

    def batch(df: DataFrame, number: int) -> None:
        if not df.isEmpty():
            table.append_deltas(df, name, number)
        if repartition_every and number % repartition_every == repartition_every - 1:
            table.cascade()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
