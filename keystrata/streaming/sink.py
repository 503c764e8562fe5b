"""Upserts of a stream's micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..session import KeyedSession


def upsert_stream(session: KeyedSession, stream: DataFrame, table: str, checkpoint: str) -> DataStreamWriter:
    """A writer that upserts each micro-batch by key. A batch that is run again after a failure writes the
    same keys and values, so the table ends up the same."""

    def write(batch: DataFrame, _: int) -> None:
        session.insert(table, batch)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
