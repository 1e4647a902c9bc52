"""Segments from a stream: each micro-batch becomes an indexed segment, in a folder of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from siftgrid import schema
from siftgrid.analyzers import IndexConf
from siftgrid.operators.index import IndexedFrame
from siftgrid.sources import store


def append_segments(stream: DataFrame, path: str, checkpoint: str, order: list[str], conf: IndexConf = IndexConf()) -> StreamingQuery:
    """Writes each batch of ``stream`` under ``path``/<batch number>, rows numbered by ``order``.

    A batch that is run again after a failure overwrites its own folder, so each row is indexed once. The folders are
    opened together with ``store.open_multi_indexed`` and compacted with ``store.write_merged_indexed``.
    """

    def one(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            store.write_indexed(IndexedFrame.create(schema.dense_positions(batch, *order), conf), f"{path}/{number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
