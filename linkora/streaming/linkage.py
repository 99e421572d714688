"""Linking a stream of records to static entities: each micro-batch is linked by itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def link_stream(records: DataFrame, link: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append ``link(batch)`` to Parquet at ``path`` for each micro-batch of the ``records`` stream.

    Blocking, ranks and the best owner are keyed by the record, so how records fall into batches changes no
    result. A batch that is repeated after a failure overwrites its own folder, so rows come once.
    """

    def write(batch: DataFrame, number: int) -> None:
        link(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
