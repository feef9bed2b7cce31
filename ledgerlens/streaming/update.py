"""Updates of an index from a stream of leaves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerlens.plans.index import LogIndex


def update_stream(leaves: DataFrame, index: LogIndex, checkpoint_at: Callable[[int], bytes], checkpoint_location: str, once: bool = True, every: str = "10 seconds") -> StreamingQuery:
    """Start a query that takes each batch of ``leaves`` (a streaming DataFrame idx, leaf) into the index as a revision.

    ``checkpoint_at(size)`` gives the signed checkpoint of that size: with the tiled source every batch ends at one. A batch that was committed
    before a failure is known by its size and not taken again; one that reaches back before the index's size adds only what is new. ``once`` drains what is there and stops; otherwise the
    query looks for new leaves ``every`` so often.
    """

    def take(batch: DataFrame, batch_id: int) -> None:
        last = batch.agg(F.max("idx")).first()[0]
        if last is not None:
            index.update(checkpoint_at(last + 1), lambda a, b: batch.where((F.col("idx") >= a) & (F.col("idx") < b)), batch_id)

    writer = leaves.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint_location)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
