"""Micro-batches to a sink: retries, offsets after delivery, progress."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.positions import highest
from ..sinks import Sink
from ..sinks.webhook import PermanentError
from ..sources.stores import OffsetStore

logger = logging.getLogger("changeloom.run")


def backoff(attempt: int) -> float:
    return float(min(2**attempt, 30))


def deliver(sink: Sink, events: DataFrame, batch_id: int, attempts: int | None = None, sleep: Callable[[float], None] = time.sleep) -> int:
    """Delivers until the sink accepts, pausing 1, 2, 4 … 30 s; the number of retries.

    Refusals are retried like all else, as long as attempts last; without a bound that is for ever,
    so streams pass one and leave the rest to the query's restart from its checkpoint.
    """
    n = 0
    while True:
        try:
            sink.deliver(events, batch_id)
            return n
        except Exception as e:
            if attempts is not None and n + 1 >= attempts:
                raise
            logger.warning("batch %s failed (%s)%s", batch_id, e, ", refused" if isinstance(e, PermanentError) else "")
            sleep(backoff(n))
            n += 1


def start(events: DataFrame, sink: Sink, checkpoint: str, offsets: OffsetStore | None = None, flush_interval_ms: int | None = 500, attempts: int = 5) -> StreamingQuery:
    """A running query that hands each micro-batch to the sink and then acknowledges its greatest position.

    The checkpoint is what a restart resumes from; the offset file is its readable copy. Without an
    interval, all that is there is taken and the query ends.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            deliver(sink, batch, batch_id, attempts)
            top = batch.agg(highest().alias("top")).first().top if offsets is not None else None
            if top is not None:
                offsets.ack(top.binlog_file, top.position)
        finally:
            batch.unpersist()

    writer = events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if flush_interval_ms is None else writer.trigger(processingTime=f"{flush_interval_ms} milliseconds")
    return writer.start()


class Progress(StreamingQueryListener):
    """Calls back with batch id, input rows and rows a second after each micro-batch."""

    def __init__(self, tell: Callable[[dict], None]):
        self.tell = tell

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.tell({"batch": p.batchId, "rows": p.numInputRows, "rows_per_second": p.processedRowsPerSecond})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
