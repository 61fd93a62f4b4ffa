"""JSON lines, a folder per batch."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.envelope import to_json
from .base import Sink
from .keys import KeyIndex


class JsonLinesSink(Sink):
    """Writes ``path/batch=<id>/``; a batch that is delivered again replaces itself.

    Events are sorted by position inside range partitions, so that transactions stay together
    and large batches are still written in parallel. With ``dedupe_index_path`` keys
    that were written before are skipped, in whatever order they come (see ``KeyIndex``); keys are kept after the write, so repeats inside a
    batch are both written. ``append=False`` keeps only the last batch.
    """

    def __init__(self, path: str, dedupe_index_path: str | None = None, append: bool = True):
        self.path, self.index_path, self.append = path, dedupe_index_path, append
        self.index: KeyIndex | None = None

    def deliver(self, events: DataFrame, batch_id: int) -> None:
        own, keys = events, ["binlog_file", "position"]
        if self.index_path:
            self.index = self.index or KeyIndex(events.sparkSession, self.index_path)
            own = self.index.unseen(events, batch_id)
        target = f"{self.path}/batch={batch_id}" if self.append else self.path
        to_json(own.select(*events.columns).repartitionByRange(*keys).sortWithinPartitions(*keys)).write.mode("overwrite").text(target)
        if self.index is not None:
            self.index.add(own, batch_id)
