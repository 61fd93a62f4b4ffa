"""HTTP delivery: a POST for each batch of a transaction or of loose events."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.delivery import payloads
from ..operators.transactions import CAP
from .base import Sink


class PermanentError(Exception):
    """The receiver has refused the batch; sending it again is of no use."""


def post(url: str, body: bytes, headers: dict[str, str], timeout: float) -> int:
    request = urllib.request.Request(url, data=body, headers=headers, method="POST")
    try:
        with urllib.request.urlopen(request, timeout=timeout) as r:
            return r.status
    except urllib.error.HTTPError as e:
        return e.code


class WebhookSink(Sink):
    """Posts from the executors, so a batch of many transactions is sent in parallel.

    Refusals (4xx) are permanent; server and network errors are tried ``max_retries`` times more, with
    doubling pauses. The defaults, headers and names in the body are fixed values, which receivers rely on. The key header lets the receiver drop what it has had before.
    """

    def __init__(self, url: str, timeout_seconds: float = 10, max_retries: int = 10, initial_backoff_seconds: float = 0.5, max_backoff_seconds: float = 30, extra_headers: dict[str, str] | None = None, source: str = "incremental"):
        self.url, self.timeout, self.retries = url, timeout_seconds, max_retries
        self.first, self.most, self.headers, self.source = initial_backoff_seconds, max_backoff_seconds, dict(extra_headers or {}), source

    def pause(self, attempt: int) -> float:
        return min(self.first * 2 ** (attempt - 1), self.most)

    def send(self, body: bytes, key: str, poster: Callable[..., int] = post, sleep: Callable[[float], None] = time.sleep) -> int:
        """The number of attempts it took."""
        last = None
        for attempt in range(self.retries + 1):
            if attempt:
                sleep(self.pause(attempt))
            headers = {"Content-Type": "application/json", "X-CDC-Idempotency-Key": key, "X-CDC-Retry-Attempt": str(attempt), **self.headers}
            try:
                status = poster(self.url, body, headers, self.timeout)
            except OSError as e:
                last = e
                continue
            if 200 <= status < 300:
                return attempt + 1
            if 400 <= status < 500:
                raise PermanentError(f"{self.url} answered {status}")
            last = RuntimeError(f"{self.url} answered {status}")
        raise RuntimeError(f"gave up on {self.url} after {self.retries + 1} attempts") from last

    def batches(self, events: DataFrame) -> DataFrame:
        """batch_id, key and body of the posts: one for each delivery batch, or else for each transaction and each position of loose events.

        A post has at most ``CAP`` + 1 events, so that no list grows without a bound; more make further posts.
        """
        name = F.col("delivery_batch") if "delivery_batch" in events.columns else F.coalesce("transaction_id", F.concat_ws("-", F.lit("at"), "binlog_file", "position"))
        number = F.row_number().over(Window.partitionBy("_name").orderBy("binlog_file", "position"))
        part = F.floor((number - 1) / (CAP + 1))
        own = events.withColumn("_name", name).withColumn("_part", part)
        own = own.withColumn("batch_id", F.when(F.col("_part") > 0, F.concat_ws("-part-", "_name", "_part")).otherwise(F.col("_name"))).drop("_name", "_part")
        lists = own.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("binlog_file", "position", F.to_json(F.struct(*events.columns), {"ignoreNullFields": "false"}).alias("event")))).alias("sorted"))
        return payloads(own, "batch_id").join(lists, "batch_id").withColumn("events", F.transform("sorted", lambda x: x["event"])).drop("sorted")

    def deliver(self, events: DataFrame, batch_id: int) -> None:
        sink = self

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                done = []
                for r in f.itertuples():
                    body = {"batch_id": r.batch_id, "source": sink.source, "event_count": int(r.event_count), "max_binlog_file": r.max_binlog_file, "max_binlog_position": None if pd.isna(r.max_binlog_position) else int(r.max_binlog_position), "transaction_id": r.transaction_id, "events": [json.loads(e) for e in r.events]}
                    done.append((r.batch_id, sink.send(json.dumps(body, default=str).encode(), r.batch_key)))
                yield pd.DataFrame(done, columns=["batch_id", "attempts"])

        self.batches(events).mapInPandas(run, "batch_id string, attempts long").agg(F.sum("attempts")).collect()
