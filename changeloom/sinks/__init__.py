"""Where batches of events go. A sink takes (DataFrame, batch id) and returns once they are durable."""

from __future__ import annotations

from .base import LogSink, MemorySink, Sink, TableSink
from .jsonl import JsonLinesSink
from .keys import KeyIndex
from .published import PublishedSink
from .webhook import WebhookSink


def create(settings: dict) -> Sink:
    """A sink by its type: memory, log (default), stdout, jsonl, published or webhook."""
    options = dict(settings)
    kind = str(options.pop("type", "log") or "log").lower()
    if kind == "memory":
        return MemorySink(options.get("path"))
    if kind in ("log", "stdout"):
        return LogSink(to_stdout=kind == "stdout")
    if kind == "jsonl":
        return JsonLinesSink(**options)
    if kind == "published":
        return PublishedSink(**options)
    if kind == "webhook":
        return WebhookSink(**options)
    raise ValueError(f"unknown sink type: {kind}")


__all__ = ["JsonLinesSink", "KeyIndex", "LogSink", "MemorySink", "PublishedSink", "Sink", "TableSink", "WebhookSink", "create"]
