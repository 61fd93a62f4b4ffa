"""The registered queries of the change-data-capture engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ddl import statement_kind, table_of
from ..functions.keys import batch_key
from ..functions.positions import at_or_after, committed_so_far, position
from ..operators import asof, delivery, transactions, views
from ..operators.envelope import as_map, envelopes, named, snapshot_envelopes, to_json
from ..operators.filters import TableFilter, without_boundaries
from ..operators.history import latest_version, schema_history
from ..sinks.keys import KeyIndex
from ..sinks.published import PublishedSink
from ..sources.chunks import ChunkedSnapshot, between
from ..sources.landed import from_binlog_events
from ..sources.shared import shared_folder
from ..sources.snapshot import Snapshot, SnapshotTable, page, schema_entries
from ..sources.splits import SplitRead
from . import changelog as c
from . import statements, streams


def op_counts(s: SparkSession, d: str) -> DataFrame:
    return c.rows(s, d).groupBy("tbl", "op").agg(F.count("*").alias("n"))


def table_filter(s: SparkSession, d: str) -> DataFrame:
    log = c.log(s, d).select("kind", F.lit("app").alias("database"), F.col("tbl").alias("table"))
    return TableFilter(include_tables=("app.user_state",)).apply(log).groupBy("kind").agg(F.count("*").alias("n"))


def envelope_keys(s: SparkSession, d: str) -> DataFrame:
    return c.events(s, d).select("idempotency_key", "dedup_key")


def unique_events(s: SparkSession, d: str) -> DataFrame:
    return views.unique_events(c.delivered(s, d).select("idempotency_key", "delivery_seq"))


def duplicates(s: SparkSession, d: str) -> DataFrame:
    return views.duplicates(c.delivered(s, d).select("idempotency_key", "delivery_seq"))


def latest_by_dedup_key(s: SparkSession, d: str) -> DataFrame:
    return views.latest(c.delivered(s, d), "dedup_key", position(), "delivery_seq", ["op", "position"])


def materialized_view(s: SparkSession, d: str) -> DataFrame:
    events = c.events(s, d).where("kind = 'row'")
    return views.materialized(events, ["tbl", "user_id"], position(), "slot", ["event_type", "value"]).select("user_id", "event_type", "value")


def tx_batches(s: SparkSession, d: str) -> DataFrame:
    log = c.log(s, d)
    return transactions.complete(log, "tx").join(log.groupBy("tx").agg(F.max("slot").alias("mx")), "tx").select("tx", "row_count", "mx")


def tx_pending(s: SparkSession, d: str) -> DataFrame:
    return transactions.pending(c.log(s, d), "tx").select("tx", F.col("events").alias("n"))


def non_tx_orphans(s: SparkSession, d: str) -> DataFrame:
    return transactions.orphans(c.log(s, d), "tx").select("slot", "kind")


def size_batches(s: SparkSession, d: str) -> DataFrame:
    rows = delivery.size_batches(c.log(s, d).where("kind = 'row'"), "slot", F.floor(F.col("slot") / 100_000), 100)
    return rows.groupBy("batch_no").agg(F.count("*").alias("n"), F.max("binlog_file").alias("f"))


def resume_from(s: SparkSession, d: str) -> DataFrame:
    return c.log(s, d).where(at_or_after(f"{c.FILE}000002", 4 + 128 * 300)).agg(F.count("*").alias("n"))


def _events(s: SparkSession, d: str) -> DataFrame:
    return envelopes(c.raw(s, d), c.full_history(s))


def before_after(s: SparkSession, d: str) -> DataFrame:
    """What an update's two images say of one column: by its name, or by its number where a table's columns are anonymous."""
    maps = _events(s, d).where("change_type = 'UPDATE'").select("table", "binlog_file", "position", as_map(F.col("before_columns")).alias("before"), as_map(F.col("after_columns")).alias("after"))
    cell = lambda image, name, number: F.coalesce(F.element_at(image, name), F.element_at(image, f"col_{number}"))
    return maps.select("table", "binlog_file", "position", cell("after", "user_id", 0).alias("user_id"), F.map_contains_key("after", "col_0").alias("anonymous"), cell("before", "value", 3).alias("before_value"), cell("after", "value", 3).alias("after_value"))


def _line(image: F.Column) -> F.Column:
    return F.array_join(F.transform(image, lambda x: F.concat(x["name"], F.lit("="), F.coalesce(x["value"], F.lit("~")))), "|")


def envelope_rows(s: SparkSession, d: str) -> DataFrame:
    key = F.array_join(F.transform(F.map_entries("primary_key"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("~")))), "|")
    return _events(s, d).where("event_type = 'row'").select("source", "database", "table", "change_type", _line(F.col("before_columns")).alias("before_image"), _line(F.col("after_columns")).alias("after_image"), key.alias("key_text"), "binlog_file", "position", F.col("timestamp").alias("event_ts"), "transaction_id", "idempotency_key", "dedup_key")


def envelope_types(s: SparkSession, d: str) -> DataFrame:
    """The labels of the images' columns: the schema's where widths agree, none where columns are anonymous."""
    cells = _events(s, d).where("event_type = 'row'").select(F.explode(F.concat("before_columns", "after_columns")).alias("x"))
    return cells.groupBy(F.col("x.name").alias("col_name"), F.col("x.data_type").alias("data_type")).agg(F.count("*").alias("n"))


def envelope_marks(s: SparkSession, d: str) -> DataFrame:
    """Begins, commits (with the rows of their transaction) and statements (with the version that they made)."""
    return _events(s, d).where("event_type <> 'row'").select("event_type", "table", "ddl_statement", "schema_version", "row_count", "binlog_file", "position", "transaction_id", "idempotency_key", "dedup_key", F.size("primary_key").alias("key_size"))


def filtered_row_counts(s: SparkSession, d: str) -> DataFrame:
    """Commits count the rows of captured tables only, down to none."""
    kept = TableFilter(exclude_tables=("app.user_state",)).apply(c.raw(s, d))
    return envelopes(kept, c.full_history(s)).where("event_type = 'tx_commit'").groupBy("row_count").agg(F.count("*").alias("n"))


def event_json(s: SparkSession, d: str) -> DataFrame:
    """Events as JSON lines, nulls included, but for their random ids."""
    return to_json(_events(s, d).select("event_type", "change_type", "schema_version", "row_count", "binlog_file", "position", "transaction_id", "dedup_key"))


def images_as_maps(s: SparkSession, d: str) -> DataFrame:
    """Of columns with one name the last counts."""
    twice = F.concat("after_columns", F.array(F.struct(F.lit("event_type").alias("name"), F.lit("again").alias("value"), F.lit(None).cast("string").alias("data_type"))))
    own = _events(s, d).where("change_type = 'INSERT'").select("binlog_file", "position", as_map(twice).alias("m"))
    return own.select("binlog_file", "position", F.size("m").alias("n"), F.element_at("m", "event_type").alias("event_type"), F.element_at("m", "user_id").alias("user_id"))


def snapshot_envelope_rows(s: SparkSession, d: str) -> DataFrame:
    """Snapshot rows by the library's reader and envelopes; a row longer than the columns is cut."""
    own = c.snapshot(s, d)
    tables = [SnapshotTable("app", t, own.where(F.col("tbl") == t).select("user_id", (F.col("user_id") * 2).alias("twice")), ["user_id"]) for t in ("audit", "user_state")]
    snapshot = Snapshot(f"{c.FILE}000001", 4, tables)
    rows = snapshot.rows(s, TableFilter()).withColumn("row", F.concat("row", F.array(F.lit("more"))))
    found = snapshot_envelopes(rows, snapshot.binlog_file, snapshot.position)
    return found.select("event_type", "table", _line(F.col("after_columns")).alias("after_image"), "binlog_file", "position", "transaction_id", "idempotency_key", "dedup_key")


def snapshot_schema(s: SparkSession, d: str) -> DataFrame:
    """The history's entries of the tables that the filter passes, from rows of a database's own description."""
    found = schema_entries(statements.information(s, d), f"{c.FILE}000001", 4, TableFilter(exclude_tables=("app.t3", "app.t5")))
    return found.select("database", "table", "binlog_file", "position", "version", F.array_join("primary_key_columns", ",").alias("key_columns"), F.explode("columns").alias("x")).select("database", "table", "binlog_file", "position", "version", "key_columns", F.col("x.ordinal_position").alias("i"), F.col("x.name").alias("col_name"), F.col("x.data_type").alias("data_type"), F.col("x.is_primary_key").alias("in_key"), F.col("x.is_nullable").alias("nullable"))


def snapshot_page(s: SparkSession, d: str) -> DataFrame:
    return page(c.snapshot(s, d).select("user_id", "tbl"), ["user_id", "tbl"], 3, 20)


def binlog_records(s: SparkSession, d: str) -> DataFrame:
    """Raw binlog events as log records: kinds, operations, a record a row, names of transactions."""
    own = from_binlog_events(c.binlog(s, d))
    return own.select("kind", "operation", "table", "binlog_file", "position", "transaction_id", F.get("before_row", F.lit(0)).alias("before_id"), F.get("after_row", F.lit(0)).alias("after_id"))


def statement_kinds(s: SparkSession, d: str) -> DataFrame:
    """What the queries of a binlog are, and which table they name."""
    return statements.queries(s, d).select("event_id", statement_kind(F.col("query"), F.col("event_id") % 2 == 0).alias("kind"), table_of(F.col("query")).alias("table_name"))


def ddl_filter(s: SparkSession, d: str) -> DataFrame:
    """Statements of captured tables pass, and those whose table isn't known."""
    own = statements.statements(s, d).select("kind", "database", F.when(F.col("table").endswith("0"), F.lit("")).otherwise(F.col("table")).alias("table"))
    kept = TableFilter(include_databases=("app",), exclude_tables=("app.audit", "app.t3", "app.t15")).apply(own.unionByName(c.raw(s, d).select("kind", "database", "table")))
    return kept.groupBy("kind", F.coalesce("table", F.lit("?")).alias("table_name")).agg(F.count("*").alias("n"))


def boundaries_off(s: SparkSession, d: str) -> DataFrame:
    return without_boundaries(c.raw(s, d)).groupBy("kind").agg(F.count("*").alias("n"), F.count("transaction_id").alias("in_transactions"))


def tx_assembly(s: SparkSession, d: str) -> DataFrame:
    """Transactions as ordered batches, cut beyond a cap of four."""
    log = c.log(s, d).withColumn("delivery_seq", F.col("slot"))
    found = transactions.assemble(log, "tx", cap=4)
    kinds = F.array_join(F.transform("events", lambda e: e["kind"]), ",")
    slots = F.array_join(F.transform("events", lambda e: e["slot"].cast("string")), ",")
    return found.select("tx", kinds.alias("kinds"), slots.alias("slots"), "n", "cut", F.col("max_position.binlog_file").alias("max_file"), F.col("max_position.position").alias("max_pos"))


def delivery_batches(s: SparkSession, d: str) -> DataFrame:
    """Whole transactions, parts beyond a cap of four, loose events by fifty, and what is pending."""
    found = delivery.batched(c.raw(s, d), cap=4, size=50)
    return found.groupBy("delivery_batch", "pending").agg(F.count("*").alias("n"), F.min("position").alias("least_position"))


def delivery_summary(s: SparkSession, d: str) -> DataFrame:
    return delivery.summary(delivery.batched(c.raw(s, d), size=50, leads=True))


def delivery_measured(s: SparkSession, d: str) -> DataFrame:
    """``delivery_summary`` as counted by the pass that writes the batches."""
    marked, seen = delivery.measured(delivery.batched(c.raw(s, d), size=50, leads=True))
    marked.write.parquet(shared_folder(s, "measured"))
    got, top = seen.get, seen.get["top"]
    row = (*(got[n] for n in ("batches_delivered", "events_delivered", "events_pending")), top and top["binlog_file"], top and top["position"])
    return s.createDataFrame([row], "batches_delivered long, events_delivered long, events_pending long, last_binlog_file string, last_position long")


def sink_published(s: SparkSession, d: str) -> DataFrame:
    """Events delivered in three batches, one of them once more with other rows, which changes nothing."""
    events = c.events(s, d).select("tx", "kind", "binlog_file", "position", "idempotency_key")
    sink = PublishedSink(shared_folder(s, "published"))
    for batch in (0, 2, 1):
        sink.deliver(events.where(F.col("tx") % 3 == batch), batch)
    sink.deliver(events, 1)
    return sink.events(s, events.schema)


def batch_offsets(s: SparkSession, d: str) -> DataFrame:
    """The greatest (file, position) of each batch of events in delivery order."""
    batches = delivery.size_batches(c.delivered(s, d).where("kind = 'row'"), "delivery_seq", F.floor(F.col("delivery_seq") / 100_000), 70)
    return delivery.batch_offsets(batches).select("batch_no", F.col("max_position.binlog_file").alias("max_file"), F.col("max_position.position").alias("max_pos"))


def mixed_payloads(s: SparkSession, d: str) -> DataFrame:
    """Payloads of batches that hold several transactions (then none is named) or one."""
    rows = c.events(s, d).withColumn("batch", F.when(F.col("tx") % 3 == 0, F.col("tx")).otherwise(F.floor(F.col("tx") / 10) * 10 + 1))
    return delivery.payloads(rows, "batch", tx="tx")


def _wide(s: SparkSession, d: str) -> DataFrame:
    log = c.log(s, d).where("kind = 'row'")
    wide = ((F.col("tbl") == "user_state") & (F.col("binlog_file") >= f"{c.FILE}000002")) | ((F.col("tbl") == "audit") & (F.col("binlog_file") >= f"{c.FILE}000003"))
    return log.withColumn("width", F.when(wide, 4).otherwise(3))


def _decoded(s: SparkSession, d: str) -> DataFrame:
    return asof.schema_at(_wide(s, d), c.history(s), keys=("tbl",))


def schema_asof(s: SparkSession, d: str) -> DataFrame:
    return _decoded(s, d).groupBy("tbl", F.col("h_version").alias("version"), "width").agg(F.count("*").alias("n"))


def schema_asof_ranges(s: SparkSession, d: str) -> DataFrame:
    """``schema_asof`` with nothing broadcast: log and history meet in ranges of the log."""
    found = asof.by_range(_wide(s, d), c.history(s), ("tbl",), ("put_seq",), size=128 * 50)
    return found.groupBy("tbl", F.col("h_version").alias("version"), "width").agg(F.count("*").alias("n"))


def decoded_columns(s: SparkSession, d: str) -> DataFrame:
    cents = F.round(F.col("value") * 100).cast("bigint").cast("string")
    narrow = [F.col("user_id").cast("string"), F.col("event_type")]
    image = F.when(F.col("width") == 4, F.array(*narrow, F.col("props"), cents)).otherwise(F.array(*narrow, cents))
    columns = F.transform(F.split("h_cols", ","), lambda n: F.struct(n.alias("name"), F.lit(None).cast("string").alias("data_type")))
    return _decoded(s, d).select("slot", F.posexplode(named(image, columns)).alias("i", "c")).select("slot", "i", F.col("c.name").alias("col_name"), F.col("c.value").alias("col_value"))


def snapshot_union(s: SparkSession, d: str) -> DataFrame:
    kinds = c.snapshot(s, d).select(F.lit("snapshot").alias("kind")).union(c.log(s, d).select("kind"))
    return kinds.groupBy("kind").agg(F.count("*").alias("n"))


def _snapshot_keys(s: SparkSession, d: str) -> DataFrame:
    own = c.snapshot(s, d)
    tables = [SnapshotTable("app", t, own.where(F.col("tbl") == t).select("user_id"), ["user_id"]) for t in ("audit", "user_state")]
    found = snapshot_envelopes(Snapshot(f"{c.FILE}000001", 4, tables).rows(s), f"{c.FILE}000001", 4)
    return found.select("dedup_key", "idempotency_key", F.col("event_type").alias("kind"), "binlog_file", "position", F.lit(-1).cast("bigint").alias("delivery_seq"))


def snapshot_overlap_latest(s: SparkSession, d: str) -> DataFrame:
    changes = c.events(s, d).where("kind = 'row'").select("dedup_key", "idempotency_key", "kind", "binlog_file", "position", F.col("slot").alias("delivery_seq"))
    return views.latest(_snapshot_keys(s, d).unionByName(changes), "dedup_key", position(), "delivery_seq", ["kind"])


def snapshot_idempotency_overlap(s: SparkSession, d: str) -> DataFrame:
    keys = _snapshot_keys(s, d).select("idempotency_key").union(c.events(s, d).where("kind = 'row'").select("idempotency_key"))
    per_key = keys.groupBy("idempotency_key").agg(F.count("*").alias("n"))
    return per_key.agg(F.sum("n").alias("n"), F.count("*").alias("n_keys"))


def offset_progress(s: SparkSession, d: str) -> DataFrame:
    return committed_so_far(c.delivered(s, d).select("delivery_seq", "slot"), F.col("slot")).select("delivery_seq", F.col("committed").alias("committed_slot"))


def tx_cap(s: SparkSession, d: str) -> DataFrame:
    return transactions.capped(c.log(s, d), "tx", cap=3)


def sink_dedup_anti(s: SparkSession, d: str) -> DataFrame:
    events = c.events(s, d).select("tx", "idempotency_key")
    return views.unseen(events.select("idempotency_key"), events.where("tx % 2 = 0"))


def webhook_payload_meta(s: SparkSession, d: str) -> DataFrame:
    events = c.events(s, d)
    whole = transactions.complete(events, "tx").select("tx")
    return delivery.payloads(events.join(whole, "tx", "left_semi").withColumn("batch", F.col("tx")), "batch", tx="tx").select(F.col("batch").alias("tx"), "event_count", "max_binlog_file", "max_binlog_position", "transaction_id")


def delivery_stats(s: SparkSession, d: str) -> DataFrame:
    return delivery.statistics(c.log(s, d), "tx")


def batch_idempotency_key(s: SparkSession, d: str) -> DataFrame:
    return c.events(s, d).groupBy("tx").agg(batch_key("idempotency_key").alias("batch_key"))


def _versions(s: SparkSession, d: str) -> DataFrame:
    return schema_history(statements.registered(s, d), statements.statements(s, d))


def ddl_history(s: SparkSession, d: str) -> DataFrame:
    """All versions of hundreds of tables, from their registrations and the log's statements."""
    columns = F.array_join(F.transform("columns", lambda x: F.concat_ws(" ", x["name"], x["data_type"])), ", ")
    return _versions(s, d).select("database", "table", "binlog_file", "position", "version", columns.alias("columns"), F.array_join("primary_key_columns", ",").alias("key"))


def ddl_versions(s: SparkSession, d: str) -> DataFrame:
    """The version that an event of each table reports: of one that is dropped or not known, 0."""
    return latest_version(_versions(s, d))


def sink_dedup_index(s: SparkSession, d: str) -> DataFrame:
    """``sink_dedup_anti`` through a sink's key index of four batches, delivered in any order."""
    events = c.events(s, d).select("tx", "idempotency_key")
    index = KeyIndex(s, shared_folder(s, "keys"))
    for batch in (2, 0, 3, 1):
        index.add(events.where((F.col("tx") % 2 == 0) & (F.floor(F.col("tx") / 2) % 4 == batch)), batch)
    return index.unseen(events, 9).select("idempotency_key")


def snapshot_chunks(s: SparkSession, d: str) -> DataFrame:
    """``materialized_view`` from a table that is read in four chunks while its log goes on, and the log from the first mark on; no position holds for all chunks."""
    log = c.events(s, d).where("kind = 'row'").select("kind", "tbl", "user_id", "event_type", "value", "op", "binlog_file", "position", "slot")
    end = log.agg(F.max("slot")).first()[0] or 0
    clock = iter(range(1, 99))
    ends: list[int] = []

    def mark() -> tuple[str, int]:
        """The log has gone on since the last mark."""
        ends.append(end * next(clock) // 10)
        top = log.where(F.col("slot") <= ends[-1]).agg(F.max(F.struct("binlog_file", "position")).alias("at")).first().at
        return ("", 0) if top is None else (top.binlog_file, top.position)

    def read(i: int) -> DataFrame:
        """The table's rows somewhere between two marks."""
        now = log.where((F.col("slot") <= ends[-1] + end // 20) & (F.pmod(F.xxhash64("user_id"), F.lit(4)) == i))
        return views.materialized(now, ["tbl", "user_id"], position(), "slot", ["event_type", "value"])

    chunks = ChunkedSnapshot(s, shared_folder(s, "chunks"), 4, ["tbl", "user_id"])
    chunks.run(read, lambda: log, mark, most=2)
    chunks.run(read, lambda: log, mark)  # resumed
    later = log.where(between(chunks.start(), ("~", 0)))
    both = chunks.rows().withColumns({"op": F.lit("READ"), "slot": F.lit(-1).cast("long")}).unionByName(later.drop("kind"))
    return views.materialized(both, ["tbl", "user_id"], position(), "slot", ["event_type", "value"]).select("user_id", "event_type", "value")


def snapshot_splits(s: SparkSession, d: str) -> DataFrame:
    """A table with a key of two columns, read in ranges of it, in two runs: how many ranges, rows and keys, and whether the ranges are even."""
    items = s.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity")
    split = SplitRead(s, shared_folder(s, "splits"), ["l_orderkey", "l_linenumber"], 16)
    split.run(items, most=6)
    split.run(items)
    per = split.rows().groupBy("_range").agg(F.count("*").alias("n"), F.countDistinct("l_orderkey", "l_linenumber").alias("k"), F.sum("l_quantity").alias("q"))
    return per.agg(F.count("*").alias("n_ranges"), F.sum("n").alias("n_rows"), F.sum("k").alias("n_keys"), F.sum("q").cast("double").alias("quantity"), (F.max("n") <= 1.5 * F.avg("n")).alias("even"))


_NAMES = """op_counts table_filter envelope_keys unique_events duplicates latest_by_dedup_key materialized_view tx_batches tx_pending non_tx_orphans size_batches resume_from
before_after schema_asof decoded_columns snapshot_union snapshot_overlap_latest snapshot_idempotency_overlap offset_progress tx_cap sink_dedup_anti webhook_payload_meta delivery_stats
batch_idempotency_key ddl_history envelope_rows envelope_types envelope_marks filtered_row_counts event_json images_as_maps snapshot_envelope_rows snapshot_schema snapshot_page
binlog_records statement_kinds ddl_filter boundaries_off tx_assembly delivery_batches delivery_summary batch_offsets mixed_payloads ddl_versions schema_asof_ranges sink_dedup_index snapshot_chunks snapshot_splits delivery_measured sink_published""".split()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: globals()[n] for n in _NAMES} | streams.QUERIES
