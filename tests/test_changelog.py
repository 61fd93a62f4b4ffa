"""The change log engine: its queries against DuckDB, and the scenarios of a log by hand."""

import json

import duckdb
import pytest
from changeloom.config import Settings
from changeloom.functions.ddl import statement_kind, table_of
from changeloom.functions.positions import committed_so_far
from changeloom.operators import delivery, transactions, views
from changeloom.operators.asof import schema_at
from changeloom.operators.filters import TableFilter
from changeloom.operators.history import schema_history
from changeloom.pipeline import Pipeline
from changeloom.plans import catalog, oracle
from changeloom.schemas import RAW_LOG, SCHEMA_HISTORY, spark_type
from changeloom.sinks import JsonLinesSink, MemorySink, WebhookSink, create
from changeloom.sinks.webhook import PermanentError
from changeloom.sources.landed import from_binlog_events
from logscript import LogScript, scripted_source
from changeloom.sources.snapshot import Snapshot, SnapshotTable, information, page, tables_of
from changeloom.sources.stores import OffsetStore
from changeloom.streaming.assemble import assembled, unique
from changeloom.streaming.run import Progress, deliver, start
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
FILE = "mysql-bin-changelog.000001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for table in ("events", "lineitem"):
        c.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    own = catalog.QUERIES[name](spark, SF)
    other = duck.sql(oracle.oracle_sql()[name])
    assert sorted(own.columns) == sorted(other.columns)
    order = [own.columns.index(c) for c in other.columns]
    assert sorted((tuple(r[i] for i in order) for r in own.collect()), key=str) == sorted(other.fetchall(), key=str)


def users(spark):
    return SnapshotTable("app", "users", spark.createDataFrame([(1, "Alice", 30)], "id int, name string, age int"), ["id"])


def pipeline(spark, tmp_path, **settings):
    out = Pipeline(spark, Settings(offset_path=str(tmp_path / "offsets.json"), schema_path=str(tmp_path / "history.json"), staging_path=str(tmp_path / "staged"), **settings), MemorySink())
    return out


def rows(p, *columns):
    return [tuple(r) for r in p.sink.events().orderBy("binlog_file", "position").select(*columns).collect()]


def test_snapshot_then_log_then_restart(spark, tmp_path):
    script = LogScript()
    snapshot = Snapshot(FILE, 4, [users(spark)])
    script.begin().update("app", "users", [1, "Alice", 30], [1, "Alice Smith", 31]).insert("app", "users", [2, "Bob", 25]).commit()
    script.begin().ddl("app", "users", "ALTER TABLE users ADD COLUMN email VARCHAR(255) AFTER name").commit()
    script.begin().insert("app", "users", [3, "Cy", "cy@x.org", 40]).delete("app", "users", [2, "Bob", None, 25]).commit()
    p = pipeline(spark, tmp_path)
    assert p.run(script.frame(spark), snapshot) == 12
    assert [r[0] for r in rows(p, "event_type")] == ["snapshot", "tx_begin", "row", "row", "tx_commit", "tx_begin", "schema", "tx_commit", "tx_begin", "row", "row", "tx_commit"]
    last = p.sink.events().where("change_type = 'INSERT'").orderBy("position").select(F.transform("after_columns", lambda c: c["name"])).collect()[-1][0]
    assert last == ["id", "name", "email", "age"]
    assert p.sink.events().where("event_type = 'tx_commit'").agg(F.sum("row_count")).first()[0] == 4
    assert p.sink.events().where("event_type = 'schema'").first().schema_version == 2
    view = views.materialized(p.sink.events().where("dedup_key is not null").withColumn("op", F.coalesce("change_type", F.lit("READ"))).withColumn("seq", F.col("position")), "dedup_key", F.struct("binlog_file", "position"), "seq", ["primary_key"])
    assert sorted(r.primary_key["id"] for r in view.collect()) == ["1", "3"]
    assert p.offsets.committed == (FILE, script.at)
    # a restart delivers what is new, and the record at the committed position again
    done = script.at
    script.begin().insert("app", "users", [4, "Di", "d@x.org", 20]).commit()
    again = pipeline(spark, tmp_path)
    again.run(script.frame(spark), snapshot)
    assert rows(again, "event_type", "position") == [("tx_commit", done), ("tx_begin", done + 128), ("row", done + 256), ("tx_commit", done + 384)]
    assert again.sink.events().where("event_type = 'row'").first().primary_key == {"id": "4"}


def test_images_and_keys(spark, tmp_path):
    script = LogScript().begin().insert("app", "users", [1, "A", 3]).update("app", "users", [1, "A", 3], [1, "B", 4]).delete("app", "users", [1, "B", 4]).commit()
    p = pipeline(spark, tmp_path, snapshot_enabled=False)
    p.run(script.frame(spark), Snapshot(FILE, 4, [users(spark)]))
    found = p.sink.events().where("event_type = 'row'").orderBy("position").collect()
    assert [(len(r.before_columns), len(r.after_columns)) for r in found] == [(0, 3), (3, 3), (3, 0)]
    assert {r.dedup_key for r in found} == {"mysql:app:users:id=1"}
    assert found[0].idempotency_key == f"mysql:{FILE}:260:row:id=1"


def test_table_filter_and_boundaries(spark, tmp_path):
    script = LogScript().begin().insert("app", "users", [1, "A", 3]).insert("app", "other", [1]).insert("x", "users", [1]).ddl("app", None, "CREATE DATABASE q").commit()
    p = pipeline(spark, tmp_path, snapshot_enabled=False, include_databases=["app"], exclude_tables=["app.other"])
    p.run(script.frame(spark))
    assert rows(p, "event_type", "database") == [("tx_begin", None), ("row", "app"), ("schema", "app"), ("tx_commit", None)]
    names = p.sink.events().where("event_type = 'row'").first()
    assert [c.name for c in names.after_columns] == ["col_0", "col_1", "col_2"] and names.dedup_key is None
    bare = pipeline(spark, tmp_path / "b", snapshot_enabled=False, transaction_boundaries=False)
    bare.run(script.frame(spark))
    assert {r[0] for r in rows(bare, "event_type")} == {"row", "schema"}


def test_unknown_operation_is_an_error(spark, tmp_path):
    log = LogScript().insert("app", "users", [1]).frame(spark).withColumn("operation", F.lit("MERGE"))
    with pytest.raises(Exception, match="unknown operation"):
        pipeline(spark, tmp_path, snapshot_enabled=False).run(log)


STATEMENTS = [
    ("ALTER TABLE t ADD COLUMN c INT AFTER a", "a c b", "a", 2),
    ("ALTER TABLE t ADD c INT FIRST", "c a b", "a", 2),
    ("ALTER TABLE t ADD x INT, ADD y INT AFTER a", "a y x b", "a", 2),
    ("ALTER TABLE t DROP COLUMN a", "b", "", 2),
    ("ALTER TABLE t CHANGE a z BIGINT", "z b", "z", 2),
    ("ALTER TABLE t MODIFY COLUMN b TEXT FIRST", "a b", "a", 2),
    ("ALTER TABLE t ADD COLUMN a INT", "a b", "a", 2),
    ("ALTER TABLE t ADD COLUMN first VARCHAR(5)", "first a b", "a", 2),
    ("ALTER TABLE t ADD COLUMN c INT COMMENT 'a remark that goes on for more than fifty characters' FIRST", "a b c", "a", 2),
    ("ALTER TABLE t ADD INDEX i (a)", "a b INDEX", "a", 2),
    ("ALTER TABLE t DROP COLUMN IF EXISTS b", "a b", "a", 2),
    ("RENAME TABLE t TO u", "a b", "a", 2),
    ("RENAME TABLE", "a b", "a", 1),
    ("TRUNCATE t", "a b", "a", 2),
    ("ROLLBACK", "a b", "a", 2),
]


def folded(spark, scripts):
    """The last version of each table (name: registered columns or None, statements), by the fold."""
    registered = [("app", t, FILE, 4, 0, [(n, k, i == 0, i > 0, None, None, None, None, i) for i, (n, k) in enumerate(columns)], [columns[0][0]], 1, 0.0, None) for t, (columns, _) in scripts.items() if columns]
    log = [("schema", "app", t, None, None, None, ddl, FILE, 100 + k, None, 0.0, None) for t, (_, ddls) in scripts.items() for k, ddl in enumerate(ddls)]
    found = schema_history(spark.createDataFrame(registered, SCHEMA_HISTORY), spark.createDataFrame(log, RAW_LOG)).collect()
    last = {t: max((r for r in found if r.table == t), key=lambda r: (r.position, r.put_seq)) for t in scripts}
    return {t: None if r.columns is None else (" ".join(c.name for c in r.columns), " ".join(r.primary_key_columns), r.version) for t, r in last.items()}, found


def test_statements(spark):
    found, _ = folded(spark, {f"t{i}": ([("a", "INT"), ("b", "INT")], [case[0]]) for i, case in enumerate(STATEMENTS)})
    assert found == {f"t{i}": case[1:] for i, case in enumerate(STATEMENTS)}


def test_statements_of_unknown_tables(spark):
    scripts = {"new": (None, ["CREATE TABLE t (a INT)"]), "never": (None, ["ALTER TABLE t ADD a INT"]), "gone": ([("a", "INT")], ["drop table if exists t"]), "again": ([("a", "INT")], ["DROP TABLE t", "CREATE TABLE t (b INT)", "ALTER TABLE t ADD c INT"])}
    found, rows = folded(spark, scripts)
    assert found == {"new": ("", "", 1), "never": None, "gone": None, "again": ("c", "", 2)}
    assert len(rows) == 2 + 6  # a version for each entry, unknown ones too
    types = {c.name: (c.data_type, c.is_nullable, c.ordinal_position) for r in rows if r.table == "again" and r.columns for c in r.columns}
    assert types == {"a": ("INT", False, 0), "c": ("INT", True, 0)}


def test_the_fold_has_no_python(spark):
    from changeloom.plans import catalog

    plan = catalog.ddl_history(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_statement_kinds_and_tables(spark):
    rows = [("BEGIN", True), (" commit", True), ("COMMIT", False), ("ROLLBACK", True), ("ALTER TABLE `db`.`t` ADD a INT", False), ("truncate table db.u", False), ("SET x = 1", False)]
    found = spark.createDataFrame(rows, "q string, o boolean").select(statement_kind(F.col("q"), F.col("o")), table_of(F.col("q"))).collect()
    assert [tuple(r) for r in found] == [("tx_begin", None), ("tx_commit", None), (None, None), ("schema", None), ("schema", "t"), ("schema", "u"), ("schema", None)]


def test_schema_as_of(spark):
    history = spark.createDataFrame([("t", FILE, 100, 0, "a"), ("t", FILE, 500, 1, "b"), ("t", FILE, 500, 2, "c")], "table string, binlog_file string, position bigint, put_seq bigint, cols string")
    log = spark.createDataFrame([("t", FILE, 4), ("t", FILE, 499), ("t", FILE, 500), ("t", "z", 1), ("u", FILE, 9), ("t", None, None)], "table string, binlog_file string, position bigint")
    got = {(r.table, r.binlog_file, r.position): r.h_cols for r in schema_at(log, history, keys=("table",)).collect()}
    assert got == {("t", FILE, 4): "a", ("t", FILE, 499): "a", ("t", FILE, 500): "c", ("t", "z", 1): "c", ("u", FILE, 9): None, ("t", None, None): "c"}


def test_assembly_cap_and_repeated_begin(spark):
    script = LogScript().begin()
    for k in range(5):
        script.insert("app", "t", [k])
    script.commit().begin().insert("app", "t", [9]).commit()
    log = script.frame(spark).withColumn("delivery_seq", F.col("position"))
    got = {r.n: r.cut for r in transactions.assemble(log, cap=3).collect()}
    assert got == {4: True, 3: False}


def test_running_offset_by_ranges(spark):
    rows = [(k, (k * 7919) % 101) for k in range(300)]
    got = committed_so_far(spark.createDataFrame(rows, "delivery_seq long, v long"), F.col("v"), bucket_rows=17).orderBy("delivery_seq").collect()
    top, want = 0, []
    for _, v in rows:
        top = max(top, v)
        want.append(top)
    assert [r.committed for r in got] == want


def test_binlog_events(spark):
    schema = "event string, database string, table string, query string, rows array<struct<before:array<string>,after:array<string>>>, binlog_file string, position bigint, ts double"
    events = [
        ("QueryEvent", "app", None, "BEGIN", None, FILE, 10, 0.0),
        ("WriteRowsEvent", "app", "t", None, [(None, ["1"]), (None, ["2"])], FILE, 20, 0.0),
        ("XidEvent", None, None, None, None, FILE, 30, 0.0),
        ("QueryEvent", "app", None, "COMMIT", None, FILE, 40, 0.0),
        ("QueryEvent", "app", None, "ALTER TABLE t ADD c INT", None, FILE, 50, 0.0),
        ("DeleteRowsEvent", "app", "t", None, [(["1"], None)], FILE, 60, 0.0),
    ]
    got = [(r.kind, r.operation, r.table, r.transaction_id) for r in from_binlog_events(spark.createDataFrame(events, schema)).orderBy("position").collect()]
    tx = f"tx-{FILE}-10"
    assert got == [("tx_begin", None, None, tx), ("row", "INSERT", "t", tx), ("row", "INSERT", "t", tx), ("tx_commit", None, None, tx), ("schema", None, "t", None), ("row", "DELETE", "t", None)]


def test_offsets_only_rise(tmp_path):
    s = OffsetStore(str(tmp_path / "o.json"), flush_ms=0)
    assert s.ack("b", 5) and not s.ack("a", 9) and not s.ack("b", 5) and s.ack("b", 6)
    s.begin_snapshot()
    assert not s.ack("c", 1)
    s.end_snapshot("c", 2)
    assert OffsetStore(str(tmp_path / "o.json")).committed == ("c", 2)
    (tmp_path / "o.json").write_text("{")
    assert OffsetStore(str(tmp_path / "o.json")).committed is None


def test_json_lines_replace_their_batch(spark, tmp_path):
    sink = JsonLinesSink(str(tmp_path / "out"), dedupe_index_path=str(tmp_path / "idx"))
    events = spark.createDataFrame([(FILE, k, f"k{k}") for k in range(5)], "binlog_file string, position bigint, idempotency_key string")
    sink.deliver(events, 0)
    sink.deliver(events, 0)
    sink.deliver(events.union(spark.createDataFrame([(FILE, 9, "k9")], events.schema)), 1)
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sorted(x["idempotency_key"] for x in lines) == ["k0", "k1", "k2", "k3", "k4", "k9"]


def test_webhook_attempts(spark):
    sink, seen = WebhookSink("http://x", max_retries=3), []
    answers = iter([500, 503, 200])
    assert sink.send(b"{}", "key", lambda u, b, h, t: (seen.append(h), next(answers))[1], lambda s: seen.append(s)) == 3
    assert [x for x in seen if isinstance(x, float)] == [0.5, 1.0] and seen[-1]["X-CDC-Retry-Attempt"] == "2"
    with pytest.raises(PermanentError):
        sink.send(b"{}", "key", lambda *_: 404, lambda s: None)
    script = LogScript().begin().insert("app", "t", [1]).commit().frame(spark).withColumn("idempotency_key", F.concat_ws(":", "kind", "position"))
    r = sink.batches(script).first()
    assert (r.event_count, r.max_binlog_position, len(r.events)) == (3, 388, 3)
    named = sink.batches(script.withColumn("delivery_batch", F.lit("b"))).first()
    assert (named.batch_id, named.event_count) == ("b", 3)


def test_webhook_posts_are_bounded(spark, monkeypatch):
    from changeloom.sinks import webhook

    monkeypatch.setattr(webhook, "CAP", 3)
    script = LogScript().begin()
    for k in range(9):
        script.insert("app", "t", [k])
    log = script.commit().frame(spark).withColumn("idempotency_key", F.concat_ws(":", "kind", "position"))
    posts = {r.batch_id.rpartition("-part-")[2]: len(r.events) for r in WebhookSink("http://x").batches(log).collect()}
    assert sorted(posts.values()) == [3, 4, 4]


def test_batches_parts_and_what_is_pending(spark, tmp_path):
    script = LogScript().insert("app", "t", [0]).begin().insert("app", "t", [1]).insert("app", "t", [2]).commit()
    for k in range(4):
        script.insert("app", "t", [k])
    done = script.at
    script.begin().insert("app", "t", [9])
    log = script.frame(spark)
    got = {r.delivery_batch: (r.pending, r.n) for r in delivery.batched(log, size=2).groupBy("delivery_batch", "pending").agg(F.count("*").alias("n")).collect()}
    assert sorted(got.values(), key=str) == sorted([(False, 2), (False, 2), (False, 1), (False, 4), (True, 2)], key=str) and got[None] == (True, 2)
    cut = delivery.batched(log, cap=2, size=100).groupBy("delivery_batch").agg(F.count("*").alias("n")).collect()
    assert sorted((str(r.delivery_batch)[:5], r.n) for r in cut) == [("None", 2), ("loose", 6), ("tx-tx", 3)]
    # an open transaction isn't delivered, and the next run begins with it
    p = pipeline(spark, tmp_path, snapshot_enabled=False, batch_size=2)
    assert p.run(log) == 9 and p.offsets.committed == (FILE, done)
    script.commit()
    again = pipeline(spark, tmp_path, snapshot_enabled=False, batch_size=2)
    again.run(script.frame(spark))
    assert [r[0] for r in rows(again, "event_type")] == ["row", "tx_begin", "row", "tx_commit"]
    assert again.sink.events().where("transaction_id is not null").select("delivery_batch").distinct().count() == 1


def test_snapshot_chunks(spark, tmp_path):
    p = pipeline(spark, tmp_path, snapshot_chunk_size=10)
    table = SnapshotTable("app", "many", spark.range(95).select("id"), ["id"])
    assert p.run(LogScript().frame(spark), Snapshot(FILE, 4, [table])) == 95
    assert 5 <= p.sink.events().select("delivery_batch").distinct().count() <= 10


def test_information_of_a_database():
    from collections import namedtuple

    C = namedtuple("C", "t c d k o")
    assert "= 'o''b' " in information("o'b") + " " or "'o''b'" in information("o'b")
    columns = [C("u", "b", "varchar(9)", "", 2), C("u", "a", "int unsigned", "PRI", 1), C("v", "x", "int", "", 1)]
    found = tables_of(columns, "app", TableFilter(exclude_tables=("app.v",)))
    assert {t: [(r.c, r.d) for r in own] for t, own in found.items()} == {"u": [("a", "int unsigned"), ("b", "varchar(9)")]}
    assert set(tables_of(columns, "app", names=["v"])) == {"v"} and not tables_of(columns, "app", TableFilter(include_databases=("x",)))


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    from changeloom import cli

    monkeypatch.chdir(tmp_path)
    assert cli.main([]) == 2
    (tmp_path / "c.yaml").write_text("source: mysql\n")
    assert cli.main(["--config", "c.yaml"]) == 2 and "log_path" in capsys.readouterr().err
    assert cli.settings_of(cli.arguments(["--demo", "--sink", "jsonl", "--sink-path", "x"])).sink == {"type": "jsonl", "path": "x"}
    assert cli.main(["--demo", "--sink", "stdout"]) == 0
    events = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert [e["event_type"] for e in events].count("snapshot") == 2 and len(events) == 8  # the last transaction is open
    wall = next(e for e in events if e["change_type"] == "INSERT")
    assert [c["name"] for c in wall["after_columns"]] == ["shade", "bed", "plants", "square_meters"]
    # a landed log, as files
    script = LogScript().begin().insert("app", "t", [1]).commit()
    script.files(str(tmp_path / "log"), 2)
    (tmp_path / "d.yaml").write_text(f"source: files\nlog_path: {tmp_path}/log\nsink: {{type: jsonl, path: {tmp_path}/out}}\noffset_storage: {{path: {tmp_path}/o.json}}\nschema_storage: {{path: {tmp_path}/h.json}}\n")
    assert cli.main(["--config", "d.yaml"]) == 0 and spark.read.text(str(tmp_path / "out")).count() == 3


def test_row_counts_meet_commits_only(spark):
    """Loose rows and rows of transactions are not shuffled for the counts: only commits are joined."""
    from changeloom.operators.envelope import envelopes
    from changeloom.schemas import SCHEMA_HISTORY

    log = LogScript().begin().insert("app", "t", [1]).commit().commit().frame(spark).union(LogScript().insert("app", "t", [5]).frame(spark))
    got = envelopes(log, spark.createDataFrame([], SCHEMA_HISTORY)).where("event_type = 'tx_commit'").orderBy("position").collect()
    assert [r.row_count for r in got] == [1, 0]


def test_sink_factory_and_retries():
    assert isinstance(create({"type": "MEMORY"}), MemorySink)
    with pytest.raises(ValueError):
        create({"type": "kafka"})

    class Flaky(MemorySink):
        n = 0

        def deliver(self, events, batch_id):
            self.n += 1
            if self.n < 3:
                raise OSError("away")

    pauses = []
    assert deliver(Flaky(), None, 0, sleep=pauses.append) == 2 and pauses == [1.0, 2.0]


def test_types_and_pages(spark):
    assert [spark_type(x).simpleString() for x in ("INT", "bigint UNSIGNED", "DECIMAL(10, 2)", "VARCHAR(9)", None, "geometry")] == ["int", "decimal(20,0)", "decimal(10,2)", "string", "string", "string"]
    frame = spark.range(10)
    assert [r.id for r in page(frame, ["id"], 2, 4).collect()] == [8, 9]
    with pytest.raises(ValueError):
        page(frame, [], 0)


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("source: files\ninclude_databases: [app]\ndelivery: {batch_size: 64}\nsink: {type: jsonl, path: x}\nsnapshot: {enabled: false}\n")
    s = Settings.from_yaml(str(tmp_path / "c.yaml"))
    assert (s.batch_size, s.sink["path"], s.snapshot_enabled, s.tables) == (64, "x", False, TableFilter(include_databases=("app",)))


def test_stream_assembles_across_batches_and_restarts(spark, tmp_path):
    script = LogScript()
    for k in range(4):
        script.begin().insert("app", "t", [k, "a"]).insert("app", "t", [k, "b"]).commit()
    script.insert("app", "t", [77])
    told = []
    listener = Progress(told.append)
    spark.streams.addListener(listener)
    spark.dataSource.register(scripted_source(script, "scripted_for_test", 6))
    stream = spark.readStream.format("scripted_for_test").load()
    got = []

    class Sink(MemorySink):
        def deliver(self, events, batch_id):
            got.extend((r.kind, r.n_events, r.row_count) for r in events.collect())

    batches = assembled(stream).withColumnsRenamed({"max_file": "binlog_file", "max_position": "position"})
    offsets = OffsetStore(str(tmp_path / "o.json"), flush_ms=0)
    q = start(batches, Sink(), str(tmp_path / "cp"), offsets, flush_interval_ms=200)
    try:
        for _ in range(120):
            if len(got) >= 5 or not q.isActive:
                break
            q.awaitTermination(0.5)
    finally:
        q.stop()
    spark.streams.removeListener(listener)
    assert sorted(got) == [("loose", 1, 1)] + [("transaction", 4, 2)] * 4 and offsets.committed == (FILE, script.at)
    assert sum(t["rows"] for t in told) > 0 and {t["batch"] for t in told} >= {0}


def test_stream_unique_from_files(spark, tmp_path):
    from changeloom.sources.landed import stream_log

    script = LogScript().begin().insert("app", "t", [1]).commit()
    script.records += script.records
    script.files(str(tmp_path / "log"), 2)
    stream = stream_log(spark, str(tmp_path / "log"), files_per_trigger=1).withColumn("key", F.concat_ws(":", "kind", "position"))
    sink = MemorySink()
    start(unique(stream, "key"), sink, str(tmp_path / "cp"), flush_interval_ms=None).awaitTermination(120)
    start(unique(stream, "key"), sink, str(tmp_path / "cp"), flush_interval_ms=None).awaitTermination(120)
    assert sorted(r.kind for r in sink.events().collect()) == ["row", "tx_begin", "tx_commit"]
