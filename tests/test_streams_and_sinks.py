"""Streams, the keyed table, the key index, the table sink, chunks, splits, the as-of join: restarts, timers, hot keys, failures half-way."""

import json
import os
import pickle
import random

import pytest
from changeloom.operators import asof, delivery, transactions, views
from changeloom.sinks import JsonLinesSink, KeyIndex, PublishedSink, TableSink, create
from changeloom.sinks.keys import made, may_hold
from changeloom.sinks.published import PublishedFiles, _Files
from changeloom.sources.chunks import ChunkedSnapshot
from changeloom.sources.ledger import Ledger
from changeloom.sources.logstream import LogReader, stream_positions
from changeloom.sources.logstream import land as land_files
from changeloom.sources.shared import register, shared_folder
from changeloom.sources.snapshot import schema_entries
from changeloom.sources.splits import SplitRead, bounds, predicates
from changeloom.streaming.assemble import _Assembler
from changeloom.streaming.loose import loose_batches
from changeloom.streaming.table import KeyedTable
from pyspark.sql import Row
from pyspark.sql import functions as F

LOG = "lane long, seq long, ts timestamp"


def land(spark, rows, path, schema=LOG):
    spark.createDataFrame(rows, schema).withColumn("ts", F.col("ts").cast("timestamp")).write.mode("append").parquet(path)


def minute(m):
    import datetime

    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)


def plain_batches(rows, size, age):
    """Batches of a lane in order, one event after another; and what waits at the end."""
    out, now = [], []
    for seq, m in rows:
        if now and m - now[0][1] >= age:
            out.append(([s for s, _ in now], "age"))
            now = []
        now.append((seq, m))
        if len(now) == size:
            out.append(([s for s, _ in now], "size"))
            now = []
    return out, now


def test_loose_batches_across_restarts(spark, tmp_path):
    rng, log, at = random.Random(7), {0: [], 1: [], 2: []}, 0
    for seq in range(90):
        at += rng.choice([1, 1, 2, 30])
        log[rng.randrange(3)].append((seq, at))
    everything = sorted((s, m, lane) for lane, own in log.items() for s, m in own)
    got = []
    for part in (everything[:25], everything[25:26], everything[26:70], everything[70:]):  # a run each, cut amid batches
        land(spark, [(lane, s, minute(m)) for s, m, lane in part], f"{tmp_path}/log")
        stream = loose_batches(spark.readStream.schema(LOG).parquet(f"{tmp_path}/log"), "lane", "seq", "ts", size=4, age_ms=20 * 60_000)
        stream.writeStream.foreachBatch(lambda rows, _: got.extend(rows.collect())).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    for lane, own in log.items():
        want, left = plain_batches(own, 4, 20)
        if left and left[0][1] + 20 <= at:  # a timer flushes it, not an event
            want.append(([s for s, _ in left], "age"))
        mine = sorted((r for r in got if r.lane == lane), key=lambda r: r.batch_no)
        assert [([json.loads(e)["seq"] for e in r.events], r.reason) for r in mine] == want and [r.batch_no for r in mine] == list(range(len(want)))


def test_loose_batches_by_processing_time(spark, tmp_path):
    land(spark, [(0, s, minute(0)) for s in range(7)], f"{tmp_path}/log")
    got = []
    stream = loose_batches(spark.readStream.schema(LOG).parquet(f"{tmp_path}/log"), "lane", "seq", size=5, age_ms=1000)
    q = stream.writeStream.foreachBatch(lambda rows, _: got.extend(rows.collect())).option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="200 milliseconds").start()
    try:
        for _ in range(120):
            if len(got) == 2 or not q.isActive:
                break
            q.awaitTermination(0.5)
    finally:
        q.stop()
    assert sorted((r.n_events, r.reason) for r in got) == [(2, "age"), (5, "size")]


def files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_keyed_table(spark, tmp_path):
    rng, path = random.Random(3), f"{tmp_path}/table"
    schema = "k long, v long, op string, at long"
    rows = [(rng.choice([1, 1, rng.randrange(60)]), i, rng.choice(["INSERT", "UPDATE", "UPDATE", "DELETE"]), i) for i in range(800)]
    table = KeyedTable(spark, f"file://{path}", spark.createDataFrame([], schema).schema, ["k"], ["at"], buckets=8)
    assert table.read().collect() == []
    for b in range(8):
        before = files(path)
        touched = table.upsert(spark.createDataFrame(rows[100 * b : 100 * b + 100], schema), b)
        after = files(path)
        assert {f: t for f, t in after.items() if f in before} == before  # nothing that was there is written again
        assert {int(f.rpartition("_bucket=")[2].partition("/")[0]) for f in after if f not in before} == set(touched)
        so_far = spark.createDataFrame(rows[: 100 * b + 100], schema)
        want = views.materialized(so_far, "k", F.col("at"), "at", ["v", "op"])
        assert sorted(map(tuple, table.read().select("k", "v", "op").collect())) == sorted(map(tuple, want.select("k", "v", "op").collect()))
        if b == 4:
            names = table.manifest()["files"]
            assert set(table.compact(3)) == {int(x) for x, folders in names.items() if len(folders) > 3}
            assert max(map(len, table.manifest()["files"].values())) <= 3
    # delivered again, it changes nothing; a writer that dies before it publishes leaves nothing to see
    assert table.upsert(spark.createDataFrame([(1, -1, "UPDATE", 10**6)], schema), 7) == []
    seen = sorted(map(tuple, table.read().collect()))
    table._publish, publish = (lambda m: (_ for _ in ()).throw(RuntimeError("died"))), table._publish
    with pytest.raises(RuntimeError, match="died"):
        table.upsert(spark.createDataFrame([(1, -1, "UPDATE", 10**6)], schema), 8)
    assert sorted(map(tuple, table.read().collect())) == seen
    table._publish = publish
    table.upsert(spark.createDataFrame([(1, -2, "UPDATE", 10**6)], schema), 8)
    assert table.read().where("k = 1").first().v == -2
    # one bucket's batch writes one bucket; another writer's manifest isn't overwritten
    assert len(table.upsert(spark.createDataFrame([(5, 0, "INSERT", 10**7)] * 50, schema), 9)) == 1
    with pytest.raises(RuntimeError, match="another writer"):
        table._publish({**table.manifest(), "version": table.manifest()["version"] - 1})


def test_filters_hold_their_keys():
    import numpy as np

    keys = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 5000)
    f = made(keys[:1000])
    assert all(may_hold(f, keys[i : i + 1]) for i in range(1000))
    assert sum(may_hold(f, keys[i : i + 1]) for i in range(1000, 5000)) < 60


def test_key_index_reads_few_files_in_any_order(spark, tmp_path):
    frame = lambda ks: spark.createDataFrame([("f", k, f"key-{k}") for k in ks], "binlog_file string, position bigint, idempotency_key string")
    sink = JsonLinesSink(f"{tmp_path}/out", dedupe_index_path=f"{tmp_path}/idx")
    batches = [range(300, 400), range(100, 200), [350, 150, 7, 7], range(0, 6), [3, 399, 500]]  # not in the order of positions
    for b, ks in enumerate(batches):
        sink.deliver(frame(ks), b)
    assert sink.index.read < sink.index.files / 2
    lines = [json.loads(r.value)["position"] for r in spark.read.text(f"{tmp_path}/out").collect()]
    assert sorted(lines) == sorted([*range(300, 400), *range(100, 200), 7, 7, *range(0, 6), 500])  # repeats inside a batch are both written
    sink.deliver(frame(batches[0]), 0)
    assert spark.read.text(f"{tmp_path}/out/batch=0").count() == 100
    nulls = spark.createDataFrame([("f", 1, None), ("f", 2, None), ("f", 3, "key-3")], frame([1]).schema)
    assert KeyIndex(spark, f"{tmp_path}/idx").unseen(nulls, 9).count() == 2


def test_table_sink(spark, tmp_path):
    sink = TableSink(f"{tmp_path}/t")
    rows = [("k1", "a", 1), ("k2", "a", 5), ("k2", "a", 5), ("k3", "b", 2)]
    schema = "idempotency_key string, dedup_key string, position bigint"
    for _ in range(2):  # delivered again, it replaces itself
        sink.deliver(spark.createDataFrame(rows, schema), 0)
    sink.deliver(spark.createDataFrame([("k1", "a", 1)], schema), 1)
    assert sink.events().count() == 5 and sink.unique_events().count() == 3 and sink.duplicates().count() == 2
    assert sorted((r.dedup_key, r.position) for r in sink.latest(["position"], F.col("position")).collect()) == [("a", 5), ("b", 2)]
    assert TableSink(f"{tmp_path}/t").events(spark).count() == 5


def test_hot_transaction_is_cut_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(transactions, "RANGE", 64)
    rows = [("tx_begin", "h", 0)] + [("row", "h", i) for i in range(1, 3000)] + [("tx_commit", "h", 3000)]
    rows += [("tx_begin", "s", 5000), ("row", "s", 5001), ("tx_commit", "s", 5002), ("row", "o", 6000), ("tx_begin", "p", 7000), ("row", "p", 7001)]
    log = spark.createDataFrame([(k, t, "f", p, p) for k, t, p in rows], "kind string, transaction_id string, binlog_file string, position bigint, delivery_seq bigint")
    kept = transactions._far(log, "transaction_id", 11).where("not _far")
    assert 11 <= kept.where("transaction_id = 'h'").count() <= 11 + 64 and kept.where("transaction_id <> 'h'").count() == 6
    found = {r.transaction_id: ([e.position for e in r.events], r.cut) for r in transactions.assemble(log, cap=10).collect()}
    assert found == {"h": (list(range(11)), True), "s": ([5000, 5001, 5002], False)}
    assert [tuple(r) for r in transactions.capped(log, cap=10).collect()] == [("h", 11, 2990)]


def test_batches_of_a_hot_transaction(spark, monkeypatch):
    """What is numbered of a transaction is its first events and a range of the log; the rest is loose, in order."""
    monkeypatch.setattr(transactions, "RANGE", 64)
    rows = [("row", "h", 0), ("tx_begin", "h", 1)] + [("row", "h", i) for i in range(2, 2000)] + [("tx_commit", "h", 2000)]
    rows += [("tx_begin", "s", 5000), ("row", "s", 5001), ("tx_commit", "s", 5002), ("row", "o", 6000), ("row", None, 6001), ("tx_begin", "p", 7000), ("row", "p", 7001)]
    log = spark.createDataFrame([(k, t, "f", p) for k, t, p in rows], "kind string, transaction_id string, binlog_file string, position bigint")
    for part in (log, log.repartition(7)):
        found = {}
        marked, seen = delivery.measured(delivery.batched(part, cap=10, size=100, leads=True))
        for r in marked.collect():
            found.setdefault((r.delivery_batch, r.pending), []).append(r.position)
        found = {k: sorted(v) for k, v in found.items()}
        loose = [*range(12, 2001), 6000, 6001]
        want = {("tx-h", False): list(range(1, 12)), ("tx-s", False): [5000, 5001, 5002], (None, True): [7000, 7001]}
        want |= {(f"loose-{i}", False): loose[100 * i : 100 * i + 100] for i in range(20)}
        assert found == want  # what comes before the begin isn't delivered
        got = seen.get
        assert (got["batches_delivered"], got["events_delivered"], got["events_pending"]) == (22, 11 + 3 + len(loose), 2)
        assert tuple(got["top"]) == ("f", 6001) and tuple(got["open"]) == ("f", 7000)
    nothing, seen = delivery.measured(delivery.batched(log.where("false"), leads=True))
    assert nothing.collect() == [] and seen.get["events_delivered"] == 0 and seen.get["top"] is None


def test_a_summary_counts_leads(spark):
    """Batches aren't told apart by name again if each has a row that leads."""
    found = delivery.summary(Leads())
    assert "leads" in str(found[0]) and not any("delivery_batch" in str(c) for c in found)


class Leads:
    columns = ["leads"]

    def agg(self, *columns):
        return columns


def test_figures_need_no_other_scan(spark, tmp_path):
    """The write that counts reads the events once."""
    land_log(spark, [("f1", p) for p in range(50)], f"{tmp_path}/log")
    log = spark.read.parquet(f"{tmp_path}/log").withColumns({"delivery_batch": F.lit("b"), "pending": F.lit(False), "leads": F.col("position") == 0})
    marked, seen = delivery.measured(log)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("figures", "")
    try:
        marked.write.parquet(f"{tmp_path}/out")
        assert seen.get["events_delivered"] == 50 and tuple(seen.get["top"]) == ("f1", 49)
        assert len(tracker.getJobIdsForGroup("figures")) == 1
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


class PlainMap(dict):
    """A map state that counts what is asked and written."""

    asked = written = 0

    def getValue(self, key):
        self.asked += 1
        return self.get(key)

    def updateValue(self, key, value):
        self.written += 1
        self[key] = value

    def removeKey(self, key):
        self.written += 1
        self.pop(key, None)


def test_assembly_of_many_transactions_in_one_call():
    """A lane's transactions take one call; whole ones ask the state once and write nothing, open ones write what is new."""
    states = {}
    handle = type("Handle", (), {"getMapState": lambda self, name, *_: states.setdefault(name, PlainMap())})()
    own = _Assembler(cap=4)
    own.init(handle)
    row = Row("lane", "transaction_id", "kind", "binlog_file", "position", "event")
    make = lambda *events: iter([row(0, tx, kind, "f", at, f"{tx}-{at}") for tx, kind, at in events])
    told = lambda rows: sorted((r.transaction_id, r.kind, r.max_position, r.cut, tuple(e.partition("-")[2] for e in r.events)) for r in rows)
    whole = [(f"w{k}", kind, 10 * k + at) for at, kind in ((2, "tx_commit"), (0, "tx_begin"), (1, "row")) for k in range(50)]
    assert told(own.handleInputRows((0,), make(*whole), None)) == sorted((f"w{k}", "transaction", 10 * k + 2, False, (f"{10 * k}", f"{10 * k + 1}", f"{10 * k + 2}")) for k in range(50))
    assert states["opened"].asked == 50 and not states["opened"].written and not states["events"].written and not states["events"].asked
    assert told(own.handleInputRows((0,), make(("a", "tx_begin", 600), ("a", "row", 601), ("b", "tx_begin", 602), ("c", "row", 603)), None)) == [("c", "orphan", 603, False, ("603",))]
    assert told(own.handleInputRows((0,), make(("a", "row", 610), ("b", "row", 611)), None)) == [] and states["events"].asked == 0
    got = told(own.handleInputRows((0,), make(("a", "tx_commit", 620), ("b", "tx_begin", 621), ("b", "tx_commit", 622)), None))  # a begin that is repeated starts anew
    assert got == [("a", "transaction", 620, False, ("600", "601", "610", "620")), ("b", "transaction", 622, False, ("621", "622"))]
    assert not states["opened"] and not states["events"]
    got = told(own.handleInputRows((0,), make(("d", "tx_begin", 700), *[("d", "row", 700 + k) for k in range(1, 6)], ("d", "tx_commit", 706)), None))
    assert got == [("d", "orphan", 705, False, ("705",)), ("d", "orphan", 706, False, ("706",)), ("d", "part", 704, True, ("700", "701", "702", "703", "704"))]


POSITIONS = "binlog_file string, position long, kind string"


def land_log(spark, places, path, schema=POSITIONS):
    rows = spark.createDataFrame([(f, p, f"{f}-{p}") for f, p in places], schema)
    land_files(rows, path)


def streamed(spark, path, tmp, name="out", stop_after=None, **options):
    """Runs the stream until nothing is left; positions by batch."""
    got = {}
    schema = spark.createDataFrame([], POSITIONS).schema
    log = stream_positions(spark, path, schema, **options)
    query = log.writeStream.foreachBatch(lambda rows, b: got.update({b: sorted(((r.binlog_file, r.position) for r in rows.collect()), key=str)})).option("checkpointLocation", f"{tmp}/cp-{name}").start()
    query.processAllAvailable()
    query.stop()
    return got


def test_positions_as_a_stream(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    assert sum(streamed(spark, path, tmp_path, "empty").values(), []) == []
    one = [("f1", p) for p in range(10)] + [("f2", p) for p in range(5)]
    land_log(spark, one, path)
    assert sorted(sum(streamed(spark, path, tmp_path).values(), [])) == one
    land_log(spark, [("f2", 7), ("f3", 0)], path)
    assert sorted(sum(streamed(spark, path, tmp_path).values(), [])) == [("f2", 7), ("f3", 0)]  # resumed at the checkpoint
    land_log(spark, [("f1", 99)], path)
    assert sum(streamed(spark, path, tmp_path).values(), []) == []  # behind the offset
    # from a position on, inclusively, also one that no record has
    assert sorted(sum(streamed(spark, path, tmp_path, "at", committed=("f2", 3)).values(), [])) == [("f2", 3), ("f2", 4), ("f2", 7), ("f3", 0)]
    assert sorted(sum(streamed(spark, path, tmp_path, "gap", committed=("f2", 5)).values(), [])) == [("f2", 7), ("f3", 0)]


def test_positions_in_limited_batches(spark, tmp_path):
    """A limit gives several batches in order, none twice or lost, also over a restart, and repeats of a position stay together."""
    path = f"file://{tmp_path}/log"
    for k in range(6):
        land_log(spark, [(f"f{k // 3}", 100 * k + p // 2) for p in range(20)], path)
    options = {"rows_per_batch": 25, "progress_path": f"file://{tmp_path}/progress/p.json"}
    first = streamed(spark, path, tmp_path, **options)
    assert len(first) >= 3 and all(first.values())
    ordered = [first[b] for b in sorted(first)]
    assert all(a[-1] < b[0] for a, b in zip(ordered, ordered[1:]))
    assert sum(ordered, []) == [(f"f{k // 3}", 100 * k + p // 2) for k in range(6) for p in range(20)]
    for k in range(6, 9):
        land_log(spark, [(f"f{k // 3}", 100 * k + p) for p in range(20)], path)
    again = streamed(spark, path, tmp_path, **options)
    assert len(again) >= 2 and sum((again[b] for b in sorted(again)), []) == [(f"f{k // 3}", 100 * k + p) for k in range(6, 9) for p in range(20)]
    kept = json.loads((tmp_path / "progress" / "p.json").read_text())
    assert kept["planned"] == {"file": "f2", "position": 820} and kept["committed"]["file"] == "f2"
    with pytest.raises(Exception, match="progress_path"):
        stream_positions(spark, path, rows_per_batch=5).writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/cp-x").start().processAllAvailable()


def test_positions_that_are_null(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    land_log(spark, [(None, 3), (None, None), ("f1", None), ("f1", 2), ("f1", -4), ("f 1/:%", 1)], path)
    assert sorted(sum(streamed(spark, path, tmp_path).values(), []), key=str) == sorted([(None, 3), (None, None), ("f1", None), ("f1", 2), ("f1", -4), ("f 1/:%", 1)], key=str)


def test_positions_read_only_what_they_need(tmp_path, spark):
    """Files before the offset aren't opened; slices are row groups that meet the range."""
    land_log(spark, [(f"f{k}", p) for k in range(5) for p in range(10)], f"file://{tmp_path}/log")
    reader = LogReader({"path": f"file://{tmp_path}/log", "start_file": "f3", "start_position": "4"}, spark.createDataFrame([], POSITIONS).schema)
    start, end = reader.initialOffset(), reader.latestOffset()
    slices = reader.partitions(start, end)
    assert end == {"file": "f4", "position": 10} and {s.file for s in slices} == {"f3", "f4"}
    assert all("binlog_file=f3" in p or "binlog_file=f4" in p for p in reader.groups)
    assert sum(b.num_rows for s in slices for b in reader.read(s)) == 16


def test_many_small_files_take_few_tasks(tmp_path, spark):
    """Small files share a task, rows come once, and executors aren't sent what the driver knows of the log."""
    land_log(spark, [(f"f{k:03d}", p) for k in range(100) for p in range(3)], f"file://{tmp_path}/log")
    assert len({name.split("-")[1] for name in map(os.path.basename, files(f"{tmp_path}/log"))}) > 3  # written by several tasks
    reader = LogReader({"path": f"file://{tmp_path}/log", "start_file": "f001", "start_position": "2"}, spark.createDataFrame([], POSITIONS).schema)
    tasks = reader.partitions(reader.initialOffset(), reader.latestOffset())
    sent = pickle.loads(pickle.dumps(reader))
    got = sorted((r["binlog_file"], r["position"]) for t in tasks for b in sent.read(t) for r in b.to_pylist())
    assert len(tasks) <= 8 and len(reader.groups) >= 99 and not sent.groups
    assert got == [("f001", 2)] + [(f"f{k:03d}", p) for k in range(2, 100) for p in range(3)]


def test_published_files(spark, tmp_path):
    schema = "k string, images array<struct<name:string,value:string>>, n long"
    make = lambda *keys: spark.createDataFrame([(k, [("a", k)], i) for i, k in enumerate(keys)], schema)
    sink = PublishedSink(f"file://{tmp_path}/p")
    with pytest.raises(ValueError, match="nothing is published"):
        sink.events(spark)
    assert sink.events(spark, make("x").schema).count() == 0
    sink.deliver(make("a", "b").repartition(3), 0)
    sink.deliver(make("c"), 5)
    sink.deliver(make("z", "y"), 0)  # published before
    sink.deliver(make("x").where("false"), 6)
    assert sorted((r.k, r.images[0].value) for r in sink.events(spark).collect()) == [("a", "a"), ("b", "b"), ("c", "c")]
    assert [(b["batch"], sum(f["rows"] for f in b["files"])) for b in sink.batches()] == [(0, 2), (5, 1), (6, 0)]
    listed = {f["name"] for b in sink.batches() for f in b["files"]}
    assert {p.name for p in (tmp_path / "p" / "data").glob("*.parquet")} == listed  # the repeat's files are gone


def test_what_fails_after_its_write_is_not_seen(spark, tmp_path):
    sink = PublishedSink(f"file://{tmp_path}/p")
    sink.deliver(spark.range(3), 0)
    bad = spark.range(100, 120, 1, 4)
    with pytest.raises(Exception):
        sink.deliver(bad.where("id < 115 or isnotnull(raise_error('lost'))"), 1)
    files = _Files(sink.path, spark.range(1).schema)
    files.write(iter(spark.range(7).toArrow().to_batches()))  # an attempt whose executor is lost before the commit
    assert sorted(r.id for r in sink.events(spark).collect()) == [0, 1, 2]
    assert sink.sweep() == 0 and sink.sweep(older_than_s=0) >= 1
    sink.deliver(spark.range(100, 104), 1)
    assert sorted(r.id for r in sink.events(spark).collect()) == [0, 1, 2, 100, 101, 102, 103]
    own = files.write(iter(spark.range(2).toArrow().to_batches()))
    files.publish([own, None], 2)
    files.publish([own], 2)  # a commit that is repeated keeps its files
    assert sink.events(spark).count() == 9
    assert isinstance(create({"type": "published", "path": sink.path}), PublishedSink)


def test_stream_into_published_files(spark, tmp_path):
    path, sink = f"file://{tmp_path}/log", PublishedSink(f"file://{tmp_path}/p")
    schema = spark.createDataFrame([], POSITIONS).schema
    register(spark, PublishedFiles)
    want = []
    for k in range(3):
        want += [("f1", 10 * k + p) for p in range(10)]
        land_log(spark, want[-10:], path)
        query = stream_positions(spark, path, schema).writeStream.format("changeloom_published").option("path", sink.path).option("checkpointLocation", f"{tmp_path}/cp").start()
        query.processAllAvailable()
        query.stop()
        assert sorted((r.binlog_file, r.position) for r in sink.events(spark).collect()) == want


def test_schema_entries(spark):
    rows = [("app", "t", "b", "varchar(9)", "", "YES", 2), ("app", "t", "a", "int unsigned", "PRI", "NO", 1), ("app", "u", "x", "int", "", "NO", 1), ("app", "t", "c", "int", "PRI", "NO", 3)]
    found = {r.table: r for r in schema_entries(spark.createDataFrame(rows, "table_schema string, table_name string, column_name string, column_type string, column_key string, is_nullable string, ordinal_position int"), "f", 4).collect()}
    assert [(c.name, c.data_type, c.is_primary_key, c.is_nullable, c.ordinal_position, c.default_value) for c in found["t"].columns] == [("a", "int unsigned", True, False, 0, None), ("b", "varchar(9)", False, True, 1, None), ("c", "int", True, False, 2, None)]
    assert found["t"].primary_key_columns == ["a", "c"] and found["u"].primary_key_columns == [] and found["u"].version == 1


def test_shared_folders_are_fresh(spark):
    a, b = shared_folder(spark, "x"), shared_folder(spark, "x")
    assert a != b and a.startswith("file:")


def test_as_of_by_ranges_equals_that_by_intervals(spark):
    rng = random.Random(11)
    file = lambda: rng.choice(["a", "b", "c"])
    history = [(t, file(), rng.randrange(60), i, f"v{i}") for i, t in enumerate(["t"] * 25 + ["u"] * 2)] + [("t", "b", 30, 90, "x"), ("t", "b", 30, 91, "y"), ("w", "a", 3, 92, "only")]
    log = [(t, f, None if f is None else p, i) for i, (t, f, p) in enumerate((rng.choice(["t", "t", "t", "u", "w", "none", None]), rng.choice(["a", "b", "c", "d", None]), rng.randrange(70)) for _ in range(400))]
    history = spark.createDataFrame(history, "table string, binlog_file string, position bigint, put_seq bigint, cols string")
    log = spark.createDataFrame(log, "table string, binlog_file string, position bigint, id int")
    one = asof.schema_at(log, history, keys=("table",))
    two = asof.schema_at(log, history, keys=("table",), broadcast_bytes=0)
    assert one.columns == two.columns
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    three = asof.by_range(log, history, ("table",), ("put_seq",), size=7)
    assert sorted(map(str, one.collect())) == sorted(map(str, three.collect()))
    # a table's records are dealt by ranges, not by the table
    plan = three._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_k0" in plan and "_f" in plan and "BroadcastNestedLoop" not in plan


def test_splits_of_any_key(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.choice([None, "a", "b", "é", "zz"]), rng.choice([None, *range(40)]), i) for i in range(600)]
    df = spark.createDataFrame(rows, "name string, n int, id int").repartition(3)
    cuts = bounds(df, ["name", "n"], 8)
    assert 1 <= len(cuts) <= 7
    marked = df.select("id", *[p.cast("int").alias(f"p{i}") for i, p in enumerate(predicates(["name", "n"], cuts))]).collect()
    assert all(sum(r[1:]) == 1 for r in marked)  # each row is in one range, nulls too
    split = SplitRead(spark, f"file://{tmp_path}/s", ["name", "n"], 8)
    first = split.run(df, most=3)
    asked = []
    rest = SplitRead(spark, f"file://{tmp_path}/s", ["name", "n"], 8).run(df, read=lambda p: (asked.append(p), df.where(p))[1])
    assert len(first) == 3 and len(asked) == len(rest) == len(cuts) + 1 - 3 and not set(first) & set(rest)
    assert sorted(r.id for r in split.rows().collect()) == list(range(600))
    assert split.run(df) == []
    none = SplitRead(spark, f"file://{tmp_path}/none", ["n"], 8)
    assert none.run(df.where("false")) == [0] and none.rows().count() == 0


def test_chunks_give_way_to_the_log(spark, tmp_path):
    """A row that changes while its chunk is read comes from the log, whichever version was read."""
    log = spark.createDataFrame([("row", 1, "f", 10, "late"), ("row", 2, "f", 20, "late"), ("row", 9, "f", 30, "new")], "kind string, id int, binlog_file string, position bigint, v string")
    marks = iter([("f", 5), ("f", 15), ("f", 15), ("f", 25)])
    table = {0: [(1, "early"), (3, "same")], 1: [(2, "late"), (4, "same")]}
    chunks = ChunkedSnapshot(spark, f"file://{tmp_path}/c", 2, ["id"])
    read = lambda i: spark.createDataFrame(table[i], "id int, v string")
    assert chunks.run(read, lambda: log, lambda: next(marks), most=1) == [0]
    with pytest.raises(ZeroDivisionError):  # cut off while a chunk is read: it doesn't count
        chunks.run(lambda i: 1 / 0, lambda: log, lambda: ("f", 15))
    again = ChunkedSnapshot(spark, f"file://{tmp_path}/c", 2, ["id"])
    assert again.run(read, lambda: log, lambda: next(marks)) == [1] and again.run(read, lambda: log, lambda: next(marks)) == []
    assert sorted((r.id, r.v, r.position) for r in again.rows().collect()) == [(3, "same", 15), (4, "same", 25)] and again.start() == ("f", 5)


def test_ledger(spark, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}/l")
    assert ledger.entries() == {}
    ledger.add(3, "three")
    ledger.add(3, "again")
    ledger.add(12, "twelve\n")
    assert Ledger(spark, f"file://{tmp_path}/l").entries() == {3: "three", 12: "twelve\n"}
