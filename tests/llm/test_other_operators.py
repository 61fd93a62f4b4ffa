"""Vectors, pages, conversations, components and the pipeline."""

import base64
import hashlib
import random
import re

import duckdb
import numpy as np
import pandas as pd
import pytest
from changeloom.llm import chat_format, hnsw, queries, warc_bundles
from changeloom.llm.components import connected_components
from changeloom.llm.oracle import ORACLE_SQL
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 30)] + [(100, 50), (101, 50), (7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 1 for k in range(1, 31)}, 50: 50, 100: 50, 101: 50, 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_vectors_equal_all_pairs(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 8))
    vectors = [base[k % 40] + rng.normal(size=8) * rng.choice([0.0, 0.05, 0.3]) for k in range(300)]
    rows = [(k, v.tolist(), 0, 1) for k, v in enumerate(vectors)]
    got = hnsw.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, node int, dim int")).toPandas().sort_values("vec_id")
    u = hnsw.unit(np.stack(vectors))
    linked = u @ u.T >= hnsw.THRESHOLD
    assert got.n_links.tolist() == (linked.sum(axis=1) - 1).tolist()
    root = np.arange(300)
    for _ in range(300):
        root = np.array([root[row].min() for row in linked])
    assert got.component_id.tolist() == root.tolist() and (got.kept == (got.vec_id == got.component_id)).all()


def test_odd_vectors(spark):
    rows = [(2, [2.0, 0.0]), (1, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [1.0, None]), (7, [float("inf"), 1.0]), (8, []), (9, [1e300, 0.0]), (2, [2.0, 0.0]), (None, [3.0, 0.0]), (10, [1.0, 0.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in hnsw.near_duplicates(frame).collect()]
    assert sorted(got, key=str) == sorted([(2, 4, 1, False), (1, 4, 1, True), (9, 4, 1, False), (2, 4, 1, False), (None, 4, 1, False)] + [(k, 0, k, True) for k in (3, 4, 5, 6, 7, 8, 10)], key=str)
    assert hnsw.near_duplicates(frame.limit(0)).count() == 0


def test_graph_recall():
    rng = np.random.default_rng(9)
    v = hnsw.unit(np.concatenate([rng.normal(size=(1500, 16)), np.repeat(rng.normal(size=(1, 16)), 300, axis=0) + rng.normal(size=(300, 16)) * 0.02]))
    g = hnsw.Graph.load(hnsw.Graph(np.arange(len(v)), np.ones(len(v), np.int64), v).dump())
    every = np.arange(len(v))
    a, b, of, hit = g.links(v, every[::50], every)
    found, truth = set(zip(a, b)), set(zip(*g.scan(v)))
    assert found <= truth and len(found) >= 0.99 * len(truth) and (hit >= 0.99 * of).all() and of.max() >= 299


def test_graphs_are_files_and_links_come_in_parts(monkeypatch, tmp_path):
    """Rows carry a graph's path, and cosines of a bounded number of candidates stand in memory together."""
    monkeypatch.setattr(hnsw, "_PAIRS", 1 << 12)
    rng = np.random.default_rng(10)
    v = hnsw.unit(np.concatenate([rng.normal(size=(700, 16)), rng.normal(size=(1, 16)) + rng.normal(size=(300, 16)) * 0.02]))
    row = hnsw._build(f"file://{tmp_path}/graphs")((16, 3), pd.DataFrame({"node": np.arange(1000), "copies": 1, "embedding": list(v)}))
    assert row.to_dict("records") == [{"dim": 16, "shard": 3, "graph": f"file://{next((tmp_path / 'graphs').iterdir())}"}]
    with open(row["graph"][0].removeprefix("file://"), "rb") as f:
        g = hnsw.Graph.load(f)
    for beam in (32, 1000):
        parts = list(g.parts(g.exact, beam))
        assert len(parts) > 8 and max(len(a) for a, _ in parts) <= 1 << 12
        queries = np.concatenate([np.unique(a) for a, _ in parts])
        assert len(queries) == len(set(queries))  # a query's links come together
        found, truth = {x for a, b in parts for x in zip(a, b)}, set(zip(*g.scan(g.exact)))
        assert found <= truth and len(found) >= 0.99 * len(truth)
    alone = g.ids < 700
    assert len({*g.roots[~alone]}) == 1 and (g.roots[alone] == np.flatnonzero(alone)).mean() > 0.9


def test_planted_links_across_shards_and_their_recall(spark, monkeypatch):
    """Single links among many vectors without any: all found, against brute force, and the recall that the run tells."""
    monkeypatch.setattr(hnsw, "SHARD_LEAST", 700)
    rng = np.random.default_rng(12)
    v = hnsw.unit(rng.normal(size=(3000, 32)))
    pair = hnsw.unit(v[:400] * 0.96 + 0.28 * hnsw.unit(rng.normal(size=(400, 32))))
    v = np.concatenate([v, pair, np.repeat(v[:1], 900, axis=0)])
    rows = [(k, x.tolist()) for k, x in enumerate(v)]
    got = hnsw.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), with_recall=True).toPandas().sort_values("vec_id")
    linked = v @ v.T >= hnsw.THRESHOLD
    want = linked.sum(axis=1) - 1
    assert (got.n_links.to_numpy() <= want).all() and got.n_links.sum() >= 0.99 * want.sum() and (got.n_links.to_numpy()[::50] == want[::50]).mean() >= 0.99
    assert (want[3000:3400] > 0).sum() > 300 and got.recall.dropna().min() >= 0.9 and got.recall.notna().sum() >= 5


def test_a_class_is_audited_by_any_of_its_ids(spark):
    rng = np.random.default_rng(13)
    v = hnsw.unit(rng.normal(size=(30, 16)))
    near = hnsw.unit((v[0] + 0.01 * rng.normal(size=16))[None])[0]
    rows = [(37, v[0].tolist()), (100, v[0].tolist()), (38, near.tolist()), *[(200 + k, x.tolist()) for k, x in enumerate(v[1:]) if (200 + k) % 50]]
    got = {r.vec_id: (r.n_links, r.recall) for r in hnsw.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), with_recall=True).collect()}
    assert got[37] == got[100] == (2, 1.0) and got[38] == (2, None)


def test_signed_zeros_are_equal(spark):
    rows = [(5, [0.0, 1.0]), (4, [-0.0, 1.0]), (7, [1.0, -0.0]), *[(10 + k, [-0.0 if k % 2 else 0.0, -3.0]) for k in range(300)]]
    got = {r.vec_id: (r.n_links, r.component_id) for r in hnsw.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert got == {5: (1, 4), 4: (1, 4), 7: (0, 7), **{10 + k: (299, 10) for k in range(300)}}


def test_a_node_is_named_by_its_neighbours():
    """Among vectors without near ones a node that others crowd out of all lists is met by no beam, unless the beam grows with the shard."""
    rng = np.random.default_rng(14)
    v = hnsw.unit(rng.normal(size=(4000, 64)))
    links = hnsw.Graph(np.arange(4000), np.ones(4000, np.int64), v).layers[-1].links
    assert np.bincount(links[links >= 0], minlength=4000).min() >= hnsw.NAMED
    assert (np.sort(links, axis=1)[:, 1:] == np.sort(links, axis=1)[:, :-1])[np.sort(links, axis=1)[:, 1:] >= 0].sum() == 0


@pytest.mark.parametrize("shards", [1, 2, 5, 6])
def test_of_two_shards_one_is_asked(spark, shards):
    dealt = spark.range(shards * 3).select(F.col("id").alias("node"), F.pmod("id", F.lit(shards)).alias("shard"))
    got = [(r.node, r.home, r.shard) for r in hnsw._asked(dealt, shards).collect()]
    pairs = [(a, b) for a in range(shards) for b in range(a, shards)]
    assert sorted({tuple(sorted(x[1:])) for x in got}) == pairs and len({x[1:] for x in got}) == len(pairs) and len(got) == 3 * len(pairs)


PAGES = [(1, "a\r\nb é", "x"), (2, None, "x"), (3, "u", None), (4, "u", ""), (None, "u", "x"), (1, "q", "x"), (None, "u", "zz"), (8, "v", "é" * 700_000), (9, "w", "x\r\n\r\nWARC/1.1")]


def test_archives(spark):
    pages = spark.createDataFrame([(*p, "d") for p in PAGES], "page_id long, url string, html string, digest string")
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc_bundles.archive(pages).collect()]
    first = {}
    for i, _, h in PAGES:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = []
    for i, _, h in PAGES:
        raw = (h or "").encode()
        again = first.get(h or "", i) != i
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", first[h or ""] if again else None))
    assert sorted(got, key=str) == sorted(want, key=str)
    large = [r.record_type for r in warc_bundles.archive(pages, least_bytes=2).collect()]
    assert set(large) == {"response"}
    assert warc_bundles.archive(pages.limit(0)).count() == 0


def test_frames_are_independent(tmp_path):
    import zstandard

    path = tmp_path / "x.warc.zst"
    records = [warc_bundles.record(k, f"http://x/{k}", bytes([k % 256]) * 90_000, "D", None, False) for k in range(40)]
    with open(path, "wb") as sink:
        w = warc_bundles.BundleWriter(sink)
        places = [w.add(r) for r in records]
        w.close()
    import pyarrow as pa

    b = warc_bundles.Bundle(pa.OSFile(str(path)))
    assert len(b.places) > 2
    assert all(b.record(*places[k], len(records[k])) == records[k] for k in (39, 0, 20))
    with open(path, "rb") as f:  # other readers skip the table
        assert zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read() == b"".join(records)


def test_conversations(spark):
    rng = random.Random(6)
    parts = ["### ", "</turn>", "\\", "\n", "a", "é😀", ": ", "### assistant: ", "%3A", "#", ""]
    text = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(0, 6)))
    roles = ["user", "assistant", "a: b", "x\n#%<\\", "", None]
    rows = [(k // 5, k % 5, rng.choice(roles), rng.choice([text(), None]), "t") for k in range(400)]
    rows += [(900, 0, "assistant", "same", "t"), (900, 0, "assistant", "same", "t"), (900, None, "user", "first", "t"), (None, 1, "user", "x", "t")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, items string")
    made = chat_format.format_conversations(turns)
    got = {r.conv_id: r for r in chat_format.read_back(made).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted([(-1 if t is None else t, role or "", x or "") for c, t, role, x, _ in rows if c == conv])
        assert [(t.role, t.text) for t in got[conv].turns] == [x[1:] for x in own]
        assert got[conv].loss_texts == [x for _, role, x in own if role == "assistant"]
    # outside of backslashes control strings are marks only
    for r in made.collect():
        assert len(re.findall(r"(?<!\\)(### |</turn>)", r.formatted)) == 2 * len(got[r.conv_id].turns)
    assert chat_format.format_conversations(turns.limit(0)).count() == 0


def test_plain_texts_stay_as_they_are(spark):
    rows = spark.createDataFrame([(1, 0, "user", "hi \\ there")], "conv_id long, turn long, role string, text string")
    assert chat_format.format_conversations(rows).first().formatted == "### user: hi \\ there\n</turn>\n"


@pytest.mark.parametrize("name", ["op7_hnsw", "op10_chat_format"])
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for t in ("embeddings", "conversations"):
        duck.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    own, other = queries.QUERIES[name](spark, SF), duck.sql(ORACLE_SQL[name])
    order = [own.columns.index(c) for c in other.columns]
    assert sorted((tuple(r[i] for i in order) for r in own.collect()), key=str) == sorted(other.fetchall(), key=str)


def test_pipeline_stages(spark, tmp_path):
    """Each stage against plain Python on what the stage before has kept."""
    import corpus_pipeline
    from test_text_operators import brute_lines, components, near

    docs = before = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs, before = spark.read.parquet(str(tmp_path / name)), docs
        old, new = sorted((r.doc_id, r.text) for r in before.collect()), docs.toPandas()
        if name == "quality_classifier":
            right = [(i in set(new.doc_id)) == bool(labels[i]) for i, _ in old if i in labels]
            assert sum(right) >= 0.95 * len(right)
        elif name == "line_dedup":
            want = {i: t for i, t in brute_lines(old).items() if t.strip(" \t\n\x0b\x0c\r") or t == dict(old)[i]}
            assert dict(zip(new.doc_id, new.text)) == want and (new.n_chars == new.text.str.len()).all()
        elif name == "minhash_near_dedup":
            root = components(old, near)
            assert sorted(new.doc_id) == [old[k][0] for k in sorted(set(root))]
        elif name == "decontamination":
            assert set(new.doc_id) == {i for i, t in old if not any(b in t for b in bench)}
        else:
            assert set(new.doc_id) == {i for i, _ in old} and new.groupby("sequence_id")["length"].sum().max() <= 2048
        if name != "packing":
            assert docs.columns == before.columns


def test_pipeline_run_equals_its_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    own, want = corpus_pipeline.run(spark, SF), docs
    assert own.columns == want.columns
    piece = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(own.select(*piece).collect()) == sorted(want.select(*piece).collect())


def test_stages_of_odd_rows(spark, tmp_path):
    """Nulls, empty texts, repeated and shared doc_ids, extra columns named as the operators' own: kept as they are where no stage removes them."""
    import corpus_pipeline

    line = "a line of some length that is only here, with 3 words more than that"
    rows = [(None, None, "x"), (None, line, "x"), (1, line, "y"), (1, "quite another text, and a longer one at that", "z"), (2, "", "w"), (3, "short\nshort\nlong enough to be a line", "v")]
    schema = "doc_id long, text string, n_lines string"
    extra = lambda df: df.select("*", *[F.lit("own").alias(c) for c in ("n_exact", "n_near", "gone", "gone_t", "t", "node", "score", "label", "h", "place")])
    docs, empty = extra(spark.createDataFrame(rows, schema)), extra(spark.createDataFrame([], schema))
    for name, stage in corpus_pipeline.STAGES[1:4]:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == empty.columns and stage(spark, empty, SF).count() == 0
        assert {r.n_near for r in docs.collect()} == {"own"}
    want = [(None, None, "x"), (None, line, "x"), (1, "quite another text, and a longer one at that", "z"), (2, "", "w"), (3, "short\nlong enough to be a line", "v")]
    assert sorted([(r.doc_id, r.text, r.n_lines) for r in docs.collect()], key=str) == sorted(want, key=str)
    assert corpus_pipeline.STAGES[0][1](spark, empty, SF).count() == corpus_pipeline.STAGES[4][1](spark, empty, SF).count() == 0
    assert corpus_pipeline.STAGES[4][1](spark, docs, SF).select("doc_id").distinct().count() == 4


def test_archive_query_equals_a_plain_version(spark):
    pages = [(r.page_id, (r.html or "").encode()) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    first = {}
    for i, raw in sorted(pages):
        first.setdefault(raw, i)
    want = sorted((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if first[raw] == i else "revisit", None if first[raw] == i else first[raw]) for i, raw in pages)
    got = queries.QUERIES["op2_warc_bundles"](spark, SF).collect()
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want


def test_a_common_payload_is_dealt_to_parts(spark, monkeypatch):
    from changeloom.llm import common

    monkeypatch.setattr(warc_bundles, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "LIGHT", 5)
    pages = spark.createDataFrame([(k, "u", "common" if k % 2 else f"page {k}") for k in range(200)], "page_id long, url string, html string")
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc_bundles.archive(pages).collect()}
    assert got == {k: ("revisit", 1) if k % 2 and k > 1 else ("response", None) for k in range(200)}


def test_benchmark_times_the_pipeline(spark, monkeypatch, capsys):
    import json

    import __spark_entry__ as entry
    import bench

    before = spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.delenv("BENCH_QUERIES", raising=False)
    monkeypatch.setattr(entry, "queries", lambda: {n: lambda spark, sf: spark.range(1) for n in ("op_counts", "pipeline")})
    bench.main()
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert set(json.loads(capsys.readouterr().out.splitlines()[-1])["queries"]) == {"op_counts", "pipeline"}
