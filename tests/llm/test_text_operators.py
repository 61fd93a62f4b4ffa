"""Operators on documents against brute force, with nulls, empty texts, repeats, empty tables and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from changeloom.llm import decontaminate, line_dedup, minhash_mih, packing, quality_mil, queries, secret_scan, token_ans
from changeloom.llm.oracle import ORACLE_SQL
from changeloom.llm.tokens import BatchEncoder, default_tokenizer
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, node string, label int, parts string, gone string, score double"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "p", "g", 0.5) for i, t in rows], DOCS)


ENCODER = BatchEncoder(default_tokenizer())
FORGETFUL = BatchEncoder(default_tokenizer(), known=8)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"abZ é ß\n\t'12.!_÷’ \r 漢", "'s", "'ll", " '", "  ", "<|endoftext|>"]), max_size=12).map("".join), max_size=6))
def test_ids_are_those_of_the_library(texts):
    want = [x.ids for x in ENCODER.library.encode_batch(texts, add_special_tokens=False)]
    for e in (ENCODER, FORGETFUL):
        ids, at = e.encode(pa.array(texts, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == want


def test_what_comes_up_again_is_kept():
    e = BatchEncoder(default_tokenizer(), known=4)
    for text in ("one two", "one two three", "one four five six", "one seven"):
        ids, _ = e.encode(pa.array([text]))
        assert ids.tolist() == e.library.encode(text, add_special_tokens=False).ids
        assert "one" in e.known and len(e.known) <= 4


def test_token_file_round_trip_and_random_access(tmp_path):
    rng = np.random.default_rng(1)
    sizes = np.array([0, 1, 5, token_ans.BLOCK * 2 + 17, 3])
    ids = (rng.zipf(1.3, sizes.sum()) % 50257).astype(np.uint32)
    import pyarrow.fs as fs

    store, path = fs.LocalFileSystem(), str(tmp_path / "x")
    with store.open_output_stream(path) as sink:
        w = token_ans.TokenFileWriter(sink)
        w.add(pa.array([None, 1, 2, 3, 4], pa.int64()), ids, sizes)
        assert w.close() == (5, sizes.sum())
    f = token_ans.TokenFile(store.open_input_file(path))
    found = list(f.documents())
    assert [d for d, _, _ in found] == [None, 1, 2, 3, 4] and np.array_equal(np.concatenate([x for _, _, x in found]), ids)
    assert [a for _, a, _ in found] == (np.cumsum(sizes) - sizes).tolist() and np.array_equal(f.ids(7, 140_000), ids[7:140_000])
    assert np.array_equal(f.blocks(0, 1, 2), ids[token_ans.BLOCK : 2 * token_ans.BLOCK])
    raw = bytearray(open(path, "rb").read())
    raw[f.segments[0]["blocks"][0][0] + 500] ^= 1
    open(path, "wb").write(bytes(raw))
    with pytest.raises(ValueError, match="checksum"):
        token_ans.TokenFile(store.open_input_file(path)).blocks(0)


def test_frequencies_fill_the_range():
    for ids in (np.zeros(5, np.int64), np.arange(50000), np.repeat(np.arange(3), [10**6, 1, 1])):
        symbols, share = token_ans.frequencies(ids)
        assert share.sum() == 1 << token_ans.BITS and share.min() >= 1 and len(symbols) == len(np.unique(ids))


ODD = [(3, "b  c"), (1, None), (None, "a"), (2, ""), (3, "b  c"), (3, "other"), (9, "word " * 5000)]


def ids_of(text, end):
    return [*ENCODER.library.encode(text or "", add_special_tokens=False).ids, end]


def test_token_files_and_packing_of_odd_rows(spark):
    docs = documents(spark, ODD)
    got = token_ans.encode_corpus(docs).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted([i for i, _ in ODD], key=lambda i: (i is not None, i or 0))
    crcs = collections.Counter(zlib.crc32(np.array(ids_of(t, 0), "<u4").tobytes()) for _, t in ODD)
    assert collections.Counter(r.ids_crc32 for r in got) == crcs
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()
    packed = packing.pack(docs, with_ids=True, sequence_length=64).toPandas()
    assert packed["length"].sum() == sum(len(ids_of(t, 1)) for _, t in ODD)
    for _, g in packed.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == (g["length"].cumsum() - g["length"]).tolist() and g["length"].sum() <= 64
    long = packed[packed.doc_id == 9].sort_values("start")
    assert np.concatenate(long["ids"].to_list()).tolist() == ids_of(ODD[-1][1], 1)
    assert token_ans.encode_corpus(docs.limit(0)).count() == packing.pack(docs.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 50)))
def test_packs_hold_the_histogram(histogram):
    packs = packing.shortest_pack_first(histogram, 32)
    held = collections.Counter()
    for lengths, n in packs:
        assert sum(lengths) <= 32 and n > 0
        for x in lengths:
            held[x] += n
    assert held == collections.Counter(histogram)
    total = sum(k * v for k, v in histogram.items())
    assert sum(n for _, n in packs) <= 2 * total / 32 + 1


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset())


def components(rows, linked):
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if linked(rows[a], rows[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(rows))]


def near(a, b):
    x, y = shingles(a[1]), shingles(b[1])
    return bool(x and y) and 100 * len(x & y) >= 75 * len(x | y)


def test_near_duplicates_equal_all_pairs(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base = [word() for _ in range(60)]
    rows = [(k, " ".join(word() if rng.random() < 0.012 else w for w in base)) for k in range(60)]  # chains of near copies
    rows += [(100 + k, " ".join(word() for _ in range(30))) for k in range(20)]
    rows += [(200, "One two"), (201, "one  TWO\n"), (202, "one two three"), (203, ""), (204, None), (205, " \t"), (206, rows[0][1]), (207, "É a b c d e"), (208, "é a b c d e")]
    got = {r.doc_id: r for r in minhash_mih.near_duplicates(documents(spark, rows)).collect()}
    root = components(rows, near)
    for k, (i, t) in enumerate(rows):
        least = min(rows[j][0] for j in range(len(rows)) if root[j] == root[k])
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(shingles(t)), least, least == i)
    kept = minhash_mih.deduplicated(documents(spark, rows))
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")] and kept.count() == len(set(root))


def test_near_duplicates_of_odd_rows(spark):
    got = minhash_mih.near_duplicates(documents(spark, ODD)).toPandas()
    assert len(got) == len(ODD) and set(got[got.doc_id == 3].component_id) == {3}
    assert minhash_mih.near_duplicates(documents(spark, ODD).limit(0)).count() == 0


@pytest.mark.parametrize("edges", [0, 5, 1 << 18])
def test_edges_within_the_distance_keep_components(monkeypatch, edges):
    monkeypatch.setattr(minhash_mih, "EDGES", edges)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 16, (4, minhash_mih.SYMBOLS)).astype(np.uint16)
    source = rng.integers(0, 4, 40)
    symbols = base[source]
    for row in symbols:
        row[rng.permutation(minhash_mih.SYMBOLS)[:12]] ^= 1
    n, group = len(symbols), np.sort(rng.integers(0, 3, len(symbols)))
    node = rng.permutation(n) + 100
    columns = {"key": group, "x": np.zeros(n, int), "y": np.zeros(n, int), "own": np.zeros(n, int), "node": node, "label": node, "n_shingles": np.full(n, 50)}
    batch = pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns.values()), pa.array([r.astype("<u2").tobytes() for r in symbols], pa.binary())], [*columns, "symbols"])
    found = pa.Table.from_batches(minhash_mih._within(iter([batch.slice(0, 7), batch.slice(7, 0), batch.slice(7)])))
    reach = {int(k): int(k) for k in node}

    def top(k):
        while reach[k] != k:
            k = reach[k]
        return k

    for a, b in zip(found["a"].to_pylist(), found["b"].to_pylist()):
        reach[max(top(a), top(b))] = min(top(a), top(b))
    whole = collections.defaultdict(set)
    for k, g, s in zip(node.tolist(), group, source):
        whole[g, s].add(k)
    assert all(top(k) == min(own) for own in whole.values() for k in own)


def test_any_signatures_within_the_distance_share_a_key():
    rng = np.random.default_rng(5)
    for _ in range(200):
        one = rng.integers(0, 1 << 16, minhash_mih.SYMBOLS).astype(np.uint16)
        two = one.copy()
        at = rng.choice(minhash_mih.SYMBOLS, minhash_mih.DISTANCE, replace=False)
        two[at] ^= np.uint16(1)
        a, b = minhash_mih.chunk_keys(np.stack([one, two]))
        assert (a == b).any()


def brute_lines(rows):
    clean = lambda s: re.sub(r"[\x20\x09-\x0D]+", " ", s).lower().strip(" ")
    first, all_lines = {}, []
    for i, t in rows:
        for k, line in enumerate((t or "").split("\n") if t is not None else []):
            if clean(line):
                all_lines.append((i, k, clean(line)))
    for i, k, n in sorted(all_lines):
        first.setdefault(n, (i, k))

    def close(a, b):
        if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < line_dedup.MIN_CHARS:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    gone = {(i, k) for i, k, n in all_lines if (i, k) != first[n] or any(first[m] < first[n] and close(m, n) for m in first)}
    return {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in rows}


def test_line_dedup_equals_all_pairs(spark):
    rng = random.Random(11)
    base = ["the quick brown fox jumps", "aaaaaaaaaaaaaaaaaaaa", "ünïcödé line of some length 漢", "short"]

    def edit(s):
        k, c = rng.randrange(len(s)), rng.choice("aé x")
        return rng.choice([s, s[:k] + s[k + 1 :], s[:k] + c + s[k + 1 :], s[:k] + c + s[k:], s.upper(), s.replace(" ", "  ")])

    rows = [(k, "\n".join(edit(edit(rng.choice(base))) for _ in range(4))) for k in range(40)] + [(50, None), (51, ""), (52, "\n\n")]
    docs = documents(spark, rows)
    got = line_dedup.without_repeats(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_exact", "n_near"]
    assert {r.doc_id: r.text for r in got.collect()} == brute_lines(rows)
    assert {(r.parts, r.gone) for r in got.collect()} == {("p", "g")}


def test_line_dedup_of_odd_rows(spark):
    line = "a line that is long enough"
    rows = [(2, line), (2, line), (None, line), (3, f"{line}!\n{line}"), (3, None)]
    got = sorted(((r.doc_id, r.text) for r in line_dedup.without_repeats(documents(spark, rows)).collect()), key=str)
    assert got == sorted([(2, ""), (2, ""), (None, line), (3, ""), (3, None)], key=str)
    assert line_dedup.without_repeats(documents(spark, rows).limit(0)).count() == 0


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("edits", [2, 4])
def test_line_dedup_of_more_edits_equals_all_pairs(spark, edits):
    rng = random.Random(edits)
    base = ["the quick brown fox jumps", "a" * 34, "ünïcödé line of some length 漢, and as much again, \U0001f600 as it takes to allow for all edits", "0123456789 " * 6, "short"]

    def edit(s):
        for _ in range(rng.randrange(6)):
            k, c = rng.randrange(len(s)), rng.choice("aé x")
            s = rng.choice([s[:k] + s[k + 1 :], s[:k] + c + s[k + 1 :], s[:k] + c + s[k:]])
        return s

    rows = [(k, "\n".join(edit(rng.choice(base)) for _ in range(4))) for k in range(60)] + [(70, None), (71, "")]
    first, n_near = {}, 0
    for i, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            norm = re.sub(" +", " ", line).lower().strip(" ")
            if norm:
                first.setdefault(norm, []).append((i, k))
    gone = {p for places in first.values() for p in places[1:]}
    for x, places in first.items():
        if len(x) >= line_dedup.MIN_CHARS and any(o[0] < places[0] and levenshtein(x, y) <= min(edits, min(len(x), len(y)) // line_dedup.MIN_CHARS) for y, o in first.items()):
            gone |= set(places)
            n_near += len(places)
    want = {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in rows}
    got = line_dedup.without_repeats(documents(spark, rows), edits=edits).collect()
    assert {r.doc_id: r.text for r in got} == want and sum(r.n_near for r in got) == n_near
    assert line_dedup.without_repeats(documents(spark, rows).limit(0), edits=edits).count() == 0


@pytest.mark.parametrize("edits", [1, 2])
def test_short_lines_repeat_exactly(spark, edits):
    rows = [(1, "ietzte.\n\nIETZTE. \na line that is long enough"), (2, "ietzte!\n \nietzte.\na line that is long enough!"), (3, "x\n\nx\nx")]
    got = {r.doc_id: (r.text, r.n_exact, r.n_near) for r in line_dedup.without_repeats(documents(spark, rows), edits=edits).collect()}
    assert got == {1: ("ietzte.\n\na line that is long enough", 1, 0), 2: ("ietzte!\n ", 1, 1), 3: ("x\n", 2, 0)}


@settings(max_examples=100, deadline=None)
@given(st.text(min_size=1, max_size=12))
def test_deletion_hashes(text):
    own, less = line_dedup.deletion_hashes(text)
    for k, h in enumerate(less):
        rest = text[:k] + text[k + 1 :]
        assert not rest or int(h) == line_dedup.deletion_hashes(rest)[0]


BENCH = [(1, "Tom has 5 apples and gives 2 apples to Anna who already had 7 pears in 3 kg"), (2, "one two three four five six"), (3, None), (4, ""), (2, "one two three four five six")]


def test_templates(spark):
    same = "Bob has 9 apples and gives 4 apples to Mary who already had 8 pears in 1 lb".replace("lb", "km")
    rows = [
        (1, "before it " + same + " and after"),
        (2, "Bob has 9 apples and gives 4 apples to Bob who already had 8 pears in 2 kg"),
        (3, BENCH[0][1]),
        (4, "it has 9 apples but keeps them all and gives nothing to Mary who had 8"),
        (5, "say one two three four five six seven"),
        (6, None),
        (7, ""),
        (None, "one two three four five six"),
        (1, "before it " + same + " and after"),
        (8, "Tom has 5 apples and gives 2 apples to Anna who already had 7 pears in 3 kg Tom has 6 apples and gives 2 apples to Ann who already had 7 pears in 3 kg"),
    ]
    bench = spark.createDataFrame(BENCH, "item_id long, text string").withColumn("words", decontaminate.F.lit("w"))
    got = {(r.doc_id, r.item_id): r.changed_slots for r in decontaminate.find_contaminated(documents(spark, rows), bench).collect()}
    assert got == {(1, 1): 7, (2, 1): 6, (3, 1): 0, (5, 2): 0, (None, 2): 0, (8, 1): 0}
    kept = decontaminate.clean(documents(spark, rows), bench)
    assert sorted(r.doc_id for r in kept.collect()) == [4, 6, 7] and kept.columns == documents(spark, []).columns
    assert decontaminate.find_contaminated(documents(spark, rows), bench.limit(0)).count() == 0
    assert decontaminate.find_contaminated(documents(spark, rows).limit(0), bench).count() == 0


def test_inconsistent_slots_are_no_match(spark):
    item = spark.createDataFrame([(1, "take 3 and then 3 and then 3 and then 4 more of it")], "item_id long, text string")
    docs = documents(spark, [(1, "take 5 and then 5 and then 5 and then 6 more of it"), (2, "take 5 and then 6 and then 7 and then 8 more of it")])
    assert [(r.doc_id, r.changed_slots) for r in decontaminate.find_contaminated(docs, item).collect()] == [(1, 2)]


def test_short_items_and_items_of_placeholders(spark):
    bench = spark.createDataFrame([(1, "Tom 5 Anna 7 Bob 9 Carl 3"), (2, "Two Words"), (3, " \n"), (4, "the sum of 3 and 3 and the words after it up to the very end")], "item_id long, text string")
    rows = [(1, "so Tom 5 Anna 7 BOB 9 Carl 3 it is"), (2, "so Tim 5 Anna 7 Bob 9 Carl 3 it is"), (3, "two\nWORDS"), (4, "two words more"), (5, ""), (6, "the sum of 3 and 4 and the words after it up to the very end"), (7, "the sum of 3 and 3 and the words")]
    found = {(r.doc_id, r.item_id): (r.item_windows, r.covered_windows, r.changed_slots) for r in decontaminate.find_contaminated(documents(spark, rows), bench).collect()}
    # one of two equal numbers changed: the windows with both say no, the others count
    assert found == {(1, 1): (1, 1, 0), (3, 2): (1, 1, 0), (6, 4): (9, 5, 1)}


def test_items_full_of_slots_and_short_items_anywhere(spark):
    bench = spark.createDataFrame([(1, "Ann paid Bob 5 dollars and 7 cents in 3 days"), (2, "four words stand here"), (3, "two words"), (4, "1 2 3 4 5 6 7 8 9 10")], "item_id long, text string")
    rows = [(1, "so Eve paid Tom 9 dollars and 2 cents in 8 days again"), (2, "so Eve paid Tom 9 dollars or 2 cents in 8 days again"), (3, "here FOUR words stand here now"), (4, "two words more"), (5, "9 8 7 6 5 4 3 2 1 0")]
    found = {(r.doc_id, r.item_id): (r.item_windows, r.covered_windows) for r in decontaminate.find_contaminated(documents(spark, rows), bench).collect()}
    assert found == {(1, 1): (4, 4), (3, 2): (1, 1)}


def test_rows_that_share_a_doc_id_stay_by_their_texts(spark):
    item = "one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    unique, other = "a text that is like no other one here", "yet another text that nobody else has written"
    rows = [(1, item), (1, unique), (None, item), (None, other), (None, None), (2, item), (2, None)]
    docs = documents(spark, rows)
    assert sorted(((r.doc_id, r.text) for r in decontaminate.clean(docs, bench).collect()), key=str) == sorted([(1, unique), (None, other), (None, None), (2, None)], key=str)
    assert sorted(((r.doc_id, r.text) for r in minhash_mih.deduplicated(docs).collect()), key=str) == sorted([(1, item), (1, unique), (None, other), (None, None), (2, None)], key=str)


def test_secret_structure():
    import base64
    import json

    def tlv(tag, body):
        n = len(body)
        return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x82]) + n.to_bytes(2, "big")) + body

    number = lambda n: tlv(2, b"\x01" * n)
    pkcs1 = tlv(0x30, tlv(2, b"\0") + number(64) + b"".join(number(8) for _ in range(7)))
    pkcs8 = tlv(0x30, tlv(2, b"\0") + tlv(0x30, tlv(6, b"\x2a\x86")) + tlv(4, pkcs1))
    field = lambda b: len(b).to_bytes(4, "big") + b
    ssh = b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4, "big") + field(b"public") + field(b"x" * 40)
    for raw in (pkcs1, pkcs8, ssh):
        assert secret_scan.is_private_key(raw) and not secret_scan.is_private_key(raw[:-1]) and not secret_scan.is_private_key(raw + b"\0")
    b64 = base64.b64encode(pkcs8).decode()
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    token = f"{part({'alg': 'HS256'})}.{part({'sub': '1'})}.c2ln"
    pem = f"-----BEGIN PRIVATE KEY-----\n{b64[:64]}\n{b64[64:]}\n-----END PRIVATE KEY-----"
    wrapped = base64.b64encode(b"the password = hunter2hunter2 here").decode()
    text = f"é {b64} {token} {pkcs1.hex()} {wrapped} {pem} {'Ab1' * 30}"
    kinds = [(k, text[a:b]) for a, b, k in secret_scan.in_order(secret_scan.confirmed_spans(text))]
    assert kinds == [("key", b64), ("jwt", token), ("key", pkcs1.hex()), ("encoded", wrapped), ("pem", pem)]


def test_short_and_wrapped_secrets():
    import base64
    import json

    b64 = lambda b: base64.b64encode(b).decode()
    tlv = lambda tag, body: bytes([tag]) + (bytes([len(body)]) if len(body) < 128 else bytes([0x82]) + len(body).to_bytes(2, "big")) + body
    key = b64(tlv(0x30, tlv(2, b"\0") + tlv(2, b"\1" * 64) + b"".join(tlv(2, b"\1" * 8) for _ in range(7))))
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    token = f"{part({'alg': 'HS256'})}.{part({'sub': '1'})}.c2ln"
    access = b"AKIA" + b"A" * 16
    found = lambda text: [(k, text[a:b]) for a, b, k in secret_scan.in_order(secret_scan.confirmed_spans(text))]
    for short in (b64(access), access.hex(), b64(b"password=hunter2x"), b"password=hunter2x".hex().upper(), b64(b"token=abcdef"), b"token=abcdef".hex()):
        assert found(f"see {short} there") == [("encoded", short)]
    for width in (64, 76):
        lines = [key[k : k + width] for k in range(0, len(key), width)]
        for end in ("\n", "\r\n", "\n  "):
            assert found(f"a key:\n{end.join(lines)}\nand words after it") == [("key", end.join(lines))]
    even = key[: len(key) // 2] + "\n" + key[len(key) // 2 :]
    assert len(key) % 2 == 0 and found(f"{even}\nwords") == [("key", even)]
    assert found(f"somehost1.{token} api.somehost1.{token}") == [("jwt", token), ("jwt", token)]
    assert found("internationalization and\nincomprehensibilities\nwithout any secret.of.them") == []


def test_secret_base_spans(spark):
    hex24 = "0123456789abcdef01234567"
    text = f"API-KEY: no; apikey = '{hex24}' Token:short passwd:\"longer1\" AKIA{'A' * 16} xAKIA{'B' * 15} {hex24[:-1]} ſecret: abcdefgh"
    rows = [(1, text), (2, None), (3, ""), (None, text), (1, text)]
    got = secret_scan.summarize(documents(spark, rows)).collect()
    assert len(got) == 5
    one = next(r for r in got if r.doc_id == 1)
    base = []
    for kind, p in (("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), ("access", "AKIA[A-Z0-9]+"), ("hex", "[0-9a-f]+")):
        for m in re.finditer(p, text, re.ASCII):
            if {"assign": lambda m: len(m[2]) >= 6, "access": lambda m: len(m[0]) >= 20, "hex": lambda m: len(m[0]) >= 24}[kind](m):
                base.append((m.start(), ("assign", "access", "hex").index(kind), f"{kind}:{m.start()}:{m.end()}"))
    assert one.base_sha256 == hashlib.sha256(",".join(x[2] for x in sorted(base)).encode()).hexdigest()
    assert (one.n_assign, one.n_access, one.n_hex) == (2, 1, 1)
    empty = next(r for r in got if r.doc_id == 2)
    assert empty.spans == "" and empty.base_sha256 == hashlib.sha256(b"").hexdigest()
    assert secret_scan.summarize(documents(spark, rows).limit(0)).count() == 0


def test_quality_learns_and_scores_odd_rows(spark):
    rng = random.Random(2)
    good = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(80)) for _ in range(150)]
    bad = [" ".join(["SPAM!!"] * 80) if k % 2 else " ".join([f"w{k} ###"] * 50) for k in range(150)]
    rows = list(enumerate(good + bad))
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i, _ in rows] + [(5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality_mil.classify(documents(spark, rows + ODD), labels).toPandas()
    assert len(got) == len(rows) + len(ODD) and got.score.between(0, 1).all()
    first = got.iloc[: len(rows)].astype({"doc_id": "int64"})
    assert (first.predicted == (first.doc_id < 150)).mean() > 0.97
    assert [zlib.crc32(str(i).encode()) % 5 == 0 for i in first.doc_id] == first.held_out.tolist()
    assert not got[got.doc_id.isna()].held_out.any()
    none = quality_mil.classify(documents(spark, rows[:3]), labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    docs = documents(spark, rows)
    assert quality_mil.accepted(docs, labels).columns == docs.columns
    assert quality_mil.classify(docs.limit(0), labels).count() == 0


def test_every_passage_belongs_to_its_text():
    x, whose = quality_mil.passages(pa.array(["a " * 130, None, "", "b", " \n"]))
    assert whose.tolist() == [0, 0, 0, 1, 2, 3, 4] and len(x) == 7


@pytest.mark.parametrize("name", ["op3_decontaminate", "op8_line_dedup", "op9_minhash_mih"])
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    own, other = queries.QUERIES[name](spark, SF), duck.sql(ORACLE_SQL[name])
    order = [own.columns.index(c) for c in other.columns]
    assert sorted((tuple(r[i] for i in order) for r in own.collect()), key=str) == sorted(other.fetchall(), key=str)


def plain_loss(p, bags, y):
    """The attention's formulas document by document."""
    sig = lambda v: 1 / (1 + np.exp(-v))
    total = 0.0
    for x, label in zip(bags, y):
        e = np.tanh(x @ p["w"] + p["b"])
        a = np.array([np.sum(p["a"] * np.tanh(row @ p["v"]) * sig(row @ p["u"])) for row in e])
        a = np.exp(a) / np.exp(a).sum()
        score = sig(sum(w * row for w, row in zip(a, e)) @ p["c"] + p["d"][0])
        total -= label * np.log(score) + (1 - label) * np.log(1 - score)
    return total / len(y)


def test_attention_scores_and_gradients_equal_a_plain_version():
    rng = np.random.default_rng(8)
    d, units, gates = 5, 4, 3
    p = {"w": rng.normal(size=(d, units)), "b": rng.normal(size=units), "v": rng.normal(size=(units, gates)), "u": rng.normal(size=(units, gates)), "a": rng.normal(size=gates), "c": rng.normal(size=units), "d": rng.normal(size=1)}
    bags, y = [rng.normal(size=(n, d)) for n in (1, 7, 2, 30)], np.array([1.0, 0, 0, 1])
    count = np.array([len(b) for b in bags])
    loss, grads = quality_mil.loss_and_gradients(p, np.concatenate(bags), count, y)
    assert abs(loss - plain_loss(p, bags, y)) < 1e-9
    for name, g in grads.items():
        for at in list(np.ndindex(p[name].shape))[:6]:
            moved = []
            for step in (1e-5, -1e-5):
                other = {k: v.copy() for k, v in p.items()}
                other[name][at] += step
                moved.append(plain_loss(other, bags, y))
            assert abs((moved[0] - moved[1]) / 2e-5 - g[at]) < 1e-6
    model = quality_mil.Model(np.zeros(d), np.ones(d), p)
    scores = model.score(np.concatenate(bags), np.repeat(np.arange(4), count))
    assert abs(-np.mean(y * np.log(scores) + (1 - y) * np.log(1 - scores)) - loss) < 1e-6


def test_learning_takes_whole_bags_and_one_text_of_a_doc_id(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality_mil, "fit", lambda x, whose, y: seen.append((len(x), np.bincount(whose).tolist(), y.tolist())))
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5][:3]
    rows = [(ids[0], "w " * 20_000), (ids[1], "a b"), (ids[1], "another text"), (ids[1], "a b"), (ids[2], None)]
    labels = spark.createDataFrame([(i, k % 2, 0) for k, i in enumerate(ids)], "doc_id long, quality int, toxic int")
    quality_mil.train(documents(spark, rows), labels)
    assert seen[0][0] == -(-20_000 // 64) + 2 and sorted(seen[0][1]) == [1, 1, 313]
    monkeypatch.setattr(quality_mil, "TRAIN_PASSAGES", 313)
    quality_mil.train(documents(spark, rows), labels)
    assert all(n in (1, 313) for n in seen[1][1]) and sum(seen[1][1]) <= 313  # whole bags or none
    monkeypatch.setattr(quality_mil, "TRAIN_PASSAGES", 20)
    quality_mil.train(documents(spark, rows), labels)
    assert seen[2][1] == [1, 1]  # the one that is too large is left out, wherever it stands
    monkeypatch.setattr(quality_mil, "TRAIN_PASSAGES", 0)
    with pytest.raises(ValueError, match="passages"):
        quality_mil.train(documents(spark, rows), labels)


def test_held_out_accuracy_on_the_labels(spark):
    got = queries.QUERIES["op1_quality_mil"](spark, SF).toPandas().merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    held = got[got.held_out & got.quality.notna()]
    assert len(held) and (held.predicted == held.quality).mean() >= 0.9


def test_packing_deals_a_common_length_to_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 5)
    docs = documents(spark, [(k, "a b c") for k in range(300)] + [(1000 + k, "word " * (k % 9)) for k in range(60)])
    got = packing.pack(docs, sequence_length=16).toPandas()
    ends = got.sort_values("offset").groupby("sequence_id").apply(lambda g: (g["offset"].tolist() == (g["length"].cumsum() - g["length"]).tolist()) and g["length"].sum() <= 16, include_groups=False)
    assert ends.all() and len(got) == len(got.drop_duplicates(["sequence_id", "offset"])) and got.sequence_id.nunique() <= 1.2 * got["length"].sum() / 16


def test_packing_query_equals_the_tokenizer(spark):
    """Every id of every document of the table lies in one piece, with the ids' checksum."""
    got = queries.QUERIES["op6_packing"](spark, SF).toPandas()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for doc_id, own in got.groupby("doc_id"):
        ids, at = ids_of(texts[doc_id], 1), 0
        for r in own.sort_values("start").itertuples():
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    assert set(got.doc_id) == set(texts) and got["length"].sum() >= 0.95 * 2048 * got.sequence_id.nunique()


def test_token_query_equals_the_tokenizer(spark):
    got = queries.QUERIES["op4_token_ans"](spark, SF).orderBy("start").toPandas()
    at = 0
    for r, (doc_id, text) in zip(got.itertuples(), sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()), strict=True):
        ids = ids_of(text, 0)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_secret_query_equals_plain_patterns(spark):
    """Base spans of the table's texts by patterns written out anew, and no span lost."""
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rules = (("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6), ("access", "AKIA[A-Z0-9]+", 20), ("hex", "[0-9a-f]+", 24))
    for r in queries.QUERIES["op5_secret_scan"](spark, SF).collect():
        want = []
        for rank, (kind, pattern, least) in enumerate(rules):
            want += [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, texts[r.doc_id], re.ASCII) if len(m[2] if kind == "assign" else m[0]) >= least]
        assert r.base_sha256 == hashlib.sha256(",".join(x[2] for x in sorted(want)).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x[1] == k for x in want) for k in range(3)]
        assert {x[2] for x in want} <= set(r.spans.split(","))


def test_documents_with_common_boilerplate_are_no_near_copies(spark, monkeypatch):
    """A hot key: many documents share a passage, a few of them are near copies; blocks are small, so that the hot key takes many."""
    monkeypatch.setattr(minhash_mih, "BLOCK", 16)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    common = [word() for _ in range(24)]
    rows = [(k, " ".join(common + [word() for _ in range(16)])) for k in range(150)]
    for k in range(30):
        own = rows[k * 5][1].split(" ")
        own[-1 - k % 3] = word()
        rows.append((500 + k, " ".join(own)))
    got = {r.doc_id: r.component_id for r in minhash_mih.near_duplicates(documents(spark, rows)).collect()}
    root = components(rows, near)
    assert got == {i: min(rows[j][0] for j in range(len(rows)) if root[j] == root[k]) for k, (i, _) in enumerate(rows)}


def test_very_long_texts_and_lines(spark):
    """A text of megabytes, a single huge line, a single huge word: the same results as for short ones."""
    rng = random.Random(1)
    words = " ".join(str(rng.randrange(10**6)) for _ in range(250_000))
    lines = "\n".join(f"line number {k} of a long text" for k in range(60_000))
    rows = [(1, words), (2, words + " end"), (3, "x" * 1_500_000), (4, "y" * 1_500_000), (5, lines)]
    docs = documents(spark, rows)
    near_ids = {r.doc_id: (r.component_id, r.n_shingles) for r in minhash_mih.near_duplicates(docs).collect()}
    assert {i: c for i, (c, _) in near_ids.items()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
    assert near_ids[1][1] == len(shingles(words)) and near_ids[3][1] == 1
    packed = packing.pack(docs.where("doc_id = 1")).agg(F.sum("length"), F.max("doc_tokens")).first()
    assert packed[0] == packed[1] > 500_000
    spans = token_ans.encode_corpus(docs.where("doc_id < 3")).collect()
    assert {r.doc_id for r in spans} == {1, 2}
    assert quality_mil.classify(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 5
    assert secret_scan.summarize(docs).count() == 5


def test_joins_deal_hot_keys_to_parts(spark, monkeypatch):
    from changeloom.llm import common

    monkeypatch.setattr(common, "LIGHT", 10)
    many = spark.range(1000).select(F.col("id").alias("row"), F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(F.col("id")).alias("k"))
    one = many.select("k").distinct().where("k is not null and k <> 11").withColumn("v", F.col("k") * 2)
    for how in ("inner", "left"):
        got = sorted(tuple(r) for r in common.spread_join(many, one, "k", "row", how).select("row", "v").collect())
        assert got == sorted(tuple(r) for r in many.join(one, "k", how).select("row", "v").collect())
