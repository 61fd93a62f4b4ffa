"""Substring dedup, whitening and resampling against plain Python, with nulls, empty texts, repeats, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from changeloom.llm import queries, resampling, substring_dedup, whitening
from changeloom.llm.oracle import ORACLE_SQL
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = queries.QUERIES[name](spark, SF)
    rel = con.execute(ORACLE_SQL[name])
    at = [[c[0] for c in rel.description].index(c) for c in found.columns]
    assert sorted(map(tuple, found.collect()), key=str) == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=str)


# ---------------------------------------------------------------- substring dedup


def plain_repeats(rows):
    """(doc_id, kept text, n_words, n_removed) by looking at all windows; a null id is the greatest."""
    first, texts = {}, []
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())
        d = math.inf if i is None else i
        texts.append((i, d, w))
        for j in range(len(w) - 19):
            key = tuple(w[j : j + 20])
            first[key] = min(first.get(key, (d, j)), (d, j))
    out = []
    for i, d, w in texts:
        gone = set()
        for j in range(len(w) - 19):
            if first[tuple(w[j : j + 20])] < (d, j):
                gone |= {*range(j, j + 20)}
        out.append((i, b" ".join(x for k, x in enumerate(w) if k not in gone).decode(), len(w), len(gone)))
    return out


def table(spark, rows):
    """Documents with columns that are named as the operator's own."""
    names = "d long, k string, h long, p int, n long, places string, copy boolean, frequent int, r int, n_words string, part int, z string"
    return spark.createDataFrame([(i, t, 1, "k", 2, 3, 4, "p", True, 5, 6, "w", 7, "z") for i, t in rows], f"doc_id long, text string, {names}")


def passages(seed, n=60):
    """Texts of few words with common passages at any shift, some of them just under and over a window's length."""
    rng = random.Random(seed)
    say = lambda size: [rng.choice("abcdefghijklmnop") + str(rng.randrange(40)) for _ in range(size)]
    common = [say(size) for size in (19, 20, 21, 27, 33, 60)]
    rows = []
    for i in range(n):
        text = say(rng.randrange(30))
        for _ in range(rng.randrange(4)):
            text += rng.choice(common) + say(rng.randrange(15))
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(text)))
    rows += [(1000 + i, rows[3 + i % 2][1]) for i in range(20)]  # copies
    return rows


ODD = [(7, None), (None, None), (8, ""), (9, " \n"), (10, "word " * 3000), (None, "word " * 50), (None, "word " * 50), (11, "é漢字 " * 25), (12, "é漢字 " * 22), (12, "x " + "é漢字 " * 22), (12, "x " + "é漢字 " * 22), (-5, "low " * 19), (-4, "low " * 20)]


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_are_those_of_all_windows(spark, seed):
    rows = passages(seed) + (ODD if seed == 2 else [])
    found = substring_dedup.without_repeats(table(spark, rows).repartition(3))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(plain_repeats(rows), key=str)


def test_frequent_anchors_change_nothing(spark, monkeypatch):
    rows = passages(3) + [(5000 + i, passages(4)[0][1] + " " + " ".join(f"hot{k}" for k in range(45)) + f" end{i}") for i in range(80)]
    monkeypatch.setattr(substring_dedup, "SAMPLED", 1)
    monkeypatch.setattr(substring_dedup, "OFTEN", 8)
    keyed = substring_dedup._keyed(table(spark, rows))
    often = substring_dedup._frequent(keyed)
    assert len(often.value) > 5
    # what is dealt by an anchor's hash is spread: a frequent anchor has no hash in common
    anchors = keyed.select("d", "k", "text").mapInArrow(substring_dedup._anchors(often), "h long, d long, k long, p int, frequent boolean")
    assert anchors.where("frequent").groupBy("h").count().agg(F.max("count")).first()[0] == 1
    found = substring_dedup.without_repeats(table(spark, rows))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(plain_repeats(rows), key=str)


def test_the_cover_aligns_any_two_windows():
    p, cover = substring_dedup.PERIOD, substring_dedup.COVER
    for i in range(p):
        for j in range(p):
            assert any((i + s) % p in cover and (j + s) % p in cover for s in range(p))
    assert p - 1 + substring_dedup.ANCHOR == substring_dedup.WINDOW


def test_no_documents_no_rows(spark):
    assert substring_dedup.without_repeats(table(spark, [])).collect() == []


def test_substring_dedup_equals_sql(spark):
    same_as_sql(spark, "op11_substring_dedup")


# ---------------------------------------------------------------- whitening


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "v", 2) for i, v in rows], "vec_id long, embedding array<double>, n int, v string, component int")


def plain_fit(vs):
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vs]
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    return x, n, s, [sum((n * c - t) ** 2 for c, t in zip(v, s, strict=True)) for v in x]


def test_scatter_is_exact_at_any_size():
    rng = random.Random(1)
    for top in (10, 10**6, 10**12, 10**17, 10**30):
        rows = [[rng.randrange(-top, top) for _ in range(5)] for _ in range(70)]
        y = np.array(rows, np.int64 if top < 2**62 else object)
        total, product = whitening.scatter(y)
        assert list(total) == [sum(c) for c in zip(*rows, strict=True)]
        assert product.tolist() == [[sum(r[i] * r[j] for r in rows) for j in range(5)] for i in range(5)]


def test_whitened_rows(spark):
    rng = np.random.default_rng(3)
    mixed = rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6)) + 3
    rows = [(i, v.tolist()) for i, v in enumerate(mixed)] + [(0, mixed[0].tolist()), (None, mixed[1].tolist())]
    bad = [(900, None), (901, []), (902, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (903, [float("nan")] * 6), (904, [float("inf")] * 6), (905, [1.0, 2.0])]
    found = whitening.whiten(vectors(spark, rows + bad).repartition(4)).collect()
    assert len(found) == len(rows) * 6 and found[0]["n"] == len(rows)
    x, n, s, deviation = plain_fit([v for _, v in rows])
    assert sorted({(r["vec_id"], int(r["deviation"])) for r in found}, key=str) == sorted({(i, d) for (i, _), d in zip(rows, deviation, strict=True)}, key=str)
    w = np.array(sorted((r["component"], r["vec_id"], r["whitened"]) for r in found if r["vec_id"] is not None and r["vec_id"] > 0))[:, 2].reshape(6, -1)
    own = np.array(x, float) - np.array([t / n for t in s])
    values, basis = np.linalg.eigh(own.T @ own / n)
    plain = (own @ basis[:, ::-1]) / np.sqrt(values[::-1])
    plain = plain[1:300].T
    sign = np.sign((w * plain).sum(axis=1, keepdims=True))
    assert np.abs(w * sign - plain).max() < 1e-8
    shares = {r["component"]: r["explained"] for r in found}
    assert np.allclose([shares[c] for c in range(1, 7)], values[::-1] / values.sum(), rtol=1e-10)
    assert {r["identity_error"] for r in found} == {found[0]["identity_error"]} and found[0]["identity_error"] < 1e-9


def test_directions_without_variance_and_huge_entries(spark):
    rng = np.random.default_rng(4)
    flat = [(i, [a, 2 * a, 5.0]) for i, a in enumerate(rng.integers(-50, 50, 40).astype(float).tolist())]
    found = whitening.whiten(vectors(spark, flat)).collect()
    assert {r["component"] for r in found} == {1} and len(found) == 40 and found[0]["explained"] == pytest.approx(1)
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0])] * 3)).collect() == []
    assert whitening.whiten(vectors(spark, [])).collect() == whitening.whiten(vectors(spark, [(1, None), (2, [])])).collect() == []
    huge = [(i, [v, float(i % 7)]) for i, v in enumerate((1e25, -3e25, 2e25, 1.0, 5.0))]
    found = whitening.whiten(vectors(spark, huge)).collect()
    assert {r["component"] for r in found} >= {1} and all((r["deviation"] is None) == (r["vec_id"] < 3) for r in found) and found[0]["identity_error"] < 1e-6


def test_whitening_of_the_table(spark):
    found = queries.op12_whitening(spark, SF)
    assert dict(found.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    own = found.collect()
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    x, n, s, deviation = plain_fit([v for _, v in rows])
    assert {(r["vec_id"], r["deviation"], r["n"]) for r in own} == {(i, d, n) for (i, _), d in zip(rows, deviation, strict=True)}
    assert len(own) == 32 * n and {r["component"] for r in own} == set(range(1, 33)) and own[0]["identity_error"] < 1e-4


# ---------------------------------------------------------------- resampling


def plain_resample(rows, target, percent=5, least=20):
    def buckets(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]

    own, wanted = [buckets(t) for _, t in rows], [buckets(t) for t in target]
    s, t = [0] * 10000, [0] * 10000
    for side, found in ((s, own), (t, wanted)):
        for _, bs in found:
            for b in bs:
                side[b] += 1
    gain = [math.floor(1000 * math.log((b + 1.0) * (sum(s) + 10000.0) / ((a + 1.0) * (sum(t) + 10000.0)))) for a, b in zip(s, t, strict=True)]
    out = []
    for (i, _), (n, bs) in zip(rows, own, strict=True):
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in bs)
        out.append([i, len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    order = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], math.inf if r[0] is None else r[0]))
    for k, r in enumerate(order[: percent * len(order) // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in out]


def test_scores_and_ranks(spark):
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice(["Ab", "cé", "x1", "Y-z", "漢", "don't", "ZZ9", "É"]) for _ in range(n))
    rows = [(i, say(rng.randrange(60))) for i in range(150)] + [(200, None), (201, ""), (202, "-- !"), (None, say(40)), (203, say(5000)), (-1, "\x00a\x7fb" * 30)]
    target = [say(15), None, "", "unseen words here"]
    docs = spark.createDataFrame([(i, t, 1, "f", 2) for i, t in rows], "doc_id long, text string, n_words int, features string, rank int").repartition(3)
    found = resampling.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), percent=40)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(plain_resample(rows, target, 40), key=str)


def test_resampling_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resample(none, none).collect() == []
    rows = [(4, "a b c d e f g h i j k l m n o p q r s t u")] * 30 + [(5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, resampling.resample(docs, none, percent=50).collect()), key=str) == sorted(plain_resample(rows, [], 50), key=str)


def test_resampling_equals_sql(spark):
    same_as_sql(spark, "op13_resampling")


def test_scoring_explodes_nothing(spark):
    """Scores come from arrays: the plan that makes them has neither Generate nor a shuffle."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = resampling.scored(resampling.featured(docs.select("doc_id", "text")), [0] * 10000)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Exchange" not in plan and "aggregate(" in plan
