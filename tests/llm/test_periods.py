"""Periodic runs against a brute-force search, through Spark and in one tile."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from postulant.llm import periods

SPACES = " \t\n\x0b\x0c\r"


def brute(words):
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        x = 0
        while x < n - q:
            if words[x] != words[x + q]:
                x += 1
                continue
            start = x
            while x < n - q and words[x] == words[x + q]:
                x += 1
            length = x - start + q
            smaller = any(all(words[i] == words[i + p] for i in range(start, start + length - p)) for p in range(1, q))
            if length >= max(6, 4 * q) and not smaller:
                out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def split(text):
    for c in SPACES[1:]:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def expected(doc_id, text):
    words = split(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped).encode()
    milli = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, hashlib.sha256(listed).hexdigest(), hashlib.sha256(kept).hexdigest())


def rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", *periods.DIGESTS.names).collect()), key=repr)


@pytest.mark.parametrize("tile", [3, 50, 4096])
def test_fragments_cover_every_run(monkeypatch, tile):
    monkeypatch.setattr(periods, "TILE", tile)
    rng = random.Random(tile)
    for _ in range(700):
        n, k = rng.randint(0, 160), rng.choice([1, 2, 3, 5, 50])
        words = [rng.randrange(k) for _ in range(n)]
        for _ in range(rng.randint(0, 3) if n > 4 else 0):
            a = rng.randrange(n)
            p, end = 1 + (n - a) // rng.randint(3, 10), rng.randint(a, n)
            for i in range(a, end):
                words[i] = words[a + (i - a) % p]
        parts = [part for d, core, begin, piece in periods.tiles(np.array(words, np.int32)) for part in periods.fragments(piece, d, core, begin)]
        found = {}
        for q, low, high in sorted(parts):
            spans = found.setdefault(q, [])
            if spans and low <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], high)
            else:
                spans.append([low, high])
        runs = [(low, high - low + q, q) for q, spans in found.items() for low, high in spans if high - low + q >= max(6, 4 * q)]
        assert sorted(runs, key=lambda r: (r[0], r[2])) == brute(words)


def test_query_equals_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    known = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect() if len(r.text) < 6000]
    wanted = sorted((expected(*r) for r in known), key=repr)
    found = [r for r in rows(periods.periods(spark, folder)) if r[0] in {i for i, _ in known}]
    assert found == wanted and sum(r[1] for r in wanted) > 10


def test_odd_rows(spark):
    rng = random.Random(5)
    period = " ".join(f"w{i}" for i in range(1, 400))
    texts = [None, "", " \t\n ", "a a a a a", "a a a a a a", "a b a b a b a b", "x " + "a b c " * 40 + "y", period * 1, (period + " ") * 5, "é\x00 " * 9, "z " * 30000]
    texts += [" ".join(rng.choice("ab") for _ in range(200)) for _ in range(20)]
    data = [(i, t) for i, t in enumerate(texts)] + [(None, "b c " * 30), (None, "b c " * 30), (7, "a b a b a b a b"), (7, "a b a b a b a b")]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    clash = docs.selectExpr("*", "1 AS row", "2 AS kind", "3 AS runs", "4 AS n_runs")
    found = rows(periods.analysed(clash, periods.digest, periods.DIGESTS, periods.planted))
    short = [r for r in data if len(r[1] or "") < 20000]
    assert [r for r in found if r[0] != 10] == sorted((expected(*r) for r in short), key=repr)
    assert [r[1:5] for r in found if r[0] == 10] in ([(1, 0, 30000, 1)], [expected(10, "z " * 300)[1:5]])
    assert rows(periods.analysed(docs.limit(0), periods.digest, periods.DIGESTS)) == []


def test_real_outputs(spark):
    docs = spark.createDataFrame([(1, "x a b a b a b a b y"), (2, "one two"), (3, None)], "doc_id long, text string")
    assert {r.doc_id: [tuple(x) for x in r.runs] for r in periods.find_runs(docs).collect()} == {1: [(1, 8, 2)], 2: [], 3: []}
    assert {tuple(r) for r in periods.collapse(docs).collect()} == {(1, "x a b y", 6), (2, "one two", 0), (3, "", 0)}


def test_tiles_of_a_long_document_are_rows_of_their_own():
    words = np.array([i % 5 for i in range(200_000)], np.int32)
    cut = list(periods.tiles(words))
    assert len([t for t in cut if t[0] == 4]) > 40
    assert max(len(t[3]) for t in cut if t[0] == 4) < 2 * periods.TILE


def test_shuffles_are_by_document_and_period(spark, folder):
    plan = periods.periods(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
