"""Ranked search against an exhaustive search."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from postulant.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, best=20):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc_id, c in counted:
            m = 75 + (25 * sum(c.values()) * n_docs) // n_terms
            score = 0
            for t in terms(text):
                if t in c:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                scores.append((-score, doc_id is None, doc_id))
        out += [(item, rank + 1, doc_id, -score) for rank, (score, _, doc_id) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:best])]
    return sorted(out, key=repr)


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 3))) for _ in range(150)]
    docs = [(i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(150)], k=rng.randint(0, 80)))) for i in range(n)]
    docs += [(n + i, docs[3][1]) for i in range(60)]
    docs += [(None, docs[4][1]), (None, docs[4][1]), (5, docs[4][1]), (6, None), (7, ""), (8, "!? \n"), (9, "Ab,ab;AB é\x00é x" + "zz " * 400), (n + 99, "a " * 30000)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 30)))) for i in range(25)]
    items += [(100, docs[3][1]), (101, docs[4][1] + " " + docs[4][1]), (102, None), (103, "!!"), (104, "nowhere zz"), (104, "nowhere zz"), (None, "a b c")]
    return docs, items


def frames(spark, docs, items):
    made = spark.createDataFrame(docs, "doc_id long, text string").repartition(5).selectExpr("*", "1 AS query", "2 AS n", "3 AS score")
    return made, spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit(0))


@pytest.mark.parametrize(("seed", "spare", "slice_", "batch"), [(1, 4, 2_000_000, 1024), (2, 1, 40, 1024), (3, 1, 300, 7)])
def test_search_equals_exhaustive_search(spark, monkeypatch, seed, spare, slice_, batch):
    """Also with crowded sketches, which need several slices, and with several batches."""
    monkeypatch.setattr(lexical, "SPARE", spare)
    monkeypatch.setattr(lexical, "LEAST_WIDTH", 2 if spare == 1 else 16)
    monkeypatch.setattr(lexical, "SLICE", slice_)
    monkeypatch.setattr(lexical, "BATCH_ITEMS", batch)
    docs, items = corpus(seed, 150)
    found = lexical.search(*frames(spark, docs, items))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(docs, items)


def test_bounds_are_never_below_scores(spark):
    docs, items = corpus(4, 100)
    made, asked = frames(spark, docs, items)
    index = lexical.build(made)
    batch = lexical.weighted(next(lexical.batches_of(asked)), made, index)
    zeros = np.zeros(len(batch.items), np.int64)
    bounds = {}
    for r in lexical.open_bounds(index, batch, zeros, zeros).collect():
        bounds[r.query, r.doc_id] = max(bounds.get((r.query, r.doc_id), 0), r.bound)
    pairs = made.select("doc_id").distinct().crossJoin(spark.range(len(batch.items)).withColumnRenamed("id", "query"))
    scores = lexical.rescored(made, batch, pairs).collect()
    assert len(scores) > 500 and all(bounds[r.query, r.doc_id] >= r.score for r in scores)
    assert sum(bounds[r.query, r.doc_id] < 1.1 * r.score for r in scores) > 0.8 * len(scores)


def test_empty_tables(spark):
    made, asked = frames(spark, *corpus(5, 10))
    assert lexical.search(made.limit(0), asked).count() == 0
    assert lexical.search(made, asked.limit(0)).count() == 0
    assert lexical.search(made.where("doc_id = 7"), asked).columns == ["item_id", "rank", "doc_id", "score"]


def test_many_occurrences_pass_the_sketch(spark):
    """255 and more occurrences share one value, whose impact is the largest possible."""
    docs = [(i, "a " * (250 + i) + "b " * 3) for i in range(30)] + [(100 + i, "c d e") for i in range(90)]
    found = lexical.search(*frames(spark, docs, [(1, "a b")]))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(docs, [(1, "a b")])
