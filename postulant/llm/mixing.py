"""Mixing to target weights with soft membership.

A classifier fitted to the labelled table gives every document a posterior over
domains; nonnegative document rates are then fitted so that the expected tokens per
domain, sum of rate x tokens x posterior, match the targets.

Classifier: naive Bayes over hashed words (`FEATURES` buckets), counted for all
labelled documents by grouped aggregation. Its tables hold FEATURES numbers per
domain, a fixed size, and enter the plan as constants; each document sums them in
its own row, without explode or shuffle. Sums are tempered by the text's length and
posteriors rounded to units of 1/`UNITS`, which is part of their definition.

Rates depend on the posterior rounded to `GRID` and on whether the first domain is the
likeliest: at most a few thousand cells, whatever the corpus. Documents are first added
up per cell, with their posteriors in full, so that rare domains are not rounded away.
The rates are those that minimise the squared misses divided by their targets plus
`PULL` times the squared distance to rate 1. They have the form 1 plus one number per
domain times the cell's posterior, never below 0, nor below `floor` where the first
domain is the likeliest. Newton's method finds these numbers with the small
domain-by-domain Hessian, until the condition of the minimum holds within `TOLERANCE`
of every target, or raises. Where targets contradict the floor, the minimum misses
them; `fitted` returns natural, wanted and reached tokens, and `rated` warns.

Main path: DataFrame functions only. Defined results: null text has no tokens and
gets the prior as posterior; labels that are null or unmatched teach nothing;
several labels of one document all count; repeated rows get equal rates; an empty
table gives an empty result; a domain without labels gets no document, so without
any labels all belong to the first; extra columns are
kept by `mix`, those named `_m_*` are refused.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log
from warnings import warn

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postulant.llm.common import small, table, written

FEATURES = 4096
GRID = 50
UNITS = 1_000_000
PULL = 1e-9
TOLERANCE = 1e-3  # of a domain's wanted tokens
ROUNDS = 500
SMOOTH = 1.0
# Wanted share of the tokens of each domain. The first is the reference whose tokens stay as they are.
TARGETS = {"clean": 0.90, "junk": 0.05, "toxic": 0.05}


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), lambda w: w != "")


def _feature(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(FEATURES)).cast("int")


def domain(labels: DataFrame) -> DataFrame:
    """(doc_id, domain): junk if of low quality, else toxic or clean."""
    known = labels.where(F.col("quality").isNotNull() & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    return known.select("doc_id", F.when(F.col("quality") == 0, "junk").when(F.col("toxic") == 1, "toxic").otherwise("clean").alias("domain"))


def ratios(docs: DataFrame, labelled: DataFrame, domains: list[str]) -> dict[str, tuple[float, list[float]]]:
    """Per domain but the first: log prior ratio and log ratio per feature, both against the first."""
    joined = docs.select("doc_id", "text").join(small(written(labelled, "labelled")), "doc_id")
    counted = joined.select("domain", F.explode(words(F.col("text"))).alias("w")).groupBy("domain", _feature(F.col("w")).alias("f")).count().collect()  # FEATURES rows a domain
    number = {r.domain: r["count"] for r in joined.groupBy("domain").count().collect()}
    tables = {d: [SMOOTH] * FEATURES for d in domains}
    for r in counted:
        tables[r.domain][r.f] += r["count"]
    total = {d: sum(t) for d, t in tables.items()}
    base = domains[0]
    prior = {d: log((number[d] + 1) / (number.get(base, 0) + 1)) if d in number else -30.0 for d in domains}
    return {d: (prior[d], [log(x / total[d]) - log(y / total[base]) for x, y in zip(tables[d], tables[base], strict=True)]) for d in domains[1:]}


def _adding(weights: Column) -> Callable[[Column, Column], Column]:
    return lambda total, feature: total + F.get(weights, feature)


def posteriors(docs: DataFrame, model: dict[str, tuple[float, list[float]]], domains: list[str]) -> DataFrame:
    """Adds _m_tokens (long) and _m_p, the posterior over domains as array of int in units of 1/UNITS that sum to UNITS."""
    step = docs.withColumn("_m_words", words(F.col("text")))
    step = step.withColumn("_m_features", F.transform("_m_words", _feature)).withColumn("_m_tokens", F.size("_m_words").cast("long"))
    heat = 1 + F.col("_m_tokens") / 100
    for d in domains[1:]:
        prior, numbers = model[d]
        weights = F.split(F.lit(",".join(f"{x:.5f}" for x in numbers)), ",").cast("array<double>")
        total = F.aggregate("_m_features", F.lit(0.0), _adding(weights))
        step = step.withColumn(f"_m_{d}", F.exp(F.least(F.greatest(prior + total / heat, F.lit(-30.0)), F.lit(30.0))))
    step = step.withColumn("_m_sum", sum((F.col(f"_m_{d}") for d in domains[1:]), F.lit(1.0)))
    others = [F.round(UNITS * F.col(f"_m_{d}") / F.col("_m_sum")).cast("int") for d in domains[1:]]
    step = step.withColumn("_m_others", F.array(*others))
    rest = F.greatest(UNITS - F.aggregate("_m_others", F.lit(0), lambda a, x: a + x), F.lit(0))
    return step.withColumn("_m_p", F.concat(F.array(rest), "_m_others")).drop("_m_words", "_m_features", "_m_sum", "_m_others", *[f"_m_{d}" for d in domains[1:]])


def cell(p: Column) -> Column:
    """The posterior in units of 1/GRID, and whether the first domain is the likeliest."""
    rounded = F.transform(p, lambda x: F.round(x * GRID / UNITS).cast("int"))
    return F.concat(rounded, F.array((p[0] == F.array_max(p)).cast("int")))


def fit_rates(cells: list[tuple[float, list[float], bool]], targets: dict[str, float], floor: float) -> tuple[list[float], list[tuple[float, float, float]]]:
    """The number per domain that makes the rates, and (natural, wanted, reached) tokens per domain.

    `cells` has tokens, tokens per domain, and whether the first domain is the likeliest.
    The numbers maximise the concave dual of the squared distance to rate 1.
    """
    n = sum(c[0] for c in cells)
    filled = [c for c in cells if c[0]]
    if not filled:
        return [0.0] * len(targets), [(0.0, 0.0, 0.0)] * len(targets)
    weight = np.array([c[0] for c in filled]) / n
    p = np.array([[x / c[0] for x in c[1]] for c in filled])
    least = np.array([floor if c[2] else 0.0 for c in filled])
    natural = weight @ p
    share = np.array(list(targets.values()))
    wanted = share * (natural[0] / share[0] if natural[0] else 1.0)
    scale = np.where(wanted > 0, wanted, 1.0)
    used = wanted > 0  # a domain without a target is not steered

    def state(numbers: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """The dual's value, its gradient, what the rates reach, and where they are free."""
        wish = 1 + p @ numbers
        rate = np.maximum(wish, least)
        free = wish > least
        value = weight @ (0.5 * (rate - 1) ** 2 - rate * (p @ numbers)) + numbers @ wanted - PULL / 2 * (scale @ numbers**2)
        reached = (weight * rate) @ p
        return value, np.where(used, wanted - reached - PULL * scale * numbers, 0.0), reached, free

    numbers = np.zeros(len(share))
    value, slope, reached, free = state(numbers)
    for _ in range(ROUNDS):
        if (np.abs(slope) <= TOLERANCE / 10 * scale).all():
            break
        # In units in which every target is 1; the identity stands for domains that are not steered.
        root = np.sqrt(scale)
        bend = (p[free] * weight[free, None]).T @ p[free] / np.outer(root, root) + PULL * np.eye(len(share))
        bend[~used], bend[:, ~used] = 0.0, 0.0
        bend[~used, ~used] = 1.0
        step = np.linalg.solve(bend, slope / root) / root
        size, gain = 1.0, float(slope @ step)
        while size > 1e-12:
            after = state(numbers + size * step)
            if after[0] >= value + 1e-4 * size * gain or (np.abs(after[1] / root)).max() < 0.5 * (np.abs(slope / root)).max():
                break
            size /= 2
        numbers = numbers + size * step
        value, slope, reached, free = after
    if (np.abs(slope) > TOLERANCE * scale).any():
        raise ArithmeticError(f"rates not fitted after {ROUNDS} rounds: {dict(zip(targets, slope / scale, strict=True))}")
    return numbers.tolist(), list(zip((natural * n).tolist(), (wanted * n).tolist(), (reached * n).tolist(), strict=True))


def fitted(
    docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, floor: float = 1.0, keep: list[str] | None = None
) -> tuple[DataFrame, dict[str, tuple[float, float, float]]]:
    """`rated`, and (natural, wanted, reached) tokens per domain."""
    clash = [c for c in docs.columns if c.startswith("_m_")]
    if clash:
        raise ValueError(f"columns with the names of results: {clash}")
    domains = list(targets)
    model = ratios(docs, domain(labels), domains)
    known = written(posteriors(docs, model, domains).select(*(keep or docs.columns), "_m_tokens", "_m_p"), "posteriors")
    sums = [F.sum(F.col("_m_tokens") * F.col("_m_p")[i]).alias(f"t{i}") for i in range(len(domains))]
    cells = written(known.groupBy(cell(F.col("_m_p")).alias("_m_cell")).agg(F.sum("_m_tokens").alias("tokens"), *sums).coalesce(1), "cells")
    rows = sorted(cells.collect(), key=lambda r: r["_m_cell"])  # at most a few thousand
    numbers, reached = fit_rates([(float(r.tokens), [r[f"t{i}"] / UNITS for i in range(len(domains))], r["_m_cell"][-1] == 1) for r in rows], targets, floor)

    def mean(i: int) -> Column:
        return F.when(F.col("tokens") > 0, F.col(f"t{i}") / UNITS / F.col("tokens")).otherwise(F.col("_m_cell")[i] / GRID)

    wish = sum((F.lit(x) * mean(i) for i, x in enumerate(numbers)), F.lit(1.0))
    least = F.when(F.element_at("_m_cell", -1) == 1, F.lit(float(floor))).otherwise(0.0)
    rates = written(cells.select("_m_cell", F.greatest(wish, least).alias("_m_rate")), "rates")
    rated = known.withColumn("_m_of", cell(F.col("_m_p"))).join(F.broadcast(rates), F.col("_m_of") == F.col("_m_cell")).drop("_m_cell", "_m_of")
    return rated, dict(zip(domains, reached, strict=True))


def rated(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, floor: float = 1.0, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all by default) with _m_tokens, _m_p and _m_rate; they are written once beside the posteriors. Warns of missed targets."""
    known, report = fitted(docs, labels, targets, floor, keep)
    missed = {d: (n, w, r) for d, (n, w, r) in report.items() if w and abs(r - w) > 0.01 * w}
    if missed:
        warn(f"mixing: targets out of reach (natural, wanted and reached tokens): {missed}", stacklevel=2)
    return known


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, floor: float = 1.0) -> DataFrame:
    """Every document as often as its rate says; the fraction is drawn by a hash of id and text, alike in every run."""
    known = rated(docs, labels, targets, floor)
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_003)) / 1_000_003
    times = (F.floor("_m_rate") + (draw < F.col("_m_rate") - F.floor("_m_rate")).cast("int")).cast("int")
    copies = known.withColumn("_m_times", times).where("_m_times > 0")
    return copies.withColumn("_m_copy", F.explode(F.array_repeat(F.lit(1), F.col("_m_times")))).select(*docs.columns)


def mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    known = rated(docs, table(spark, folder, "labels"), keep=["doc_id"])
    shares = [(F.col("_m_p")[i] / UNITS).alias(f"p_{d}") for i, d in enumerate(TARGETS)]
    return known.select("doc_id", F.col("_m_tokens").alias("n_tokens"), *shares, F.col("_m_rate").alias("rate"))


QUERIES = {"op6_mixing": mixing}
SQL: dict[str, str] = {}
