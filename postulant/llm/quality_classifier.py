"""Quality by hierarchical empirical Bayes: a document's own evidence on top of what is known of its site.

Evidence: eight counts of a text become rates, each rate a bucket; the log ratio of
the bucket's share among good and bad labelled documents is its evidence (naive
Bayes with add-one shares), tempered because the rates depend on each other.

Prior: labels per host and per path within the host. The corpus gives the mean and,
by the method of moments over hosts, the weight of a Beta prior; a host's posterior
mean shrinks to the corpus, a path's to its host, and sites without labels take the
level above. All of this is grouped aggregation of narrow rows. The documents table
has no url: `source` is the host and `lang` the path within it.

Defined results: null text has no words; null host or path is a site of its own;
labels that are null or belong to no document teach nothing; several labels of one
document all count; repeated rows are scored alike; without labels the prior is one
half and evidence is 0; an empty table gives an empty result; only the named columns
are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postulant.llm.common import small, table, written
from postulant.llm.kernel import SPACES, prefix, slices, spans, words

RATES = ("words", "length", "symbols", "upper", "marks", "digits", "distinct", "lines")
TEMPER = 0.5
THRESHOLD = 0.5
_CLASSES = {"symbols": b"#*$%&|<>", "upper": bytes(range(65, 91)), "marks": b"!?", "digits": b"0123456789"}


def _member(characters: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters)] = True
    return out


def rates(df: DataFrame) -> DataFrame:
    """doc_id, host, path and the rates (int) of every row with doc_id, text, host and path."""
    members = {name: _member(c) for name, c in _CLASSES.items()}

    def distinct(hashes: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        order = np.lexsort((hashes, rows))
        h, r = hashes[order], rows[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
        return np.bincount(r[fresh], minlength=n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in slices(batch.column(1)):
                n = end - first
                sums = prefix(data)
                starts, ends, rows = words(~SPACES[data], offsets)
                of_byte = np.repeat(np.arange(n), np.diff(offsets))
                count = np.bincount(rows, minlength=n)
                least = np.maximum(count, 1)
                line_starts, line_ends, line_rows = words(data != 10, offsets)
                lines = np.bincount(line_rows, minlength=n)
                values = {
                    "words": count,
                    "length": 10 * np.bincount(rows, ends - starts, n) // least,
                    "distinct": 100 * distinct(spans(sums, starts, ends), rows, n) // least,
                    "lines": 100 * (lines - distinct(spans(sums, line_starts, line_ends), line_rows, n)) // np.maximum(lines, 1),
                    **{name: 100 * np.bincount(of_byte[member[data]], minlength=n) // least for name, member in members.items()},
                }
                kept = [batch.column(i).slice(first, n) for i in (0, 2, 3)]
                yield pa.RecordBatch.from_arrays([*kept, *[pa.array(values[r].astype(np.int32)) for r in RATES]], ["doc_id", "host", "path", *RATES])

    schema = "doc_id long, host string, path string, " + ", ".join(f"{r} int" for r in RATES)
    return df.select(F.col("doc_id").cast("long"), "text", F.col("host").cast("string"), F.col("path").cast("string")).mapInArrow(run, schema)


def _bucket(rate: Column) -> Column:
    """Two buckets per doubling, so at most about 60 per rate."""
    digits = F.bin(rate.cast("long"))
    return F.when(rate < 2, rate).otherwise(2 * F.length(digits) + (F.substring(digits, 2, 1) == "1").cast("int")).cast("int")


def evidence(labelled: DataFrame) -> dict[str, dict[int, float]]:
    """Log ratio of good to bad share per rate and bucket; the table has at most some hundred rows."""
    pairs = F.inline(F.array(*[F.struct(F.lit(r).alias("rate"), _bucket(F.col(r)).alias("bucket")) for r in RATES]))
    rows = labelled.select("good", pairs).groupBy("rate", "bucket").agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad")).collect()
    out: dict[str, dict[int, float]] = {}
    for rate in RATES:
        mine = [r for r in rows if r.rate == rate]
        good, bad = (sum(r[k] for r in mine) + len(mine) for k in ("good", "bad"))
        out[rate] = {r.bucket: float(np.log((r.good + 1) / good) - np.log((r.bad + 1) / bad)) for r in mine}
    return out


def _evidence_of(model: dict[str, dict[int, float]]) -> Column:
    total = F.lit(0.0)
    for rate, shares in model.items():
        if shares:
            lookup = F.create_map(*[F.lit(x) for pair in sorted(shares.items()) for x in pair])
            total = total + F.coalesce(lookup[_bucket(F.col(rate))], F.lit(0.0))
    return F.lit(TEMPER) * total


def _weight(sites: DataFrame, mean: float) -> float:
    """Weight of the Beta prior by the method of moments over sites with labels, between 1 and 1000."""
    found = sites.agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("n") * (F.col("good") / F.col("n") - mean) ** 2).alias("ss"), F.sum(F.col("n") ** 2).alias("n2")).first()
    if not found["k"] or found["k"] < 2:
        return 10.0
    inside = mean * (1 - mean)
    spare = found["n"] - found["n2"] / found["n"]
    between = (found["ss"] - (found["k"] - 1) * inside) / spare if spare > 0 else 0.0
    return float(min(1000.0, max(1.0, inside / between - 1))) if between > 0 else 1000.0


def site_posteriors(rated: DataFrame, labelled: DataFrame) -> DataFrame:
    """(host, path, host_posterior, path_posterior) of every site in the rated rows."""
    paths = written(labelled.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("good").alias("good")), "paths")
    total = paths.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    mean = (total["good"] + 1) / (total["n"] + 2) if total["n"] else 0.5
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    host_weight, path_weight = _weight(hosts, mean), _weight(paths, mean)
    every = rated.select("host", "path").distinct()
    h = hosts.select(F.col("host").alias("h"), F.col("n").alias("hn"), F.col("good").alias("hg"))
    p = paths.select(F.col("host").alias("ph"), F.col("path").alias("pp"), F.col("n").alias("pn"), F.col("good").alias("pg"))
    joined = every.join(h, F.col("host").eqNullSafe(F.col("h")), "left").join(p, F.col("host").eqNullSafe(F.col("ph")) & F.col("path").eqNullSafe(F.col("pp")), "left")
    zero = F.lit(0)
    host = (F.coalesce("hg", zero) + host_weight * mean) / (F.coalesce("hn", zero) + host_weight)
    path = (F.coalesce("pg", zero) + path_weight * F.col("host_posterior")) / (F.coalesce("pn", zero) + path_weight)
    return joined.withColumn("host_posterior", host).withColumn("path_posterior", path).select("host", "path", "host_posterior", "path_posterior")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, host_posterior, path_posterior, score, kept) of every row of docs (doc_id, text, host, path); labels: doc_id, quality."""
    rated = written(rates(docs), "rates")
    truth = labels.where(F.col("quality").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("good"))
    labelled = written(rated.join(truth, "doc_id"), "labelled")
    own = _evidence_of(evidence(labelled))
    sites = written(site_posteriors(rated, labelled), "sites").select(F.col("host").alias("_h"), F.col("path").alias("_p"), "host_posterior", "path_posterior")
    joined = rated.join(small(sites), F.col("host").eqNullSafe(F.col("_h")) & F.col("path").eqNullSafe(F.col("_p")), "left")
    prior = F.log(F.col("path_posterior") / (1 - F.col("path_posterior")))
    score = 1 / (1 + F.exp(-(own + prior)))
    scored = joined.select("doc_id", "host_posterior", "path_posterior", score.alias("score"))
    return scored.withColumn("kept", F.col("score") >= THRESHOLD)


def quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", F.col("source").alias("host"), F.col("lang").alias("path"))
    return classify(docs, table(spark, folder, "labels"))


QUERIES = {"op4_quality_classifier": quality}
SQL: dict[str, str] = {}
