"""Steps that several operators share: written intermediates, size checks, links to components."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postulant.session import work_folder

# A written side with at most this many rows of at most a few dozen bytes each may be broadcast.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The frame, computed once into the shared folder and read back; lost executors cannot lose it."""
    spark = df.sparkSession
    path = work_folder(spark, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint for a written frame of narrow rows, if it has few rows; else the frame itself."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def parts(df: DataFrame, bytes_each: int, size: int) -> int:
    """Number of partitions of about `bytes_each` bytes, at least Spark's own setting."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(least, -(-size // bytes_each))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with a link: the smallest node it can reach.

    `edges` has columns a, b (long). Each round hooks every node to its smallest
    neighbour, shortens the hooks once and contracts the links; the links that
    remain join different components, so rounds grow with the logarithm of the
    longest chain. All rounds are aggregations and joins of written tables.
    """
    edges = written(edges.select("a", "b").where("a <> b").distinct(), "links")
    labels = written(edges.select("a").union(edges.select("b")).distinct().select(F.col("a").alias("node"), F.col("a").alias("component")), "labels")
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        hook = written(both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("up")), "hooks")
        above = hook.select(F.col("a").alias("up"), F.col("up").alias("top"))
        roots = written(hook.join(above, "up", "left").select("a", F.coalesce("top", "up").alias("root")), "roots")
        labels = written(
            labels.join(roots.withColumnRenamed("a", "component"), "component", "left").select("node", F.coalesce("root", "component").alias("component")),
            "labels",
        )
        left, right = roots.select("a", F.col("root").alias("ra")), roots.select(F.col("a").alias("b"), F.col("root").alias("rb"))
        moved = edges.join(left, "a").join(right, "b").where("ra <> rb")
        edges = written(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "links")
    return labels
