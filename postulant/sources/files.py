"""Folders on whatever file system the tables lie on, through Spark's own access to it, and small frames."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def few_rows(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A frame of some rows the driver has. It is part of the plan, so no Python worker starts for it."""
    kind = T.StructType.fromDDL(schema)
    if not rows:
        return spark.range(0).select(*[F.lit(None).cast(field.dataType).alias(field.name) for field in kind])
    texts = json.dumps([{f.name: None if v is None else str(v) for f, v in zip(kind, row, strict=True)} for row in rows])
    plain = "array<struct<" + ",".join(f"`{f.name}`:string" for f in kind) + ">>"
    named = spark.range(1).select(F.inline(F.from_json(F.lit(texts), plain)))
    return named.select(*[F.col(f.name).cast(f.dataType) for f in kind])


def _opened(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def listed(spark: SparkSession, folder: str) -> dict[str, int]:
    """Names below a folder, with the length of files and 0 for folders; none if the folder does not exist."""
    path, system = _opened(spark, folder)
    if not system.exists(path):
        return {}
    return {status.getPath().getName(): status.getLen() for status in system.listStatus(path)}


def exists(spark: SparkSession, path: str) -> bool:
    found, system = _opened(spark, path)
    return system.exists(found)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a file or a folder with all it holds; one that is missing is fine."""
    found, system = _opened(spark, path)
    system.delete(found, True)
