"""Mail inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postulant.functions import as_column
from postulant.schema import MESSAGES

MAIL_FILES = "*.msg"


def read_mail_files(spark: SparkSession, folder: str, pattern: str = MAIL_FILES) -> DataFrame:
    """Raw mail files below a folder: name and bytes, one row per file.

    A mail decoder, applied with `mapInPandas`, turns these rows into `messages`.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(folder)
    )
    return files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), "path", "length", "content")


def only_mails(messages: DataFrame) -> DataFrame:
    """Decoded rows that stem from a mail file."""
    return messages.where(as_column("filename").endswith(MAIL_FILES.removeprefix("*")))


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """Decoded mails, under the fixed schema."""
    return spark.read.schema(MESSAGES).parquet(path)


def stream_messages(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """New files of decoded mails as a stream."""
    reader = spark.readStream.schema(MESSAGES)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)
