"""File types and data links, over documents as bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postulant.catalogue.standins import DOCUMENTS, documents
from postulant.functions.files import data_link, download_name, file_type, mime_type


def stored_files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents behind the leading bytes of a file type; Spanish ones have no file."""
    lang, data = F.col("lang"), F.encode("text", "UTF-8")
    cv = (
        F.when(lang == "fr", F.concat(F.unhex(F.lit("255044462D")), data))
        .when((lang == "en") & (F.col("source") == "src1"), F.concat(F.unhex(F.lit("504B0304")), data))
        .when((lang == "en") & (F.col("source") == "src2"), F.concat(F.unhex(F.lit("D0CF11E0")), data))
        .when(lang != "es", data)
    )
    return documents(spark, folder).select("id", "source", cv.alias("cv"))


def sniff(spark: SparkSession, folder: str) -> DataFrame:
    kinds = stored_files(spark, folder).select("id", file_type("cv").alias("kind"))
    return kinds.select("id", "kind", mime_type("kind").alias("mime"))


def link(spark: SparkSession, folder: str) -> DataFrame:
    return stored_files(spark, folder).select(
        "id", data_link("cv").alias("link"), download_name("cv", "source").alias("file")
    )


QUERIES = {"bn_sniff": sniff, "bn_link": link}

_FILES = rf"""{DOCUMENTS},
files AS (
  SELECT id, source,
    CASE WHEN lang = 'fr' THEN '\x25\x50\x44\x46\x2D'::BLOB || encode(text)
         WHEN lang = 'en' AND source = 'src1' THEN '\x50\x4B\x03\x04'::BLOB || encode(text)
         WHEN lang = 'en' AND source = 'src2' THEN '\xD0\xCF\x11\xE0'::BLOB || encode(text)
         WHEN lang <> 'es' THEN encode(text) END AS cv,
    CASE WHEN lang = 'fr' THEN 'pdf' WHEN lang = 'en' AND source = 'src1' THEN 'docx'
         WHEN lang = 'en' AND source = 'src2' THEN 'doc' ELSE 'bin' END AS kind
  FROM resumes),
typed AS (
  SELECT *, CASE kind WHEN 'pdf' THEN 'application/pdf'
    WHEN 'docx' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document'
    WHEN 'doc' THEN 'application/msword' ELSE 'application/octet-stream' END AS mime
  FROM files)"""

SQL = {
    "bn_sniff": f"WITH {_FILES} SELECT id, kind, mime FROM typed",
    "bn_link": f"""WITH {_FILES}
SELECT id, CASE WHEN cv IS NULL THEN '✖️' ELSE 'data:' || mime || ';base64,' || base64(cv) END AS link,
       CASE WHEN cv IS NOT NULL THEN source || '.' || kind END AS file FROM typed""",
}
