"""Insert-if-absent, update and delete, over orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postulant.catalogue.standins import ORDERS, orders
from postulant.functions.status import status_code
from postulant.operators import upsert as up
from postulant.operators.browse import edits_of, present
from postulant.schema import CANDIDATES
from postulant.session import work_folder
from postulant.sources.candidates import CandidateStore

COLUMNS = ("id", "job", "name", "status", "years_exp")


def insert(spark: SparkSession, folder: str) -> DataFrame:
    """Orders since 1997 arrive at a table that holds the earlier ones."""
    rows = orders(spark, folder)
    recent = F.col("applied_at") >= F.lit("1997-01-01").cast(rows.schema["applied_at"].dataType)
    batch, existing = rows.where(recent), rows.where(~recent)
    return up.insert_if_absent(batch, existing, order=("applied_at", "id")).select(*COLUMNS)


def edits(spark: SparkSession, folder: str) -> DataFrame:
    """Edited rows: some with a new status and experience, some unchanged, some unknown."""
    rows = orders(spark, folder)
    label = F.when(F.col("job") == "1-URGENT", "✅ Go process").otherwise("🟡 Non traité")
    changed = rows.where(F.col("job").isin("1-URGENT", "2-HIGH")).select(
        F.when(F.col("years_exp") > 49, -F.col("id") - 1).otherwise(F.col("id")).alias("id"),
        F.when(F.col("job") == "1-URGENT", F.concat_ws(",", F.floor("years_exp").cast("string")))
        .otherwise(F.col("years_exp").cast("string")).alias("years_exp"),
        label.alias("label"),
    )
    return changed.withColumn("status", status_code("label")).drop("label")


def update(spark: SparkSession, folder: str) -> DataFrame:
    return up.update_by_id(orders(spark, folder), edits(spark, folder)).select(*COLUMNS)


def changes(spark: SparkSession, folder: str) -> DataFrame:
    return up.changed_rows(orders(spark, folder), edits(spark, folder)).select(*COLUMNS)


def save_page(spark: SparkSession, folder: str) -> DataFrame:
    """What remains to save of a listing in which urgent orders got a new label."""
    shown = present(orders(spark, folder))
    label = F.when(F.col("job") == "1-URGENT", "📨 Formulaire envoyé").otherwise(F.col("status"))
    saved = edits_of(shown, shown.withColumn("status", label))
    return saved.select("id", "job", "name", "phone", "status", "years_exp")


def delete(spark: SparkSession, folder: str) -> DataFrame:
    """Remove the very large orders and those without a name."""
    rows = orders(spark, folder)
    doomed = rows.where((F.col("years_exp") > 45) | (F.col("name") == "")).select("id")
    return up.delete_by_id(rows, doomed).select(*COLUMNS)


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """The same steps on the stored table: two loads, an update that moves rows, a delete."""
    place = work_folder(spark, "orders")
    store = CandidateStore(spark, place, "orders_" + place.rsplit("-", 1)[1])
    rows = orders(spark, folder).withColumn("filename", F.lpad(F.col("id").cast("string"), 12, "0"))
    rows = rows.select("filename", *[
        (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in CANDIDATES.fields if f.name != "id"
    ])
    recent = F.col("applied_at") >= "1997-01-01"
    store.insert(rows.where(~recent), "early")
    store.insert(rows.where(recent), "late")
    edited = store.read().where(F.col("job").isin("1-URGENT", "2-HIGH"))
    later = F.expr("if(job = '2-HIGH', applied_at + INTERVAL 1 MONTH, applied_at)").cast("string")
    store.update(edited.select("id", F.lit(3).alias("status"), later.alias("applied_at")))
    store.delete(store.read().where(F.col("years_exp") > 45).select("id"))
    day = F.date_format("applied_at", "yyyy-MM-dd").alias("applied_at")
    rows = store.read().select("job", "name", "status", "years_exp", day, "applied_month", "load_id")
    rows.write.parquet(f"{place}/result")
    store.drop()
    return spark.read.schema(rows.schema).parquet(f"{place}/result")


QUERIES = {
    "mut_insert": insert,
    "mut_update": update,
    "mut_changes": changes,
    "mut_save": save_page,
    "mut_delete": delete,
    "mut_table": stored,
}

_EDITS = f"""{ORDERS},
edits AS (
  SELECT CASE WHEN years_exp > 49 THEN -id - 1 ELSE id END AS id,
         CASE WHEN job = '1-URGENT' THEN floor(years_exp) ELSE years_exp END AS years_exp,
         CASE WHEN job = '1-URGENT' THEN 3 ELSE 0 END AS status
  FROM applications WHERE job IN ('1-URGENT', '2-HIGH'))"""

SQL = {
    "mut_table": f"""WITH {ORDERS},
loads AS (SELECT *, CASE WHEN applied_at < TIMESTAMP '1997-01-01 00:00:00' THEN 'early' ELSE 'late' END AS load_id
          FROM applications),
placed AS (SELECT *, row_number() OVER (PARTITION BY load_id, job, name ORDER BY applied_at, id) AS place FROM loads),
kept AS (SELECT * FROM placed p WHERE name = '' OR job = '' OR (place = 1 AND (load_id = 'early' OR NOT EXISTS (
  SELECT 1 FROM loads e WHERE e.load_id = 'early' AND e.job = p.job AND e.name = p.name)))),
moved AS (SELECT * REPLACE (CASE WHEN job IN ('1-URGENT', '2-HIGH') THEN 3 ELSE status END AS status,
  CASE WHEN job = '2-HIGH' THEN applied_at + INTERVAL 1 MONTH ELSE applied_at END AS applied_at) FROM kept)
SELECT job, name, status, years_exp, strftime(applied_at, '%Y-%m-%d') AS applied_at,
       strftime(applied_at, '%Y-%m') AS applied_month, load_id FROM moved WHERE years_exp <= 45""",
    "mut_insert": f"""WITH {ORDERS},
batch AS (SELECT *, row_number() OVER (PARTITION BY job, name ORDER BY applied_at, id) AS place
          FROM applications WHERE applied_at >= TIMESTAMP '1997-01-01 00:00:00'),
stored AS (SELECT job, name FROM applications WHERE applied_at < TIMESTAMP '1997-01-01 00:00:00')
SELECT id, job, name, status, years_exp FROM batch
WHERE name = '' OR job = '' OR (place = 1 AND NOT EXISTS (
  SELECT 1 FROM stored WHERE stored.job = batch.job AND stored.name = batch.name))""",
    "mut_update": f"""WITH {_EDITS}
SELECT a.id AS id, job, name, coalesce(e.status, a.status) AS status, coalesce(e.years_exp, a.years_exp) AS years_exp
FROM applications a LEFT JOIN edits e ON a.id = e.id""",
    "mut_changes": f"""WITH {_EDITS}
SELECT a.id AS id, job, name, e.status AS status, e.years_exp AS years_exp
FROM applications a JOIN edits e ON a.id = e.id
WHERE e.status <> a.status OR e.years_exp <> a.years_exp""",
    "mut_save": f"""WITH {ORDERS}
SELECT CAST(id AS VARCHAR) AS id, job, name, phone, 1 AS status, years_exp FROM applications
WHERE job = '1-URGENT' AND status <> 1""",
    "mut_delete": f"""WITH {ORDERS}
SELECT id, job, name, status, years_exp FROM applications
WHERE id NOT IN (SELECT id FROM applications WHERE years_exp > 45 OR name = '')""",
}
