"""Filters, sorting and pages, over events, orders and documents."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postulant.catalogue.standins import DOCUMENTS, EVENTS, ORDERS, STATUS_LABEL, documents, events, orders
from postulant.functions.status import status_label
from postulant.operators import browse as br
from postulant.operators.browse import BrowseSpec

FILTERS = BrowseSpec(
    status="📨 Formulaire envoyé",
    days=(date(2024, 1, 5), date(2024, 1, 25)),
    job="Purchase",
    freelance="OUI",
    experience=(0, 25),
)
MONTH = BrowseSpec(days=(date(1997, 1, 1), date(1997, 1, 31)))
SORTED = BrowseSpec(sort=(("job", False), ("years_exp", True)), page=3)
WORDS = BrowseSpec(sort=(("job", True),), page=1, page_size=100)
SEARCH = r"\bonion|éaux? (le|la)\b|tion\."


def filters(spark: SparkSession, folder: str) -> DataFrame:
    kept = br.filtered(events(spark, folder), FILTERS)
    return kept.withColumn("status", status_label("status")).select("id", "job", "freelance", "years_exp", "status")


def date_range(spark: SparkSession, folder: str) -> DataFrame:
    kept = br.filtered(orders(spark, folder), MONTH)
    return kept.select("id", F.col("applied_at").cast("string").alias("applied_at"))


def search(spark: SparkSession, folder: str) -> DataFrame:
    resumes = documents(spark, folder).withColumnRenamed("title", "first_line")
    resumes = resumes.withColumns({"title": F.col("text"), "years_exp": F.lit(0.0)})
    return br.filtered(resumes, BrowseSpec(search_column="title", search=SEARCH)).select("id", "first_line")


def loose_equality(spark: SparkSession, folder: str) -> DataFrame:
    resumes = documents(spark, folder).withColumn("years_exp", F.lit(0.0))
    return br.filtered(resumes, BrowseSpec(job="thé")).select("id", "job")


def loose_order(spark: SparkSession, folder: str) -> DataFrame:
    page = br.in_order(documents(spark, folder).select("id", "job"), WORDS.sort)
    return page.offset(WORDS.page * WORDS.page_size).limit(WORDS.page_size)


def _listing(df: DataFrame) -> DataFrame:
    return df.withColumn("applied_at", F.col("applied_at").cast("string"))


def sorted_page(spark: SparkSession, folder: str) -> DataFrame:
    """The second page of a listing by two columns."""
    spec = BrowseSpec(sort=(("phone", False), ("years_exp", True)), page=1)
    return br.browse(orders(spark, folder), spec).select("id", "phone")


def page(spark: SparkSession, folder: str) -> DataFrame:
    return _listing(br.browse(orders(spark, folder), SORTED))


def page_after(spark: SparkSession, folder: str) -> DataFrame:
    """The page behind order 0, wherever that one is in the listing."""
    rows = orders(spark, folder)
    seen = rows.where(F.col("id") == 0).select("job", "years_exp", "id").first()
    return _listing(br.browse_after(rows, SORTED, seen.asDict()))


def lookup(spark: SparkSession, folder: str) -> DataFrame:
    files = documents(spark, folder).select("id", F.encode("text", "UTF-8").alias("cv"))
    found = br.lookup(orders(spark, folder), files, 42)
    return found.select(F.decode("cv", "UTF-8").alias("cv"), "name", "job")


def nobody(spark: SparkSession, folder: str) -> DataFrame:
    """A page no row is on keeps its columns; an incomplete range of days selects nothing away."""
    spec = BrowseSpec(job="1-urgent", days=(date(1997, 1, 1),), experience=(99, 100))
    return _listing(br.browse(orders(spark, folder), spec))


def open_range(spark: SparkSession, folder: str) -> DataFrame:
    """An incomplete range of days is ignored."""
    return br.total(orders(spark, folder), BrowseSpec(job="1-urgent", days=(date(1997, 1, 1),), experience=(5, 30)))


QUERIES = {
    "br_nobody": nobody,
    "br_open_range": open_range,
    "br_filters": filters,
    "br_date_range": date_range,
    "br_search": search,
    "br_collate_eq": loose_equality,
    "br_collate_sort": loose_order,
    "br_sort": sorted_page,
    "br_page": page,
    "br_after": page_after,
    "br_total": lambda spark, folder: br.total(orders(spark, folder), BrowseSpec(job="1-urgent", experience=(5, 30))),
    "br_jobs": lambda spark, folder: br.distinct_jobs(orders(spark, folder)),
    "br_lookup": lookup,
}

_PAGE_COLUMNS = f"""CAST(applied_at AS VARCHAR) AS applied_at, job, name, coalesce(phone, '') AS phone,
  years_exp, {STATUS_LABEL} AS status, CAST(id AS VARCHAR) AS id"""

SQL = {
    "br_filters": f"""WITH {EVENTS}
SELECT id, job, freelance, years_exp, '📨 Formulaire envoyé' AS status FROM applications
WHERE status = 1 AND applied_at BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-26 00:00:00'
  AND strip_accents(lower(job)) = 'purchase' AND freelance = 'OUI' AND years_exp BETWEEN 0 AND 25""",
    "br_date_range": f"""WITH {ORDERS}
SELECT id, CAST(applied_at AS VARCHAR) AS applied_at FROM applications
WHERE applied_at BETWEEN TIMESTAMP '1997-01-01 00:00:00' AND TIMESTAMP '1997-01-31 00:00:00' + INTERVAL 1 DAY
  AND years_exp BETWEEN -1 AND 30""",
    "br_search": rf"""WITH {DOCUMENTS}
SELECT id, title AS first_line FROM resumes
WHERE regexp_matches(text, '(^|[^\p{{L}}\p{{N}}_])onion|éaux? (le|la)($|[^\p{{L}}\p{{N}}_])|tion\.', 'i')""",
    "br_collate_eq": f"""WITH {DOCUMENTS}
SELECT id, job FROM resumes WHERE strip_accents(lower(job)) = 'the'""",
    "br_collate_sort": f"""WITH {DOCUMENTS}
SELECT id, job FROM resumes
ORDER BY replace(strip_accents(lower(job)), 'ß', 'ss'), id LIMIT 100 OFFSET 100""",
    "br_sort": f"""WITH {ORDERS}
SELECT CAST(id AS VARCHAR) AS id, coalesce(phone, '') AS phone FROM applications WHERE years_exp BETWEEN -1 AND 30
ORDER BY phone DESC NULLS LAST, years_exp, id LIMIT 20 OFFSET 20""",
    "br_page": f"""WITH {ORDERS}
SELECT {_PAGE_COLUMNS} FROM (SELECT * FROM applications WHERE years_exp BETWEEN -1 AND 30
  ORDER BY job DESC, years_exp, id LIMIT 20 OFFSET 60)""",
    "br_after": f"""WITH {ORDERS},
seen AS (SELECT job AS j, years_exp AS y, id AS i FROM applications WHERE id = 0)
SELECT {_PAGE_COLUMNS} FROM (SELECT applications.* FROM applications, seen WHERE years_exp BETWEEN -1 AND 30
  AND (job < j OR (job = j AND (years_exp > y OR (years_exp = y AND id > i))))
  ORDER BY job DESC, years_exp, id LIMIT 20)""",
    "br_total": f"""WITH {ORDERS}
SELECT count(*) AS n_rows, CAST(ceil(count(*) / 20.0) AS BIGINT) AS n_pages FROM applications
WHERE lower(job) = '1-urgent' AND years_exp BETWEEN 5 AND 30""",
    "br_nobody": f"WITH {ORDERS} SELECT {_PAGE_COLUMNS} FROM applications WHERE years_exp BETWEEN 99 AND 100",
    "br_open_range": f"""WITH {ORDERS}
SELECT count(*) AS n_rows, CAST(ceil(count(*) / 20.0) AS BIGINT) AS n_pages FROM applications
WHERE lower(job) = '1-urgent' AND years_exp BETWEEN 5 AND 30""",
    "br_jobs": f"WITH {ORDERS} SELECT DISTINCT job FROM applications",
    "br_lookup": f"""WITH {ORDERS}
SELECT text AS cv, name, job FROM applications LEFT JOIN documents ON doc_id = id WHERE id = 42""",
}
