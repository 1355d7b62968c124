"""Counts by job and calendar period, over events."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postulant.catalogue.standins import EVENTS, events, table
from postulant.functions.dates import calendar_part, to_moment
from postulant.operators import statistics as st

DAYS = (date(2024, 1, 10), date(2024, 1, 20))


def date_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Calendar parts of dates that arrive as text, some of them unreadable."""
    text = F.when(F.col("event_type") == "error", F.concat(F.lit("le "), F.col("ts").cast("string"))).otherwise(
        F.col("ts").cast("string")
    )
    moments = table(spark, folder, "events").select("event_id", to_moment(text).alias("moment"))
    parts = [calendar_part("moment", period).alias(period) for period in ("year", "month", "day")]
    return moments.select("event_id", *parts)


def date_range(spark: SparkSession, folder: str) -> DataFrame:
    return st.count_by_job_and_period(st.filter_applications(events(spark, folder), days=DAYS), "day")


def job_filter(spark: SparkSession, folder: str) -> DataFrame:
    return st.count_by_job_and_period(st.filter_applications(events(spark, folder), job="click"), "month")


def job_month(spark: SparkSession, folder: str) -> DataFrame:
    """The flagship: counts by job and month within a date range."""
    return st.count_by_job_and_period(st.filter_applications(events(spark, folder), days=DAYS), "month")


QUERIES = {
    "st_total": lambda spark, folder: st.count_by_job(events(spark, folder)),
    "st_job_year": lambda spark, folder: st.count_by_job_and_period(events(spark, folder), "year"),
    "st_job_month": lambda spark, folder: st.count_by_job_and_period(events(spark, folder), "month"),
    "st_job_day": lambda spark, folder: st.count_by_job_and_period(events(spark, folder), "day"),
    "st_year": lambda spark, folder: st.count_by_period(events(spark, folder), "year"),
    "st_month": lambda spark, folder: st.count_by_period(events(spark, folder), "month"),
    "st_day": lambda spark, folder: st.count_by_period(events(spark, folder), "day"),
    "st_calendar": lambda spark, folder: st.count_by_every_period(events(spark, folder)),
    "st_jobs": lambda spark, folder: st.listed_jobs(events(spark, folder)),
    "st_date_range": date_range,
    "st_job_filter": job_filter,
    "dt_parts": date_parts,
}

_FORMATS = {
    "year": "CAST(year(applied_at) AS INTEGER)",
    "month": "strftime(applied_at, '%Y-%m')",
    "day": "strftime(applied_at, '%Y-%m-%d')",
}
_IN_RANGE = """applied_at >= TIMESTAMP '2024-01-10 00:00:00'
  AND applied_at <= TIMESTAMP '2024-01-20 00:00:00' + INTERVAL 1 DAY - INTERVAL 1 SECOND"""


def _by_job(period: str, condition: str = "true") -> str:
    return f"""WITH {EVENTS}
SELECT job, {_FORMATS[period]} AS {period}, count(*) AS n FROM applications
WHERE job IS NOT NULL AND applied_at IS NOT NULL AND {condition} GROUP BY 1, 2"""


def _by_period(period: str) -> str:
    return f"""WITH {EVENTS}
SELECT {_FORMATS[period]} AS {period}, count(*) AS n FROM applications
WHERE applied_at IS NOT NULL GROUP BY 1"""


SQL = {
    "st_total": f"WITH {EVENTS} SELECT job, count(*) AS n FROM applications WHERE job IS NOT NULL GROUP BY job",
    "st_job_year": _by_job("year"),
    "st_job_month": _by_job("month"),
    "st_job_day": _by_job("day"),
    "st_year": _by_period("year"),
    "st_month": _by_period("month"),
    "st_day": _by_period("day"),
    "st_calendar": f"""WITH {EVENTS},
labels AS (SELECT unnest([
    {{'period': 'year', 'label': CAST(year(applied_at) AS VARCHAR)}},
    {{'period': 'month', 'label': {_FORMATS['month']}}},
    {{'period': 'day', 'label': {_FORMATS['day']}}}]) AS x
  FROM applications WHERE applied_at IS NOT NULL)
SELECT x.period AS period, x.label AS label, count(*) AS n FROM labels GROUP BY 1, 2""",
    "st_jobs": f"WITH {EVENTS} SELECT DISTINCT job FROM applications WHERE job IS NOT NULL",
    "st_date_range": _by_job("day", _IN_RANGE),
    "st_job_filter": _by_job("month", "job = 'click'"),
    "dt_parts": """WITH moments AS (
  SELECT event_id, try_cast(CASE WHEN event_type = 'error' THEN 'le ' || CAST(ts AS VARCHAR)
                                 ELSE CAST(ts AS VARCHAR) END AS TIMESTAMP) AS moment FROM events)
SELECT event_id, CAST(year(moment) AS INTEGER) AS year, strftime(moment, '%Y-%m') AS month,
       strftime(moment, '%Y-%m-%d') AS day FROM moments""",
}
