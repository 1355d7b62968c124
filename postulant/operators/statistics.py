"""Counts of applications by job and calendar period.

Grouping happens on plain dates and the labels are formatted afterwards, once per
group. Rows without a job or a date do not count wherever that column is a key.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postulant.functions.dates import PERIODS, period_label, period_start, within_days
from postulant.schema import ALL


def filter_applications(df: DataFrame, job: str = ALL, days: tuple[date, ...] = ()) -> DataFrame:
    """Exact job and date range. The range ends one second before midnight."""
    kept = df if job == ALL else df.where(F.col("job") == job)
    in_range = within_days(df, "applied_at", days, through_midnight=False)
    return kept if in_range is None else kept.where(in_range)


def count_by_job(df: DataFrame) -> DataFrame:
    """Applications per job, most first."""
    counts = df.where(F.col("job").isNotNull()).groupBy("job").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "job")


def count_by_job_and_period(df: DataFrame, period: str) -> DataFrame:
    dated = df.where(F.col("job").isNotNull() & F.col("applied_at").isNotNull())
    counts = dated.groupBy("job", period_start("applied_at", period).alias("start")).agg(F.count("*").alias("n"))
    return counts.select("job", period_label("start", period).alias(period), "n").orderBy("job", period)


def count_by_period(df: DataFrame, period: str) -> DataFrame:
    dated = df.where(F.col("applied_at").isNotNull())
    counts = dated.groupBy(period_start("applied_at", period).alias("start")).agg(F.count("*").alias("n"))
    return counts.select(period_label("start", period).alias(period), "n").orderBy(period)


def count_by_every_period(df: DataFrame) -> DataFrame:
    """Year, month and day counts from a single scan.

    Days are counted first; months and years add up those few day counts.
    """
    days = (
        df.where(F.col("applied_at").isNotNull())
        .groupBy(period_start("applied_at", "day").alias("day_start"))
        .agg(F.count("*").alias("n"))
    )
    labels = [
        F.struct(F.lit(period).alias("period"), calendar.alias("label"))
        for period in PERIODS
        for calendar in [period_label(period_start("day_start", period), period).cast("string")]
    ]
    spread = days.select("n", F.inline(F.array(*labels)))
    return spread.groupBy("period", "label").agg(F.sum("n").alias("n")).orderBy("period", "label")


def listed_jobs(df: DataFrame) -> DataFrame:
    """Distinct jobs, sorted, without null."""
    return df.where(F.col("job").isNotNull()).select("job").distinct().orderBy("job")


# ---- Maintained counts: (job, day, n) rows, as `CandidateStore.counts` keeps them; they are only added up. ----


def filter_counts(counts: DataFrame, job: str = ALL, days: tuple[date, ...] = ()) -> DataFrame:
    """Exact job and closed range of days. Counts know days only, so the last second of a day belongs to it."""
    kept = counts if job == ALL else counts.where(F.col("job") == job)
    return kept if len(days) != 2 else kept.where(F.col("day").between(*[F.lit(day) for day in days]))


def merged_by_job(counts: DataFrame) -> DataFrame:
    """Applications per job, most first."""
    merged = counts.where(F.col("job").isNotNull()).groupBy("job").agg(F.sum("n").alias("n"))
    return merged.orderBy(F.desc("n"), "job")


def merged_by_job_and_period(counts: DataFrame, period: str) -> DataFrame:
    dated = counts.where(F.col("job").isNotNull() & F.col("day").isNotNull())
    merged = dated.groupBy("job", period_start("day", period).alias("start")).agg(F.sum("n").alias("n"))
    return merged.select("job", period_label("start", period).alias(period), "n").orderBy("job", period)


def merged_by_period(counts: DataFrame, period: str) -> DataFrame:
    dated = counts.where(F.col("day").isNotNull())
    merged = dated.groupBy(period_start("day", period).alias("start")).agg(F.sum("n").alias("n"))
    return merged.select(period_label("start", period).alias(period), "n").orderBy(period)
