"""Filtered, sorted, paged listing of candidates.

Texts compare and sort the French way, blind to case and accents. The collation
is applied inside each comparison only; stored columns keep their plain type, so
regular expressions and scan filters go on working.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postulant.functions.dates import within_days
from postulant.functions.status import status_code, status_label
from postulant.operators.upsert import changed_rows
from postulant.schema import ALL, EXPERIENCE_RANGE, NO, PAGE_SIZE, SEARCHABLE, STATUS_LABELS, YES

COLLATION = "fr_CI_AI"  # fixed value


@dataclass(frozen=True)
class BrowseSpec:
    """What a listing shows. Every default except the experience range filters nothing."""

    status: str = ALL
    days: tuple[date, ...] = ()
    job: str = ALL
    freelance: str = ALL
    experience: tuple[float, float] = EXPERIENCE_RANGE
    search_column: str = SEARCHABLE[0]
    search: str = ""
    sort: tuple[tuple[str, bool], ...] = ()  # (column, ascending)
    page: int = 0
    page_size: int = PAGE_SIZE


def collated(text: Column) -> Column:
    """A text as it is compared and sorted."""
    return F.collate(text, COLLATION)


def loosely_equal(column: str, value: str) -> Column:
    return collated(F.col(column)) == F.lit(value)


def matches(column: str, pattern: str) -> Column:
    """Case-insensitive search anywhere in one of the searchable columns."""
    if column not in SEARCHABLE:
        raise ValueError(f"cannot search in {column!r}")
    search = "(?iu)" + pattern
    try:  # Spark itself tells whether it knows the pattern, before a job starts
        SparkSession.active().range(1).select(F.lit("").rlike(search)).first()
    except Exception as error:
        raise ValueError(f"no valid search pattern: {pattern!r}") from error
    return F.col(column).rlike(search)


def predicates(df: DataFrame, spec: BrowseSpec) -> dict[str, Column]:
    """One predicate per filtered column; a later one on a column replaces an earlier one."""
    chosen: dict[str, Column | None] = {}
    if spec.status != ALL:
        codes = {label: code for code, label in STATUS_LABELS.items()}
        chosen["status"] = F.col("status") == codes[spec.status]
    chosen["applied_at"] = within_days(df, "applied_at", spec.days, through_midnight=True)
    if spec.job != ALL:
        chosen["job"] = loosely_equal("job", spec.job)
    if spec.freelance in (YES, NO):
        chosen["freelance"] = loosely_equal("freelance", spec.freelance)
    chosen["years_exp"] = F.col("years_exp").between(*spec.experience)
    if spec.search:
        chosen[spec.search_column] = matches(spec.search_column, spec.search)
    return {column: predicate for column, predicate in chosen.items() if predicate is not None}


def filtered(df: DataFrame, spec: BrowseSpec) -> DataFrame:
    """All rows a spec selects."""
    return df.where(reduce(and_, predicates(df, spec).values()))


def _sort_key(df: DataFrame, column: str) -> Column:
    is_text = isinstance(df.schema[column].dataType, T.StringType)
    return collated(F.col(column)) if is_text else F.col(column)


def ordering(df: DataFrame, sort: tuple[tuple[str, bool], ...]) -> list[Column]:
    """Sort columns, with the id last so that no two rows tie. Missing values come first ascending."""
    keys = [_sort_key(df, column).asc() if up else _sort_key(df, column).desc() for column, up in sort]
    return keys + [F.col("id").asc()]


def in_order(df: DataFrame, sort: tuple[tuple[str, bool], ...] = ()) -> DataFrame:
    return df.orderBy(*ordering(df, sort))


def present(df: DataFrame) -> DataFrame:
    """Display form: phone and id as text, status as label, no file, id last."""
    shown = df.drop("cv").withColumns({
        "phone": F.coalesce(F.col("phone").cast("string"), F.lit("")),
        "id": F.col("id").cast("string"),
        "status": status_label("status"),
    })
    return shown.select(*[c for c in shown.columns if c != "id"], "id")


def edits_of(shown: DataFrame, edited: DataFrame) -> DataFrame:
    """Rows of an edited page that differ from the page as shown, in their stored form."""
    stored = {"status": status_code("status"), "phone": F.when(F.col("phone") != "", F.col("phone"))}
    return changed_rows(shown, edited).withColumns(stored)


def browse(df: DataFrame, spec: BrowseSpec = BrowseSpec()) -> DataFrame:
    """One page. Spark plans sort, offset and limit as a top-k, not as a full sort."""
    rows = in_order(filtered(df.drop("cv"), spec), spec.sort)
    return present(rows.offset(spec.page * spec.page_size).limit(spec.page_size))


def browse_after(df: DataFrame, spec: BrowseSpec, last: dict[str, object]) -> DataFrame:
    """The page behind a given row, which holds the sort columns and the id.

    Unlike an offset, this costs the same on every page.
    """
    rows = filtered(df.drop("cv"), spec)
    behind = []
    tied = F.lit(True)
    for column, up in (*spec.sort, ("id", True)):
        key = _sort_key(rows, column) if column != "id" else F.col("id")
        value = F.lit(last[column])
        if last[column] is None:  # nulls come first ascending, last descending
            further = key.isNotNull() if up else F.lit(False)
            same = key.isNull()
        else:
            further = key > value if up else (key < value) | key.isNull()
            same = key == value
        behind.append(tied & further)
        tied = tied & same
    rows = in_order(rows.where(reduce(or_, behind)), spec.sort)
    return present(rows.limit(spec.page_size))


def total(df: DataFrame, spec: BrowseSpec = BrowseSpec()) -> DataFrame:
    """Number of rows and of pages, under the predicate the pages use."""
    count = filtered(df, spec).agg(F.count("*").alias("n_rows"))
    return count.withColumn("n_pages", F.ceil(F.col("n_rows") / spec.page_size))


def distinct_jobs(df: DataFrame) -> DataFrame:
    return df.select("job").distinct()


def lookup(df: DataFrame, files: DataFrame, candidate_id: object) -> DataFrame:
    """File, name and job of one candidate: one row or none."""
    # The id reaches both scans as a plain filter.
    person = df.where(F.col("id") == F.lit(candidate_id)).select("id", "name", "job")
    file = files.where(F.col("id") == F.lit(candidate_id)).select("id", "cv")
    return person.join(file, "id", "left").select("cv", "name", "job").limit(1)


def sortable_columns(df: DataFrame) -> list[str]:
    return df.columns


def turn_page(page: int, move: str, rows_shown: int, n_pages: int, page_size: int = PAGE_SIZE) -> int:
    """Page reached by `first`, `previous`, `next` or `last`.

    The next page opens only behind a full page, the previous one not before the first.
    """
    if move == "first":
        return 0
    if move == "previous":
        return max(page - 1, 0)
    if move == "next":
        return page + 1 if rows_shown == page_size else page
    if move == "last":
        return max(n_pages - 1, 0)
    raise ValueError(f"unknown move {move!r}")
