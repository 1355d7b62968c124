"""Jump to any page of a sorted listing, read from the range that holds it.

An offset costs a top-k of all rows before the page, and the last page a top-k of the
whole table. A directory holds the number of rows in each range of the sort order. A page
then comes from its own range alone, from the range's nearer end; if that range is still
large, from a directory of the range. The directory belongs to the rows it was made of:
make a new one when they change.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass, replace
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postulant.operators.browse import BrowseSpec, collated, filtered, present
from postulant.operators.ranges import Bound, SortKey, before, range_of, sampled_bounds

RANGES = 256
# A range of more rows gets a directory of its own when a page lies in it.
WHOLE = 100_000


def sort_keys(df: DataFrame, spec: BrowseSpec) -> list[SortKey]:
    """The listing's order, with the id last so that no two rows tie."""
    texts = {field.name for field in df.schema.fields if isinstance(field.dataType, T.StringType)}
    named = [SortKey(column, up, as_key=collated) if column in texts else SortKey(column, up) for column, up in spec.sort]
    return [*named, SortKey("id")]


@dataclass(frozen=True)
class Directory:
    """Rows per range of the listing that a spec selects and sorts; its page does not matter."""

    spec: BrowseSpec
    bounds: tuple[Bound, ...]
    counts: tuple[int, ...]

    def n_rows(self) -> int:
        return sum(self.counts)

    def n_pages(self) -> int:
        return -(-self.n_rows() // self.spec.page_size)


def directory(df: DataFrame, spec: BrowseSpec, ranges: int = RANGES) -> Directory:
    """One pass for the sample and one for the counts; neither sorts or shuffles the rows."""
    return _directory(filtered(df.drop("cv"), spec), spec, ranges)


def _directory(rows: DataFrame, spec: BrowseSpec, ranges: int) -> Directory:
    keys = sort_keys(rows, spec)
    bounds = sampled_bounds(rows, keys, ranges, ["id"])
    counted = rows.groupBy(range_of(rows, keys, bounds).alias("range")).agg(F.count("*").alias("n")).collect()  # a row per range
    counts = {row["range"]: row["n"] for row in counted}
    return Directory(spec, tuple(bounds), tuple(counts.get(i, 0) for i in range(len(bounds) + 1)))


def _reaching(rows: DataFrame, key: SortKey, low: Bound | None, high: Bound | None) -> list[Column]:
    """Plain conditions on the first sort column that all rows between two bounds meet, for the scan to use."""
    if isinstance(rows.schema[key.column].dataType, T.StringType):
        return []
    value, found = F.col(key.column), []
    for bound, least in ((low, key.ascending), (high, not key.ascending)):
        if bound is not None and bound[0] is not None:
            edge = F.lit(bound[0]).cast(rows.schema[key.column].dataType)
            reached = value >= edge if least else value <= edge
            # Missing values lie beyond one of the bounds.
            found.append(reached | value.isNull() if (bound is low) != key.first() else reached)
    return found


def jump(df: DataFrame, made: Directory, page: int) -> DataFrame:
    """One page as `browse` shows it, from the range that holds it."""
    spec = replace(made.spec, page=page)
    rows = filtered(df.drop("cv"), spec)
    return present(_between(rows, made, page * spec.page_size, spec.page_size))


def _between(rows: DataFrame, made: Directory, start: int, size: int) -> DataFrame:
    keys = sort_keys(rows, made.spec)
    ends = list(accumulate(made.counts))
    size = max(min(size, made.n_rows() - start), 0)
    if size == 0:
        return rows.limit(0)
    first, last = bisect_right(ends, start), bisect_right(ends, start + size - 1)
    skip, held = start - (ends[first] - made.counts[first]), sum(made.counts[first : last + 1])
    low = made.bounds[first - 1] if first else None
    high = made.bounds[last] if last < len(made.bounds) else None
    for condition in _reaching(rows, keys[0], low, high):
        rows = rows.where(condition)
    if low is not None:
        rows = rows.where(~before(rows, keys, low))
    if high is not None:
        rows = rows.where(before(rows, keys, high))
    if held > WHOLE and len(made.bounds) > 0:
        return _between(rows, _directory(rows, made.spec, RANGES), skip, size)
    forwards = [key.order() for key in keys]
    if 2 * skip + size <= held:
        return rows.orderBy(*forwards).offset(skip).limit(size)
    behind = held - skip - size
    return rows.orderBy(*[key.order(backwards=True) for key in keys]).offset(behind).limit(size).orderBy(*forwards)
