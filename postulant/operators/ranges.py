"""Ranges of a sorted order, cut at sampled order statistics.

A bound is the row at which a range begins, as text in the listing's sort columns. The
range of a row is the number of bounds that do not come after it, found by binary search
in an expression of plain columns. So counts and pages agree on the ranges without any
shuffle of the rows, whatever the sort directions, collations and missing values are, and
a value that many rows share is cut by the columns behind it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Sampled rows for each range.
SAMPLED = 32


@dataclass(frozen=True)
class SortKey:
    """One column of a sort order; `as_key` gives what is compared, such as a collated text."""

    column: str
    ascending: bool = True
    nulls_first: bool | None = None
    as_key: Callable[[Column], Column] = lambda value: value

    def first(self) -> bool:
        """Whether missing values come first; by default they do so ascending only."""
        return self.ascending if self.nulls_first is None else self.nulls_first

    def order(self, backwards: bool = False) -> Column:
        key = self.as_key(F.col(self.column))
        if self.ascending != backwards:
            return key.asc_nulls_first() if self.first() != backwards else key.asc_nulls_last()
        return key.desc_nulls_first() if self.first() != backwards else key.desc_nulls_last()

    def before(self, value: Column, other: Column) -> Column:
        """Whether one value of this column comes before another; never null."""
        mine, theirs = self.as_key(value), self.as_key(other)
        nearer = mine < theirs if self.ascending else mine > theirs
        missing = mine.isNull() & theirs.isNotNull() if self.first() else mine.isNotNull() & theirs.isNull()
        return F.coalesce(nearer, F.lit(False)) | missing

    def same(self, value: Column, other: Column) -> Column:
        return self.as_key(value).eqNullSafe(self.as_key(other))


Bound = tuple[str | None, ...]


def _typed(df: DataFrame, keys: Sequence[SortKey], bound: Bound) -> list[Column]:
    return [F.lit(value).cast(df.schema[key.column].dataType) for key, value in zip(keys, bound, strict=True)]


def before(df: DataFrame, keys: Sequence[SortKey], bound: Bound) -> Column:
    """Whether a row comes before a bound."""
    return _before(keys, [F.col(key.column) for key in keys], _typed(df, keys, bound))


def _before(keys: Sequence[SortKey], mine: Sequence[Column], theirs: Sequence[Column]) -> Column:
    ways, tied = [], F.lit(True)
    for key, value, other in zip(keys, mine, theirs, strict=True):
        ways.append(tied & key.before(value, other))
        tied = tied & key.same(value, other)
    return reduce(or_, ways)


def sampled_bounds(df: DataFrame, keys: Sequence[SortKey], ranges: int, identity: Sequence[str]) -> list[Bound]:
    """Bounds of about `ranges` ranges with similar numbers of rows, from a sample of `SAMPLED` rows for each.

    The sample are the rows with the smallest hashes of `identity`, so it is the same in every run.
    At most `ranges` rows reach the driver.
    """
    wanted = list(dict.fromkeys(key.column for key in keys))
    drawn = df.select(*wanted, F.xxhash64(*identity).alias("_drawn")).orderBy("_drawn", *wanted).limit(ranges * SAMPLED)
    placed = drawn.withColumn("_place", F.row_number().over(W.orderBy(*[key.order() for key in keys])))
    chosen = placed.where((F.col("_place") % SAMPLED == 0)).orderBy("_place")
    rows = chosen.select(*[F.col(c).cast("string").alias(c) for c in wanted]).collect()
    return list(dict.fromkeys(tuple(row[key.column] for key in keys) for row in rows))


def range_of(df: DataFrame, keys: Sequence[SortKey], bounds: Sequence[Bound]) -> Column:
    """Number of the range a row lies in, from 0."""
    if not bounds:
        return F.lit(0)
    names = [f"k{i}" for i in range(len(keys))]
    texts = f"array<struct<{', '.join(f'{n}:string' for n in names)}>>"
    kinds = T.ArrayType(T.StructType([T.StructField(n, df.schema[k.column].dataType) for n, k in zip(names, keys, strict=True)]))
    listed = F.from_json(F.lit(json.dumps([dict(zip(names, bound, strict=True)) for bound in bounds])), texts).cast(kinds)

    def narrowed(found: Column, _: Column) -> Column:
        middle = F.floor((found["low"] + found["high"]) / 2).cast("int")
        bound = F.get(found["bounds"], middle)
        left = _before(keys, [F.col(k.column) for k in keys], [bound[n] for n in names])
        open_ = found["low"] < found["high"]
        return F.struct(
            F.when(open_ & ~left, middle + 1).otherwise(found["low"]).alias("low"),
            F.when(open_ & left, middle).otherwise(found["high"]).alias("high"),
            found["bounds"].alias("bounds"),
        )

    # The bounds travel with the search, so the expression names them once.
    whole = F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high"), listed.alias("bounds"))
    steps = F.array(*[F.lit(i) for i in range(len(bounds).bit_length())])
    return F.aggregate(steps, whole, narrowed, lambda found: found["low"])


def rank_within(df: DataFrame, group: str, keys: Sequence[SortKey], identity: Sequence[str], ranges: int = 256) -> DataFrame:
    """Adds `place`: the row's number within its group, from 1, by the sort keys.

    A window per group would put a whole group into one task. Here a window covers one
    range of one group only, and the rows before it are known from counts; a group that
    holds most rows lies in most ranges.
    """
    ordered = [SortKey(group), *keys]
    bounds = sampled_bounds(df, ordered, ranges, identity)
    ranged = df.withColumn("_range", range_of(df, ordered, bounds))
    counts = ranged.groupBy(group, "_range").agg(F.count("*").alias("_n"))
    earlier = W.partitionBy(group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # a row per range
    offsets = counts.select(F.col(group).alias("_group"), F.col("_range").alias("_of"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    within = W.partitionBy(group, "_range").orderBy(*[key.order() for key in keys])
    placed = ranged.withColumn("_place", F.row_number().over(within))
    same = F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_of"))
    joined = placed.join(offsets, same)
    return joined.withColumn("place", (F.col("_before") + F.col("_place")).cast("long")).select(*df.columns, "place")
