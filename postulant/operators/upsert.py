"""Insert-if-absent, update and delete as joins that yield the new table content."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postulant.schema import NATURAL_KEY

# A side may be broadcast up to this many bytes of content and this many rows.
BROADCAST_BYTES = 32 << 20
BROADCAST_ROWS = 1_000_000


def fits_broadcast(df: DataFrame) -> bool:
    """Whether a side is small enough to send to every executor. Runs one small count."""
    widths = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)).cast("long") for c in df.columns]
    size = df.agg(F.count("*").alias("n"), F.sum(reduce(add, widths)).alias("bytes")).first()
    return size["n"] <= BROADCAST_ROWS and (size["bytes"] or 0) <= BROADCAST_BYTES


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """Hint a broadcast behind a size check; a larger side is left to Spark's own choice."""
    return F.broadcast(df) if fits_broadcast(df) else df


def has_key(df: DataFrame, keys: Sequence[str] = NATURAL_KEY) -> Column:
    """True if every key column is filled, else false (never null)."""

    def filled(key: str) -> Column:
        present = F.col(key).isNotNull()
        is_text = isinstance(df.schema[key].dataType, T.StringType)
        return present & (F.col(key) != "") if is_text else present

    return reduce(and_, [filled(key) for key in keys])


def earliest_per_key(batch: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of every key.

    Spark keeps one row per key and task before the shuffle (WindowGroupLimit), so
    a key with very many rows does not fill one task.
    """
    first, *ties = order
    window = W.partitionBy(*keys).orderBy(F.col(first).asc_nulls_last(), *ties)
    ranked = batch.withColumn("_place", F.row_number().over(window))
    return ranked.where(F.col("_place") == 1).drop("_place")


def known_keys(batch: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys in the table that matter for a batch.

    A small batch is sent to the table's scan, so that the table is not shuffled
    for it. Otherwise the keys are made distinct per task and then shuffled.
    """
    stored = existing.select(*keys)
    wanted = batch.select(*keys)
    if fits_broadcast(wanted):
        stored = stored.join(F.broadcast(wanted), list(keys), "left_semi")
    return stored.distinct()


def insert_if_absent(
    batch: DataFrame,
    existing: DataFrame,
    keys: Sequence[str] = NATURAL_KEY,
    order: Sequence[str] = ("applied_at", "filename"),
) -> DataFrame:
    """The rows of a batch to append.

    Of several rows with one key the earliest stays, unless the table has that key.
    Rows with an empty key part are all new. They take no part in the joins, so
    they cannot pile up in one task either.
    """
    keyed = batch.where(has_key(batch, keys))
    return absent_rows(batch, known_keys(keyed, existing, keys), keys, order)


def absent_rows(
    batch: DataFrame,
    known: DataFrame,
    keys: Sequence[str] = NATURAL_KEY,
    order: Sequence[str] = ("applied_at", "filename"),
) -> DataFrame:
    """The rows of `insert_if_absent`, given the keys among the batch's that the table has."""
    keyed = batch.where(has_key(batch, keys))
    fresh = earliest_per_key(keyed, keys, order).join(known, list(keys), "left_anti")
    return fresh.unionByName(batch.where(~has_key(batch, keys)))


def delete_by_id(base: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return base.join(broadcast_if_small(ids.select(key)), key, "left_anti")


def last_edits(edits: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """One edit per id: the latest by `order`; without an order the largest by its columns, so that every run keeps the same."""
    if order is None:
        whole = F.struct(*[c for c in edits.columns if c != key])
        return edits.groupBy(key).agg(F.max(whole).alias("_edit")).select(key, "_edit.*")
    columns = [c for c in edits.columns if c not in (key, order)]
    newest = edits.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("_edit"))
    return newest.select(key, "_edit.*")


def _paired(
    base: DataFrame, edits: DataFrame, key: str, order: str | None, how: str
) -> tuple[DataFrame, dict[str, Column]]:
    """Base rows beside their edit, and the edited value per supplied column."""
    edits = last_edits(edits, key, order)
    columns = [c for c in edits.columns if c != key and c in base.columns]
    renamed = edits.select(key, F.lit(True).alias("_edited"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    # Bad dates and numbers become null instead of failing the job.
    new = {c: F.col(f"_new_{c}").try_cast(base.schema[c].dataType) for c in columns}
    return base.join(broadcast_if_small(renamed), key, how), new


def changed_rows(base: DataFrame, edits: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """Base rows whose edit differs in at least one column, in their new form."""
    paired, new = _paired(base, edits, key, order, "inner")
    differs = reduce(or_, [~F.col(c).eqNullSafe(value) for c, value in new.items()])
    return paired.where(differs).select(*[new.get(c, F.col(c)).alias(c) for c in base.columns])


def update_by_id(base: DataFrame, edits: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """The whole table with every supplied column overwritten; unknown ids do nothing."""
    paired, new = _paired(base, edits, key, order, "left")
    edited = F.col("_edited").isNotNull()
    return paired.select(*[
        F.when(edited, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in base.columns
    ])
