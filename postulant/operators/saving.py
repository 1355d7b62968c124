"""Saving an edited page while others edit the same rows.

Each value is compared three ways: as the page showed it, as it was edited, and as it is
stored now. A value that only the editor changed is saved; one that only others changed
stays theirs; if both changed it, to different values, the row is a conflict and nothing
of it is saved.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postulant.functions.status import status_code
from postulant.operators.browse import present
from postulant.operators.upsert import broadcast_if_small, last_edits

SAVED, UNCHANGED, CONFLICT, GONE = "saved", "unchanged", "conflict", "gone"


def three_way(stored: DataFrame, shown: DataFrame, edited: DataFrame) -> DataFrame:
    """One row per shown row: what becomes of its edit.

    `shown` and `edited` are in the form of `browse.present`, `stored` is the table.
    Result: id, `state` (saved, unchanged, conflict, or gone if the row was deleted while it
    was edited), the edited columns with the values to store, and `conflicts`, an
    array of (column, shown, edited, stored) as texts. Edits of rows that the page did not
    show count as no edits.
    """
    columns = [c for c in edited.columns if c != "id" and c in shown.columns]
    page = last_edits(shown.select("id", *columns))
    mine = last_edits(edited.select("id", *columns))
    renamed = [mine.select("id", *[F.col(c).try_cast(shown.schema[c].dataType).alias(f"_mine_{c}") for c in columns])]
    renamed.append(page.select("id", *[F.col(c).alias(f"_base_{c}") for c in columns]))
    pairs = renamed[0].join(broadcast_if_small(renamed[1]), "id")
    wanted = broadcast_if_small(pairs)
    now = present(stored).select(F.col("id"), F.lit(True).alias("_held"), *[F.col(c).alias(f"_now_{c}") for c in columns])
    # Pages are small beside the table: the table is scanned for their rows, not shuffled.
    found = now.join(broadcast_if_small(pairs.select("id")), "id", "left_semi")
    rows = wanted.join(found, "id", "left")

    def part(kind: str, c: str) -> Column:
        return F.col(f"_{kind}_{c}")

    changed = {c: ~part("mine", c).eqNullSafe(part("base", c)) for c in columns}
    clash = {c: changed[c] & ~part("now", c).eqNullSafe(part("base", c)) & ~part("now", c).eqNullSafe(part("mine", c)) for c in columns}
    news = {c: changed[c] & ~part("now", c).eqNullSafe(part("mine", c)) for c in columns}
    told = [
        F.when(clash[c], F.struct(F.lit(c).alias("column"), *[part(k, c).cast("string").alias(n) for k, n in (("base", "shown"), ("mine", "edited"), ("now", "stored"))]))
        for c in columns
    ]
    held = F.col("_held").isNotNull()
    state = (
        F.when(~held, F.when(_any(changed), GONE).otherwise(UNCHANGED))
        .when(_any(clash), CONFLICT)
        .when(_any(news), SAVED)
        .otherwise(UNCHANGED)
    )
    kept = [F.when(changed[c], part("mine", c)).otherwise(F.when(held, part("now", c)).otherwise(part("base", c))).alias(c) for c in columns]
    conflicts = F.when(held, F.array_compact(F.array(*told))).otherwise(F.array_compact(F.array(*[F.when(F.lit(False), t) for t in told])))
    return rows.select("id", state.alias("state"), *kept, conflicts.alias("conflicts"))


def _any(flags: dict[str, Column]) -> Column:
    return reduce(or_, flags.values(), F.lit(False))


def to_store(outcome: DataFrame) -> DataFrame:
    """The rows to save, in the table's own form: status as code, no text for a missing phone."""
    rows = outcome.where(F.col("state") == SAVED).drop("state", "conflicts")
    forms = {"status": status_code("status"), "phone": F.when(F.col("phone") != "", F.col("phone"))}
    return rows.withColumns({c: form for c, form in forms.items() if c in rows.columns})
