"""Import new mails as they arrive."""

from __future__ import annotations

from datetime import datetime, time, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from postulant.plans.ingest import finished, keyed
from postulant.sources.candidates import CandidateStore


def insert_recent(store: CandidateStore, batch: DataFrame, load_id: str, keep: timedelta, **options) -> None:
    """Insert the applications of a batch that are not past their time, after removing the stored ones that are.

    An application is kept for `keep`, counted back from the end of the newest day seen, stored or in the batch;
    days that are yet to come do not count. The moment does not depend on the load's own earlier attempt, and removal
    comes first, so a repeated load ends with the same table. Undated applications stay.
    """
    latest = batch.where(F.col("applied_at") <= F.current_timestamp()).agg(F.to_date(F.max("applied_at"))).first()[0]
    stored = store.newest_day(apart_from=load_id)
    days = [day for day in (latest, stored and min(stored, datetime.now().date())) if day]
    if not days:
        return store.insert(batch, load_id, **options)
    limit = datetime.combine(max(days), time()) + timedelta(days=1) - keep
    store.retire(limit)
    recent = F.coalesce(F.col("applied_at") >= F.lit(str(limit)).cast("timestamp"), F.lit(True))
    store.insert(batch.where(recent), load_id, **options)


def import_stream(
    messages: DataFrame, store: CandidateStore, checkpoint: str, source: str, store_cv: bool = False, keep: timedelta | None = None
) -> StreamingQuery:
    """Import everything a stream of decoded mails holds now, then stop.

    The candidate table is the only state, so no watermark is needed. Each
    micro-batch is its own load: if Spark repeats one after a failure, it replaces
    its first attempt. Loads are named by `source`, by the identity that Spark keeps in
    the checkpoint, and by number, so another checkpoint never replaces them. With `keep`, each
    micro-batch also removes applications that are older (see `insert_recent`).
    """

    def insert(batch: DataFrame, number: int) -> None:
        identity = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        if not identity:
            raise RuntimeError("the stream has no identity, so its loads cannot be told from those of others")
        load_id = f"{source}-{identity}-{number:010d}"
        if keep is None:
            store.insert(keyed(batch), load_id, store_cv, finish=finished)
        else:
            insert_recent(store, keyed(batch), load_id, keep, store_cv=store_cv, finish=finished)

    return (
        messages.writeStream.foreachBatch(insert)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
