"""Answers of the external model, kept by the digest of the prompt.

Asking costs money and quota, so each distinct prompt is asked once over all loads: copies
of a mail, repeated loads and lost jobs find its answer here. A prompt that failed is asked
again after a pause that grows with each attempt, until the attempts are used up.

Rows are only ever appended, one per attempt, in folders by the first digits of the digest;
the row with the most attempts counts. A batch reads the folders of its own prompts.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postulant.operators.extraction import Ask, ask_model
from postulant.operators.upsert import broadcast_if_small
from postulant.session import work_folder
from postulant.sources.files import few_rows, listed

# Seconds until a failed prompt may be asked again, after each attempt; there are no more attempts.
WAITS = (30, 60, 120, 240, 480)

ANSWERS = "digest string, answer string, error string, attempts int, next_try timestamp"
# Prompts asked between two commits, about; what is committed is never asked again.
COMMITTED = 10_000


def digest(prompt: Column | str) -> Column:
    return F.sha2(F.encode(F.col(prompt) if isinstance(prompt, str) else prompt, "UTF-8"), 256)


class AnswerTable:
    def __init__(self, spark: SparkSession, root: str, waits: Sequence[int] = WAITS, prefix_digits: int = 2):
        self.spark = spark
        self.root = root
        self.waits = tuple(waits)
        self.prefix = F.substring("digest", 1, prefix_digits)

    def read(self) -> DataFrame:
        """Every attempt."""
        found = [name for name in listed(self.spark, self.root) if name.startswith("prefix=")]
        if not found:
            return few_rows(self.spark, [], f"{ANSWERS}, prefix string")
        return self.spark.read.schema(f"{ANSWERS}, prefix string").parquet(self.root)

    def known(self, digests: DataFrame) -> DataFrame:
        """The last attempt for each of the given digests that was ever asked."""
        wanted = {row[0] for row in digests.select(self.prefix).distinct().collect()}  # at most as many as folders
        rows = self.read().where(F.col("prefix").isin(sorted(wanted))).drop("prefix")
        asked = rows.join(broadcast_if_small(digests.select("digest")), "digest", "left_semi")
        last = asked.groupBy("digest").agg(F.max_by(F.struct("answer", "error", "attempts", "next_try"), "attempts").alias("last"))
        return last.select("digest", "last.*")

    def due(self, prompts: DataFrame, now: datetime) -> DataFrame:
        """(digest, prompt, attempts so far) of the distinct prompts to ask at a moment."""
        known = self.known(prompts).select("digest", "answer", "attempts", "next_try")
        open_ = F.col("answer").isNull() & (F.coalesce("attempts", F.lit(0)) < len(self.waits))
        later = F.coalesce(F.col("next_try") > F.lit(now), F.lit(False))
        paired = prompts.join(broadcast_if_small(known), "digest", "left").where(open_ & ~later)
        return paired.select("digest", "prompt", F.coalesce("attempts", F.lit(0)).alias("attempts"))

    def ask(
        self,
        df: DataFrame,
        make_client: Callable[[], Ask],
        prompt: str = "prompt",
        response: str = "response",
        error: str = "error",
        now: datetime | None = None,
    ) -> DataFrame:
        """Adds the model's answer to every row with a prompt, and the error of a prompt without one.

        Only prompts without an answer that are due are asked, each once however many
        rows have it. They are asked in slices by digest and each slice is committed, so a
        job that is lost has asked no more than one slice in vain.
        """
        now = now or datetime.now()
        place = work_folder(self.spark, "prompts")
        named = df.where(F.col(prompt).isNotNull()).select(digest(prompt).alias("digest"), F.col(prompt).alias("prompt"))
        named.groupBy("digest").agg(F.first("prompt").alias("prompt")).write.parquet(f"{place}/all")
        prompts = self.spark.read.schema("digest string, prompt string").parquet(f"{place}/all")
        self.due(prompts, now).write.parquet(f"{place}/due")
        due = self.spark.read.schema("digest string, prompt string, attempts int").parquet(f"{place}/due")
        n = due.count()
        slices = max(1, -(-n // COMMITTED))
        waits = F.element_at(F.array(*[F.lit(w) for w in self.waits]), F.col("attempts"))
        for k in range(slices if n else 0):
            part = due.where(F.pmod(F.xxhash64("digest"), F.lit(slices)) == k)
            # Several tasks ask at once, whatever the size of the written files.
            spread = part.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions", "200")), "digest")
            asked = ask_model(spread, make_client, response="answer", error="error").withColumn("attempts", F.col("attempts") + 1)
            wait = F.when(F.col("answer").isNull(), F.lit(now) + F.make_dt_interval(secs=waits))
            rows = asked.select("digest", "answer", "error", "attempts", wait.cast("timestamp").alias("next_try"))
            placed = rows.withColumn("prefix", self.prefix).hint("rebalance", F.col("prefix"))
            placed.write.mode("append").partitionBy("prefix").parquet(self.root)
        known = self.known(prompts).select(F.col("digest").alias("_digest"), F.col("answer").alias("_answer"), F.col("error").alias("_error"))
        joined = df.drop(response, error).withColumn("_of", digest(prompt)).join(broadcast_if_small(known), F.col("_of") == F.col("_digest"), "left")
        return joined.withColumns({response: F.col("_answer"), error: F.col("_error")}).drop("_of", "_digest", "_answer", "_error")
