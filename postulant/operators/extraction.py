"""Ask an external model for the structured fields of a resume."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Ask = Callable[[pd.Series], pd.Series]


def ask_model(
    df: DataFrame,
    make_client: Callable[[], Ask],
    prompt: str = "prompt",
    response: str = "response",
    keep_errors: bool = True,
    error: str | None = None,
) -> DataFrame:
    """Add the model's answer to every row that has a prompt.

    `make_client` runs once per task and returns a function from a series of
    prompts to a series of JSON texts. Only the prompt column travels to Python.
    A client that fails for single prompts returns the exception in their place; only
    if the whole call raises are its prompts asked one by one. With `keep_errors` a
    prompt that fails gets no answer, and so later the default fields; the column
    `error`, if named, then tells why, so that such mails can be held back. Write the
    result before using it further: each new action would ask the model again. Long prompts ask for a lower
    `spark.sql.execution.arrow.maxRecordsPerBatch`.
    """

    def answers(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        ask = make_client()

        def ask_each(prompts: pd.Series) -> list[str | None]:
            found = []
            for text in prompts:
                try:
                    found.append(pd.Series(ask(pd.Series([text]))).iloc[0])
                except Exception as failure:
                    found.append(failure)
            return found

        for prompts in batches:
            sent = prompts[prompts.notna()]
            known = pd.Series([None] * len(prompts), index=prompts.index, dtype=object)
            if len(sent):
                try:
                    known[sent.index] = list(ask(sent))
                except Exception:
                    if not keep_errors:
                        raise
                    known[sent.index] = ask_each(sent)
            failed = known.map(lambda value: isinstance(value, Exception))
            if failed.any() and not keep_errors:
                raise known[failed].iloc[0]
            reasons = known[failed].map(lambda value: f"{type(value).__name__}: {value}").reindex(known.index)
            yield pd.DataFrame({"answer": known.where(~failed, None), "error": reasons.astype(object).where(failed, None)})

    asked = F.pandas_udf(answers, "answer string, error string").asNondeterministic()
    both = df.withColumn("_asked", asked(F.col(prompt)))
    added = {response: F.col("_asked.answer")} | ({error: F.col("_asked.error")} if error else {})
    return both.withColumns(added).drop("_asked")
