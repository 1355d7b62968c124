"""From decoded mails to candidate rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postulant.functions.answers import normalise_answers
from postulant.functions.attachments import first_attachment, resume_text, resume_type
from postulant.functions.contacts import first_email, first_phone, redact
from postulant.functions.text import (
    DEFAULT_PROMPT,
    fill_prompt,
    freelance_flag,
    header_lines,
    job_from_filename,
    location_in,
    maskable_names,
    name_from_filename,
    one_decimal,
    row_class,
    title_in,
)
from postulant.operators.extraction import Ask, ask_model
from postulant.operators.ranges import SortKey, rank_within
from postulant.schema import CANDIDATES, DEFAULT_STATUS, MESSAGES, NO_EXPERIENCE, NOT_AVAILABLE
from postulant.sources.messages import only_mails


def keyed(messages: DataFrame) -> DataFrame:
    """The mails among the messages, with the fields of their first attachment and what tells applications apart.

    Only the file name is looked at, so rows that need not be imported can go before `finished` reads their texts.
    """
    chosen = first_attachment(only_mails(messages)).drop("attachments")
    return chosen.withColumns({
        "applied_at": F.col("sent_at"),
        "job": job_from_filename("filename"),
        "name": name_from_filename("filename"),
    })


def with_text(chosen: DataFrame) -> DataFrame:
    """Add `text`, which is null without a readable resume and empty without text, and `cv`.

    The bytes of the files are only read if `cv` is used later.
    """
    typed = chosen.withColumn("_kind", resume_type("file_name"))
    return typed.withColumns({
        "text": resume_text("_kind", "file_pages", "file_tables", "file_paragraphs", "file_fallback"),
        "cv": F.when(F.col("_kind").isNotNull(), F.col("file_content")),
    })


def prompts(messages: DataFrame, template: str = DEFAULT_PROMPT) -> DataFrame:
    """Add the model prompt, built from the masked resume; null where there is no text. Only mails stay."""
    mails = only_mails(messages)
    named = with_text(first_attachment(mails)).withColumn("names", maskable_names(name_from_filename("filename")))
    asked = F.when(F.col("text") != "", fill_prompt("redacted", template))
    return redact(named).select(*messages.columns, asked.alias("prompt"))


def answered(
    messages: DataFrame, make_client: Callable[[], Ask], template: str = DEFAULT_PROMPT, error: str | None = None
) -> DataFrame:
    """The mails with the model's answers as their `response`.

    A column `error`, if named, tells why a prompt has no answer. Rows with an error can be held back and
    asked again; imported, they would stay with default fields. Write the answers before the import goes on:
    each new action would ask the model again.
    """
    asked = ask_model(prompts(messages, template), make_client, response="_answer", error=error)
    more = [error] if error else []
    return asked.withColumn("response", F.col("_answer")).select(*[field.name for field in MESSAGES.fields], *more)


def candidates(messages: DataFrame) -> DataFrame:
    """One candidate row per mail, with its `filename` and `cv`."""
    return finished(keyed(messages))


def finished(chosen: DataFrame) -> DataFrame:
    """Candidates from the rows of `keyed`.

    A mail with a readable resume takes contacts from the text and fields from the
    model's answer. Without attachment or text, every such field is "not available".
    """
    staged = with_text(chosen).withColumn("_lines", header_lines("body"))
    read = normalise_answers(staged.select(
        "filename",
        "applied_at",
        "job",
        "name",
        title_in("_lines").alias("title"),
        location_in("_lines").alias("location"),
        "text",
        "cv",
        "response",
    ))
    has_text = F.coalesce(F.col("text") != "", F.lit(False))

    def if_text(value: Column, otherwise: object = NOT_AVAILABLE) -> Column:
        return F.when(has_text, value).otherwise(F.lit(otherwise))

    columns = {
        "email": if_text(first_email("text")),
        "phone": if_text(first_phone("text")),
        "freelance": freelance_flag("title", if_text(F.col("freelance"))),
        "grad_year": if_text(F.col("grad_year")),
        "years_exp": if_text(F.col("years_exp"), float(NO_EXPERIENCE)),
        "companies": if_text(F.col("companies")),
        "skills": if_text(F.col("skills")),
        "status": F.lit(DEFAULT_STATUS),
    }
    names = [field.name for field in CANDIDATES.fields if field.name != "id"]
    return read.withColumns(columns).select("filename", *names, "cv")


def import_order(rows: DataFrame) -> DataFrame:
    """Display order of an import: by job, then date; missing dates come last."""
    return rows.orderBy(F.col("job").asc_nulls_last(), F.col("applied_at").asc_nulls_last(), "filename")


def import_report(rows: DataFrame) -> DataFrame:
    """What an import shows of its candidates: no file, their place within the job, one decimal, a class per row.

    The place follows the date, then the file name; missing dates come last. Rows are ranked within ranges of
    that order, so that neither a large job nor many applications of one moment fill a task.
    """
    keys = [SortKey("applied_at", nulls_first=False), SortKey("filename")]
    placed = rank_within(rows.drop("cv"), "job", keys, identity=["filename"])
    return placed.withColumns({
        "years_exp": one_decimal("years_exp"),
        "row_class": row_class("grad_year", "freelance"),
    })
