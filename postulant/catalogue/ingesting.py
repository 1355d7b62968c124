"""Mails to candidates, over messages made from documents and conversations."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postulant.catalogue.standins import ANSWERS, HEADERS, MESSAGES, messages, table
from postulant.catalogue.texts import email_of, phone_of, redacted
from postulant.functions.answers import normalise_answers
from postulant.functions.attachments import (
    file_extension,
    first_attachment,
    join_pages,
    join_parts,
    resume_text,
    resume_type,
)
from postulant.functions.text import header_lines, job_from_filename, location_in, name_from_filename, title_in
from postulant.operators.upsert import insert_if_absent
from postulant.plans.ingest import answered, candidates, finished, import_report, keyed, prompts
from postulant.schema import CANDIDATES, MESSAGES as MESSAGE_SCHEMA
from postulant.session import work_folder
from postulant.sources.candidates import CandidateStore
from postulant.sources.messages import only_mails, stream_messages
from postulant.streaming.incremental import import_stream

SHOWN = [field.name for field in CANDIDATES.fields if field.name not in ("id", "applied_at")]


def _shown(rows: DataFrame, *more: str) -> DataFrame:
    moment = F.date_format("applied_at", "yyyy-MM-dd HH:mm").alias("applied_at")
    return rows.select(*more, moment, *SHOWN)


def mails(spark: SparkSession, folder: str) -> DataFrame:
    """Intake of mail files only."""
    return only_mails(messages(spark, folder)).select(
        "id", "filename", F.date_format("sent_at", "yyyy-MM-dd HH:mm").alias("sent_at"),
        F.size("attachments").alias("n_attachments"), F.octet_length("body").alias("body_bytes"),
    )


def filenames(spark: SparkSession, folder: str) -> DataFrame:
    return messages(spark, folder).select(
        "id", job_from_filename("filename").alias("job"), name_from_filename("filename").alias("name")
    )


def headers(spark: SparkSession, folder: str) -> DataFrame:
    """Header lines of mail bodies, read from conversations."""
    body = F.regexp_replace("text", r"\.\s*", " .\t\r\n ")
    turns = table(spark, folder, "conversations").select("conv_id", "turn", header_lines(body).alias("lines"))
    return turns.select("conv_id", "turn", title_in("lines").alias("title"), location_in("lines").alias("location"))


def attachments(spark: SparkSession, folder: str) -> DataFrame:
    chosen = first_attachment(messages(spark, folder)).withColumn("kind", resume_type("file_name"))
    is_resume = F.col("kind").isNotNull()
    return chosen.select(
        "id", file_extension("file_name").alias("extension"),
        F.when(is_resume, F.col("file_name")).alias("resume"),
        F.when(is_resume, F.octet_length("file_content")).alias("resume_bytes"),
    )


def file_texts(spark: SparkSession, folder: str) -> DataFrame:
    chosen = first_attachment(messages(spark, folder)).withColumn("kind", resume_type("file_name"))
    return chosen.select(
        "id",
        F.when(F.col("kind") == ".pdf", join_pages("file_pages", fallback=True)).alias("pages"),
        F.when(F.col("kind").isNotNull(), join_parts("file_tables", "file_paragraphs")).alias("parts"),
        resume_text("kind", "file_pages", "file_tables", "file_paragraphs", "file_fallback").alias("text"),
    )


def candidate_rows(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(candidates(messages(spark, folder)), "filename")


def model_prompts(spark: SparkSession, folder: str) -> DataFrame:
    return prompts(messages(spark, folder)).select("filename", "prompt")


def new_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Insert-if-absent of the mails into a table that holds the older half of them."""
    rows = keyed(messages(spark, folder))
    recent = F.col("applied_at") >= F.lit("2024-01-02").cast(rows.schema["applied_at"].dataType)
    return _shown(finished(insert_if_absent(rows.where(recent), rows.where(~recent))), "filename")


def extraction(spark: SparkSession, folder: str) -> DataFrame:
    """A stand-in for the model reports the length of each prompt, and fails for some lengths."""

    def answer(text: str) -> str | Exception:
        if len(text) % 7 == 0:
            return TimeoutError("no answer")
        return json.dumps({"Expérience": len(text), "Compétences": "Spark"})

    def client():
        return lambda asked: asked.map(answer)

    return normalise_answers(answered(messages(spark, folder), client, error="error").select("filename", "response", "error"))


def streamed(spark: SparkSession, folder: str) -> DataFrame:
    """The mails arrive as a stream; the table they end up in."""
    place = work_folder(spark, "import")
    name = place.rsplit("-", 1)[1]
    messages(spark, folder).select(*[
        F.col(f.name).cast(f.dataType).alias(f.name) for f in MESSAGE_SCHEMA.fields
    ]).write.parquet(f"{place}/messages")
    store = CandidateStore(spark, place, f"candidates_{name}")
    import_stream(stream_messages(spark, f"{place}/messages"), store, f"{place}/progress", "test").awaitTermination()
    return _last(store, _shown(store.read()), place)


def _last(store: CandidateStore, rows: DataFrame, place: str) -> DataFrame:
    """The rows, written beside the tables, which are then forgotten."""
    rows.write.parquet(f"{place}/result")
    store.drop()
    return store.spark.read.schema(rows.schema).parquet(f"{place}/result")


def stored_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files kept with their candidates: a load, its repetition, a delete, and the removal of what is left behind."""
    place = work_folder(spark, "files")
    store = CandidateStore(spark, place, "filed_" + place.rsplit("-", 1)[1])
    for _ in range(2):
        store.insert(candidates(messages(spark, folder)), "mails", store_cv=True)
    store.delete(store.read().where("years_exp > 20").select("id"))
    store.vacuum()
    files = store.read_files().select(F.col("id").alias("file_id"), F.md5("cv").alias("cv_md5"))
    rows = store.read().join(files, F.col("id") == F.col("file_id"), "full")
    moment = F.date_format("applied_at", "yyyy-MM-dd HH:mm").alias("applied_at")
    return _last(store, rows.select("job", "name", moment, "years_exp", "cv_md5"), place)


def report(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(import_report(candidates(messages(spark, folder))), "filename", "place", "row_class")


QUERIES = {
    "ing_messages": mails,
    "ing_filename": filenames,
    "ing_headers": headers,
    "ing_attach": attachments,
    "ar_text": file_texts,
    "ing_candidates": candidate_rows,
    "ing_prompts": model_prompts,
    "ing_insert": new_candidates,
    "ux_extract": extraction,
    "ing_stream": streamed,
    "ing_report": report,
    "mut_files": stored_files,
}

# ---- SQL ---------------------------------------------------------------------

_MAILS = f"{MESSAGES}, {ANSWERS}, {HEADERS}"

_CANDIDATES = f"""{_MAILS},
read AS (SELECT *, {email_of('mail_text')} AS email, {phone_of('mail_text')} AS phone,
                coalesce(mail_text <> '', false) AS has_text FROM mails WHERE filename LIKE '%.msg'),
candidates AS (
  SELECT filename, strftime(sent_at, '%Y-%m-%d %H:%M') AS applied_at, mail_job AS job, mail_name AS name,
    mail_title AS title, mail_location AS location,
    CASE WHEN has_text THEN email ELSE 'N/A' END AS email,
    CASE WHEN has_text THEN phone ELSE 'N/A' END AS phone,
    CASE WHEN contains(lower(mail_title), 'freelance') THEN 'OUI'
         WHEN has_text THEN a_freelance ELSE 'N/A' END AS freelance,
    CASE WHEN has_text THEN a_year ELSE 'N/A' END AS grad_year,
    CASE WHEN has_text THEN try_cast(replace(a_years, ',', '.') AS DOUBLE) ELSE -1 END AS years_exp,
    CASE WHEN has_text THEN a_companies ELSE 'N/A' END AS companies,
    CASE WHEN has_text THEN a_skills ELSE 'N/A' END AS skills,
    0 AS status
  FROM read)"""

_NAMES = """list_transform(list_reverse_sort(list_transform(
      list_filter(string_split(mail_name, ' '), lambda w: length(w) > 2),
      lambda w, i: {'l': length(w), 'i': -i, 'w': w})), lambda x: x.w)"""

_FIRST = "row_number() OVER (PARTITION BY job, name ORDER BY applied_at, filename)"
_COLUMNS = ", ".join(["applied_at", *SHOWN])

_PROMPTS = f"""{_MAILS},
named AS (SELECT *, {_NAMES} AS names, {phone_of('mail_text')} AS phone FROM mails WHERE filename LIKE '%.msg'),
masked AS (
  SELECT filename, CASE WHEN mail_text <> '' THEN {redacted('mail_text', 'names', 'phone')} END AS redacted FROM named)"""


def _template_parts() -> tuple[str, str]:
    from postulant.functions.text import DEFAULT_PROMPT

    before, after = DEFAULT_PROMPT.split("{text}")
    return before.replace("'", "''"), after.replace("'", "''")


_BEFORE, _AFTER = _template_parts()

SQL = {
    "ing_messages": f"""WITH {MESSAGES}
SELECT id, filename, strftime(sent_at, '%Y-%m-%d %H:%M') AS sent_at,
  CAST(CASE WHEN lang = 'fr' OR (lang = 'en' AND source = 'src1') THEN 2 WHEN lang = 'es' THEN 0 ELSE 1 END AS INTEGER)
    AS n_attachments, CAST(strlen(body) AS INTEGER) AS body_bytes
FROM answered WHERE filename LIKE '%.msg'""",
    "ing_filename": f"WITH {_MAILS} SELECT id, mail_job AS job, mail_name AS name FROM mails",
    "ing_headers": rf"""WITH turns AS (
  SELECT conv_id, turn, string_split(regexp_replace(text, '\.\s*', ' .' || chr(9) || chr(13) || chr(10) || ' ', 'g'),
                                     chr(9) || chr(13) || chr(10)) AS parts FROM conversations)
SELECT conv_id, turn, CASE WHEN len(parts) > 4 THEN trim(parts[4]) ELSE 'N/A' END AS title,
       CASE WHEN len(parts) > 4 THEN trim(parts[5]) ELSE 'N/A' END AS location FROM turns""",
    "ing_attach": f"""WITH {_MAILS}
SELECT id, CASE attachment WHEN 'notes.txt' THEN '.txt' WHEN 'cv.pdf' THEN '.pdf' WHEN 'cv.docx' THEN '.docx'
                           WHEN 'CV.PDF' THEN '.PDF' END AS extension,
  CASE WHEN attachment IN ('cv.pdf', 'cv.docx') THEN attachment END AS resume,
  CASE WHEN attachment IN ('cv.pdf', 'cv.docx') THEN CAST(strlen(text) AS INTEGER) END AS resume_bytes FROM mails""",
    "ar_text": f"""WITH {_MAILS}
SELECT id, CASE WHEN attachment = 'cv.pdf' THEN replace(text, chr(10), ' ') END AS pages,
  CASE attachment WHEN 'cv.pdf' THEN '' WHEN 'cv.docx' THEN replace(title, ' ', chr(9)) || chr(10) || text END AS parts,
  mail_text AS text FROM mails""",
    "ing_candidates": f"WITH {_CANDIDATES} SELECT filename, {_COLUMNS} FROM candidates",
    "ing_prompts": f"""WITH {_PROMPTS}
SELECT filename, '{_BEFORE}' || redacted || '{_AFTER}' AS prompt FROM masked""",
    "ing_insert": f"""WITH {_CANDIDATES},
batch AS (SELECT *, {_FIRST} AS place FROM candidates WHERE applied_at >= '2024-01-02'),
stored AS (SELECT job, name FROM candidates WHERE applied_at < '2024-01-02')
SELECT filename, {_COLUMNS} FROM batch
WHERE job = '' OR name = '' OR (place = 1 AND NOT EXISTS (
  SELECT 1 FROM stored WHERE stored.job = batch.job AND stored.name = batch.name))""",
    "ing_stream": f"""WITH {_CANDIDATES}, placed AS (SELECT *, {_FIRST} AS place FROM candidates)
SELECT {_COLUMNS} FROM placed WHERE job = '' OR name = '' OR place = 1""",
    "ing_report": f"""WITH {_CANDIDATES}
SELECT filename, row_number() OVER (PARTITION BY job ORDER BY applied_at, filename) AS place,
  CASE WHEN freelance = 'OUI' THEN 'freelance'
       WHEN regexp_matches(grad_year, '^[0-9]+$') AND try_cast(grad_year AS INTEGER) <= 2020 THEN 'senior' ELSE '' END AS row_class,
  {_COLUMNS.replace('years_exp', "printf('%.1f', years_exp) AS years_exp")} FROM candidates""",
    "mut_files": f"""WITH {_CANDIDATES}, placed AS (SELECT *, {_FIRST} AS place FROM candidates)
SELECT p.job AS job, p.name AS name, p.applied_at AS applied_at, p.years_exp AS years_exp,
  CASE WHEN m.attachment IN ('cv.pdf', 'cv.docx') THEN md5(m.text) END AS cv_md5
FROM placed p JOIN mails m ON m.filename = p.filename
WHERE (p.job = '' OR p.name = '' OR place = 1) AND coalesce(p.years_exp, 0) <= 20""",
    "ux_extract": f"""WITH {_PROMPTS},
asked AS (SELECT filename, length('{_BEFORE}' || redacted || '{_AFTER}') AS n FROM masked)
SELECT filename, 'N/A' AS freelance, 'N/A' AS grad_year, CASE WHEN n % 7 <> 0 THEN n ELSE -1 END::DOUBLE AS years_exp,
  'N/A' AS companies, CASE WHEN n % 7 <> 0 THEN 'Spark' ELSE 'N/A' END AS skills,
  CASE WHEN n % 7 = 0 THEN 'TimeoutError: no answer' END AS error FROM asked""",
}
