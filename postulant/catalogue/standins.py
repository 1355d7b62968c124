"""The test tables under the column names of the library, in Spark and in SQL.

There is no public table of applications, so events, orders and documents stand
in: an event or order is an application, a document is the text of a resume.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postulant.schema import ATTACHMENT


SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A test table. Its schema is known, so no file has to be opened to plan a query."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("ts").alias("applied_at"),
        F.col("event_type").alias("job"),
        F.col("user_id").cast("string").alias("name"),
        F.when(F.col("event_type") == "purchase", "OUI").when(F.col("event_type") == "click", "NON")
        .otherwise("N/A").alias("freelance"),
        F.col("value").alias("years_exp"),
        (F.col("user_id") % 5 - 1).cast("int").alias("status"),
        F.col("event_id").alias("id"),
    )


EVENTS = """applications AS (
  SELECT ts AS applied_at, event_type AS job, CAST(user_id AS VARCHAR) AS name,
         CASE event_type WHEN 'purchase' THEN 'OUI' WHEN 'click' THEN 'NON' ELSE 'N/A' END AS freelance,
         value AS years_exp, CAST(user_id % 5 - 1 AS INTEGER) AS status, event_id AS id
  FROM events)"""


def orders(spark: SparkSession, folder: str) -> DataFrame:
    status = F.col("o_orderstatus")
    customer = F.col("o_custkey").cast("string")
    return table(spark, folder, "orders").select(
        F.col("o_orderdate").alias("applied_at"),
        F.col("o_orderpriority").alias("job"),
        # Cheap orders play the applications without a name.
        F.when(F.col("o_totalprice") < 20000, "").otherwise(customer).alias("name"),
        F.when(status != "P", customer).alias("phone"),
        (F.col("o_totalprice") / 10000).alias("years_exp"),
        F.when(status == "O", 0).when(status == "F", 1).otherwise(7).alias("status"),
        F.col("o_orderkey").alias("id"),
    )


ORDERS = """applications AS (
  SELECT o_orderdate AS applied_at, o_orderpriority AS job,
         CASE WHEN o_totalprice < 20000 THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS name,
         CASE WHEN o_orderstatus <> 'P' THEN CAST(o_custkey AS VARCHAR) END AS phone,
         o_totalprice / 10000 AS years_exp,
         CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 ELSE 7 END AS status, o_orderkey AS id
  FROM orders)"""

# Label of a status code, as SQL over a column named status.
STATUS_LABEL = """CASE status WHEN 0 THEN '🟡 Non traité' WHEN -1 THEN '❌ Refus'
  WHEN 1 THEN '📨 Formulaire envoyé' WHEN 2 THEN '🛠️ En cours de qualif.' WHEN 3 THEN '✅ Go process' END"""


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with their first word, first line, and their first two words as names."""
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"),
        "text",
        "lang",
        "source",
        "n_chars",
        F.regexp_extract("text", r"^\p{L}+", 0).alias("job"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.array(
            F.regexp_extract("text", r"^[^ \n]+", 0), F.regexp_extract("text", r"^[^ \n]+[ \n]+([^ \n]+)", 1)
        ).alias("words"),
    )


DOCUMENTS = r"""resumes AS (
  SELECT doc_id AS id, text, lang, source, n_chars,
         regexp_extract(text, '^\p{L}+') AS job, split_part(text, chr(10), 1) AS title,
         [regexp_extract(text, '^[^ \n]+'), regexp_extract(text, '^[^ \n]+[ \n]+([^ \n]+)', 1)] AS words
  FROM documents)"""


def responses(row: DataFrame) -> DataFrame:
    """Add a model answer to documents: complete, partial, null-valued, escaped or broken."""
    start, escaped = F.col("source").substr(1, 4), F.lit(r"\&")
    years = F.concat((F.col("n_chars") % 40).cast("string"), F.lit(","), (F.col("n_chars") % 10).cast("string"))
    full = F.concat(
        F.lit('{"Freelance": "'), F.when(F.col("lang") == "en", "OUI").otherwise("NON"),
        F.lit('", "Année de diplomation": "'), (F.col("n_chars") % 30 + 2000).cast("string"),
        F.lit('", "Expérience": "'), years, F.lit('", "Entreprises": "'), F.col("source"), escaped,
        F.lit(' Co", "Compétences": "Spark, SQL"}'),
    )
    answer = (
        F.when(start == "src2", '{"Freelance": "NON", "Entreprises": null}')
        .when(start == "src3", "no JSON at all")
        .when(start == "src4", '["Freelance"]')
        .when(start == "src5", F.concat(full, F.lit(" trailing")))
        .when(start == "src6", '{"Expérience": "deux ans", "Compétences": ""}')
        .when(start == "src7", F.lit(None).cast("string"))
        .when(start == "src8", F.concat(F.lit('{"Expérience": '), F.col("n_chars").cast("string"), F.lit("}")))
        .otherwise(full)
    )
    return row.withColumn("response", answer)


_FULL = r"""'{"Freelance": "' || CASE lang WHEN 'en' THEN 'OUI' ELSE 'NON' END
  || '", "Année de diplomation": "' || (n_chars % 30 + 2000) || '", "Expérience": "'
  || (n_chars % 40) || ',' || (n_chars % 10) || '", "Entreprises": "' || source
  || '\& Co", "Compétences": "Spark, SQL"}'"""

RESPONSE = rf"""CASE source[1:4]
  WHEN 'src2' THEN '{{"Freelance": "NON", "Entreprises": null}}'
  WHEN 'src3' THEN 'no JSON at all'
  WHEN 'src4' THEN '["Freelance"]'
  WHEN 'src5' THEN {_FULL} || ' trailing'
  WHEN 'src6' THEN '{{"Expérience": "deux ans", "Compétences": ""}}'
  WHEN 'src7' THEN NULL
  WHEN 'src8' THEN '{{"Expérience": ' || n_chars || '}}'
  ELSE {_FULL} END"""

# Typed answer columns from a column named response.
ANSWERS = r"""parsed AS (
  SELECT *, CASE WHEN json_valid(replace(response, '\&', '&')) AND json_type(replace(response, '\&', '&')) = 'OBJECT'
                 THEN replace(response, '\&', '&') ELSE '{}' END AS answer
  FROM answered),
fields AS (
  SELECT *,
    CASE WHEN json_exists(answer, '$."Freelance"') THEN answer ->> '$."Freelance"' ELSE 'N/A' END AS a_freelance,
    CASE WHEN json_exists(answer, '$."Année de diplomation"')
         THEN answer ->> '$."Année de diplomation"' ELSE 'N/A' END AS a_year,
    CASE WHEN json_exists(answer, '$."Expérience"') THEN answer ->> '$."Expérience"' ELSE '-1' END AS a_years,
    CASE WHEN json_exists(answer, '$."Entreprises"') THEN answer ->> '$."Entreprises"' ELSE 'N/A' END AS a_companies,
    CASE WHEN json_exists(answer, '$."Compétences"') THEN answer ->> '$."Compétences"' ELSE 'N/A' END AS a_skills
  FROM parsed)"""


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """Decoded mails made from the documents; the language decides their shape."""
    docs = responses(documents(spark, folder))
    lines = F.split("text", "\n")
    no_list = F.lit(None).cast("array<string>")
    no_tables = F.lit(None).cast("array<array<array<string>>>")

    def file(name, pages=no_list, tables=no_tables, paragraphs=no_list):
        return F.struct(
            F.lit(name).alias("name"), pages.alias("pages"), tables.alias("tables"),
            paragraphs.alias("paragraphs"), F.encode("text", "UTF-8").alias("content"),
            F.col("source").startswith("src2").alias("fallback"),
        )

    pdf = file("cv.pdf", pages=lines)
    docx = file("cv.docx", tables=F.array(F.array(F.split("title", " "))), paragraphs=lines)
    lang = F.col("lang")
    # The name ends at the first ".msg", so a copy number keeps file names unique.
    copy = F.concat(F.lit(" copy "), F.col("id").cast("string"), F.lit(".msg"))
    return docs.select(
        F.when(lang == "en", F.concat(
            F.lit("application_ Data "), "source", F.lit(" from  "), "job", F.lit("  Martin.msg"), copy))
        .when(lang == "fr", F.concat(F.lit("application_ Analyste from "), "job", F.lit(".msg"), copy))
        .when(lang == "es", F.concat(F.lit("application_ Data from.msg"), copy))
        .otherwise(F.concat(F.lit("cv "), "source", F.lit(".eml"))).alias("filename"),
        F.expr("timestampadd(MINUTE, n_chars, timestamp_ntz'2024-01-01 00:00:00')").alias("sent_at"),
        F.replace("text", F.lit("\n"), F.lit("\t\r\n")).alias("body"),
        F.when((lang == "en") & (F.col("source") == "src1"), F.array(file("notes.txt"), pdf))
        .when(lang == "en", F.array(pdf))
        .when(lang == "fr", F.array(docx, pdf))
        .when(lang == "de", F.array(file("CV.PDF", pages=lines)))
        .otherwise(F.array().cast(T.ArrayType(ATTACHMENT))).alias("attachments"),
        "response",
        "id",
    )


# The same mails; `name` and `extension` describe the first attachment.
MESSAGES = DOCUMENTS + rf""",
answered AS (
  SELECT *, {RESPONSE} AS response,
    CASE lang WHEN 'en' THEN 'application_ Data ' || source || ' from  ' || job || '  Martin.msg copy ' || id || '.msg'
              WHEN 'fr' THEN 'application_ Analyste from ' || job || '.msg copy ' || id || '.msg'
              WHEN 'es' THEN 'application_ Data from.msg copy ' || id || '.msg'
              ELSE 'cv ' || source || '.eml' END AS filename,
    TIMESTAMP '2024-01-01 00:00:00' + to_minutes(n_chars) AS sent_at,
    replace(text, chr(10), chr(9) || chr(13) || chr(10)) AS body,
    CASE WHEN lang = 'en' AND source = 'src1' THEN 'notes.txt' WHEN lang = 'en' THEN 'cv.pdf'
         WHEN lang = 'fr' THEN 'cv.docx' WHEN lang = 'de' THEN 'CV.PDF' END AS attachment
  FROM resumes)"""

# Job, name, title, location and cleaned text of each mail.
HEADERS = r"""mails AS (
  SELECT *,
    CASE WHEN regexp_matches(filename, 'application_ (.*?) from')
         THEN regexp_extract(filename, 'application_ (.*?) from', 1) ELSE 'Inconnu' END AS mail_job,
    CASE WHEN contains(filename, 'from')
         THEN trim(regexp_replace(split_part(split_part(filename, 'from', 2), '.msg', 1), '\s+', ' ', 'g'))
         ELSE 'Inconnu' END AS mail_name,
    CASE WHEN len(string_split(body, chr(9) || chr(13) || chr(10))) > 4
         THEN trim(string_split(body, chr(9) || chr(13) || chr(10))[4]) ELSE 'N/A' END AS mail_title,
    CASE WHEN len(string_split(body, chr(9) || chr(13) || chr(10))) > 4
         THEN trim(string_split(body, chr(9) || chr(13) || chr(10))[5]) ELSE 'N/A' END AS mail_location,
    CASE attachment WHEN 'cv.pdf' THEN trim(replace(text, chr(10), CASE WHEN source LIKE 'src2%' THEN ' ' ELSE '' END))
                    WHEN 'cv.docx' THEN trim(title || ' ' || replace(text, chr(10), ' ')) END AS mail_text
  FROM fields)"""
