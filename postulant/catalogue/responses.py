"""Model answers as JSON text, made from documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postulant.catalogue.standins import ANSWERS, DOCUMENTS, RESPONSE, documents
from postulant.catalogue.standins import responses as with_responses
from postulant.functions.answers import answer_field, normalise_answers, parse_answers, to_number


def parsing(spark: SparkSession, folder: str) -> DataFrame:
    """Which answers are objects, and what one of their fields reads."""
    return parse_answers(with_responses(documents(spark, folder))).select(
        "id",
        F.col("answer").isNotNull().alias("is_object"),
        answer_field("answer", "Entreprises", "N/A").alias("companies"),
    )


def defaults(spark: SparkSession, folder: str) -> DataFrame:
    rows = with_responses(documents(spark, folder)).select("id", "response")
    return normalise_answers(rows)


def numbers(spark: SparkSession, folder: str) -> DataFrame:
    size = F.col("n_chars").cast("string")
    text = (
        F.when(F.col("lang") == "fr", F.concat(size, F.lit(",5")))
        .when(F.col("lang") == "de", F.concat(F.lit(" -"), size, F.lit(".25 ")))
        .when(F.col("lang") == "es", F.concat(size, F.lit(" ans")))
        .when(F.col("source") == "src1", "NaN")
        .otherwise(size)
    )
    return documents(spark, folder).select("id", to_number(text).alias("number"))


QUERIES = {"js_parse": parsing, "js_defaults": defaults, "js_number": numbers}

_ANSWERED = f"{DOCUMENTS}, answered AS (SELECT *, {RESPONSE} AS response FROM resumes), {ANSWERS}"

SQL = {
    "js_parse": rf"""WITH {_ANSWERED}
SELECT id, coalesce(json_valid(replace(response, '\&', '&'))
                    AND json_type(CASE WHEN json_valid(replace(response, '\&', '&'))
                                       THEN replace(response, '\&', '&') END) = 'OBJECT', false) AS is_object,
       a_companies AS companies FROM fields""",
    "js_defaults": f"""WITH {_ANSWERED}
SELECT id, a_freelance AS freelance, a_year AS grad_year, try_cast(replace(a_years, ',', '.') AS DOUBLE) AS years_exp,
       a_companies AS companies, a_skills AS skills FROM fields""",
    "js_number": f"""WITH {DOCUMENTS}
SELECT id, CASE WHEN lang = 'fr' THEN n_chars + 0.5 WHEN lang = 'de' THEN -n_chars - 0.25
                WHEN lang = 'es' OR source = 'src1' THEN NULL ELSE n_chars END::DOUBLE AS number FROM resumes""",
}
