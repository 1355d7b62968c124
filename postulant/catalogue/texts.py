"""Text functions and redaction, over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postulant.catalogue.standins import DOCUMENTS, documents
from postulant.functions import contacts as c
from postulant.functions import text as t


def emails(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select(
        "id",
        c.first_email("text").alias("email"),
        # The same text with the address run into the next word.
        c.first_email(F.regexp_replace("text", r"(@\w+\.\w+)\W+", "$1")).alias("glued"),
        c.mask_emails("text").alias("masked"),
    )


def phones(spark: SparkSession, folder: str) -> DataFrame:
    found = documents(spark, folder).select("id", "text", c.first_phone("text").alias("phone"))
    return found.select("id", "phone", c.mask_phone("text", "phone").alias("masked"))


def addresses(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select("id", c.mask_addresses("text").alias("masked"))


def names(spark: SparkSession, folder: str) -> DataFrame:
    resumes = documents(spark, folder).select("id", "text", t.maskable_names(F.array_join("words", " ")).alias("names"))
    return resumes.select(
        "id", F.array_join(c.longest_first("names"), " ").alias("names"), c.mask_names("text", "names").alias("masked")
    )


def redaction(spark: SparkSession, folder: str) -> DataFrame:
    resumes = documents(spark, folder).select("id", "text", t.maskable_names(F.array_join("words", " ")).alias("names"))
    return c.redact(resumes).select("id", "email", "phone", "redacted")


def cleaning(spark: SparkSession, folder: str) -> DataFrame:
    noisy = F.concat(F.lit(" \t\n"), "text", F.lit("\0 \tfin\n  "))
    return documents(spark, folder).select(
        "id",
        t.clean_pdf_text(noisy).alias("pdf"),
        t.clean_docx_text(noisy).alias("docx"),
        t.strip(noisy).alias("stripped"),
        t.squeeze(noisy).alias("squeezed"),
    )


def flags(spark: SparkSession, folder: str) -> DataFrame:
    """Titles that mention freelance work outweigh the answer."""
    title = F.when(F.col("source") == "src1", F.concat("title", F.lit(" FreeLance Data"))).otherwise(F.col("title"))
    answer = F.when(F.col("lang") == "fr", "NON").when(F.col("lang") == "es", "N/A")
    return documents(spark, folder).select("id", t.freelance_flag(title, answer).alias("freelance"))


def formats(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select("id", t.one_decimal(F.col("n_chars") / 8).alias("shown"))


def classes(spark: SparkSession, folder: str) -> DataFrame:
    year = (
        F.when(F.col("lang") == "de", "N/A")
        .when(F.col("lang") == "es", F.concat(F.lit("en "), F.col("n_chars").cast("string")))
        .otherwise((F.col("n_chars") % 60 + 1980).cast("string"))
    )
    freelance = F.when(F.col("source") == "src1", "OUI").when(F.col("source") == "src2", "NON")
    return documents(spark, folder).select("id", t.row_class(year, freelance).alias("class"))


def prompts(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select("id", t.fill_prompt("text", "Lis {text} et réponds.").alias("prompt"))


QUERIES = {
    "tx_email": emails,
    "tx_phone": phones,
    "tx_address": addresses,
    "tx_names": names,
    "tx_redact": redaction,
    "tx_clean": cleaning,
    "tx_flag": flags,
    "tx_fmt": formats,
    "tx_class": classes,
    "tx_prompt": prompts,
}

# ---- SQL ---------------------------------------------------------------------

SPACE = r"[\t-\r\x1c-\x20\x85\p{Z}]"
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
ADDRESS = (
    r"\d{1,5}\s+\w+(?:\s+\w+)*(?:,\s*\w+(?:\s+\w+)*)?,?\s*\d{5}"
    .replace(r"\s", SPACE).replace(r"\w", r"[\p{L}\p{N}_]").replace(r"\d", r"\p{Nd}")
)


def email_of(text: str) -> str:
    """First address of a text, its tail cut. DuckDB gives '' for no match."""
    found = f"regexp_extract({text}, '{EMAIL}')"
    return rf"nullif(regexp_replace({found}, '(@[^@]+(\.com|\.net|\.fr)).*', '\1'), '')"


# DuckDB's regular expressions cannot look behind or ahead, so digits are marked
# first: S and E around each run of digits, N before a run's last four digits if
# they read 2ddd and a separator follows, and stand-ins for a plus sign or bracket
# that comes straight after a digit, where no number may start.
_S, _E, _N, _PLUS, _OPEN = "\ue000", "\ue001", "\ue002", "\ue003", "\ue004"
_SEP = r"[-.\t-\r\x1c-\x20\x85\p{Z}]"
_D = rf"{_S}?{_N}?\p{{Nd}}{_E}?"
_GROUP = f"(?:{_D}){{2,4}}{_SEP}?"
_LAST = rf"(?:{_D}){{1,3}}{_S}?{_N}?\p{{Nd}}{_E}"
_AREA_TAIL = rf"[3-9]{_E}?(?:{_D}){{1,3}}\)?{_SEP}?(?:{_GROUP}){{2,3}}{_LAST}"
_PLAIN_TAIL = rf"\p{{Nd}}{_E}?(?:{_D}){{1,3}}{_SEP}?(?:{_GROUP}){{1,2}}{_LAST}"
_COUNTRY = rf"(?:\+(?:{_D}){{1,3}}|{_S}{_N}?\p{{Nd}}{_E}?(?:{_D}){{0,2}}){_SEP}?"
PHONE = (
    rf"{_COUNTRY}(?:[({_OPEN}]?{_S}?{_AREA_TAIL}|{_S}?{_PLAIN_TAIL})"
    rf"|(?:\({_S}?|{_S}){_AREA_TAIL}|{_S}{_PLAIN_TAIL}"
)


def phone_of(text: str) -> str:
    marked = rf"regexp_replace({text}, '(\p{{Nd}}+)', '{_S}\1{_E}', 'g')"
    marked = rf"regexp_replace({marked}, '(2\p{{Nd}}{{3}}{_E}{_SEP})', '{_N}\1', 'g')"
    marked = f"replace(replace({marked}, '{_E}+', '{_E}{_PLUS}'), '{_E}(', '{_E}{_OPEN}')"
    found = f"regexp_extract_all({marked}, '{PHONE}')"
    plain = f"list_transform({found}, lambda m: replace(regexp_replace(m, '[{_S}{_E}{_N}]', '', 'g'), '{_OPEN}', '('))"
    return f"list_filter({plain}, lambda m: m[1] NOT IN ('1', '2'))[1]"


NAMES = r"""named AS (
  SELECT *, list_transform(list_reverse_sort(list_transform(
      list_filter(words, lambda w: length(w) > 2), lambda w, i: {'l': length(w), 'i': -i, 'w': w})), lambda x: x.w) AS names
  FROM resumes)"""


def without_names(text: str, names: str) -> str:
    return rf"""list_reduce({names}, lambda t, w: regexp_replace(t, '(?i)\Q' || w || '\E', '[ANONYMISÉ]', 'g'), {text})"""


def redacted(text: str, names: str, phone: str) -> str:
    mailless = f"regexp_replace({without_names(text, names)}, '{EMAIL}', '[EMAIL]', 'g')"
    return f"regexp_replace(replace({mailless}, coalesce({phone}, ''), '[TÉL]'), '{ADDRESS}', '[ADRESSE]', 'g')"


_BLANKS = "' ' || chr(9) || chr(10) || chr(160)"
_NOISY = "' ' || chr(9) || chr(10) || text || chr(0) || chr(160) || chr(9) || 'fin' || chr(10) || ' ' || chr(160)"

SQL = {
    "tx_email": rf"""WITH {DOCUMENTS},
glued AS (SELECT *, regexp_replace(text, '(@[0-9A-Za-z_]+\.[0-9A-Za-z_]+)[^0-9A-Za-z_]+', '\1', 'g') AS run_on FROM resumes)
SELECT id, {email_of('text')} AS email, {email_of('run_on')} AS glued,
       regexp_replace(text, '{EMAIL}', '[EMAIL]', 'g') AS masked FROM glued""",
    "tx_phone": f"""WITH {DOCUMENTS},
found AS (SELECT *, {phone_of('text')} AS phone FROM resumes)
SELECT id, phone, CASE WHEN phone IS NULL THEN text ELSE replace(text, phone, '[TÉL]') END AS masked FROM found""",
    "tx_address": f"""WITH {DOCUMENTS}
SELECT id, regexp_replace(text, '{ADDRESS}', '[ADRESSE]', 'g') AS masked FROM resumes""",
    "tx_names": f"""WITH {DOCUMENTS}, {NAMES}
SELECT id, array_to_string(names, ' ') AS names, {without_names('text', 'names')} AS masked FROM named""",
    "tx_redact": f"""WITH {DOCUMENTS}, {NAMES},
found AS (SELECT *, {email_of('text')} AS email, {phone_of('text')} AS phone FROM named)
SELECT id, email, phone, {redacted('text', 'names', 'phone')} AS redacted FROM found""",
    "tx_clean": f"""WITH {DOCUMENTS}, noisy AS (SELECT id, {_NOISY} AS x FROM resumes)
SELECT id, trim(replace(replace(x, chr(0), ''), chr(10), ' '), {_BLANKS}) AS pdf,
       trim(replace(replace(replace(x, chr(160), ' '), chr(10), ' '), chr(9), ' '), {_BLANKS}) AS docx,
       trim(x, {_BLANKS}) AS stripped, trim(regexp_replace(x, '{SPACE}+', ' ', 'g')) AS squeezed FROM noisy""",
    "tx_flag": f"""WITH {DOCUMENTS}
SELECT id, CASE WHEN source = 'src1' OR contains(lower(title), 'freelance') THEN 'OUI'
                WHEN lang = 'fr' THEN 'NON' WHEN lang = 'es' THEN 'N/A' END AS freelance FROM resumes""",
    "tx_fmt": f"WITH {DOCUMENTS} SELECT id, printf('%.1f', n_chars / 8) AS shown FROM resumes",
    "tx_class": f"""WITH {DOCUMENTS}
SELECT id, CASE WHEN source = 'src1' THEN 'freelance'
                WHEN lang NOT IN ('de', 'es') AND n_chars % 60 + 1980 <= 2020 THEN 'senior' ELSE '' END AS class
FROM resumes""",
    "tx_prompt": f"WITH {DOCUMENTS} SELECT id, 'Lis ' || text || ' et réponds.' AS prompt FROM resumes",
}
