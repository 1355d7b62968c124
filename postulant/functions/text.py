"""Whitespace, mail header and prompt text functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postulant.functions import as_column
from postulant.functions.patterns import HEADER_BREAK, JOB_IN_FILENAME, SPACE
from postulant.schema import NOT_AVAILABLE, SENIOR_UNTIL, UNKNOWN, YES

DEFAULT_PROMPT = """Tu es chargé(e) du recrutement dans une équipe data. Lis le CV ci-dessous et réponds
uniquement par un objet JSON avec ces cinq clés, toutes de type texte :
"Freelance" : OUI ou NON ;
"Année de diplomation" : l'année de fin du diplôme le plus récent, sur quatre chiffres ;
"Expérience" : le nombre d'années d'expérience, hors stages et alternances, par exemple 2,5 ;
"Entreprises" : les employeurs, hors stages, séparés par des virgules ;
"Compétences" : les cinq principales compétences techniques, séparées par des virgules.

CV : {text}
"""

# Every white space character: NEL, no-break and typographic spaces included.
WHITE_SPACE = "".join(chr(code) for code in range(0x3001) if chr(code).isspace())


def strip(text: Column | str) -> Column:
    """Remove all kinds of white space at both ends (`trim` only knows the blank)."""
    return F.btrim(as_column(text), F.lit(WHITE_SPACE))


def squeeze(text: Column | str) -> Column:
    """Words joined by single blanks."""
    return F.trim(F.regexp_replace(as_column(text), f"{SPACE}+", " "))


def _swap(text: Column, changes: dict[str, str]) -> Column:
    """Replace single characters. A few `replace` calls are far cheaper than one `translate`."""
    for old, new in changes.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def clean_pdf_text(text: Column | str) -> Column:
    """Drop NUL characters, turn line feeds into blanks, strip."""
    return strip(_swap(as_column(text), {"\0": "", "\n": " "}))


def clean_docx_text(text: Column | str) -> Column:
    """Turn no-break spaces, line feeds and tabs into blanks, strip."""
    return strip(_swap(as_column(text), {"\u00a0": " ", "\n": " ", "\t": " "}))


def job_from_filename(filename: Column | str) -> Column:
    # A dot in the pattern means "anything but a line feed".
    name, pattern = as_column(filename), "(?d)" + JOB_IN_FILENAME
    return F.when(name.rlike(pattern), F.regexp_extract(name, pattern, 1)).otherwise(UNKNOWN)


def name_from_filename(filename: Column | str) -> Column:
    """The squeezed text between the first and the second `from`, up to `.msg`."""
    name = as_column(filename)
    part = F.substring_index(F.get(F.split(name, "from", -1), F.lit(1)), ".msg", 1)
    return F.when(name.contains("from"), squeeze(part)).otherwise(UNKNOWN)


def maskable_names(name: Column | str) -> Column:
    """The words of a name that are long enough to mask."""
    return F.filter(F.split(as_column(name), " "), lambda word: F.length(word) > 2)


def header_lines(body: Column | str) -> Column:
    """The opening lines of a mail body. Splitting stops once five lines are complete."""
    return F.split(as_column(body), HEADER_BREAK, 6)


def header_field(lines: Column | str, position: int) -> Column:
    """One of the opening lines, if the body has more than four."""
    array = as_column(lines)
    return F.when(F.size(array) > 4, strip(F.get(array, F.lit(position)))).otherwise(NOT_AVAILABLE)


def title_in(lines: Column | str) -> Column:
    return header_field(lines, 3)


def location_in(lines: Column | str) -> Column:
    return header_field(lines, 4)


def mentions_freelance(title: Column | str) -> Column:
    return F.coalesce(F.lower(as_column(title)).contains("freelance"), F.lit(False))


def freelance_flag(title: Column | str, answer: Column | str) -> Column:
    """A title that says so outweighs the model's answer."""
    return F.when(mentions_freelance(title), YES).otherwise(as_column(answer))


def fill_prompt(text: Column | str, template: str = DEFAULT_PROMPT) -> Column:
    return F.replace(F.lit(template), F.lit("{text}"), as_column(text))


def one_decimal(number: Column | str) -> Column:
    """One decimal, a half going to the even digit: 2.25 shows as 2.2."""
    value = as_column(number)
    return F.when(value.isNotNull(), F.format_string("%.1f", F.bround(value, 1)))


def row_class(grad_year: Column | str, freelance: Column | str) -> Column:
    """`freelance` first, else `senior` for an early graduation year, else empty."""
    year = as_column(grad_year)
    early = year.rlike("^[0-9]+$") & (year.try_cast("int") <= SENIOR_UNTIL)
    return F.when(as_column(freelance) == YES, "freelance").when(early, "senior").otherwise("")
