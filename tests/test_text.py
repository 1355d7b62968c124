"""Text functions: fixed examples, and Python's own regular expressions as brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from postulant.functions import contacts as c
from postulant.functions import text as t
from postulant.functions.patterns import EMAIL, PHONE, POSTAL_ADDRESS


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column).first()[0]


@pytest.mark.parametrize("filename, job, name", [
    ("application_ Data Engineer from Jean  Dupont.msg", "Data Engineer", "Jean Dupont"),
    ("cv.msg", "Inconnu", "Inconnu"),
    ("application_ Data from.msg", "Data", ""),
    ("from Anne\tLe Gall .msg.msg", "Inconnu", "Anne Le Gall"),
    ("application_ X from A from B.msg", "X", "A"),
    ("application_ from.msg", "Inconnu", ""),
    ("application_ a\nb from c.msg", "Inconnu", "c"),
])
def test_file_name(spark, filename, job, name):
    assert one(spark, filename, t.job_from_filename("text")) == job
    assert one(spark, filename, t.name_from_filename("text")) == name


@pytest.mark.parametrize("body, title, location", [
    ("a\t\r\nb\t\r\nc\t\r\n d \t\r\ne", "d", "e"),
    ("a\t\r\nb\t\r\nc\t\r\nd", "N/A", "N/A"),
    ("a\t\r\nb\t\r\nc\t\r\nd\t\r\n e\t\r\nf\t\r\ng", "d", "e"),
    ("a\r\nb\r\nc\r\nd\r\ne", "N/A", "N/A"),
    (None, "N/A", "N/A"),
])
def test_headers(spark, body, title, location):
    lines = t.header_lines("text")
    assert one(spark, body, t.title_in(lines)) == title
    assert one(spark, body, t.location_in(lines)) == location


@pytest.mark.parametrize("text, email", [
    ("x a.b@site.comTel y", "a.b@site.com"),
    ("a@b.org", "a@b.org"),
    ("no address @ all", None),
    ("first@x.com.fr.netTel second@y.org", "first@x.com.fr.net"),
    ("", None),
    (None, None),
])
def test_email(spark, text, email):
    assert one(spark, text, c.first_email("text")) == email


@pytest.mark.parametrize("text, phone", [
    ("tel 06 12 34 56 78 mail", "06 12 34 56 78"),
    ("2012 2013 2014", None),
    ("2012 2013 2014, +33 6 12 34 56 78", "6 12 34 56 78"),  # the country code needs two digits behind it
    (None, None),
])
def test_phone(spark, text, phone):
    assert one(spark, text, c.first_phone("text")) == phone


def test_only_the_first_phone_is_masked_everywhere(spark):
    text = "06 12 34 56 78 or 07 11 22 33 44 or 06 12 34 56 78"
    assert one(spark, text, c.mask_phone("text", c.first_phone("text"))) == "[TÉL] or 07 11 22 33 44 or [TÉL]"


@pytest.mark.parametrize("text, names, masked", [
    ("Paul MARTINpaul", ["Paul", "Martin"], "[ANONYMISÉ] [ANONYMISÉ][ANONYMISÉ]"),
    ("Élodie ÉLODIE élodie", ["élodie"], "[ANONYMISÉ] [ANONYMISÉ] [ANONYMISÉ]"),
    ("Jean-Marie Jean", ["Jean", "Jean-Marie"], "[ANONYMISÉ] [ANONYMISÉ]"),
    ("a.c abc", ["a.c"], "[ANONYMISÉ] abc"),
    (r"x\Ey $1", [r"x\Ey"], "[ANONYMISÉ] $1"),
    ("Martin", ["Martin", "Ano"], "[[ANONYMISÉ]NYMISÉ]"),
    ("kept", [], "kept"),
])
def test_names(spark, text, names, masked):
    df = spark.createDataFrame([(text, names)], "text string, names array<string>")
    assert df.select(c.mask_names("text", "names")).first()[0] == masked


def test_short_names_are_not_masked(spark):
    assert one(spark, "Jo Ann Li Marie", t.maskable_names("text")) == ["Ann", "Marie"]


def test_address(spark):
    assert one(spark, "12 rue de la Paix, 75002 Paris", c.mask_addresses("text")) == "[ADRESSE] Paris"


def test_redaction_order(spark):
    """A name that is the local part of an address hides it from the address mask."""
    df = spark.createDataFrame([("Paul: paul@x.fr, 06 12 34 56 78", ["Paul"])], "text string, names array<string>")
    row = c.redact(df).first()
    assert (row.email, row.phone) == ("paul@x.fr", "06 12 34 56 78")
    assert row.redacted == "[ANONYMISÉ]: [ANONYMISÉ]@x.fr, [TÉL]"


@pytest.mark.parametrize("text, pdf, docx", [
    ("\x00 a\nb\t c \n", "a b\t c", "\x00 a b  c"),
    ("　 x ", "x", "x"),
    ("", "", ""),
])
def test_cleaning(spark, text, pdf, docx):
    assert one(spark, text, t.clean_pdf_text("text")) == pdf
    assert one(spark, text, t.clean_docx_text("text")) == docx


@pytest.mark.parametrize("year, freelance, kind", [
    ("2018", "OUI", "freelance"), ("2018", "NON", "senior"), ("2020", None, "senior"), ("2021", "NON", ""),
    ("N/A", "N/A", ""), (None, None, ""), ("-5", None, ""), ("99999999999", None, ""), ("2018 ", None, ""),
])
def test_row_class(spark, year, freelance, kind):
    df = spark.createDataFrame([(year, freelance)], "year string, freelance string")
    assert df.select(t.row_class("year", "freelance")).first()[0] == kind


def test_one_decimal(spark):
    df = spark.createDataFrame([(2.25,), (2.75,), (-0.25,), (-1.0,), (None,)], "years double")
    assert [r[0] for r in df.select(t.one_decimal("years")).collect()] == ["2.2", "2.8", "-0.2", "-1.0", None]


def test_prompt_keeps_braces_of_the_text(spark):
    assert one(spark, "{text} {x} $1", t.fill_prompt("text", "CV: {text}.")) == "CV: {text} {x} $1."


# ---- brute force ---------------------------------------------------------------

PIECES = [
    "12", "7", "75002", "123456", "2012", "2 ", "rue", "Paix", "é", "_", ",", ", ", " ", "  ", "\n", "\t", " ",
    "\x1c", "-", ".", "+33", "(06)", "06", "(1", "+", "(", "2222", "a@b.com", "x@y.fr1z@q.net", "a@", "@",
    "a.b-c@site.comTel", ".fr", "²", "٣",
]
DIGITS = ["0", "1", "2", "3", "9", "20", "21 ", "2345", "-", " ", ".", "+", "(", ")", "x", "55", "123", "\n"]


def random_texts():
    source = random.Random(11)
    mixed = ["".join(source.choices(PIECES, k=source.randint(1, 40))) for _ in range(4000)]
    return mixed + ["".join(source.choices(DIGITS, k=source.randint(3, 25))) for _ in range(6000)]


def python_email(text):
    found = re.search(EMAIL, text)
    if not found:
        return None
    address = found.group()
    tail = re.search(r"@[^@]+(\.com|\.net|\.fr)", address)
    return address[: tail.end()] if tail else address


def python_phone(text):
    return next((m for m in re.findall(PHONE, text) if m.strip()[0] not in "12"), None)


def test_against_python(spark):
    texts = random_texts()
    rows = (
        spark.createDataFrame(list(enumerate(texts)), "n long, text string")
        .select(
            "n", c.first_email("text").alias("email"), c.first_phone("text").alias("phone"),
            c.mask_emails("text").alias("mailless"), c.mask_addresses("text").alias("placeless"),
            t.strip("text").alias("stripped"), t.squeeze("text").alias("squeezed"),
        )
        .collect()
    )
    for row in rows:
        text = texts[row.n]
        assert row.email == python_email(text)
        assert row.phone == python_phone(text)
        assert row.mailless == re.sub(EMAIL, "[EMAIL]", text)
        assert row.placeless == re.sub(POSTAL_ADDRESS, "[ADRESSE]", text)
        assert row.stripped == text.strip()
        assert row.squeezed == " ".join(text.split())
    assert sum(row.phone is not None for row in rows) > 1000
    assert sum("[ADRESSE]" in row.placeless for row in rows) > 500


def test_names_against_python(spark):
    source = random.Random(5)
    letters = ["a", "A", "é", "É", "n", "o", "mis", "K", "ß", ".", "(", "$1", "\\", "[", " ", "ano", "ſ", "S"]
    rows = []
    for n in range(3000):
        text = "".join(source.choices(letters, k=source.randint(0, 25)))
        rows.append((n, text, ["".join(source.choices(letters, k=source.randint(1, 3))) for _ in range(n % 4)]))
    masked = spark.createDataFrame(rows, "n long, text string, names array<string>").select(
        "n", c.mask_names("text", "names").alias("masked")
    )
    for n, result in masked.collect():
        _, expected, names = rows[n]
        for name in sorted(names, key=len, reverse=True):
            expected = re.sub("(?i)" + re.escape(name), "[ANONYMISÉ]", expected)
        assert result == expected


def test_redaction_leaves_no_address(spark, folder):
    documents = spark.read.parquet(f"{folder}/documents.parquet").withColumn("names", F.array().cast("array<string>"))
    assert c.redact(documents).where(F.col("redacted").rlike(EMAIL)).count() == 0


@pytest.mark.parametrize("text", [
    "12" + " mot" * 20000 + ", " + "mot " * 20000 + "75002 fin",  # one very long run of words
    "12 34 " * 20000,  # many house numbers, never a postcode
    "1234567 " * 10000 + "x",
    "a" * 200000,  # no address, no break
    ("a" * 50 + "@") * 2000,
    " " * 100000 + "x" + " " * 100000,
], ids=["long run", "numbers", "postcodes", "unbroken", "at signs", "blanks"])
def test_long_texts(spark, text):
    """Very long texts neither overflow the stack nor take quadratic time."""
    df = spark.createDataFrame([(text, ["Marie"])], "text string, names array<string>")
    row = c.redact(df).select("redacted", t.strip("text").alias("stripped")).first()
    assert row.stripped == text.strip()
    if text.startswith("12 mot"):
        assert row.redacted == "[ADRESSE] fin"
