"""Answers, files, status and dates."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from postulant.functions import answers as a
from postulant.functions import attachments as at
from postulant.functions import dates as d
from postulant.functions import files as f
from postulant.functions import status as s

DEFAULTS = ("N/A", "N/A", -1.0, "N/A", "N/A")


@pytest.mark.parametrize("response, expected", [
    ('{"Freelance":"OUI"}', ("OUI", *DEFAULTS[1:])),
    ('{"Entreprises":null,"Expérience":"2,5"}', ("N/A", "N/A", 2.5, None, "N/A")),
    (r'{"Compétences":"R\&D"}', (*DEFAULTS[:4], "R&D")),
    ('{"Freelance":"OUI","Freelance":"NON"}', ("NON", *DEFAULTS[1:])),
    ('{"Année de diplomation":2018,"Expérience":3}', ("N/A", "2018", 3.0, "N/A", "N/A")),
    ('  {"Freelance":"OUI"}\n', ("OUI", *DEFAULTS[1:])),
    ('{"Freelance":"OUI"} et voilà', DEFAULTS),
    ('{"Freelance":"OUI"}, {"Freelance":"NON"}', DEFAULTS),
    ('{"Freelance":"OUI"}] ', DEFAULTS),
    ("{'Freelance':'OUI'}", DEFAULTS),
    ('["Freelance"]', DEFAULTS), ('"Freelance"', DEFAULTS), ("null", DEFAULTS), ("nope", DEFAULTS), ("{}", DEFAULTS),
    ("", DEFAULTS), (None, DEFAULTS),
])
def test_answers(spark, response, expected):
    row = a.normalise_answers(spark.createDataFrame([(response,)], "response string")).first()
    assert (row.freelance, row.grad_year, row.years_exp, row.companies, row.skills) == expected


@pytest.mark.parametrize("text, number", [
    ("2,5", 2.5), (" 3 ", 3.0), ("-1", -1.0), (".5", 0.5), ("1e1", 10.0), ("2 ans", None), ("1,234.5", None),
    ("NaN", None), ("2d", None), ("", None), (None, None),
])
def test_number(spark, text, number):
    assert spark.createDataFrame([(text,)], "t string").select(a.to_number("t")).first()[0] == number


@pytest.mark.parametrize("name, extension", [
    ("a.pdf", ".pdf"), ("a.b.docx", ".docx"), ("A.PDF", ".PDF"), (".pdf", ""), ("..pdf", ""), ("a", ""), ("a.", "."),
    ("d.x/a", ""), ("d/.pdf", ""), (None, None),
])
def test_extension(spark, name, extension):
    assert spark.createDataFrame([(name,)], "n string").select(at.file_extension("n")).first()[0] == extension


@pytest.mark.parametrize("names, kind", [
    (["cv.pdf"], ".pdf"), (["cv.docx", "x.pdf"], ".docx"), (["a.txt", "b.pdf"], None), (["A.PDF"], None),
    ([None, "b.pdf"], None), ([], None), (None, None),
])
def test_only_the_first_attachment_counts(spark, names, kind):
    from postulant.schema import MESSAGES

    files = None if names is None else [(n, ["p"], None, None, b"%PDF", None) for n in names]
    df = spark.createDataFrame([("f", None, None, files, None)], MESSAGES)
    assert at.first_attachment(df).select(at.resume_type("file_name")).first()[0] == kind


def test_texts_of_pages_and_parts(spark):
    df = spark.createDataFrame(
        [(["a", None, "b"], [[["x", "y"], ["z"]], [["w"]]], ["p", "q"]), (None, None, ["p"]), (None, None, None)],
        "pages array<string>, tables array<array<array<string>>>, paragraphs array<string>",
    )
    rows = df.select(
        at.join_pages("pages"), at.join_pages("pages", fallback=True), at.join_parts("tables", "paragraphs")
    ).collect()
    assert tuple(rows[0]) == ("ab", "a  b", "x\ty\nz\nw\np\nq")
    assert rows[1][2] == "p" and rows[2][2] == ""


@pytest.mark.parametrize("content, kind, mime", [
    (b"%PDF-1.7", "pdf", "application/pdf"),
    (b"PK\x03\x04..", "docx", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"),
    (b"\xd0\xcf\x11\xe0..", "doc", "application/msword"),
    (b"%PD", "bin", "application/octet-stream"),
    (b"", "bin", "application/octet-stream"),
])
def test_file_types(spark, content, kind, mime):
    df = spark.createDataFrame([(bytearray(content),)], "cv binary")
    assert df.select(f.file_type("cv")).first()[0] == kind
    assert df.select(f.mime_type(f.file_type("cv"))).first()[0] == mime


def test_data_link(spark):
    df = spark.createDataFrame([(bytearray(b"%PDF" + b"x" * 200),), (None,)], "cv binary")
    links = [tuple(row) for row in df.select(f.data_link("cv"), f.download_name("cv")).collect()]
    assert links[0][0].startswith("data:application/pdf;base64,JVBERnh4") and "\n" not in links[0][0]
    assert links[0][1] == "cv.pdf"
    assert links[1] == ("✖️", None)


def test_status(spark):
    df = spark.createDataFrame([(-1,), (3,), (9,), (None,)], "code int")
    rows = df.select(s.status_label("code").alias("label")).select("label", s.status_code("label")).collect()
    assert [tuple(r) for r in rows] == [("❌ Refus", -1), ("✅ Go process", 3), (None, None), (None, None)]


def test_moments(spark):
    df = spark.createDataFrame([("2024-03-06 10:11:12",), ("le 6 mars",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(d.to_moment("t")).collect()] == [datetime(2024, 3, 6, 10, 11, 12), None, None, None]


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_day_ranges(spark, kind):
    moments = ["2024-01-10 00:00:00", "2024-01-20 23:59:59", "2024-01-20 23:59:59.5", "2024-01-21 00:00:00",
               "2024-01-09 23:59:59", "2024-01-21 00:00:01"]
    df = spark.createDataFrame([(m,) for m in moments], "m string").withColumn("applied_at", F.col("m").cast(kind))
    days = (date(2024, 1, 10), date(2024, 1, 20))
    browse = df.where(d.within_days(df, "applied_at", days, through_midnight=True))
    statistics = df.where(d.within_days(df, "applied_at", days, through_midnight=False))
    assert [r.m for r in browse.collect()] == moments[:4]
    assert [r.m for r in statistics.collect()] == moments[:2]
    assert d.within_days(df, "applied_at", days[:1], True) is None
    assert d.within_days(df, "applied_at", (), True) is None
