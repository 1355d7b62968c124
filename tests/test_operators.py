"""Statistics, browsing, upserts and extraction on small tables."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from postulant.operators import browse as br
from postulant.operators import statistics as st
from postulant.operators import upsert as up
from postulant.operators.browse import BrowseSpec
from postulant.operators.extraction import ask_model
from postulant.schema import CANDIDATES

NAMES = ["Zoé", "zoe", "Éric", "eric", "Œuf", "oeuf", None, "Anne", "anné", "Bob"]


@pytest.fixture(scope="module")
def people(spark):
    rows = [
        (datetime(2024, 1, 1 + n), f"Job {n % 3}", name, f"Titre {n}", None, None if n % 2 else f"0{n}", None if n % 2 else str(n),
         "OUI" if n % 2 else "NON", "2018", float(n), "ACME", "Spark, SQL", n % 5 - 1, f"{n:02d}")
        for n, name in enumerate(NAMES)
    ]
    return spark.createDataFrame(rows, CANDIDATES).withColumn("cv", F.lit(b"x"))


def test_statistics_drop_missing_keys(spark):
    rows = [("a", datetime(2023, 12, 31)), ("a", datetime(2024, 1, 1)), ("a", None), (None, datetime(2024, 1, 1)), ("b", None)]
    df = spark.createDataFrame(rows, "job string, applied_at timestamp")
    assert [tuple(r) for r in st.count_by_job(df).collect()] == [("a", 3), ("b", 1)]
    assert [tuple(r) for r in st.count_by_job_and_period(df, "year").collect()] == [("a", 2023, 1), ("a", 2024, 1)]
    assert [tuple(r) for r in st.count_by_period(df, "month").collect()] == [("2023-12", 1), ("2024-01", 2)]
    assert [r.job for r in st.listed_jobs(df).collect()] == ["a", "b"]
    every = {(r.period, r.label): r.n for r in st.count_by_every_period(df).collect()}
    for period in ("year", "month", "day"):
        single = {str(r[0]): r[1] for r in st.count_by_period(df, period).collect()}
        assert {label: n for (p, label), n in every.items() if p == period} == single
    assert st.filter_applications(df, job="A").count() == 0  # exact, unlike browsing


def test_browse_returns_a_schema_without_rows(people):
    page = br.browse(people, BrowseSpec(job="none"))
    assert page.count() == 0
    assert page.columns == [c for c in people.columns if c not in ("id", "cv")] + ["id"]


def test_display_form(people):
    rows = br.browse(people).collect()
    assert len(rows) == 10 and rows[0].phone == "0" and rows[0].status == "❌ Refus" and rows[4].status == "✅ Go process"


def test_loose_equality_and_order(people):
    def names(**spec):
        return [r.name for r in br.browse(people, BrowseSpec(**spec)).collect()]

    assert len(br.browse(people, BrowseSpec(job="JÓB 1")).collect()) == 3
    assert names(sort=(("name", True),)) == [None, "Anne", "anné", "Bob", "Éric", "eric", "Œuf", "oeuf", "Zoé", "zoe"]
    assert names(sort=(("name", False),))[-1] is None
    assert names(sort=(("freelance", False), ("years_exp", False)))[:2] == ["Bob", "anné"][:1] + ["Anne"]


def test_filters(people):
    def ids(**spec):
        return [r.id for r in br.filtered(people, BrowseSpec(**spec)).orderBy("id").collect()]

    assert ids(status="🟡 Non traité") == ["01", "06"]
    assert ids(freelance="OUI") == ["01", "03", "05", "07", "09"]
    assert ids(freelance="N/A") == ids()  # only OUI and NON filter
    assert ids(experience=(2, 3)) == ["02", "03"]
    assert ids(days=(date(2024, 1, 2), date(2024, 1, 3))) == ["01", "02", "03"]  # the next midnight counts
    assert ids(days=(date(2024, 1, 2),)) == ids()
    assert ids(search_column="name", search="É|^zo") == ["00", "01", "02", "08"]
    assert ids(search_column="skills", search="sql$", job="job 0", freelance="non") == ids(job="job 0")
    with pytest.raises(ValueError):
        ids(search_column="email", search="x")
    with pytest.raises(Exception):
        ids(search="(")


def test_unknown_experience_shows_and_missing_does_not(spark):
    df = spark.createDataFrame([(-1.0,), (None,), (float("nan"),), (31.0,), (30.0,)], "years_exp double")
    assert [r[0] for r in br.filtered(df, BrowseSpec()).collect()] == [-1.0, 30.0]


@pytest.mark.parametrize("sort", [(), (("name", True),), (("name", False),), (("email", True), ("years_exp", False)), (("email", False),)])
def test_pages_together_are_the_whole_listing(people, sort):
    whole = [r.id for r in br.in_order(people, sort).collect()]
    pages = [
        r.id for n in range(4) for r in br.browse(people, BrowseSpec(sort=sort, page=n, page_size=3)).collect()
    ]
    assert pages == whole
    walked, last = whole[:1], whole[0]
    while True:
        row = people.where(F.col("id") == last).first().asDict()
        step = [r.id for r in br.browse_after(people, BrowseSpec(sort=sort, page_size=3), row).collect()]
        if not step:
            break
        walked += step
        last = step[-1]
    assert walked == whole


def test_only_edited_rows_of_a_page_are_saved(people):
    shown = br.browse(people)
    edited = shown.withColumn("status", F.when(F.col("id") == "03", "✅ Go process").otherwise(F.col("status")))
    edited = edited.withColumn("name", F.when(F.col("id") == "06", "Anna").otherwise(F.col("name")))
    saved = {r.id: (r.name, r.status, r.phone) for r in br.edits_of(shown, edited).collect()}
    assert saved == {"03": ("eric", 3, None), "06": ("Anna", 0, "6")}
    assert br.edits_of(shown, shown).count() == 0


def test_total_and_lookup(people):
    assert tuple(br.total(people, BrowseSpec(page_size=3)).first()) == (10, 4)
    assert tuple(br.total(people, BrowseSpec(job="nobody")).first()) == (0, 0)
    files = people.select("id", "cv").where("id < '05'")
    assert tuple(br.lookup(people, files, "02").first()) == (b"x", "Éric", "Job 2")
    assert tuple(br.lookup(people, files, "07").first()) == (None, "Anne", "Job 1")
    assert br.lookup(people, files, "99").first() is None
    assert br.sortable_columns(people) == people.columns


def test_page_turning():
    assert br.turn_page(5, "first", 20, 9) == 0
    assert [br.turn_page(p, "previous", 20, 9) for p in (0, 5)] == [0, 4]
    assert [br.turn_page(5, "next", shown, 9) for shown in (20, 19)] == [6, 5]
    assert br.turn_page(5, "last", 20, 9) == 8
    with pytest.raises(ValueError):
        br.turn_page(0, "sideways", 0, 0)


MAILS = "job string, name string, applied_at timestamp, filename string"


def mails(spark, *rows):
    return spark.createDataFrame([(j, n, datetime(2024, 1, d) if d else None, f) for j, n, d, f in rows], MAILS)


def inserted(batch, existing):
    return sorted(r.filename for r in up.insert_if_absent(batch, existing).collect())


@pytest.mark.parametrize("small", [True, False])
def test_insert_if_absent(spark, monkeypatch, small):
    monkeypatch.setattr(up, "fits_broadcast", lambda df: small)
    batch = mails(
        spark, ("a", "x", 3, "late"), ("a", "x", 2, "b early"), ("a", "x", 2, "a early"), ("a", "y", 1, "known"),
        ("a", "Y", 1, "other case"), ("Inconnu", "Inconnu", None, "no date"), ("Inconnu", "Inconnu", 9, "dated"),
        ("a", "", 1, "no name 1"), ("a", "", 1, "no name 2"), ("", "x", 1, "no job"), (None, "x", 1, "null job"),
    )
    existing = mails(spark, ("a", "y", 9, "old"), ("a", "y", 8, "old too"), ("a", "", 1, "old without name"))
    expected = ["a early", "dated", "no job", "no name 1", "no name 2", "null job", "other case"]
    assert inserted(batch, existing) == sorted(expected)
    again = existing.unionByName(up.insert_if_absent(batch, existing))
    assert inserted(batch, again) == sorted(["no name 1", "no name 2", "no job", "null job"])


def test_insert_keeps_one_row_per_task_before_the_shuffle(spark):
    batch = mails(spark, ("a", "x", 1, "f"))
    plan = up.insert_if_absent(batch, batch.limit(0))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and ", Partial" in plan


@pytest.mark.parametrize("small", [True, False])
def test_update_and_delete(spark, people, monkeypatch, small):
    monkeypatch.setattr(up, "fits_broadcast", lambda df: small)
    edits = spark.createDataFrame(
        [("01", "neu", "2024-02-02 00:00:00", 1), ("02", "Éric", "bad date", 1), ("77", "nobody", None, 1), ("01", "old", None, 0)],
        "id string, name string, applied_at string, version int",
    )
    new = {r.id: r for r in up.update_by_id(people, edits, order="version").collect()}
    assert len(new) == 10
    assert (new["01"].name, new["01"].applied_at) == ("neu", datetime(2024, 2, 2))
    assert (new["02"].name, new["02"].applied_at) == ("Éric", None)
    assert new["03"].name == "eric"
    assert {r.id for r in up.changed_rows(people, edits, order="version").collect()} == {"01", "02"}
    same = people.select("id", "name", "status")
    assert up.changed_rows(people, same).count() == 0
    left = up.delete_by_id(people, spark.createDataFrame([("03",), ("03",), ("88",)], "id string"))
    assert left.count() == 9 and left.where("id = '03'").count() == 0


def test_size_check(spark, monkeypatch):
    df = spark.range(100)
    assert up.fits_broadcast(df) and up.fits_broadcast(df.limit(0))
    monkeypatch.setattr(up, "BROADCAST_ROWS", 99)
    assert not up.fits_broadcast(df)
    monkeypatch.setattr(up, "BROADCAST_ROWS", 1000)
    monkeypatch.setattr(up, "BROADCAST_BYTES", 150)
    assert not up.fits_broadcast(df)


def test_model_errors_stay_with_their_row(spark):
    def client():
        def ask(prompts):
            if prompts.str.contains("bad").any():
                raise RuntimeError("refused")
            return prompts.str.upper()

        return ask

    df = spark.createDataFrame([("a",), (None,), ("bad",), ("c",)], "prompt string").coalesce(1)
    assert [r.response for r in ask_model(df, client).collect()] == ["A", None, None, "C"]
    assert [r.response for r in ask_model(df.where("prompt <> 'bad'"), client).collect()] == ["A", "C"]
    with pytest.raises(Exception, match="refused"):
        ask_model(df, client, keep_errors=False).collect()
