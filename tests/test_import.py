"""The import from end to end: mails, the tables, updates and the stream."""

import tempfile
from datetime import date, datetime
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from postulant.operators.browse import BrowseSpec, browse, filtered
from postulant.operators.upsert import earliest_per_key
from postulant.plans.ingest import answered, candidates, finished, import_order, import_report, keyed, prompts
from postulant.schema import MESSAGES, NATURAL_KEY
from postulant.session import work_folder
from postulant.sources.candidates import CandidateStore, PartitionedTable
from postulant.sources.messages import read_mail_files, read_messages, stream_messages
from postulant.streaming.incremental import import_stream

HEAD = "a\t\r\nb\t\r\nc\t\r\n Data freelance \t\r\n Lyon \t\r\n"


def mail(filename, month=1, text="Jean Dupont jean.d@site.fr 06 12 34 56 78", response='{"Freelance":"NON"}', name="cv.pdf"):
    files = [] if name is None else [(name, [text], None, [text], b"%PDF" + filename.encode(), None)]
    mail_name = filename if filename.endswith(".msg") else filename + ".msg"
    return (mail_name, datetime(2024, month, 1), HEAD, files, response)


def named(job, name, copy=0):
    return f"application_ {job} from {name}.msg{copy}.msg"


@pytest.fixture()
def store(spark):
    root = work_folder(spark, "store")
    return CandidateStore(spark, root, "people_" + root.rsplit("-", 1)[1])


def load(spark, store, load_id, *mails, **options):
    store.insert(candidates(spark.createDataFrame(list(mails), MESSAGES)), load_id, **options)


def names(store):
    return sorted((r.job, r.name) for r in store.read().collect())


def plan_of(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def test_three_kinds_of_mail(spark):
    rows = spark.createDataFrame(
        [mail("full"), mail("blank", text=" \n"), mail("none", name=None), mail("other", name="a.txt"),
         mail("silent", response=None), mail("docx", name="x.docx", text="rien")], MESSAGES,
    )
    got = {r.filename.removesuffix(".msg"): r for r in candidates(rows).collect()}
    assert got["full"].email == "jean.d@site.fr" and got["full"].phone == "06 12 34 56 78"
    assert got["full"].freelance == "OUI"  # by the title
    assert (got["full"].title, got["full"].location) == ("Data freelance", "Lyon")
    for kind in ("blank", "none", "other"):
        assert (got[kind].email, got[kind].phone, got[kind].grad_year, got[kind].years_exp) == ("N/A", "N/A", "N/A", -1)
    assert got["docx"].email is None and got["docx"].phone is None
    assert got["none"].cv is None and got["blank"].cv is not None and got["other"].cv is None
    assert got["silent"].companies == "N/A" and got["silent"].years_exp == -1
    assert {r.status for r in got.values()} == {0}
    asked = {r.filename.removesuffix(".msg"): r.prompt for r in prompts(rows).collect()}
    own = {r.filename.removesuffix(".msg"): r.prompt for r in prompts(rows, "Lis : {text}").collect()}
    assert own["docx"] == "Lis : rien"
    assert asked["blank"] is None and asked["none"] is None and "[EMAIL]" in asked["full"]


def test_import_order(spark):
    rows = candidates(spark.createDataFrame([mail(named("b", "x"), 1), mail(named("a", "y"), 3), mail(named("a", "z"), 2)], MESSAGES))
    assert [r.name for r in import_order(rows).collect()] == ["z", "y", "x"]


def test_file_bytes_are_not_read_unless_kept(spark):
    path = work_folder(spark, "mails")
    spark.createDataFrame([mail("x")], MESSAGES).write.parquet(path)
    rows = candidates(read_messages(spark, path))
    assert "content" not in plan_of(rows.drop("cv"))
    assert "content" in plan_of(rows)


def test_loads(spark, store):
    first = [mail(named("a", "x"), 1), mail(named("a", "x", 2), 2), mail(named("a", ""), 3)]
    load(spark, store, "one", *first)
    assert names(store) == [("a", ""), ("a", "x")]
    load(spark, store, "one", *first)  # a repeated load replaces its rows
    assert names(store) == [("a", ""), ("a", "x")]
    load(spark, store, "two", *first, mail(named("b", "y")))  # a new load appends the rows without a key again
    assert names(store) == [("a", ""), ("a", ""), ("a", "x"), ("b", "y")]
    assert store.read().select("id").distinct().count() == 4
    load(spark, store, "three", first[0], store_cv=True)  # nothing new
    load(spark, store, "four", mail(named("c", "z"), name=None), store_cv=True)  # no file
    assert len(names(store)) == 5 and store.read_files().count() == 0
    with pytest.raises(ValueError):
        load(spark, store, "no/slash", *first)


def test_months_are_pruned(spark, store):
    load(spark, store, "one", *[mail(named("a", f"n{m}"), m) for m in range(1, 7)], ("x.msg", None, HEAD, [], None))
    assert {r.applied_month for r in store.read().collect()} == {f"2024-0{m}" for m in range(1, 7)} | {"unknown"}
    spec = BrowseSpec(days=(date(2024, 2, 1), date(2024, 3, 31)))
    rows = filtered(store.read(), spec)
    assert sorted(r.name for r in rows.collect()) == ["n2", "n3", "n4"]  # midnight of the first of April
    assert "PartitionFilters: [isnotnull(applied_month" in plan_of(rows)
    assert browse(store.read(), spec).columns[-1] == "id"


def test_files_update_and_delete(spark, store):
    load(spark, store, "one", mail(named("a", "x"), 1), mail(named("a", "y"), 2), mail(named("a", "x", 3), 3), store_cv=True)
    load(spark, store, "two", mail(named("a", "z"), 1), store_cv=True)
    load(spark, store, "three", mail(named("a", "w"), 1))
    ids = {r.name: r.id for r in store.read().collect()}
    files = {r.id: bytes(r.cv) for r in store.read_files().collect()}
    assert set(files) == {ids["x"], ids["y"], ids["z"]}
    assert files[ids["x"]] == b"%PDF" + named("a", "x").encode()
    assert tuple(store.lookup(ids["z"]).first()) == (files[ids["z"]], "z", "a")
    assert tuple(store.lookup(ids["w"]).first()) == (None, "w", "a")
    assert store.lookup("nobody").first() is None

    before = {r.id: r.path for r in store.read().select("id", F.input_file_name().alias("path")).collect()}
    edits = spark.createDataFrame([(ids["x"], 3, "2024-05-05"), (ids["y"], 0, "2024-02-01")], "id string, status int, applied_at string")
    store.update(edits)
    rows = {r.name: r for r in store.read().collect()}
    assert (rows["x"].status, rows["x"].applied_month, rows["x"].load_id) == (3, "2024-05", "one")
    assert len(rows) == 4
    after = {r.id: r.path for r in store.read().select("id", F.input_file_name().alias("path")).collect()}
    assert {n for n in rows if before[ids[n]] == after[ids[n]]} == {"y", "z", "w"}  # untouched partitions stay

    store.delete(spark.createDataFrame([(ids["x"],), (ids["z"],), ("nobody",)], "id string"))
    assert names(store) == [("a", "w"), ("a", "y")]
    assert {r.id for r in store.read_files().collect()} == {ids["y"]}
    store.delete(spark.createDataFrame([("nobody",)], "id string"))
    store.update(spark.createDataFrame([("nobody", 1)], "id string, status int"))
    assert names(store) == [("a", "w"), ("a", "y")]


@pytest.mark.parametrize("done", [0, 1, 2])
def test_an_update_that_breaks_off(spark, store, monkeypatch, done):
    """After any number of switched partitions no row is missing, and a second try completes the update."""
    load(spark, store, "one", *[mail(named("a", f"n{m}"), m) for m in (1, 2, 5)])
    ids = {r.name: r.id for r in store.read().collect()}
    edits = spark.createDataFrame(
        [(ids["n1"], "2024-05-09", 1), (ids["n2"], "2024-07-01", 2)], "id string, applied_at string, status int"
    )
    left = iter(range(done))
    real = PartitionedTable._alter

    def flaky(self, change):
        if next(left, None) is None:
            raise RuntimeError("driver lost")
        real(self, change)

    with monkeypatch.context() as patch:
        patch.setattr(PartitionedTable, "_alter", flaky)
        with pytest.raises(RuntimeError):
            store.update(edits)
    assert {r.id for r in store.read().collect()} == set(ids.values())
    store.update(edits)
    rows = [(r.name, r.status, r.applied_month) for r in store.read().collect()]
    assert sorted(rows) == [("n1", 1, "2024-05"), ("n2", 2, "2024-07"), ("n5", 0, "2024-05")]


def test_stream_equals_batch(spark, store):
    folder, progress = work_folder(spark, "mails"), work_folder(spark, "progress")
    days = [mail(named(f"job {n % 3}", f"name {n % 7}", n), 1 + n % 12) for n in range(30)] + [mail(named("a", "", n), 1) for n in range(3)]
    for part in range(3):
        spark.createDataFrame(days[part::3], MESSAGES).coalesce(1).write.mode("append").parquet(folder)

    def run(checkpoint, source):
        import_stream(stream_messages(spark, folder, files_per_batch=1), store, checkpoint, source).awaitTermination()

    run(progress, "mails")
    loads = {r.load_id for r in store.read().select("load_id").distinct().collect()}
    assert len(loads) == 3  # one load per micro-batch
    whole = {(f"job {n % 3}", f"name {n % 7}") for n in range(30)}
    assert names(store) == sorted([*whole, *[("a", "")] * 3])

    run(progress, "mails")  # nothing new
    assert len(names(store)) == len(whole) + 3
    run(work_folder(spark, "progress"), "again")  # a replay adds only rows without a key
    assert names(store) == sorted([*whole, *[("a", "")] * 6])


def test_repeated_micro_batch(spark, store):
    first, second = [mail(named("a", "x")), mail(named("a", ""))], [mail(named("a", "x", 2)), mail(named("b", "")), mail(named("b", "y"))]
    for load_id, batch in (("s-0", first), ("s-0", first), ("s-1", second), ("s-1", second)):
        load(spark, store, load_id, *batch)
    assert names(store) == [("a", ""), ("a", "x"), ("b", ""), ("b", "y")]


def test_mail_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "application_ a from b.msg").write_bytes(b"mail")
    (tmp_path / "sub" / "c.msg").write_bytes(b"more")
    (tmp_path / "notes.txt").write_bytes(b"no")
    rows = read_mail_files(spark, str(tmp_path)).orderBy("filename").collect()
    assert [(r.filename, bytes(r.content)) for r in rows] == [("application_ a from b.msg", b"mail"), ("c.msg", b"more")]


@pytest.mark.parametrize("settings, shared", [
    ({"spark.checkpoint.dir": "/shared", "spark.master": "yarn"}, "/shared/x-"),
    ({"spark.master": "local[2]"}, tempfile.gettempdir()),
    ({"spark.master": "yarn"}, None),
])
def test_work_folder(settings, shared):
    session = SimpleNamespace(conf=SimpleNamespace(get=settings.get))
    if shared:
        assert work_folder(session, "x").startswith(shared)
    else:
        with pytest.raises(ValueError):
            work_folder(session, "x")


def test_two_checkpoints_of_one_source_keep_all_rows(spark, tmp_path):
    store = CandidateStore(spark, str(tmp_path / "tables"), "twice")
    for run in ("first", "second"):
        folder = tmp_path / run
        rows = [(f"application_ Tester from {run.title()} Person.msg", datetime(2024, 1, 2), "body", [], None)]
        spark.createDataFrame(rows, MESSAGES).write.parquet(str(folder))
        stream = spark.readStream.schema(MESSAGES).parquet(str(folder))
        import_stream(stream, store, str(tmp_path / f"checkpoint-{run}"), source="mails").awaitTermination()
    assert {r.name for r in store.read().collect()} == {"First Person", "Second Person"}


def test_rows_for_unread_partitions_stop_the_switch(spark, tmp_path):
    store = CandidateStore(spark, str(tmp_path), "guarded")
    rows = [(f"application_ Tester from Person {c}.msg", datetime(2024, m, 2), "body", [], None) for m, c in ((1, "Anna"), (2, "Bert"))]
    store.insert(candidates(spark.createDataFrame(rows, MESSAGES)), "load")
    january = store.read().where("applied_month = '2024-01'")
    with pytest.raises(RuntimeError):
        store.people.replace(january.withColumn("applied_month", F.lit("2024-02")), store.people.labels(january))
    assert store.read().count() == 2


def test_vacuum_removes_deleted_people_from_storage(spark, tmp_path):
    store = CandidateStore(spark, str(tmp_path), "gone")
    rows = [(f"application_ Tester from Person {c}.msg", datetime(2024, 1, 2), "body", [], None) for c in ("Anna", "Bert")]
    batch = candidates(spark.createDataFrame(rows, MESSAGES))
    store.insert(batch, "load")
    ids = {r.id for r in store.read().collect()}
    store.insert(batch, "load")
    assert {r.id for r in store.read().collect()} == ids
    store.delete(store.read().where("name = 'Person Anna'").select("id"))
    store.vacuum()
    stored = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path))
    assert {r.name for r in stored.collect()} - {None} == {"Person Bert"}  # nor does the key index name the other
    assert [r.name for r in store.read().collect()] == ["Person Bert"]


def test_only_mails_are_imported(spark):
    rows = spark.createDataFrame([mail("a"), ("b.eml", *mail("a")[1:]), (None, *mail("a")[1:])], MESSAGES)
    assert [r.filename for r in candidates(rows).collect()] == [r.filename for r in prompts(rows).collect()] == ["a.msg"]


def test_each_file_is_joined_as_its_reader_did(spark):
    files = [[("cv.pdf", ["a@b.fr", "c"], None, None, b"", by)] for by in (None, False, True)]
    rows = spark.createDataFrame([(f"{i}.msg", None, HEAD, f, None) for i, f in enumerate(files)], MESSAGES)
    assert [r.prompt for r in prompts(rows, "{text}").orderBy("filename").collect()] == ["[EMAIL]", "[EMAIL]", "[EMAIL] c"]


def test_texts_are_read_for_new_candidates_only(spark):
    rows = spark.createDataFrame([mail(named("a", "x"))], MESSAGES)
    new = finished(earliest_per_key(keyed(rows), NATURAL_KEY, ("applied_at", "filename")))
    above, below = new._jdf.queryExecution().optimizedPlan().toString().split("WindowGroupLimit", 1)
    assert "from_json" in above.lower() and "from_json" not in below.lower()
    assert "regexp_extract_all" not in below.lower()


def test_failed_prompts_are_told_and_asked_once_more_only_if_the_call_broke(spark, tmp_path):
    log = tmp_path / "asked"

    def client():
        def ask(texts):
            with log.open("a") as out:
                out.write("x" * len(texts) + "\n")
            return texts.map(lambda t: ValueError("quota") if "bad" in t else "{}")

        return ask

    rows = spark.createDataFrame([mail("a", text="good"), mail("b", text="bad"), mail("c", name=None)], MESSAGES).coalesce(1)
    got = {r.filename: (r.response, r.error) for r in answered(rows, client, error="error").collect()}
    assert got == {"a.msg": ("{}", None), "b.msg": (None, "ValueError: quota"), "c.msg": (None, None)}
    assert log.read_text().replace("\n", "") == "xx"  # every prompt once


def test_report_ranks_within_the_job(spark):
    mails = [mail(named("a", f"n{i}", i), month) for i, month in enumerate((3, 1, 1, 2))] + [mail(named("b", "z"), 1)]
    undated = (named("a", "late", 9), None, HEAD, [], None)
    rows = import_report(candidates(spark.createDataFrame([*mails, undated], MESSAGES))).collect()
    places = {r.name: r.place for r in rows}
    assert places == {"n1": 1, "n2": 2, "n3": 3, "n0": 4, "late": 5, "z": 1}
    assert {(r.years_exp, r.row_class) for r in rows} == {("-1.0", "freelance")} and "cv" not in rows[0]


def test_a_repeat_without_files_removes_those_of_the_first_try(spark, store):
    load(spark, store, "one", mail(named("a", "x")), store_cv=True)
    assert store.read_files().count() == 1
    load(spark, store, "one", mail(named("a", "x")))
    assert store.read_files().count() == 0 and len(names(store)) == 1


def test_updates_that_differ_per_run_lose_nothing(spark, store):
    load(spark, store, "one", *[mail(named("a", f"n{m}"), m) for m in range(1, 7)])
    ids = store.read().select("id")
    moved = F.concat(F.lit("2024-0"), (F.floor(F.rand() * 6) + 1).cast("string"), F.lit("-02")).alias("applied_at")
    store.update(ids.union(ids).select("id", moved))
    assert {r.name for r in store.read().collect()} == {f"n{m}" for m in range(1, 7)}
    assert store.read().count() == 6
