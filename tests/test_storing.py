"""What the store keeps beside its rows: keys, packed loads, counts; pages, saves, answers and searches built on such tables."""

import random
import re
from datetime import date, datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from postulant.operators import paging, ranges, saving
from postulant.operators import statistics as st
from postulant.operators.browse import BrowseSpec, browse, in_order, present
from postulant.operators.ranges import SortKey, rank_within
from postulant.schema import CANDIDATES
from postulant.session import work_folder
from postulant.sources.answers import AnswerTable
from postulant.sources.candidates import CandidateStore, PartitionedTable
from postulant.sources.keys import ENTRIES, KeyIndex
from postulant.sources.search import FOLDED, TrigramIndex, fold, required_words

ROW = "filename string, applied_at timestamp, job string, name string, years_exp double, status int"


@pytest.fixture()
def store(spark):
    root = work_folder(spark, "store")
    return CandidateStore(spark, root, "kept_" + root.rsplit("-", 1)[1])


def batch(spark, rows):
    """Rows of (job, name, day of 2024, years)."""
    made = [(f"{job}-{name}-{day}.msg", None if day is None else datetime(2024, 1, 1) + timedelta(days=day), job, name, years, 0) for job, name, day, years in rows]
    plain = spark.createDataFrame(made, ROW)
    more = [F.lit(None).cast(f.dataType).alias(f.name) for f in CANDIDATES.fields if f.name not in (*plain.columns, "id")]
    return plain.select("*", *more)


def held(store):
    return sorted((r.job, r.name, r.load_id) for r in store.read().collect())


def test_entries_survive_splits_and_merges(spark, tmp_path):
    index = KeyIndex(spark, str(tmp_path / "keys"), bucket_bytes=5000, bucket_files=2)
    asked = spark.createDataFrame([("job", f"n{k}") for k in range(495, 505)], "job string, name string")
    read = {}
    for step in (1, 2, 3, 4):
        rows = [("job", f"n{500 * step + k}", f"i{step}-{k}", "2024-01", f"load{step}") for k in range(500)]
        index.add(spark.createDataFrame(rows, ENTRIES))
        read[step] = index.candidates(asked).count()
    assert index.read().distinct().count() == 2000
    assert len(index._depths()) == 1 and index._depths()[0] >= 2
    # What a batch reads follows its own keys: ten buckets, smaller ones as the table grows.
    assert read[4] < read[1], read
    assert {r.name for r in index.matching(asked).collect()} == {f"n{k}" for k in range(500, 505)}


def test_a_broken_split_or_merge_loses_nothing(spark, tmp_path, monkeypatch):
    index = KeyIndex(spark, str(tmp_path / "keys"), bucket_bytes=1500, bucket_files=1)
    import postulant.sources.keys as module

    def lost(*_):
        raise RuntimeError("driver lost")

    for step in range(2):
        rows = spark.createDataFrame([("job", f"n{step}-{k}", "i", "2024-01", "l") for k in range(30)], ENTRIES)
        with monkeypatch.context() as patch:
            patch.setattr(module, "remove", lost)
            try:
                index.add(rows)
            except RuntimeError:
                pass
        index.add(rows)
        assert index.read().select("name").distinct().count() == 30 * (step + 1)


def test_tiny_buckets_split_once_and_not_into_thousands_of_folders(spark, tmp_path, monkeypatch):
    index = KeyIndex(spark, str(tmp_path / "keys"), bucket_bytes=500, bucket_files=2)
    written, write = [], KeyIndex._write
    monkeypatch.setattr(KeyIndex, "_write", lambda self, *rest: (written.append(1), write(self, *rest)))
    names = [f"n{k}" for k in range(40)]
    index.add(spark.createDataFrame([("job", n, "i", "2024-01", "l") for n in names], ENTRIES))
    assert index._depths() == [2] and len(written) == 2
    for _ in range(2):
        index.rebuild(index.read())
        assert index._depths() == [2]  # rebuilding alone needs no smaller buckets
    index.discard(spark.createDataFrame([("job", n, "i") for n in names[:1]], "job string, name string, id string").withColumn("id", F.lit("j")))
    assert sorted(r.name for r in index.read().collect()) == sorted(names)


def test_merges_of_most_buckets_replace_the_folder_and_a_break_loses_nothing(spark, tmp_path, monkeypatch):
    index = KeyIndex(spark, str(tmp_path / "keys"), bucket_files=1)
    import postulant.sources.keys as module

    def lost(*_):
        raise RuntimeError("driver lost")

    rows = [spark.createDataFrame([("job", f"n{step}-{k}", f"i{step}-{k}", "2024-01", "l") for k in range(100)], ENTRIES) for step in range(3)]
    index.add(rows[0])
    with monkeypatch.context() as patch:
        patch.setattr(module, "remove", lost)
        with pytest.raises(RuntimeError):
            index.add(rows[1])
    assert len(index._depths()) == 2 and index.read().count() == 200
    index.add(rows[2])
    assert len(index._depths()) == 1 and index.read().count() == 300
    index.discard(rows[1].select("job", "name", "id"))
    assert {r.name[:2] for r in index.read().collect()} == {"n0", "n2"}


def test_many_first_entries_are_written_once_and_their_buckets_not_looked_for(spark, tmp_path, monkeypatch):
    index = KeyIndex(spark, str(tmp_path / "keys"), bucket_bytes=2000)
    rows = spark.range(1500).select(F.lit("job").alias("job"), *[F.concat(F.lit(c), "id").alias(c) for c in ("name", "id", "applied_month", "load_id")])
    index.rebuild(rows.limit(0))
    written, write = [], KeyIndex._write
    monkeypatch.setattr(KeyIndex, "_write", lambda self, *rest: (written.append(1), write(self, *rest)))
    monkeypatch.setattr(KeyIndex, "_touched", lambda *_: pytest.fail("rows were read for their buckets"))
    index.add(rows, 1500)
    assert index._depths() == [2] and len(written) == 1
    index.add(rows.withColumn("name", F.concat("name", F.lit("x"))), 64 << 8)
    assert index.read().distinct().count() == 3000
    monkeypatch.setattr("postulant.sources.keys.fits_broadcast", lambda _: False)
    monkeypatch.setattr(KeyIndex, "candidates", lambda *_: pytest.fail("many keys touch every bucket"))
    assert sorted(r.name for r in index.matching(rows.select("job", "name").limit(1500)).collect()) == sorted(f"name{k}" for k in range(1500))


def test_changes_read_and_write_only_what_they_need(spark, store, monkeypatch):
    """Without stored files no file table is written, and a load's partitions and spellings are told by its counts."""
    staged, stage, labelled, labels = [], PartitionedTable.stage, [], PartitionedTable.labels
    monkeypatch.setattr(PartitionedTable, "stage", lambda self, rows: (staged.append(self.name), stage(self, rows))[1])
    monkeypatch.setattr(PartitionedTable, "labels", lambda self, rows: (labelled.append(self.name), labels(self, rows))[1])
    for load in ("one", "two", "two"):
        rows = [("a", f"{load}-{k}", 10 * k, 1.0) for k in range(3)] + [("", "", 1, 1.0), ("b", "undated", None, 1.0)]
        store.insert(batch(spark, rows), load)
    assert not labelled and staged == [store.people.name] * 3
    assert sorted({r.job for r in store.spellings().collect()}) == ["", "a", "b"]
    store.retire(datetime(2024, 1, 15))
    assert {*staged} == {store.people.name}
    assert held(store) == [("a", "one-2", "one"), ("a", "two-2", "two"), ("b", "undated", "one")]
    assert store.counts().agg(F.sum("n")).first()[0] == 3


def test_known_keys_follow_deletes_and_updates(spark, store):
    store.insert(batch(spark, [("a", "x", 1, 1.0), ("a", "y", 2, 1.0), ("", "z", 3, 1.0)]), "one")
    store.insert(batch(spark, [("a", "x", 5, 2.0), ("b", "x", 5, 2.0), ("", "z", 3, 2.0)]), "two")
    assert held(store) == [("", "z", "one"), ("", "z", "two"), ("a", "x", "one"), ("a", "y", "one"), ("b", "x", "two")]
    store.delete(store.read().where("job = 'a' AND name = 'x'").select("id"))
    store.update(store.read().where("job = 'b'").select("id", F.lit("c").alias("job"), F.lit("2024-06-01").alias("applied_at")))
    store.insert(batch(spark, [("a", "x", 6, 3.0), ("b", "x", 6, 3.0), ("c", "x", 6, 3.0), ("a", "y", 6, 3.0)]), "three")
    assert held(store) == [("", "z", "one"), ("", "z", "two"), ("a", "x", "three"), ("a", "y", "one"), ("b", "x", "three"), ("c", "x", "two")]


def test_entries_of_a_load_that_broke_off_do_not_count(spark, store, monkeypatch):
    def lost(*_):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as patch:
        patch.setattr(PartitionedTable, "switch", lost)
        with pytest.raises(RuntimeError):
            store.insert(batch(spark, [("a", "x", 1, 1.0)]), "one")
    assert store.keys.read().count() == 1
    store.insert(batch(spark, [("a", "x", 2, 1.0)]), "two")
    assert held(store) == [("a", "x", "two")]


def test_a_store_without_an_index_gets_one(spark, store):
    store.insert(batch(spark, [("a", "x", 1, 1.0), ("a", "", 1, 1.0)]), "one")
    from postulant.sources.files import remove

    remove(spark, store.keys.root)
    store.insert(batch(spark, [("a", "x", 2, 1.0), ("a", "y", 2, 1.0)]), "two")
    assert held(store) == [("a", "", "one"), ("a", "x", "one"), ("a", "y", "two")]
    store.delete(store.read().where("name = 'x'").select("id"))
    store.vacuum()
    assert sorted(r.name for r in store.keys.read().collect()) == ["y"]


def segments(store):
    return sorted((r.applied_month, r.n) for r in store.read().groupBy("applied_month").agg(F.count_distinct("segment").alias("n")).collect())


def test_closed_loads_are_packed_and_refused(spark, store, monkeypatch):
    for k in range(5):
        store.insert(batch(spark, [("a", f"n{k}", 1 + k, 1.0), ("a", f"m{k}", 40, 1.0)]), f"load-{k}")
    later = datetime.now()
    store.insert(batch(spark, [("a", "new", 3, 1.0)]), "open")
    before = held(store)
    with monkeypatch.context() as patch:  # breaks off between the new and the old partitions

        def lost(*_):
            raise RuntimeError("driver lost")

        patch.setattr(PartitionedTable, "forget", lost)
        with pytest.raises(RuntimeError):
            store.compact(later)
    store.compact(later)
    assert held(store) == before
    assert segments(store) == [("2024-01", 2), ("2024-02", 1)]  # the open load keeps its own
    with pytest.raises(ValueError):
        store.insert(batch(spark, [("b", "n", 1, 1.0)]), "load-2")
    store.insert(batch(spark, [("a", "new", 3, 1.0), ("a", "n1", 9, 1.0)]), "open")
    assert held(store) == before
    store.delete(store.read().where("name = 'n3'").select("id"))
    store.compact(datetime.now() + timedelta(days=1), rows_per_segment=3)
    assert held(store) == [r for r in before if r[1] != "n3"]
    assert same_counts(store)
    assert store.insert(batch(spark, [("a", "n3", 1, 1.0)]), "again") is None and ("a", "n3", "again") in held(store)


def same_counts(store):
    for period in ("month", "day"):
        full = st.count_by_job_and_period(store.read(), period).collect()
        assert st.merged_by_job_and_period(store.counts(), period).collect() == full
        assert st.merged_by_period(store.counts(), period).collect() == st.count_by_period(store.read(), period).collect()
    assert st.merged_by_job(store.counts()).collect() == st.count_by_job(store.read()).collect()
    return True


def test_counts_follow_every_change(spark, store, monkeypatch):
    monkeypatch.setattr("postulant.sources.candidates.COUNT_FILES", 3)
    assert store.counts().count() == 0
    rows = [(f"j{k % 3}", f"n{k}", k % 50, float(k)) for k in range(40)] + [("", "", 3, 0.0), ("j1", "undated", None, 1.0)]
    store.insert(batch(spark, rows), "one")
    assert same_counts(store)
    store.insert(batch(spark, rows[:10] + [("j9", "more", 70, 1.0)]), "two")
    store.insert(batch(spark, rows[5:]), "one")  # repeated with fewer rows
    assert same_counts(store)
    store.update(store.read().where("years_exp > 20").select("id", F.lit("2024-09-09").alias("applied_at"), F.lit("moved").alias("job")))
    store.delete(store.read().where("job = 'j1'").select("id"))
    assert same_counts(store)
    files = st.merged_by_job_and_period(store.counts(), "day").inputFiles()
    assert files and all("-counts/" in file for file in files)  # candidates are not scanned
    days = (date(2024, 1, 3), date(2024, 1, 20))
    assert st.merged_by_job(st.filter_counts(store.counts(), days=days)).collect() == st.count_by_job(st.filter_applications(store.read(), days=days)).collect()


# ---- pages ----


def people(spark, n, seed=1):
    rng = random.Random(seed)
    names = ["Émile", "emile", "Zoé", "", None, "œuvre", "Oeuvre", "ß", "ss", "A"]
    rows = [(i, rng.choice(names), rng.choice([None, *range(5)]), None if i % 9 == 0 else datetime(2024, 1, 1 + rng.randrange(3), rng.randrange(24))) for i in range(n)]
    made = spark.createDataFrame(rows, "id long, name string, years int, applied_at timestamp")
    return made.select("*", F.col("years").cast("double").alias("years_exp"), F.lit("x").alias("phone"), F.lit(0).alias("status"), F.lit("j").alias("job"))


@pytest.mark.parametrize(("sort", "whole"), [((), 10**6), ((("name", False), ("applied_at", False)), 10**6), ((("applied_at", True), ("name", True)), 60)])
def test_every_page_equals_browse(spark, monkeypatch, sort, whole):
    monkeypatch.setattr(paging, "WHOLE", whole)  # at times ranges of ranges
    monkeypatch.setattr(paging, "RANGES", 8)
    rows = people(spark, 700).cache()
    spec = BrowseSpec(sort=sort, page_size=23, experience=(0, 3))
    made = paging.directory(rows, spec, ranges=5)
    assert made.n_rows() == rows.where("years_exp BETWEEN 0 AND 3").count()
    wanted = present(in_order(rows.where("years_exp BETWEEN 0 AND 3"), sort)).collect()
    for page in (0, made.n_pages() // 2, made.n_pages() - 1, made.n_pages()):
        assert paging.jump(rows, made, page).collect() == wanted[23 * page : 23 * page + 23], page


def test_missing_values_reach_every_page(spark):
    """Also where missing dates lie beyond the last bound and the scan gets plain conditions."""
    rows = people(spark, 300).cache()
    for up in (True, False):
        spec = BrowseSpec(sort=(("applied_at", up),), page_size=60, experience=(-1, 30))
        made = paging.directory(rows.na.fill(0.0, ["years_exp"]), spec, ranges=8)
        found = [r.id for p in range(made.n_pages()) for r in paging.jump(rows.na.fill(0.0, ["years_exp"]), made, p).collect()]
        assert found == [r.id for r in present(in_order(rows.na.fill(0.0, ["years_exp"]), spec.sort)).collect()]


def test_the_last_page_reads_one_range(spark):
    n = 400_000
    rows = spark.range(n).select("id", (F.col("id") * 7919 % n).cast("double").alias("years_exp"), F.lit("p").alias("phone"), F.lit(1).alias("status"))
    spec = BrowseSpec(sort=(("years_exp", True),), experience=(0, n))
    made = paging.directory(rows, spec)
    assert len(made.counts) > 200 and max(made.counts) < 12 * n / len(made.counts)
    page = paging.jump(rows, made, made.n_pages() - 1)
    limits = [int(x) for x in re.findall(r"TakeOrderedAndProject\(limit=(\d+)", page._jdf.queryExecution().executedPlan().toString())]
    assert limits and max(limits) <= 40
    middle = paging.jump(rows, made, made.n_pages() // 2)
    limits = [int(x) for x in re.findall(r"limit=(\d+)", middle._jdf.queryExecution().executedPlan().toString())]
    assert max(limits) < 2 * max(made.counts)
    assert [int(r.id) * 7919 % n for r in page.collect()] == list(range(n - 20, n))
    assert browse(rows, spec).collect() == paging.jump(rows, made, 0).collect()


def test_ranks_of_a_hot_group_are_dealt_out(spark):
    rng = random.Random(4)
    rows = [("hot", None, f"f{rng.randrange(10**9):09}") for _ in range(6000)] + [(rng.choice(["a", None, ""]), datetime(2024, 1, rng.randint(1, 9)), f"g{i}") for i in range(500)]
    df = spark.createDataFrame(rows, "job string, applied_at timestamp, filename string")
    keys = [SortKey("applied_at", nulls_first=False), SortKey("filename")]
    found = rank_within(df, "job", keys, ["filename"], ranges=64)
    wanted = {}
    for job in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == job), key=lambda r: (r[1] is None, r[1] or 0, r[2]))
        wanted |= {(job, r[2]): i + 1 for i, r in enumerate(own)}
    assert {(r.job, r.filename): r.place for r in found.collect()} == wanted
    bounds = ranges.sampled_bounds(df, [SortKey("job"), *keys], 64, ["filename"])
    largest = df.groupBy("job", ranges.range_of(df, [SortKey("job"), *keys], bounds)).count().agg(F.max("count")).first()[0]
    assert largest < 600
    assert rank_within(df.limit(0), "job", keys, ["filename"]).count() == 0


# ---- saving ----


def test_three_way(spark):
    schema = "id long, phone string, status int, name string, years_exp double"
    base = spark.createDataFrame([(i, None, 0, "n", 1.0) for i in range(8)], schema)
    shown = present(base)
    new = {1: ("name", "mine"), 2: ("name", "mine"), 3: ("name", "mine"), 4: ("years_exp", 2.0), 6: ("name", "mine"), 7: ("phone", "06")}
    edited = shown.toPandas()
    for i, (column, value) in new.items():
        edited.loc[edited["id"] == str(i), column] = value
    now = [(0, None, 0, "theirs", 1.0), (1, None, 0, "n", 1.0), (2, None, 0, "theirs", 1.0), (3, None, 0, "mine", 1.0), (4, None, 3, "n", 1.0), (5, None, 0, "n", 1.0), (7, None, 0, "n", 1.0)]
    stored = spark.createDataFrame(now, schema)
    outcome = saving.three_way(stored, shown, spark.createDataFrame(edited, shown.schema)).cache()
    states = {int(r.id): r.state for r in outcome.collect()}
    assert states == {0: "unchanged", 1: "saved", 2: "conflict", 3: "unchanged", 4: "saved", 5: "unchanged", 6: "gone", 7: "saved"}
    told = {int(r.id): [tuple(c) for c in r.conflicts] for r in outcome.collect() if r.conflicts}
    assert told == {2: [("name", "n", "mine", "theirs")]}
    kept = {int(r.id): (r.status, r.name, r.years_exp, r.phone) for r in saving.to_store(outcome).collect()}
    assert kept == {1: (0, "mine", 1.0, None), 4: (3, "n", 2.0, None), 7: (0, "n", 1.0, "06")}  # their status stays


def test_two_people_save_one_page(spark, store):
    store.insert(batch(spark, [("a", f"n{k}", 1, 1.0) for k in range(4)]), "one")
    shown = present(store.read().drop("applied_month", "segment", "load_id"))
    page = spark.createDataFrame(shown.collect(), shown.schema)
    first = page.withColumn("years_exp", F.when(F.col("name") == "n1", 5.0).otherwise(F.col("years_exp")))
    second = page.withColumn("years_exp", F.when(F.col("name").isin("n1", "n2"), 9.0).otherwise(F.col("years_exp")))
    assert store.save(page, first).count() == 0
    left = store.save(page, second).collect()
    assert [(r.name, r.state) for r in left] == [("n1", "conflict")]
    assert {r.name: r.years_exp for r in store.read().collect()} == {"n0": 1.0, "n1": 5.0, "n2": 9.0, "n3": 1.0}


# ---- answers ----


def test_each_prompt_is_asked_once(spark, tmp_path):
    log = tmp_path / "asked"
    log.touch()

    def client():
        def ask(prompts):
            with log.open("a") as out:
                out.write("".join(f"{p}\n" for p in prompts))
            return prompts.map(lambda p: ValueError("quota") if p.startswith("bad") else f"<{p}>")

        return ask

    kept = AnswerTable(spark, str(tmp_path / "table"))
    now = datetime(2024, 1, 1)
    rows = [("m1", "good"), ("m2", "good"), ("m3", "bad"), ("m4", None), ("m5", "")]
    df = spark.createDataFrame(rows, "mail string, prompt string")

    def asked():
        done = log.read_text().split("\n")[:-1]
        log.write_text("")
        return sorted(done)

    found = {r.mail: (r.response, r.error) for r in kept.ask(df, client, now=now).collect()}
    assert found == {"m1": ("<good>", None), "m2": ("<good>", None), "m3": (None, "ValueError: quota"), "m4": (None, None), "m5": ("<>", None)}
    assert asked() == ["", "bad", "good"]
    kept.ask(df, client, now=now + timedelta(seconds=29)).collect()
    assert asked() == []
    waited = 0
    for wait in (30, 60, 120, 240):
        waited += wait
        kept.ask(df, client, now=now + timedelta(seconds=waited)).collect()
        assert asked() == ["bad"]
    kept.ask(df, client, now=now + timedelta(days=9)).collect()
    assert asked() == []  # no sixth attempt
    more = spark.createDataFrame([("m9", "good"), ("m8", "new")], "mail string, prompt string")
    assert {r.mail: r.response for r in kept.ask(more, client).collect()} == {"m9": "<good>", "m8": "<new>"}
    assert asked() == ["new"]
    assert kept.ask(more.limit(0), client).count() == 0


def test_a_lost_job_keeps_what_was_committed(spark, tmp_path, monkeypatch):
    import postulant.sources.answers as module

    monkeypatch.setattr(module, "COMMITTED", 10)
    log = tmp_path / "asked"

    def client(limit):
        def make():
            def ask(prompts):
                if log.exists() and len(log.read_text().split()) > limit:
                    raise SystemError("lost")
                with log.open("a") as out:
                    out.write("".join(f"{p}\n" for p in prompts))
                return prompts.str.upper()

            return ask

        return make

    df = spark.createDataFrame([(f"p{i}",) for i in range(60)], "prompt string").coalesce(1)
    kept = AnswerTable(spark, str(tmp_path / "table"), waits=(0, 0, 0, 0, 0))
    kept.ask(df, client(25), now=datetime(2024, 1, 1)).collect()
    first = log.read_text().split()
    assert 25 < len(first) < 60
    assert {r.response for r in kept.ask(df, client(10**9), now=datetime(2024, 1, 2)).collect()} == {f"P{i}" for i in range(60)}
    assert sorted(log.read_text().split()) == sorted(f"p{i}" for i in range(60))  # nothing twice


# ---- search ----


def test_folding_covers_every_character(spark):
    """Each character that a case-blind pattern takes for a plain letter folds to it."""
    codes = [c for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000]
    chars = spark.createDataFrame([(chr(c),) for c in codes], "c string")
    plain = F.array(*[F.lit(x) for x in "abcdefghijklmnopqrstuvwxyz0123456789 -_@"])
    hits = chars.select("c", F.explode(plain).alias("p")).where("regexp_like(c, concat('(?iu)', p))").select("c", "p", fold(F.col("c")).alias("f")).collect()
    assert len(hits) > 60 and all(r.f == r.p for r in hits)
    assert {r.c for r in hits if not r.c.isascii()} == set(FOLDED)


@pytest.mark.parametrize("pattern, words", [
    ("Spark", ["spark"]), ("spar?k engine", ["spa", "k engine"]), ("a|spark", []), ("(spark)", []), (r"c\+\+ and", ["+ and"]), ("data.*lake", ["data", "lake"]),
    ("ab[xyz]spark", ["spark"]), (r"[a\]bcd]", []), ("x{2,3}spark", ["spark"]), (r"\dspark\b", ["spark"]), (r"\x41bcd", []), ("straße", ["stra"]), ("^java$", ["java"]), ("jav+ascript", ["jav", "ascript"]),
])
def test_required_words(pattern, words):
    assert required_words(pattern) == words


def test_index_holds_the_trigrams_of_every_text_and_one_entry_per_file(spark, tmp_path, monkeypatch):
    import postulant.sources.search as module

    monkeypatch.setattr(module, "SLICE", 7)
    texts = ["Spark ſKİ", "ab", "cd", "", None, "naïve café", "x" * 40, "a\u0000b", "日本語abc", "K\u212aı~ÿ\x7f?", "zzzzY", " the end"]

    def expected(of):
        grams = set()
        for text in of:
            plain = "".join(FOLDED.get(c, c.lower() if c.isascii() else c) for c in text or "")
            grams |= {plain[i : i + 3] for i in range(len(plain) - 2)}
        return module.slots_of([g for g in grams if g.isascii()])

    import numpy as np
    import pyarrow as pa

    for first in (0, 3):
        seen = np.zeros(1 << 21, bool)
        module._mark(seen, pa.array(texts).slice(first))
        assert sorted({*module._slot_of_gram()[np.flatnonzero(seen)].tolist()}) == expected(texts[first:])
    place = str(tmp_path / "t")
    rows = [(t, n, p) for p in range(2) for t, n in zip(texts[p::2], texts[::-1][p::2])]
    spark.createDataFrame(rows, "skills string, name string, part int").repartition(2, "part").write.partitionBy("part").parquet(place)
    df = spark.read.schema("skills string, name string, part int").parquet(place)
    index = TrigramIndex(spark, str(tmp_path / "index"), columns=("skills", "name"))
    index.add(df)
    entries = [(r.file, r.column, r.slot) for r in index._read("entries", module.ENTRIES).collect()]
    assert len({*entries}) == len(entries)
    for p in range(2):
        for column, of in (("skills", texts[p::2]), ("name", texts[::-1][p::2])):
            assert sorted(s for f, c, s in entries if f"part={p}/" in f and c == column) == expected(of)


def test_search_skips_files_and_finds_every_row(spark, tmp_path):
    rng = random.Random(2)
    words = ["spark", "SPARK", "ſpark", "java", "Kafka", "Kafka", "data lake", "python", "c++", "İstanbul", "naïve", "spar", "k"]
    rows = [(i, " ".join(rng.choices(words[2 * (i % 5) : 2 * (i % 5) + 4], k=rng.randint(0, 4))) or None, i % 5) for i in range(400)]
    place = str(tmp_path / "t")
    spark.createDataFrame(rows, "id long, skills string, part int").repartition(5, "part").write.partitionBy("part").parquet(place)
    df = spark.read.schema("id long, skills string, part int").parquet(place)
    index = TrigramIndex(spark, str(tmp_path / "index"), columns=("skills",))
    assert len(index.add(df)) == 5 and index.add(df) == []
    skipped = 0
    for pattern in ("spark", "kafka", "data.lake", r"c\+\+", "istan", "na.ve", "spar|java", "pyt?hon", "SPARK$", "zzz", "k"):
        found = index.search(df, "skills", pattern)
        assert sorted(r.id for r in found.collect()) == sorted(r.id for r in df.where(F.col("skills").rlike("(?iu)" + pattern)).collect()), pattern
        slots = required_words(pattern)
        skipped += bool(slots) and len(index.files_with("skills", __import__("postulant.sources.search", fromlist=["x"]).slots_of(slots))) < 5
    assert skipped >= 6
    spark.createDataFrame([(999, "spark new", 9)], "id long, skills string, part int").write.mode("append").partitionBy("part").parquet(place)
    df = spark.read.schema("id long, skills string, part int").parquet(place)
    assert 999 in {r.id for r in index.search(df, "skills", "spark").collect()}  # not indexed yet, read all the same
    assert len(index.add(df)) == 1
    scan = index.search(df, "skills", "kafka")._jdf.queryExecution().executedPlan()
    index.search(df, "skills", "kafka").collect()
    assert "file_path" in scan.toString()
