"""What the stored tables keep beside their rows: keys, packed loads, counts, answers, a search index, ranges."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postulant.catalogue.standins import EVENTS, ORDERS, STATUS_LABEL, events, orders, table
from postulant.functions.status import status_label
from postulant.operators import statistics as st
from postulant.operators.browse import BrowseSpec, filtered, present
from postulant.operators.paging import directory, jump, sort_keys
from postulant.operators.ranges import rank_within
from postulant.operators.saving import three_way
from postulant.schema import CANDIDATES
from postulant.session import work_folder
from postulant.sources.answers import AnswerTable
from postulant.sources.candidates import CandidateStore
from postulant.sources.keys import KeyIndex
from postulant.sources.search import TrigramIndex
from postulant.streaming.incremental import insert_recent

N_LOADS = 50


def batch_of(rows: DataFrame) -> DataFrame:
    """Stand-in applications as a batch to import."""
    numbered = rows.withColumn("filename", F.lpad(F.col("id").cast("string"), 12, "0"))
    return numbered.select("filename", *[
        (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in CANDIDATES.fields if f.name != "id"
    ])


def new_store(spark: SparkSession, name: str) -> CandidateStore:
    place = work_folder(spark, name)
    return CandidateStore(spark, place, f"{name}_" + place.rsplit("-", 1)[1])


def last_of(store: CandidateStore, rows: DataFrame) -> DataFrame:
    """The rows, written beside the tables, which are then forgotten."""
    rows.write.parquet(f"{store.root}/result")
    store.drop()
    return store.spark.read.schema(rows.schema).parquet(f"{store.root}/result")


def keys(spark: SparkSession, folder: str) -> DataFrame:
    """Keys of the orders since 1999 that the index has from the loads of the years before; small buckets, so that they split."""
    place = work_folder(spark, "keys")
    index = KeyIndex(spark, f"{place}/index", bucket_bytes=16 << 10, bucket_files=2)
    rows = orders(spark, folder).select(
        "job", "name", F.col("id").cast("string").alias("id"), F.year("applied_at").alias("year"),
        F.date_format("applied_at", "yyyy-MM").alias("applied_month"),
    )
    rows.write.parquet(f"{place}/rows")
    rows = spark.read.schema(rows.schema).parquet(f"{place}/rows")
    for year in range(1995, 1999):
        index.add(rows.where(F.col("year") == year).withColumn("load_id", F.lit(str(year))))
    asked = rows.where("year >= 1999 AND job <> '' AND name <> ''").select("job", "name").distinct()
    return index.matching(asked).select("job", "name", F.col("id").cast("long").alias("id"), "load_id").distinct()


def compacted(spark: SparkSession, folder: str) -> DataFrame:
    """Fifty loads of one month become one partition; rows keep their load."""
    store = new_store(spark, "packed")
    number = F.col("filename").cast("long") % N_LOADS
    rows = batch_of(events(spark, folder)).withColumn("load_id", F.format_string("load-%02d", number))
    store.insert(rows.where(number < N_LOADS - 1), None)
    store.insert(rows.where(number == N_LOADS - 1).drop("load_id"), f"load-{N_LOADS - 1}")
    store.compact(datetime.now() + timedelta(days=1))
    held = store.read()
    segments = held.groupBy("applied_month").agg(F.count_distinct("segment").alias("n_segments"))
    moment = F.date_format("applied_at", "yyyy-MM-dd HH:mm:ss").alias("applied_at")
    return last_of(store, held.join(F.broadcast(segments), "applied_month").select("job", "name", moment, "load_id", "n_segments"))


def maintained(spark: SparkSession, folder: str) -> DataFrame:
    """Counts kept through two loads, a repeated load, an update that moves rows to other days, and a delete."""
    store = new_store(spark, "counted")
    rows = batch_of(events(spark, folder))
    late = F.col("applied_at") >= "2024-01-16"
    for part, load in ((~late, "early"), (late, "late"), (late, "late")):
        store.insert(rows.where(part), load)
    moved = store.read().where("job = 'click'").select("id", F.expr("applied_at + INTERVAL 20 DAYS").cast("string").alias("applied_at"))
    store.update(moved)
    store.delete(store.read().where("status = 3").select("id"))
    counts = store.counts()
    parts = [st.merged_by_job_and_period(counts, p).select("job", F.col(p).cast("string").alias("period"), "n") for p in ("month", "day")]
    whole = st.merged_by_job(counts).select("job", F.lit("all").alias("period"), "n")
    return last_of(store, whole.union(parts[0]).union(parts[1]))


def jumps(spark: SparkSession, folder: str) -> DataFrame:
    """The first, a middle, the last but one and the last page of a listing, each from its own range."""
    rows = orders(spark, folder)
    made = directory(rows, PAGES)
    last = made.n_pages() - 1
    pages = [jump(rows, made, page).withColumn("page", F.lit(page)) for page in (0, last // 2, last - 1, last)]
    found = pages[0].union(pages[1]).union(pages[2]).union(pages[3])
    return found.select("page", "job", "name", F.date_format("applied_at", "yyyy-MM-dd").alias("applied_at"), "years_exp", "id")


PAGES = BrowseSpec(experience=(1.0, 40.0), sort=(("job", False), ("applied_at", True)), page_size=20)


def conflicts(spark: SparkSession, folder: str) -> DataFrame:
    """A page is saved after others changed the status of the second jobs and deleted the fifth."""
    rows = orders(spark, folder).where("id % 7 < 5")
    shown = present(rows)
    job = F.col("job")
    now = rows.withColumn("status", F.when(job.startswith("2"), 2).otherwise(F.col("status")))
    now = now.withColumn("years_exp", F.when(job.startswith("3"), 0.0).otherwise(F.col("years_exp"))).where(~job.startswith("5"))
    label = F.when(job.startswith("4"), F.col("status")).otherwise(status_label(F.lit(3)))
    outcome = three_way(now, shown, shown.withColumn("status", label))
    told = F.concat_ws("/", F.get("conflicts", F.lit(0))["column"], F.get("conflicts", F.lit(0))["stored"])
    return outcome.select("id", "state", "status", "years_exp", told.alias("told"))


def answers(spark: SparkSession, folder: str) -> DataFrame:
    """Prompts with many copies come in two loads; a quarter fails at first and one kind always."""

    def client():
        def ask(prompts):
            return prompts.map(lambda p: TimeoutError("no answer") if "-2" in p else json.dumps({"skills": p.upper()}))

        return ask

    kept = AnswerTable(spark, work_folder(spark, "answers") + "/table", prefix_digits=1)
    rows = events(spark, folder).select("id", F.concat_ws("-", "job", (F.col("id") % 40).cast("string")).alias("prompt"))
    start = datetime(2024, 1, 1)
    kept.ask(rows.where("id % 2 = 0"), client, now=start)
    for minutes in (0, 1, 10):  # a failed prompt is not due at once, but later
        found = kept.ask(rows, client, now=start + timedelta(minutes=minutes))
    attempts = kept.read().groupBy("digest").agg(F.count("*").alias("n_asked"))
    digests = F.sha2("prompt", 256)
    paired = found.withColumn("digest", digests).join(F.broadcast(attempts), "digest")
    return paired.select("id", "response", "error", "n_asked")


def indexed_search(spark: SparkSession, folder: str) -> DataFrame:
    """Three searches over files by language and source: a rare word, a word with a class behind it, and no word at all."""
    place = work_folder(spark, "search")
    docs = table(spark, folder, "documents")
    texts = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("skills"), F.concat("lang", "source").alias("part"))
    texts.hint("rebalance", "part").write.partitionBy("part").parquet(f"{place}/texts")
    rows = spark.read.schema("id long, skills string, part string").parquet(f"{place}/texts")
    index = TrigramIndex(spark, f"{place}/index", columns=("skills",))
    index.add(rows)
    found = [index.search(rows, "skills", p).select("id", F.lit(p).alias("pattern")) for p in SEARCHES]
    return found[0].union(found[1]).union(found[2])


SEARCHES = ("licen[cs]e", r"thatha\w+\.", "q.?u")

def retired(spark: SparkSession, folder: str) -> DataFrame:
    """Three loads, the last one repeated, of which 14 days are kept: rows, their keys and their counts."""
    store = new_store(spark, "recent")
    rows = batch_of(events(spark, folder).withColumn("name", F.col("id").cast("string")))
    for third in (0, 1, 2, 2):
        part = rows.where((F.col("applied_at") >= f"2024-01-{1 + 10 * third:02}") & (F.col("applied_at") < f"2024-01-{11 + 10 * third}"))
        insert_recent(store, part, f"part-{third}", timedelta(days=14))
    held = store.read().select("job", "name", F.date_format("applied_at", "yyyy-MM-dd HH:mm:ss").alias("applied_at"), "load_id", "id")
    indexed = store.keys.read().select("id", F.lit(True).alias("has_key")).distinct()
    total = store.counts().agg(F.sum("n").alias("n_counted"))
    return last_of(store, held.join(indexed, "id", "full").drop("id").crossJoin(F.broadcast(total)))


SPELLINGS = ("Æuvre œ Straße", "aeuvre OE strasse", "ÆUVRE Œ STRASSE", "Aeuvre oé Strasse", "aeuvre oe strase")


def spelled(spark: SparkSession, folder: str) -> DataFrame:
    """Applications whose job is equal to a given one up to case, accents and ligatures, from the files that have such a spelling."""
    store = new_store(spark, "spelled")
    rows = events(spark, folder).withColumn("job", F.get(F.array(*[F.lit(x) for x in SPELLINGS]), (F.col("id") % 5).cast("int")))
    rows = rows.withColumn("name", F.col("id").cast("string"))
    store.insert(batch_of(rows.where("id % 5 <> 3")), "one")
    store.insert(batch_of(rows.where("id % 5 = 3")), "two")
    spec = BrowseSpec(job="æuvre oe straße", experience=(0, 1000))
    return last_of(store, filtered(store.rows_for(spec), spec).select("job", "name", "years_exp"))


def whole_order(spark: SparkSession, folder: str) -> DataFrame:
    """The place of every document in a listing by language, downwards, then by the first word, French order."""
    docs = table(spark, folder, "documents")
    word = F.regexp_extract("text", r"^\s*(\pL+)", 1)
    rows = docs.select(F.col("doc_id").alias("id"), word.alias("name"), F.col("lang").alias("job"), F.lit(0).alias("all"))
    keys = sort_keys(rows, BrowseSpec(sort=(("job", False), ("name", True))))
    return rank_within(rows, "all", keys, identity=["id"]).select("id", "job", "name", "place")


QUERIES = {
    "br_spelled": spelled,
    "br_places": whole_order,
    "ing_retire": retired,
    "ing_keys": keys,
    "mut_compact": compacted,
    "st_maintained": maintained,
    "br_jump": jumps,
    "mut_conflict": conflicts,
    "ux_answers": answers,
    "br_indexed": indexed_search,
}

_COUNTED = f"""WITH {EVENTS},
loads AS (SELECT *, CASE WHEN applied_at < TIMESTAMP '2024-01-16 00:00:00' THEN 1 ELSE 2 END AS load FROM applications),
kept AS (SELECT * FROM loads QUALIFY row_number() OVER (PARTITION BY job, name ORDER BY load, applied_at, id) = 1),
moved AS (SELECT job, CASE WHEN job = 'click' THEN applied_at + INTERVAL 20 DAYS ELSE applied_at END AS applied_at
          FROM kept WHERE status <> 3)"""

SQL = {
    "br_spelled": f"""WITH {EVENTS}
SELECT CASE id % 5 {' '.join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(SPELLINGS[:4]))} END AS job, CAST(id AS VARCHAR) AS name, years_exp
FROM applications WHERE id % 5 <> 4 AND years_exp BETWEEN 0 AND 1000""",
    "br_places": r"""SELECT doc_id AS id, lang AS job, regexp_extract(text, '^\s*(\pL+)', 1) AS name,
  row_number() OVER (ORDER BY lang DESC, lower(strip_accents(regexp_extract(text, '^\s*(\pL+)', 1))), doc_id) AS place FROM documents""",
    "ing_retire": f"""WITH {EVENTS},
days AS (SELECT *, CAST(date_trunc('day', max(applied_at) OVER ()) AS TIMESTAMP) + INTERVAL 1 DAY - INTERVAL 14 DAYS AS first
         FROM applications WHERE applied_at >= TIMESTAMP '2024-01-01' AND applied_at < TIMESTAMP '2024-01-31')
SELECT job, CAST(id AS VARCHAR) AS name, strftime(applied_at, '%Y-%m-%d %H:%M:%S') AS applied_at,
       'part-' || ((day(applied_at) - 1) // 10) AS load_id, true AS has_key, count(*) OVER () AS n_counted
FROM days WHERE applied_at >= first""",
    "ing_keys": f"""WITH {ORDERS},
asked AS (SELECT DISTINCT job, name FROM applications WHERE year(applied_at) >= 1999 AND name <> '')
SELECT job, name, id, CAST(year(applied_at) AS VARCHAR) AS load_id FROM applications JOIN asked USING (job, name)
WHERE year(applied_at) < 1999""",
    "mut_compact": f"""WITH {EVENTS},
kept AS (SELECT * FROM applications QUALIFY row_number() OVER (PARTITION BY job, name ORDER BY id % {N_LOADS}, applied_at, id) = 1)
SELECT job, name, strftime(applied_at, '%Y-%m-%d %H:%M:%S') AS applied_at, printf('load-%02d', id % {N_LOADS}) AS load_id,
       1 AS n_segments FROM kept""",
    "st_maintained": f"""{_COUNTED}
SELECT job, 'all' AS period, count(*) AS n FROM moved GROUP BY job
UNION ALL SELECT job, strftime(applied_at, '%Y-%m'), count(*) FROM moved GROUP BY ALL
UNION ALL SELECT job, strftime(applied_at, '%Y-%m-%d'), count(*) FROM moved GROUP BY ALL""",
    "br_jump": f"""WITH {ORDERS},
listed AS (SELECT *, row_number() OVER (ORDER BY job DESC, applied_at, id) - 1 AS place, count(*) OVER () AS n
           FROM applications WHERE years_exp BETWEEN 1 AND 40),
pages AS (SELECT *, place // 20 AS page, (n + 19) // 20 - 1 AS last FROM listed)
SELECT CAST(page AS INTEGER) AS page, job, name, strftime(applied_at, '%Y-%m-%d') AS applied_at, years_exp, CAST(id AS VARCHAR) AS id
FROM pages WHERE page IN (0, last // 2, last - 1, last)""",
    "mut_conflict": f"""WITH {ORDERS}, labelled AS (SELECT *, {STATUS_LABEL} AS label FROM applications WHERE id % 7 < 5)
SELECT CAST(id AS VARCHAR) AS id,
  CASE WHEN job LIKE '5%' THEN 'gone' WHEN job LIKE '4%' THEN 'unchanged'
       WHEN job LIKE '2%' THEN 'conflict' ELSE 'saved' END AS state,
  CASE WHEN job LIKE '4%' THEN label ELSE '✅ Go process' END AS status,
  CASE WHEN job LIKE '3%' THEN 0.0 ELSE years_exp END AS years_exp,
  CASE WHEN job LIKE '2%' THEN 'status/🛠️ En cours de qualif.' ELSE '' END AS told
FROM labelled""",
    "ux_answers": f"""WITH {EVENTS}, prompts AS (SELECT id, job || '-' || (id % 40) AS prompt FROM applications)
SELECT id, CASE WHEN NOT contains(prompt, '-2') THEN '{{"skills": "' || upper(prompt) || '"}}' END AS response,
  CASE WHEN contains(prompt, '-2') THEN 'TimeoutError: no answer' END AS error,
  CASE WHEN NOT contains(prompt, '-2') THEN 1 ELSE 3 END AS n_asked FROM prompts""",
    "br_indexed": " UNION ALL ".join(
        f"SELECT doc_id AS id, '{p}' AS pattern FROM documents WHERE regexp_matches(text, '{p}', 'i')" for p in SEARCHES
    ),
}
