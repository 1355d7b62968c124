r"""Personal data: patterns first, then terms that give away whom a text is about.

Base spans are the leftmost, non-overlapping matches of four patterns that pass
their tests (address parts, Luhn sum, number of digits). Each pattern is written so
that a search is linear: a run of characters is tried from its start or from the
end of the match before, and loops give nothing back.

Sanitisation by information: the values found are the protected entities. For an
entity e and a term t, documents are counted over the whole corpus, and t discloses
e if P(e | t) is at least `LEAST_SHARE` and the pointwise mutual information
log2 P(e, t) / (P(e) P(t)) at least `LEAST_BITS`, given `LEAST_TEXTS` different
texts with both. Disclosing terms are removed wherever they stand. Terms are runs of
four letters or more, in lower case.

Once an entity recurs, terms are counted over the whole corpus, at every size alike,
and all counts are added up per task before they are shuffled and joined. Main path:
DataFrame functions only.

Defined results: null text is empty and has no spans; repeated rows have equal
spans; a null doc_id stays null; an empty table gives an empty result; very long
texts need time in proportion to their length, or to the square of the number of
their matches; extra columns are kept by `sanitise` unless their names begin with
`_p_`, which is refused. Spans count code points, ends are exclusive. Texts are told
apart by two 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postulant.llm.common import small, table, written

# Kinds in the order in which spans of one start are listed, and their patterns.
LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = [*PATTERNS, "term"]
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"

LEAST_TEXTS = 5
LEAST_SHARE = 0.8
LEAST_BITS = 3.0
SPAN = "array<struct<start:int,kind:int,end:int>>"


def _luhn(digits: Column) -> Column:
    places = F.sequence(F.lit(1), F.length(digits))

    def value(i: Column) -> Column:
        digit = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, digit).when(digit > 4, 2 * digit - 9).otherwise(2 * digit)

    return F.aggregate(places, F.lit(0), lambda total, i: total + value(i)) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(rf"^{PART}(?:\.{PART}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _passes(kind: str) -> Callable[[Column], Column]:
    return lambda x: _valid(kind, x["value"])


def _named(kind: str) -> Callable[[Column], Column]:
    return lambda x: F.concat(F.lit(f"{kind}:"), F.lower(x["value"]))


def _is(kind: int) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def _places(text: Column, pattern: Column, possible: Column) -> tuple[Column, Column]:
    """The matches and the pieces between them."""
    none = F.array().cast("array<string>")
    return F.when(possible, F.regexp_extract_all(text, pattern, F.lit(0))).otherwise(none), F.when(possible, F.split(text, pattern, -1)).otherwise(none)


def _spans(found: str, pieces: str, kind: int) -> Column:
    """Spans of matches, by adding up the lengths of the pieces and matches before each."""
    lengths = F.zip_with(found, pieces, lambda m, p: F.struct(F.length(p).alias("p"), F.length(m).alias("m")))
    ended = F.filter(lengths, lambda x: x["m"].isNotNull())
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        first = acc["at"] + x["p"]
        span = F.struct(first.alias("start"), F.lit(kind).alias("kind"), (first + x["m"]).alias("end"))
        return F.struct((first + x["m"]).alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    return F.aggregate(ended, start, step, lambda acc: acc["out"])


def with_base(df: DataFrame) -> DataFrame:
    """Adds _p_spans (base spans in order) and _p_values (distinct kind:value of them) and the text's hashes _p_k1, _p_k2."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = df.withColumn("_p_digit", text.rlike("[0-9]"))
    possible = {
        "email": F.contains(text, F.lit("@")),
        "ip": F.col("_p_digit") & F.contains(text, F.lit(".")),
        "card": F.col("_p_digit"),
        "phone": F.col("_p_digit") & F.contains(text, F.lit("+")),
    }
    found, pieces, scratch = {}, {}, ["_p_digit"]
    for kind, pattern in PATTERNS.items():
        found[f"_p_{kind}"], pieces[f"_p_{kind}_between"] = _places(text, F.lit(pattern), possible[kind])
    df = df.withColumns(found | pieces)
    spans, values = [], []
    for kind in PATTERNS:
        both = F.arrays_zip(F.col(f"_p_{kind}").alias("value"), _spans(f"_p_{kind}", f"_p_{kind}_between", KINDS.index(kind)).alias("span"))
        df = df.withColumn(f"_p_{kind}_ok", F.when(F.size(f"_p_{kind}") > 0, F.filter(both, _passes(kind))))
        spans.append(F.coalesce(F.transform(f"_p_{kind}_ok", lambda x: x["span"]), F.array().cast(SPAN)))
        values.append(F.coalesce(F.transform(f"_p_{kind}_ok", _named(kind)), F.array().cast("array<string>")))
        scratch += [f"_p_{kind}", f"_p_{kind}_between", f"_p_{kind}_ok"]
    added = {"_p_spans": F.array_sort(F.concat(*spans)), "_p_values": F.array_distinct(F.concat(*values)), "_p_k1": F.xxhash64(text), "_p_k2": F.xxhash64(F.lit(1), text)}
    return df.withColumns(added).drop(*scratch)


def terms(text: Column) -> Column:
    """The distinct terms of a text."""
    return F.filter(F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+")), lambda w: F.length(w) >= 4)


def disclosing(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(term): the terms that disclose an entity. `found` is `with_base` of docs, written."""
    keys = ["_p_k1", "_p_k2"]
    mentions = found.select(*keys, F.explode("_p_values").alias("entity"))
    recurring = mentions.groupBy("entity").agg(F.count("*").alias("n_e"), F.approx_count_distinct("_p_k1").alias("texts"))
    entities = written(recurring.where(F.col("texts") >= LEAST_TEXTS - 1).select("entity", "n_e"), "entities")
    if entities.isEmpty():
        return entities.select(F.col("entity").alias("term"))
    concerned = written(mentions.join(small(entities), "entity").select(*keys, "entity", "n_e").distinct(), "concerned")
    hashes = F.struct(F.xxhash64(F.coalesce("text", F.lit(""))).alias("_p_k1"), F.xxhash64(F.lit(1), F.coalesce("text", F.lit(""))).alias("_p_k2"))
    hashed = docs.select("text", hashes.alias("k")).select("text", "k.*")
    beside = hashed.join(small(concerned.select(*keys).distinct()), keys, "left_semi")
    together = beside.select(*keys, F.explode(terms(F.col("text"))).alias("term")).join(small(concerned), keys)
    per_text = together.groupBy("entity", "n_e", "term", *keys).agg(F.count("*").alias("n"))
    pairs = per_text.groupBy("entity", "n_e", "term").agg(F.sum("n").alias("n_et"), F.count("*").alias("texts"))
    candidates = written(pairs.where(F.col("texts") >= LEAST_TEXTS).select("term", "n_e", "n_et"), "candidates")
    # Counted per task before the join: a candidate that most documents hold costs one row a task, not one a document.
    counted = docs.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    total = F.lit(found.count()).cast("double")
    bits = F.log2(F.col("n_et") * total / (F.col("n_e") * F.col("n_t")))
    told = counted.join(small(candidates), "term").where((F.col("n_et") >= LEAST_SHARE * F.col("n_t")) & (bits >= LEAST_BITS))
    return written(told.select("term").distinct(), "terms")


def term_spans(docs: DataFrame, told: DataFrame) -> DataFrame:
    """(_p_k1, _p_k2, _p_terms): spans of disclosing terms per different text that holds some."""
    text = F.coalesce(F.col("text"), F.lit(""))
    hashed = docs.select(text.alias("text"), F.xxhash64(text).alias("_p_k1"), F.xxhash64(F.lit(1), text).alias("_p_k2"))
    hits = hashed.select("_p_k1", "_p_k2", F.explode(terms(F.col("text"))).alias("term")).join(small(told), "term")
    per_text = written(hits.groupBy("_p_k1", "_p_k2").agg(F.collect_set("term").alias("told")), "told")
    joined = hashed.join(small(per_text, 50_000), ["_p_k1", "_p_k2"])
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(F.array_sort("told"), "|"), F.lit(r")(?!\p{L})"))
    step = joined.withColumn("pattern", pattern)
    step = step.withColumns({"found": F.regexp_extract_all("text", F.col("pattern"), F.lit(0)), "between": F.split("text", F.col("pattern"), -1)})
    spans = step.select("_p_k1", "_p_k2", _spans("found", "between", KINDS.index("term")).alias("_p_terms"))
    return written(spans.dropDuplicates(["_p_k1", "_p_k2"]), "term_spans")


def located(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` with _p_base and _p_spans, base spans and all spans in order of start and kind."""
    clash = [c for c in docs.columns if c.startswith("_p_")]
    if clash:
        raise ValueError(f"columns with the names of results: {clash}")
    found = written(with_base(docs).select(*keep, "_p_spans", "_p_values", "_p_k1", "_p_k2"), "spans")
    told = disclosing(docs, found)
    if told.isEmpty():
        return found.withColumn("_p_base", F.col("_p_spans")).drop("_p_values", "_p_k1", "_p_k2")
    extra = small(term_spans(docs, told), 50_000)
    joined = found.withColumnRenamed("_p_spans", "_p_base").join(extra, ["_p_k1", "_p_k2"], "left")
    free = F.filter("_p_terms", lambda t: ~F.exists("_p_base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    spans = F.coalesce(F.array_sort(F.concat("_p_base", free)), F.col("_p_base"))
    return joined.withColumn("_p_spans", spans).drop("_p_values", "_p_k1", "_p_k2", "_p_terms")


def listed(spans: str) -> Column:
    """kind:start:end of every span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitise(docs: DataFrame) -> DataFrame:
    """The documents with base spans generalised to their kind, as [EMAIL], and disclosing terms removed, as [TERM].

    Of spans that overlap, the first counts and what the next ones add is covered too. A column n_chars is brought up to date.
    """
    known = located(docs, docs.columns)
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        before = F.substr("text", acc["at"] + 1, s["start"] - acc["at"])
        fresh = s["start"] >= acc["at"]
        out = F.when(fresh, F.concat(acc["out"], F.array(before, F.get(marks, s["kind"])))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    def finish(acc: Column) -> Column:
        return F.concat(F.array_join(acc["out"], ""), F.substr("text", acc["at"] + 1, F.greatest(F.length("text") - acc["at"], F.lit(0))))

    cleaned = known.withColumn("text", F.when(F.size("_p_spans") > 0, F.aggregate("_p_spans", start, step, finish)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.when(F.size("_p_spans") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return cleaned.select(*docs.columns)


def personal(spark: SparkSession, folder: str) -> DataFrame:
    known = located(table(spark, folder, "documents").select("doc_id", "text"), ["doc_id"])
    numbers = [F.size(F.filter("_p_base", _is(i))).cast("long").alias(f"n_{kind}") for i, kind in enumerate(PATTERNS)]
    return known.select("doc_id", *numbers, F.sha2(listed("_p_base"), 256).alias("base_sha256"), listed("_p_spans").alias("spans"))


QUERIES = {"op5_pii": personal}
SQL: dict[str, str] = {}
