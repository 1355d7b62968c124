"""Quality rules whose thresholds adapt to each language and source.

Words are the runs of `[^\\x20\\x09-\\x0D]`. Every text gets five counts. Fixed base
rules reject texts that are too short or repeat themselves; the other rules compare
four rates of a text with what is usual for its language and source.

What is usual comes from a mergeable quantile sketch: rates become integers, whose
leading eight bits name a bucket (exact below 256, within 1/128 above), and the
sketch is the count per bucket. Sketches merge by adding counts, so Spark builds
them with partial aggregation and a hot source costs no more than a rare one; the
result does not depend on order or retries. A source with few documents takes the
sketch of its language, a language with few that of the corpus. Each rate may
leave the median by `REACH` times the spread between median and outer deciles, and
a minimum spread keeps uniform sources from rejecting small deviations.

Main path: DataFrame functions only. Defined results: null text counts as no words
(base_failed); null language or source is a group of its own; repeated rows are
judged alike and counted; an empty table gives an empty result; extra columns are
kept by `keep` unless their names begin with `_q_`, which is refused. Windows of
five words are compared by 64-bit hashes of their words within one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postulant.llm.common import small, table, written

WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED = 20  # percent of words in repeated windows
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
REACH = 8
LEAST_DOCUMENTS = 50  # for a sketch of one's own

# Rate, its minimum spread (in the rate's integer unit), and whether low values are suspicious too.
RATES = {
    "length": (100, True),  # 100 x mean word length
    "symbols": (5, False),  # 100 x symbols per word
    "lines": (5, False),  # 100 x repeated lines per 10 words
    "repeats": (2, False),  # percent of words in repeated windows
}


def _without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _with_repeats(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words covered by windows whose hash occurs twice or more.

    Windows sorted by (hash, place) lie beside their equals; the places found,
    sorted again, each cover up to the next one or the window's length. Each array
    is a column before a lambda looks into it, else it would be built per element.
    """
    pairs = F.array_sort(F.transform("_q_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_q_twins", F.size("_q_windows") > F.size(F.array_distinct("_q_windows")))
    df = df.withColumn("_q_order", F.when(F.col("_q_twins"), pairs))
    order = F.col("_q_order")

    def twin(x: Column, i: Column) -> Column:
        before = (i > 0) & (F.get(order, F.greatest(i - 1, F.lit(0)))["h"] == x["h"])
        return before | F.coalesce(F.get(order, i + 1)["h"] == x["h"], F.lit(False))

    df = df.withColumn("_q_places", F.sort_array(F.transform(F.filter(order, twin), lambda x: x["i"])))
    places = F.col("_q_places")
    df = df.withColumn("_q_covered", F.transform(places, lambda p, i: F.least(F.coalesce(F.get(places, i + 1) - p, F.lit(WINDOW)), F.lit(WINDOW))))
    total = F.aggregate("_q_covered", F.lit(0), lambda total, x: total + x)
    return df.withColumn("n_repeat_words", F.coalesce(total, F.lit(0)).cast("long"))


def counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(whole, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(whole, "\n"), lambda x: F.length(F.trim(x, F.lit(SPACES))) > 0)
    step = df.withColumns({"_q_words": words, "_q_lines": lines, "_q_chars": F.length(whole)})
    step = step.withColumns(
        {
            "n_words": F.size("_q_words").cast("long"),
            "word_chars": F.length(_without(whole, SPACES)).cast("long"),
            "n_symbols": (F.col("_q_chars") - F.length(_without(whole, SYMBOLS))).cast("long"),
            "n_dup_lines": (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"),
            "_q_windows": F.when(
                F.size("_q_words") > WINDOW,
                F.transform(F.sequence(F.lit(1), F.size("_q_words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_q_words", i, WINDOW))),
            ).otherwise(F.array().cast("array<long>")),
        }
    )
    scratch = [f"_q_{c}" for c in ("words", "lines", "chars", "windows", "twins", "order", "places", "covered")]
    return _with_repeats(step).drop(*scratch)


def _rates() -> dict[str, Column]:
    words = F.greatest("n_words", F.lit(1))
    return {
        "length": F.expr("100 * word_chars div greatest(n_words, 1)"),
        "symbols": F.expr("100 * n_symbols div greatest(n_words, 1)"),
        "lines": F.least(F.floor(1000 * F.col("n_dup_lines") / words), F.lit(100000)).cast("long"),
        "repeats": F.expr("100 * n_repeat_words div greatest(n_words, 1)"),
    }


def bucket(value: Column) -> Column:
    """The smallest integer with the same leading eight bits."""
    step = F.pow(F.lit(2), F.greatest(F.length(F.bin(value)) - 8, F.lit(0))).cast("long")
    return value - value % step


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def sketches(counted: DataFrame) -> DataFrame:
    """(lang, source, rate, bucket, n) over the documents that pass the base rules."""
    rates = [F.struct(F.lit(name).alias("rate"), bucket(value).alias("bucket")) for name, value in _rates().items()]
    rows = counted.where(~base_failed()).select("lang", "source", F.inline(F.array(*rates)))
    return rows.groupBy("lang", "source", "rate", "bucket").agg(F.count("*").alias("n"))


def _fences(sketch: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """Lower and upper fence of each rate, as columns, per group of the sketch."""
    merged = sketch.groupBy(*keys, "rate", "bucket").agg(F.sum("n").alias("n"))
    up = W.partitionBy(*keys, "rate").orderBy("bucket")
    total = F.sum("n").over(W.partitionBy(*keys, "rate"))
    placed = merged.select(*keys, "rate", "bucket", F.sum("n").over(up).alias("upto"), total.alias("total"))

    def quantile(tenths: int) -> Column:
        return F.min(F.when(10 * F.col("upto") >= tenths * F.col("total"), F.col("bucket")))

    found = placed.groupBy(*keys, "rate").agg(
        F.max("total").alias("total"), quantile(1).alias("low"), quantile(5).alias("mid"), quantile(9).alias("high")
    )
    least = F.create_map(*[F.lit(x) for name, (spread, _) in RATES.items() for x in (name, spread)])[F.col("rate")]
    spread = F.greatest(F.least(F.col("mid") - F.col("low"), F.col("high") - F.col("mid")), least)
    fenced = found.select(*keys, "rate", "total", (F.col("mid") - REACH * spread).alias("lower"), (F.col("mid") + REACH * spread).alias("upper"))

    def of(name: str, column: str) -> Column:
        return F.max(F.when(F.col("rate") == name, F.col(column)))

    columns = [of(name, side).alias(f"{prefix}{name}_{side}") for name in RATES for side in ("lower", "upper")]
    return fenced.groupBy(*keys).agg(F.max("total").alias(f"{prefix}total"), *columns)


def thresholds(counted: DataFrame) -> DataFrame:
    """(lang, source, <rate>_lower, <rate>_upper): fences of each group, from the nearest sketch with enough documents."""
    sketch = written(sketches(counted), "sketches")
    own = _fences(sketch, ["lang", "source"], "_q_s_")
    language = _fences(sketch, ["lang"], "_q_l_").withColumnRenamed("lang", "_q_lang")
    corpus = _fences(sketch.withColumn("_q_all", F.lit(1)), ["_q_all"], "_q_c_").drop("_q_all")
    joined = own.join(language, F.col("lang").eqNullSafe(F.col("_q_lang"))).join(F.broadcast(corpus))  # one row
    enough = {p: F.col(f"{p}total") >= LEAST_DOCUMENTS for p in ("_q_s_", "_q_l_")}
    chosen = [
        F.when(enough["_q_s_"], F.col(f"_q_s_{c}")).when(enough["_q_l_"], F.col(f"_q_l_{c}")).otherwise(F.col(f"_q_c_{c}")).alias(f"_q_{c}")
        for name in RATES
        for c in (f"{name}_lower", f"{name}_upper")
    ]
    return written(joined.select(F.col("lang").alias("_q_lang"), F.col("source").alias("_q_source"), *chosen), "thresholds")


def judged(counted: DataFrame) -> DataFrame:
    """Adds base_failed and kept to a written frame with the counts, lang and source."""
    limits = small(thresholds(counted), 50_000)
    joined = counted.join(limits, F.col("lang").eqNullSafe(F.col("_q_lang")) & F.col("source").eqNullSafe(F.col("_q_source")), "left")
    usual = F.lit(True)
    for name, value in _rates().items():
        usual = usual & (value <= F.col(f"_q_{name}_upper"))
        if RATES[name][1]:
            usual = usual & (value >= F.col(f"_q_{name}_lower"))
    kept = ~F.col("base_failed") & F.coalesce(usual, F.lit(True))
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", kept).drop(*limits.columns)


def keep(docs: DataFrame) -> DataFrame:
    """The documents that pass, with the columns they came with. Texts are written once beside their counts."""
    clash = [c for c in docs.columns if c.startswith("_q_") or c in COUNTS]
    if clash:
        raise ValueError(f"columns with the names of results: {clash}")
    return judged(written(counts(docs), "counted")).where("kept").select(*docs.columns)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source", "text")
    counted = written(counts(docs).drop("text"), "counted")
    return judged(counted).select("doc_id", *COUNTS)


QUERIES = {"op3_quality_rules": rules}

_BUCKET = "v - v % CAST(pow(2, greatest(length(bin(v)) - 8, 0)) AS BIGINT)"


def _sql_fences(name: str, keys: str) -> str:
    least = " ".join(f"WHEN '{rate}' THEN {spread}" for rate, (spread, _) in RATES.items())
    group = f"{keys}, rate" if keys else "rate"
    return f"""{name}_b AS (SELECT {group}, bucket, sum(n) AS n FROM sketch GROUP BY {group}, bucket),
{name}_p AS (SELECT *, sum(n) OVER (PARTITION BY {group} ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {group}) AS total FROM {name}_b),
{name}_q AS (SELECT {group}, max(total) AS total, min(bucket) FILTER (10 * upto >= total) AS low,
  min(bucket) FILTER (10 * upto >= 5 * total) AS mid, min(bucket) FILTER (10 * upto >= 9 * total) AS high FROM {name}_p GROUP BY {group}),
{name} AS (SELECT {group}, total, mid, greatest(least(mid - low, high - mid), CASE rate {least} END) * {REACH} AS reach FROM {name}_q)"""


SQL = {
    "op3_quality_rules": f"""WITH w AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text,
    list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
g AS (SELECT *, list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) AS grams FROM w),
many AS (SELECT doc_id, gram FROM (SELECT doc_id, unnest(grams) AS gram FROM g) GROUP BY 1, 2 HAVING count(*) > 1),
hits AS (SELECT h.doc_id, h.i FROM (SELECT doc_id, unnest(grams) AS gram, unnest(range(1, len(grams) + 1)) AS i FROM g) h JOIN many USING (doc_id, gram)),
gaps AS (SELECT doc_id, least(coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 5), 5) AS gap FROM hits),
repeated AS (SELECT doc_id, CAST(sum(gap) AS BIGINT) AS n FROM gaps GROUP BY 1),
counted AS (SELECT g.doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    coalesce(r.n, 0) AS n_repeat_words FROM g LEFT JOIN repeated r USING (doc_id)),
failed AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
    100 * word_chars // greatest(n_words, 1) AS length, 100 * n_symbols // greatest(n_words, 1) AS symbols,
    least(1000 * n_dup_lines // greatest(n_words, 1), 100000) AS lines, 100 * n_repeat_words // greatest(n_words, 1) AS repeats FROM counted),
long AS (SELECT lang, source, unnest(['length', 'symbols', 'lines', 'repeats']) AS rate,
    unnest([length, symbols, lines, repeats]) AS v FROM failed WHERE NOT base_failed),
sketch AS (SELECT lang, source, rate, {_BUCKET} AS bucket, count(*) AS n FROM long GROUP BY ALL),
{_sql_fences("own", "lang, source")},
{_sql_fences("language", "lang")},
{_sql_fences("corpus", "")},
fences AS (SELECT o.lang, o.source, o.rate,
    CASE WHEN o.total >= {LEAST_DOCUMENTS} THEN o.mid WHEN l.total >= {LEAST_DOCUMENTS} THEN l.mid ELSE c.mid END AS mid,
    CASE WHEN o.total >= {LEAST_DOCUMENTS} THEN o.reach WHEN l.total >= {LEAST_DOCUMENTS} THEN l.reach ELSE c.reach END AS reach
  FROM own o JOIN language l ON l.lang IS NOT DISTINCT FROM o.lang AND l.rate = o.rate JOIN corpus c ON c.rate = o.rate),
unusual AS (SELECT DISTINCT f.doc_id FROM failed f JOIN fences e ON e.lang IS NOT DISTINCT FROM f.lang AND e.source IS NOT DISTINCT FROM f.source
  WHERE CASE e.rate WHEN 'length' THEN length WHEN 'symbols' THEN symbols WHEN 'lines' THEN lines ELSE repeats END > mid + reach
     OR e.rate = 'length' AND length < mid - reach)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM unusual) AS kept FROM failed""",
}
