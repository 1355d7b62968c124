"""The training-data operators on small tables: nulls, empty texts, ties, repeated rows, clashes, brute force."""

import hashlib
import random
import re
from os.path import commonprefix

import numpy as np
import pytest
from pyspark.sql import functions as F

import oracle
from postulant.llm import bpe, common, embeddings, minhash, mixing, pii, quality_classifier, quality_rules, suffixes, toxicity, warc
from postulant.llm.catalogue import all_queries, all_sql

DOCS = "doc_id long, text string, lang string, source string"
LENGTH = suffixes.LENGTH
SPACE = r"[^\x20\x09-\x0D]+"


def documents(spark, rows):
    return spark.createDataFrame([(*r, None, None)[:4] if len(r) < 4 else r for r in rows], DOCS)


def prose(seed, n, size=40):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(n))[: size * n]


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank, repeated and long texts, a null id, tied ids."""
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "one two"), (5, "one two"), (5, "one two"), (None, prose(1, 60)), (7, prose(1, 60)), (8, prose(2, 4000)), (9, "é\x00😀 x@y.z")]
    return documents(spark, rows).cache()


def test_every_operator_has_a_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in all_queries()) == [*range(1, 14)]
    assert set(all_sql()) <= set(all_queries())


@pytest.mark.parametrize("name", sorted(all_sql()))
def test_query_equals_sql(spark, folder, name):
    rows, difference = oracle.compare(spark, oracle.connect(folder), name, folder)
    assert rows > 0 and not difference


@pytest.mark.parametrize("name", ["op3_quality_rules", "op5_pii", "op6_mixing"])
def test_native_plans(spark, folder, name):
    plan = all_queries()[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_components_of_chains_and_ties(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 200), (200, 100), (5, 5)]
    found = dict(common.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert found == {**{i: 1 for i in range(1, 61)}, 100: 100, 200: 100}


def test_bpe_as_the_library_and_back(spark, odd):
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    known = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks(path), special_tokens={})
    for row in bpe.decode(bpe.encode(odd, path, P.PATTERN), path).collect():
        assert row.ids == known.encode_ordinary(row.text or "")
        assert bytes(row.decoded) == (row.text or "").encode() and row.decoded_text == (row.text or "")
        covered = {i for a, b in zip(row.starts, row.ends) for i in range(a, b)}
        assert covered == set(range(len(row.text or "")))
    assert {r.n_tokens for r in bpe.digests(odd.where("doc_id < 3"), path, P.PATTERN).collect()} == {0}
    assert bpe.encode(odd.limit(0), path, P.PATTERN).count() == 0
    with pytest.raises(ValueError):
        bpe.encode(odd.withColumn("ids", F.lit(1)), path, P.PATTERN)


def test_bpe_offsets_of_split_characters():
    starts, ends = bpe.character_offsets(np.frombuffer("a😀b".encode(), np.uint8), np.array([1, 2, 2, 1]))
    assert starts.tolist() == [0, 1, 1, 2] and ends.tolist() == [1, 2, 2, 3]


def test_bpe_segments_keep_the_text():
    for text in ("", " ", "a  b c", " a \n b", "x y z"):
        assert "".join(bpe.segments(text)) == text


def test_warc_round_trip(spark, tmp_path):
    page = "<p>" + "x" * 200
    rows = [(3, "http://a/\r\nb", page), (1, None, page), (2, "u", None), (4, "u", ""), (5, "u", "tiny"), (6, "v", "tiny"), (None, "n", page), (1, None, page)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    warc.write_archive(pages, str(tmp_path / "a"))
    records = warc.read_archive(spark, str(tmp_path / "a")).cache()
    found = sorted([(r.page_id or 0, r.record_type, r.refers_to, bytes(r.payload).decode(), r.intact) for r in records.collect()])
    assert found == sorted([
        (0, "revisit", 1, page, True), (1, "response", None, page, True), (1, "response", None, page, True), (3, "revisit", 1, page, True),
        (2, "response", None, "", True), (4, "response", None, "", True), (5, "response", None, "tiny", True), (6, "response", None, "tiny", True),
    ])
    assert spark.read.parquet(str(tmp_path / "a/payloads")).count() == 3
    warc.export(records.coalesce(1), str(tmp_path / "w"))
    import gzip

    blocks = [r for f in (tmp_path / "w").glob("*.gz") for r in warc.parse(gzip.decompress(f.read_bytes()))]
    assert sorted(h.decode() for h, _ in blocks) == sorted(r.header for r in records.collect())
    assert sorted(len(b) for _, b in blocks) == [0, 0, 0, 0, 4, 4, len(page), len(page)]


def brute_counts(text):
    text = text or ""
    words = re.findall(SPACE, text)
    lines = [x for x in text.split("\n") if re.search(SPACE, x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark, odd):
    more = documents(spark, [(20, "a b c d e a b c d e a b c d e"), (21, "x\nx\n\n x \nx"), (22, "a b c d e f " * 30), (23, "#é|<>\x0b*")])
    for r in quality_rules.counts(odd.union(more).where("doc_id <> 8 or doc_id is null")).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_counts(r.text), r.text


def test_quality_keeps_the_usual_and_drops_the_odd(spark):
    rows = [(i, prose(i, 60), "en", "hot") for i in range(120)] + [(500, " ".join(w + "$$%" for w in prose(3, 60).split()), "en", "hot"), (501, prose(4, 60), None, None)]
    docs = documents(spark, rows).withColumn("keep", F.lit(1))
    kept = quality_rules.keep(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {*range(120), 501}
    assert quality_rules.keep(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        quality_rules.keep(docs.withColumn("n_words", F.lit(1)))


def brute_components(rows):
    def shingles(text):
        words = re.findall(SPACE, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return frozenset(tuple(words[i : i + 4]) for i in range(len(words) - 3)) or frozenset([tuple(words)] if words else [])

    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))
    for a, (_, x) in enumerate(sets):
        for b in range(a):
            y = sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                old, new = parent[a], parent[b]
                parent = [new if p == old else p for p in parent]
    least = {}
    for (i, _), p in zip(sets, parent):
        least[p] = min(least.get(p, i), i)
    return sorted((i, len(s), least[p]) for (i, s), p in zip(sets, parent))


def test_minhash_equals_brute_force(spark):
    rng = random.Random(7)
    rows = [(1, None), (2, ""), (3, " "), (4, "One two"), (5, "one TWO"), (5, "one TWO"), (6, "one two three")]
    for group in range(12):
        words = prose(group, 80).split()
        for copy in range(8):
            changed = [w if rng.random() > 0.004 * copy else "new" + w for w in words]
            rows.append((100 * (group + 1) + copy, " ".join(changed)))
    docs = documents(spark, rows).withColumn("node", F.lit(1))
    found = minhash.near_duplicates(docs).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute_components(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)
    assert sorted({r.doc_id for r in minhash.keep(docs).collect()}) == sorted({r.component_id for r in found})
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_minhash_large_bucket_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = random.Random(9)
    words = prose(5, 90).split()
    rows = [(i, " ".join(w if rng.random() > 0.001 * (i % 60) else f"n{i}" for w in words)) for i in range(60)]
    found = minhash.near_duplicates(documents(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute_components(rows)


def test_minhash_keeps_one_row_of_each_group(spark):
    copied, alone, unnamed = prose(1, 60), prose(2, 60), prose(3, 60)
    rows = [(1, copied), (2, copied), (2, alone), (None, copied), (4, prose(4, 60)), (4, prose(4, 60)), (None, unnamed), (None, unnamed), (5, ""), (5, ""), (None, None)]
    kept = sorted(((r.doc_id, r.text) for r in minhash.keep(documents(spark, rows)).collect()), key=str)
    assert kept == sorted([(1, copied), (2, alone), (4, prose(4, 60)), (None, unnamed), (5, ""), (5, ""), (None, None)], key=str)


def brute_pii(text):
    from postulant.llm.pii import KINDS

    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    out = []
    for kind, pattern in patterns.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, digits[::-1]))) % 10 == 0
            good = {"email": True, "ip": kind != "ip" or max(map(int, m[0].split("."))) <= 255, "card": 12 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}
            if good[kind]:
                out.append((m.start(), KINDS.index(kind), m.end()))
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_pii_base_equals_brute_force(spark, odd):
    rng = random.Random(3)
    pieces = ["a", "b1", "@", ".", " ", "1", "23", "456", "255", "+", "-", "(", ")", "x@y.z", "4111111111111111", "1.2.3.4", "+49 30 1234567", "\n", "é"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 40))) for _ in range(500)] + ["9" * 30000, "a." * 20000 + "@b.c", "1 " * 20000, "x@" + "a." * 20000 + "b"]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame(list(enumerate(texts, 100)), "doc_id long, text string"))
    for r in pii.with_base(docs).select("text", pii.listed("_p_spans").alias("s")).collect():
        assert r.s == brute_pii(r.text)


def test_pii_disclosing_terms(spark):
    rows = [(i, f"{prose(i, 20)} please call Zorblatt about it: bob@corp.example {prose(i + 50, 5)}") for i in range(12)]
    rows += [(100 + i, f"please call about it {prose(i + 400, 20)}") for i in range(200)] + [(900, "Only ZORBLATT."), (901, None)]
    docs = documents(spark, rows).withColumn("n_chars", F.length("text").cast("long"))
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert "[TERM]" in clean[0] and "[EMAIL]" in clean[0] and "please" in clean[0] and "Zorblatt" not in clean[0]
    assert clean[900] == "Only [TERM]." and clean[901] is None and clean[100] == dict(rows)[100]
    with pytest.raises(ValueError):
        pii.sanitise(docs.withColumn("_p_x", F.lit(1)))
    assert pii.sanitise(docs.limit(0)).count() == 0


def test_mixing_meets_targets(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    known = mixing.rated(docs, spark.read.parquet(f"{folder}/labels.parquet"), floor=0.0).cache()
    total = known.agg(*[F.sum(F.col("_m_tokens") * F.col("_m_rate") * F.col("_m_p")[i]).alias(d) for i, d in enumerate(mixing.TARGETS)]).first()
    for domain, share in mixing.TARGETS.items():
        assert abs(total[domain] / sum(total) - share) < 0.02
    assert known.where("_m_rate < 0").isEmpty() and known.count() == docs.count()
    empty = mixing.mix(docs.limit(0), spark.read.parquet(f"{folder}/labels.parquet"))
    assert empty.columns == docs.columns and empty.count() == 0


@pytest.mark.parametrize("shares", [(0.994, 0.003, 0.003), (0.998, 0.001, 0.001), (0.1, 0.8, 0.1), (0.4, 0.55, 0.05), (0.9, 0.05, 0.05)])
def test_mixing_meets_targets_from_any_shares(shares):
    pure = [(1e6 * s, [1e6 * s * (i == j) for j in range(3)], i == 0) for i, s in enumerate(shares)]
    _, reached = mixing.fit_rates(pure, mixing.TARGETS, 1.0)
    assert all(abs(r - w) <= 0.001 * w for _, w, r in reached)
    # Soft posteriors, among them clean ones that hold a little of the others.
    rng, soft = np.random.default_rng(4), []
    for i, s in enumerate(shares):
        for x in rng.dirichlet(np.where(np.arange(3) == i, 200.0, 0.3), 60):
            soft.append((1e4 * s, (1e4 * s * x).tolist(), bool(x.argmax() == 0)))
    _, reached = mixing.fit_rates(soft, mixing.TARGETS, 1.0)
    assert all(abs(r - w) <= 0.002 * w for _, w, r in reached)


def test_mixing_with_targets_out_of_reach():
    numbers, reached = mixing.fit_rates([(100.0, [60.0, 40.0, 0.0], True)], mixing.TARGETS, 1.0)
    assert all(np.isfinite(numbers)) and reached[1][2] > reached[1][1] * 1.1  # told, not hidden: the floor keeps the clean documents


def test_mixing_meets_targets_with_floor(spark):
    rows, labels = [], []
    for i in range(400):
        kind = "junk" if i % 100 == 1 else "toxic" if i % 100 == 2 else "clean"
        rng = random.Random(i)
        rows.append((i, " ".join(f"{kind}{rng.randint(0, 30)}" for _ in range(300))))
        labels.append((i, int(kind != "junk"), int(kind == "toxic")))
    docs, labelled = documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    known, report = mixing.fitted(docs, labelled, floor=1.0)
    total = known.agg(*[F.sum(F.col("_m_tokens") * F.col("_m_rate") * F.col("_m_p")[i]).alias(d) for i, d in enumerate(mixing.TARGETS)]).first()
    for domain, share in mixing.TARGETS.items():
        assert abs(total[domain] / sum(total) - share) < 0.01 * share
        assert abs(report[domain][2] - report[domain][1]) < 0.01 * report[domain][1]
    assert known.where("_m_p[0] = array_max(_m_p) and _m_rate < 1").isEmpty()


def test_mixing_without_labels_or_text(spark, odd):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert mixing.mix(odd, labels).count() == odd.count()


def test_suffixes_merge_equals_sorting():
    rng = random.Random(1)
    strings = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 90))).encode() for _ in range(40)] + [b"", b"a" * 70, b"a" * 70]
    whose, offset, common_prefix = suffixes.merge_transforms(strings)
    seen = [strings[a][b : b + 50] for a, b in zip(whose, offset)]
    assert seen == sorted(seen)
    for i in range(1, len(seen)):
        if min(len(seen[i]), len(seen[i - 1])) == 50:
            assert common_prefix[i] == len(commonprefix([seen[i - 1], seen[i]]))


def test_suffixes_equal_brute_force(spark):
    passages = [prose(i, 30).encode()[:120].decode() for i in range(4)]
    rows = [(i, prose(i + 100, 40) + passages[i % 4] + prose(i + 300, 10)) for i in range(30)]
    rows += [(50, rows[3][1]), (51, rows[3][1]), (52, "short"), (53, ""), (54, None), (55, "é" * 40), (56, "é" * 40), (57, "a" * 300), (57, "a" * 300), (None, rows[4][1])]
    first, order = {}, lambda i: 1 << 60 if i is None else i
    for i, text in sorted(rows, key=lambda r: order(r[0])):
        raw = (text or "").encode()
        for s in range(len(raw) - 49):
            first.setdefault(raw[s : s + 50], order(i))
    expected = []
    for i, text in rows:
        raw, gone = (text or "").encode(), set()
        for s in range(len(raw) - 49):
            if first[raw[s : s + 50]] < order(i):
                gone |= set(range(s, s + 50))
        expected.append((order(i), len(raw), len(gone), sum(j - 1 not in gone for j in gone), bytes(b for j, b in enumerate(raw) if j not in gone)))
    cut = suffixes.remove_repeats(documents(spark, rows).withColumn("chunk", F.lit(1))).collect()
    assert sorted((order(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in cut) == sorted(expected)
    assert suffixes.remove_repeats(documents(spark, rows).limit(0)).count() == 0


def brute_repeats(rows):
    first, order, out = {}, lambda i: 1 << 60 if i is None else i, []
    for i, text in rows:
        for s in range(len(text) - LENGTH + 1):
            first[text[s : s + LENGTH]] = min(first.get(text[s : s + LENGTH], 1 << 60), order(i))
    for i, text in rows:
        gone = {j for s in range(len(text) - LENGTH + 1) if first[text[s : s + LENGTH]] < order(i) for j in range(s, s + LENGTH)}
        out.append((order(i), len(text), len(gone), "".join(c for j, c in enumerate(text) if j not in gone).encode()))
    return sorted(out)


def cut_repeats(docs):
    return sorted((1 << 60 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept)) for r in suffixes.remove_repeats(docs).collect())


@pytest.mark.parametrize("partitions", [1, 8])
def test_suffixes_of_repeated_and_null_ids_in_several_chunks(spark, partitions):
    passage = prose(1, 60)[:160]
    unnamed, repeated = prose(2, 40) + passage + prose(3, 40), prose(4, 40) + passage + prose(5, 40)
    rows = [(1, prose(6, 40) + passage + prose(7, 40))] + [(None, unnamed), (9, repeated)] * 8
    docs = documents(spark, rows).repartition(partitions)
    assert cut_repeats(docs) == brute_repeats(rows)


def brute_links(rows):
    good = [(i, np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64))) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: {j for j, w in good if j != i and v @ w >= 0.9} for i, v in good}
    out = []
    for i, _ in rows:
        reach, new = {i}, {i}
        while new:
            new = {j for k in new for j in links.get(k, ())} - reach
            reach |= new
        out.append((i, len(links.get(i, ())), min(reach)))
    return sorted(out)


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((6, 16))
    vectors = [(c + s * rng.standard_normal(16)).astype(np.float32).tolist() for c, s in zip(centres[rng.integers(0, 6, 150)], rng.choice([0.02, 0.2, 0.4], 150))]
    vectors += [vectors[0], vectors[0], None, [0.0] * 16, [float("nan")] * 16, [None] + [1.0] * 15, []]
    rows = list(enumerate(vectors))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("raw", F.lit(1))
    found = embeddings.near_duplicates(df).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in found) == brute_links(rows)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_of_several_lengths(spark):
    rng = np.random.default_rng(6)
    vectors = []
    for length in (8, 16, 17):
        centres = rng.standard_normal((4, length))
        vectors += [(c + s * rng.standard_normal(length)).astype(np.float32).tolist() for c, s in zip(centres[rng.integers(0, 4, 40)], rng.choice([0.02, 0.2, 0.4], 40))]
    vectors += [[*vectors[40], 0.0], [1.0] * 300]  # one component more than a copy, and a single longest vector
    rows = list(enumerate(vectors))
    found = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    # The brute force takes equal lengths, so each length is its own table.
    expected = sum((brute_links([r for r in rows if len(r[1]) == n]) for n in {len(v) for v in vectors}), [])
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in found) == sorted(expected)


def test_embeddings_without_recall_raise(spark, monkeypatch):
    # No two vectors are close, so only planted links can tell that the search finds nothing.
    rows = [(i, [float(i == j) for j in range(20)]) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    monkeypatch.setattr(embeddings, "ATTEMPTS", 1, raising=False)
    monkeypatch.setattr(embeddings, "first_lists", lambda nodes, *_: nodes.sparkSession.createDataFrame([], embeddings.EDGES))
    with pytest.raises(ArithmeticError):
        embeddings.near_duplicates(df)


def test_toxicity_finds_the_sentence(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        sentences = [prose(rng.random(), 8) for _ in range(6)]
        if bad:
            sentences[2] += " vile scum"
        rows.append((i, ". ".join(sentences)))
        labels.append((i, int(bad)))
    docs = documents(spark, [*rows, (900, None), (901, ""), (None, "vile scum")])
    model = toxicity.train(docs, spark.createDataFrame([*labels, (7, None), (None, 1)], "doc_id long, toxic int"))
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert scores[900] == scores[901] == 0.0 and scores[None] >= 0.7
    assert sum((scores[i] >= toxicity.THRESHOLD) == bool(t) for i, t in labels) >= 392
    spot = toxicity.locate(docs.where("doc_id = 5"), model).first()
    assert rows[5][1][spot.start : spot.end].endswith("vile scum")
    none = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0}


def test_quality_classifier(spark):
    rows = [(i, prose(i, 50) if i % 4 else prose(i, 50).upper() + "!!! $$$ " * 20, f"path{i % 3}", f"host{i % 5}") for i in range(200)]
    docs = documents(spark, [*rows, (900, None, None, None), (901, "", "new", "new")]).select("doc_id", "text", F.col("source").alias("host"), F.col("lang").alias("path"))
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(0, 200, 2)] + [(3, None)], "doc_id long, quality int")
    found = {r.doc_id: r for r in quality_classifier.classify(docs, labels).collect()}
    assert len(found) == 202 and all(found[i].kept == (i % 4 > 0) for i in range(200))
    assert 0 < found[901].host_posterior < 1
    assert quality_classifier.classify(docs.limit(0), labels).count() == 0


def test_pipeline_stages(spark, folder):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    given = docs.columns
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, folder), "stage")
        assert docs.columns == given, name
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3] > 0
    left = docs.collect()
    assert not any(brute_pii(r.text) for r in left)
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert sorted(r.decoded_sha256 for r in tokens) == sorted(hashlib.sha256((r.text or "").encode()).hexdigest() for r in left)
