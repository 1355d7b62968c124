"""Token files: the library's ids, exact round trips, order, starts and check sums."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers

from postulant.llm import token_files

PATH = public_tokenizers.path("word_bpe_49k.json")


def library_ids(texts):
    made = token_files.tokenizer(PATH)
    return [x.ids + [1] for x in made.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]


def expected(rows):
    """Rows must be in the files' order."""
    out, start = [], 0
    for (doc_id, _), ids in zip(rows, library_ids([t for _, t in rows])):
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 1000])
def test_coding_round_trip(n):
    rng = np.random.default_rng(n)
    ranks = rng.choice([0, 1, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1], n).astype(np.uint32)
    control, data = token_files.pack(ranks)
    assert len(control) == -(-n // 4)
    assert token_files.unpack(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n).tolist() == ranks.tolist()


def test_blocks_round_trip():
    made = [token_files.block([5, None, 7], np.array([1, 0, 3]), np.array([300, 1, 2, 70000], np.uint32)), token_files.block([], np.zeros(0, np.int64), np.zeros(0, np.uint32))]
    found = list(token_files.blocks(b"\n".join(made) + b"\n"))
    assert [(d.tolist(), k.tolist(), n.tolist(), r().tolist()) for d, k, n, r in found] == [([5, 0, 7], [1, 0, 1], [1, 0, 3], [300, 1, 2, 70000]), ([], [], [], [])]
    with pytest.raises(ValueError):
        list(token_files.blocks(b"x" * 40))


def test_words_alone_encode_as_whole_texts():
    rng = random.Random(3)
    alphabet = ["a", "B", "é", "é", "́", "Σ", "ς", "İ", "ß", "1", "23", "'", "'T", "re", "ve", "«", ".”", "…", "½", "٣", "\u0301", "K", "ſ", "ǅ", "'s", "'LL", "!", "?!", " ", "  ", "\n", "\t", "\x0b", "\x0c", "\r", "\x1c", "\x85", " ", " ", "　", "中", "😀", "\x00", "<|endoftext|>", "x"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 30))) for _ in range(20000)]
    found = []
    for sizes, ids in token_files.encoded(pa.array(texts), token_files.Words(PATH, 1)):
        found += [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
    assert found == library_ids(texts)


def test_every_letter_of_the_short_way_encodes_as_in_a_whole_text():
    letters = [c for c in map(chr, range(0x41, 0x250)) if token_files.LATIN.fullmatch(c.lower()) or token_files.LATIN.fullmatch(c)]
    texts = [f"x{c}y {c} {c}{c}z" for c in letters]
    found = [x.tolist() for sizes, ids in token_files.encoded(pa.array(texts), token_files.Words(PATH, 1)) for x in np.split(ids, np.cumsum(sizes)[:-1])]
    assert len(letters) > 400 and found == library_ids(texts)


def test_a_task_forgets_and_learns_again(monkeypatch):
    monkeypatch.setattr(token_files, "REMEMBERED", 50)
    known, texts = token_files.Words(PATH, 1), [f"word{i} other{i % 7}" for i in range(200)]
    for _ in range(3):
        found = [x.tolist() for sizes, ids in token_files.encoded(pa.array(texts), known) for x in np.split(ids, np.cumsum(sizes)[:-1])]
        assert found == library_ids(texts)


def test_a_worker_remembers_over_its_tasks_and_a_failed_one_leaves_nothing_half_known(monkeypatch):
    texts, asked, made = [f"word{i} zwölf{i}" for i in range(50)], [], token_files.ids_of
    monkeypatch.setattr(token_files, "ids_of", lambda distinct, *rest: (asked.append(len(distinct)), made(distinct, *rest))[1])

    def encode():
        known = token_files.remembered(PATH, 1)
        return [x.tolist() for sizes, ids in token_files.encoded(pa.array(texts), known) for x in np.split(ids, np.cumsum(sizes)[:-1])]

    token_files.remembered.cache_clear()
    with monkeypatch.context() as patch:
        patch.setattr(token_files, "ids_of", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            encode()
    assert encode() == encode() == library_ids(texts)
    assert len(asked) == 1
    token_files.remembered.cache_clear()


def test_query_equals_the_library(spark, folder):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect()]
    found = token_files.token_files(spark, folder).orderBy("doc_id").collect()
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in found] == expected(rows)


def test_odd_rows(spark, tmp_path, monkeypatch):
    """Small blocks and files, nulls, repeated and hot ids, a long text, clashing columns."""
    monkeypatch.setattr(token_files, "BLOCK_IDS", 64)
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choices(["one", "Two", "trois", "vier"], k=rng.randint(0, 40)))) for i in range(-20, 200)]
    rows += [(300, None), (301, ""), (302, " \n"), (303, "long text " * 20000)]
    hot = [(400, "same")] * 150 + [(None, "no id")] * 100
    docs = spark.createDataFrame(rows + hot, "doc_id long, text string").repartition(6).selectExpr("*", "1 AS row", "2 AS tie", "3 AS file", "4 AS ids")
    token_files.write_files(docs, PATH, str(tmp_path / "f"), end=1)
    found = token_files.read_digests(spark, str(tmp_path / "f")).collect()
    ordered = sorted(rows) + hot
    assert sorted(map(tuple, found), key=lambda r: r[1]) == expected(ordered)
    whole = sorted(token_files.read_files(spark, str(tmp_path / "f")).collect(), key=lambda r: r.start)
    assert [list(r.ids) for r in whole] == library_ids([t for _, t in ordered])
    assert len(list((tmp_path / "f" / "ids").glob("part-*"))) > 8
    ranks = [r.id for r in spark.read.parquet(str(tmp_path / "f/ranks")).orderBy("rank").collect()]
    assert sorted(ranks) == list(range(len(ranks)))
    counts = np.bincount(np.concatenate([np.array(x) for x in library_ids([t for _, t in rows + hot])]), minlength=len(ranks))
    assert all(counts[a] >= counts[b] for a, b in zip(ranks, ranks[1:]))


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    token_files.write_files(docs, PATH, str(tmp_path / "e"), end=1)
    assert token_files.read_digests(spark, str(tmp_path / "e")).collect() == []
    assert token_files.read_files(spark, str(tmp_path / "e")).columns == ["doc_id", "start", "n_tokens", "ids"]
