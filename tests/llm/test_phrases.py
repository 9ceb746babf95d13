"""Repeated-phrase automata against plain versions, and the defined edge cases."""

import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from vulnlake.llm import phrases

from tests.llm.test_documents import EDGES, documents, prose


def plain_phrases(rows, window=phrases.WINDOW):
    """(id, words, removed, kept) in any order."""
    texts = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least = {}
    for i, words in texts:
        for k in range(len(words) - window + 1) if i is not None else ():
            key = tuple(words[k : k + window])
            least[key] = min(least.get(key, i), i)
    out = []
    for i, words in texts:
        gone = set()
        for k in range(len(words) - window + 1) if i is not None else ():
            if least[tuple(words[k : k + window])] < i:
                gone |= set(range(k, k + window))
        out.append((i, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    return sorted(out, key=str)


def check(spark, rows, window=phrases.WINDOW):
    got = phrases.remove_phrases(documents(spark, rows), window=window).select("rest.doc_id", "n_words", "n_removed", "kept")
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_phrases(rows, window)


def shared(seed, n):
    """Documents of common passages, single words and line breaks."""
    rng = random.Random(seed)
    passages = [prose(100 + k, rng.randint(5, 40)) for k in range(12)]
    rows = []
    for _ in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.7 else prose(rng.randint(0, 10**6), rng.randint(1, 30)) for _ in range(6)]
        rows.append((rng.randint(-5, 40), rng.choice([" ", "\n", "\v \t"]).join(parts)))
    return rows


def test_edges(spark):
    check(spark, EDGES)


@pytest.mark.parametrize("window", [5, 13])
def test_matches_a_plain_version(spark, window):
    check(spark, shared(window, 120), window)


def test_many_small_automata_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(phrases, "PHRASES", 7)
    monkeypatch.setattr(phrases, "SIGNS", 2)
    monkeypatch.setattr("vulnlake.llm.suffix.BLOCK_BYTES", 500)
    monkeypatch.setattr("vulnlake.llm.suffix.BUCKET_BYTES", 2000)
    check(spark, shared(3, 60))


def test_copies_and_repeats_inside_a_document(spark):
    line = prose(1, 20)
    check(spark, [(k, line) for k in range(300)] + [(500, f"{line} {line} x {line}"), (500, line), (501, "a " * 400), (502, "a " * 13)])


def test_no_documents(spark):
    assert phrases.remove_phrases(documents(spark, [])).collect() == []
    check(spark, [(1, None), (2, ""), (None, None)])


def test_no_table_is_left(spark):
    before = {t.name for t in spark.catalog.listTables()}
    check(spark, [(1, prose(1, 20))])
    assert {t.name for t in spark.catalog.listTables()} == before


def test_window_minima():
    values = np.random.default_rng(1).integers(0, 50, 40).astype(np.uint64)
    for width in (1, 2, 5, 9):
        assert phrases.window_minima(values, width).tolist() == [min(values[k : k + width]) for k in range(41 - width)]


def test_query_matches_its_sql(spark):
    connection = duckdb.connect()
    connection.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    expected = connection.execute(phrases.ORACLE)
    names = [d[0] for d in expected.description]
    got = phrases.op13_phrase_automata(spark, "/root/testdata/sf0.001").select(*names)
    assert sorted(map(tuple, got.collect())) == sorted(expected.fetchall())


def test_automata_read_only_words_that_may_recur():
    common = prose(1, 20)
    texts = [f"{prose(2, 300)} {common} {prose(3, 300)}", f"{common} {prose(4, 300)}"]
    data = [t.encode() for t in texts]
    row = {
        "sizes": pa.scalar([len(d) for d in data], pa.list_(pa.int64())),
        "data": pa.scalar(b"".join(data), pa.large_binary()),
        "ids": pa.scalar([1, 2], pa.list_(pa.int64())),
    }
    passages = phrases.Passages(row, phrases.WINDOW, 4)
    gone = passages.removed(None, None)
    assert " ".join(passages.words.take(pa.array(passages.codes[gone])).to_pylist()) == common
    assert len(passages.signs) < 100 < len(passages.codes)
