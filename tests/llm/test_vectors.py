"""Operators over embeddings against brute force."""

import duckdb
import numpy as np
import pytest

from vulnlake.llm import embeddings, hamming
from vulnlake.llm.common import least_labels

NAN = float("nan")


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, l, "x", 1, 2) for i, v, l in rows], "vec_id long, embedding array<float>, label int, id string, gid int, near int")


def clustered(n=400, dim=24, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 8, dim))
    rows = []
    for k in range(n):
        x = centres[rng.integers(0, len(centres))] + rng.normal(scale=0.12, size=dim)
        rows.append((k, [float(v) for v in x.astype(np.float32)], int(rng.integers(0, 3))))
    return rows + [(1000 + k, rows[k][1], rows[k][2]) for k in range(30)]


def brute(rows):
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    near = (x @ x.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    order = np.argsort(ids)
    i, j = np.nonzero(np.triu(near[order][:, order], 1))
    root = least_labels(len(ids), i, j)
    return {int(ids[order[k]]): (int(near[order[k]].sum()), int(ids[order[root[k]]])) for k in range(len(ids))}


@pytest.mark.parametrize("tile", [16, 2048])
def test_links_against_brute_force(spark, tile, monkeypatch):
    plain = embeddings.index_links
    monkeypatch.setattr(embeddings, "index_links", lambda d, c, s: plain(d, c, s, tile))
    rows = clustered()
    expected = brute(rows)
    got = {r["id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_vectors(vectors(spark, rows)).collect()}
    links = sum(n for n, _ in expected.values())
    assert links > 500 and all(got[k][0] <= expected[k][0] for k in got)
    assert sum(n for n, _ in got.values()) >= 0.9 * links
    assert sum(got[k] == expected[k] for k in got) >= 0.9 * len(got)


def test_recall_on_the_tables(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in table.collect()]
    expected = sum(n for n, _ in brute(rows).values())
    got = sum(r["n_links"] for r in embeddings.near_vectors(table).collect())
    assert 0.9 * expected <= got <= expected


def test_vectors_that_link_with_nothing(spark):
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [1.0, NAN], 1), (6, [1.0, float("inf")], 1)]
    rows += [(7, [1.0, 2.0], None), (8, [1.0, 2.0], None), (None, [1.0, 2.0], 1), (9, [1.0, 2.0], 1), (10, [2.0, 4.0], 1), (10, [1.0, 2.0], 1), (11, [1.0, 2.0, 3.0], 1)]
    out = embeddings.near_vectors(vectors(spark, rows)).collect()
    assert len(out) == len(rows)
    linked = sorted((r["id"], r["n_links"], r["component_id"], r["kept"]) for r in out if r["n_links"])
    assert linked == [(9, 2, 9, True), (10, 2, 9, False), (10, 2, 9, False)]
    assert all(r["component_id"] == r["id"] and r["kept"] for r in out if not r["n_links"])
    assert embeddings.near_vectors(vectors(spark, rows).limit(0)).count() == 0


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(4)
    codes = np.concatenate([rng.integers(0, 1 << 63, 300), np.repeat(rng.integers(0, 1 << 63, 3), 20)])
    rows = [(int(i), int(c)) for i, c in enumerate(codes)]
    frame = spark.createDataFrame(rows, "id long, code long")
    for k in (1, 7, 1000):
        got = hamming.top_k(frame, frame.where("id % 25 = 0"), k).collect()
        expected = []
        for q in range(0, len(codes), 25):
            near = sorted((int(np.bitwise_count(np.uint64(codes[q] ^ c))), i) for i, c in rows if i != q)[:k]
            expected += [(q, n + 1, i, d) for n, (d, i) in enumerate(near)]
        assert sorted((r["query_id"], r["rank"], r["neighbor_id"], r["distance"]) for r in got) == expected


def test_top_k_query_matches_its_sql(spark):
    connection = duckdb.connect()
    connection.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.01/embeddings.parquet'")
    expected = connection.execute(hamming.ORACLE)
    names = [d[0] for d in expected.description]
    got = hamming.op8_hamming_topk(spark, "/root/testdata/sf0.01").select(*names)
    assert sorted(map(tuple, got.collect())) == sorted(expected.fetchall())


def test_top_k_edges(spark):
    rows = [(50, [1.0, -1.0], 1), (51, [1.0, -1.0], 1), (52, None, 1), (53, [], 1), (54, [NAN, 1.0], 1), (None, [1.0, 1.0], 1), (100, [-1.0, 1.0], 1), (50, [1.0, 1.0], 1)]
    codes = hamming.sign_codes(vectors(spark, rows), "vec_id", "embedding")
    assert sorted(codes.collect()) == [(50, 1), (50, 3), (51, 1), (100, 2)]
    out = hamming.top_k(codes, codes.where("id = 100"), 2).collect()
    assert [(r["query_id"], r["neighbor_id"], r["distance"]) for r in out] == [(100, 50, 1), (100, 50, 2)]
    assert hamming.top_k(codes.limit(0), codes.limit(0)).count() == 0
