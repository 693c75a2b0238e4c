import math

import numpy as np
import pytest

from thermobox.llm.vector_search import HASHES, clean_vectors, op4, probing_sequence

FIXTURE = "/root/testdata/sf0.01/embeddings.parquet"


def exact(rows, k=20):
    """{query: [(vec_id, score)]} over clean (id, vector) rows."""
    ids = np.array([i for i, _ in rows])
    vectors = np.array([v for _, v in rows], dtype=np.float64)
    out = {}
    for i, v in zip(ids, vectors):
        if i % 20 == 0:
            scores = (vectors * v).sum(axis=1)
            order = np.lexsort((ids, -scores))
            out[int(i)] = [(int(ids[j]), float(scores[j])) for j in order if ids[j] != i][:k]
    return out


def test_probing_sequence_is_ordered_and_valid():
    rows = probing_sequence(HASHES, 200)
    assert rows.shape == (200, 2 * HASHES) and rows[0].sum() == 0 and rows[1].tolist().index(1) == 0
    assert len({tuple(r) for r in rows.tolist()}) == 200
    assert all(not (r[i] and r[2 * HASHES - 1 - i]) for r in rows for i in range(HASHES))


@pytest.mark.parametrize("path", [FIXTURE, "/root/testdata/sf0.1/embeddings.parquet"])
def test_recall(spark, path):
    table = spark.read.parquet(path)
    rows = [(r.vec_id, list(r.embedding)) for r in table.select("vec_id", "embedding").collect()]
    want, got = exact(rows), {}
    for r in op4(table).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(want)
    vectors = {i: np.array(v, dtype=np.float64) for i, v in rows}
    hits = 0
    for q, found in got.items():
        assert len(found) == min(20, len(rows) - 1) and q not in dict(found)
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))
        assert all(math.isclose(s, float(vectors[q] @ vectors[i]), abs_tol=1e-12) for i, s in found)
        hits += len({i for i, _ in found} & {i for i, _ in want[q]})
    recall = hits / sum(map(len, want.values()))
    print("recall", recall)
    assert recall >= 0.9


def recall(table, rows):
    want, got = exact(rows), {}
    for r in op4(table).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    share = sum(len(got[q] & {i for i, _ in near}) for q, near in want.items()) / sum(map(len, want.values()))
    print("recall", share)
    return share


@pytest.mark.parametrize("norms", ["one", "lognormal"])
def test_recall_with_unequal_norms(spark, norms):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(3000, 64))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    vectors *= np.exp(0.3 * rng.normal(size=(3000, 1))) if norms == "lognormal" else np.where(np.arange(3000) == 7, 3.0, 1.0)[:, None]
    rows = list(enumerate(vectors.tolist()))
    assert recall(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), rows) >= 0.9


def test_every_bucket_where_probes_do_not_reach_the_recall(spark, monkeypatch):
    monkeypatch.setattr("thermobox.llm.vector_search.MOST_PROBES", 20)
    rows = list(enumerate(np.random.default_rng(6).normal(size=(1000, 64)).tolist()))
    assert recall(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), rows) == 1.0


def test_odd_rows_ties_and_copies(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(30)]  # copies of a query
    odd = [(200, None), (220, [0.0] * 8), (240, [1.0, None] * 4), (260, [float("nan")] * 8), (280, [float("inf")] * 8),
           (300, [1.0] * 5), (None, [1.0] * 8), (7, rows[7][1])]
    table = spark.createDataFrame([(i, v, 1) for i, v in rows + odd], "vec_id long, embedding array<double>, score int")
    assert clean_vectors(table, "vec_id", "embedding").count() == len(rows)
    got = {}
    for r in op4(table).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = exact(rows)
    assert set(got) == set(want)
    assert [i for i, _ in got[0]] == [i for i, _ in want[0]] == list(range(100, 120))
    assert all(len(f) == 20 for f in got.values())


def test_few_rows_give_all_candidates(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (1, [-5.0, 2.0]), (2, [0.0, -3.0])], "vec_id long, embedding array<double>")
    rows = [tuple(r) for r in op4(table).orderBy("rank").collect()]
    assert rows == [(0, 1, 2, 0.0), (0, 2, 1, -5.0)]


def test_empty_tables(spark):
    assert op4(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    assert op4(spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")).collect() == []
