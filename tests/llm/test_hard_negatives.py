import math

import numpy as np
import pytest

from thermobox.llm import hard_negatives as h

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, positives=5, negatives=3):
    kept = {}
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        label = (label + 1) % 10 if vec_id % 7 == 0 else label
        kept[vec_id, label, tuple(math.floor(256 * float(np.float32(x))) for x in vector)] = None
    out = []
    for a, la, va in kept:
        if a % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, v)), i, label) for i, label, v in kept if i != a)
        for p, i, label in [s for s in scored if s[2] == la][:positives]:
            fits = [s for s in scored if s[2] != la and 50 * -p <= 100 * -s[0] <= 95 * -p][:negatives]
            out += [(a, i, rank + 1, j, -p, -s) for rank, (s, j, _) in enumerate(fits)]
    return sorted(out)


def made(n, dimension, seed, clusters=None):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(clusters, dimension)) if clusters else np.zeros((1, dimension))
    label = rng.integers(0, 10, n)
    vectors = base[label % len(base)] + rng.normal(size=(n, dimension)) * (0.3 if clusters else 1.0)
    vectors[n // 3:n // 2] = vectors[0]  # many copies of one vector
    return [(i, [float(np.float32(x)) for x in v], int(c)) for i, (v, c) in enumerate(zip(vectors, label))]


@pytest.mark.parametrize("clusters", [None, 5])
@pytest.mark.parametrize("block, part, group", [(h.BLOCK_VALUES, h.PART_VALUES, h.GROUP_ROWS), (600, 96, 3)])
def test_against_brute_force(spark, monkeypatch, clusters, block, part, group):
    monkeypatch.setattr(h, "BLOCK_VALUES", block)
    monkeypatch.setattr(h, "PART_VALUES", part)
    monkeypatch.setattr(h.anchor_trees, "__defaults__", (group,))
    rows = made(900, 8, 3, clusters)
    found = h.op12(spark.createDataFrame(rows, SCHEMA))
    assert found.dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"),
                            ("positive_score", "bigint"), ("negative_score", "bigint")]
    assert sorted(map(tuple, found.collect())) == brute(rows) != []


def test_odd_rows(spark):
    rows = made(160, 4, 5) + [
        (200, None, 1), (201, [1.0, None, 2.0, 0.5], 1), (202, [float("nan")] * 4, 2), (203, [float("inf"), 1.0, 1.0, 1.0], 2),
        (None, [1.0] * 4, 1), (250, [0.5] * 4, None), (300, [0.0] * 4, 3), (350, [], 4), (400, [2.0, 1.0], 5), (450, [1e30] * 4, 6),
        (0, *made(160, 4, 5)[0][1:]),
    ]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS id", "2 AS norm", "'x' AS `a.b`", "map(1, 2) AS anchor")
    assert sorted(map(tuple, h.op12(frame).collect())) == brute([r for r in rows if r[0] != 450])


def test_few_rows(spark):
    assert h.op12(spark.createDataFrame([], SCHEMA)).collect() == []
    assert h.op12(spark.createDataFrame([(50, [1.0], 1)], SCHEMA)).collect() == []


def test_tree_spans_all_with_shortest_edges():
    points = np.array([[0.0], [10.0], [1.0], [3.0], [11.0], [3.0]])
    parent, edge, depth = h.spanning_tree(points)
    assert parent[0] == -1 and depth[0] == 0 and edge.sum() == 11.0
    assert all(depth[i] == depth[parent[i]] + 1 and edge[i] == abs(points[i, 0] - points[parent[i], 0]) for i in range(1, 6))


def test_bounds_leave_rows_unscored():
    """On clustered rows most candidates of a child are never scored."""
    rng = np.random.default_rng(1)
    centres = rng.integers(-3000, 3000, (40, 16)).astype(float)
    vectors = np.repeat(centres, 50, axis=0) + rng.integers(-40, 40, (2000, 16))
    ids = np.arange(2000)
    block = h.Block(ids, ids // 50, np.linalg.norm(vectors, axis=1), ids, vectors)
    anchors = vectors[:20]
    parent, edge, depth = h.spanning_tree(anchors)
    tree = {"parent": parent, "edge": edge, "levels": [np.flatnonzero(depth == d) for d in range(depth.max() + 1)],
            "anchor": ids[:20], "id": ids[:20], "label": np.zeros(20, int), "vectors": anchors}
    scored = []
    original = h.np.nonzero
    h.np.nonzero = lambda x: scored.append(int(np.count_nonzero(x)) * (np.ndim(x) == 2)) or original(x)
    try:
        best, first = block.search(tree, [[(-np.inf, np.inf)]] * 20, 5, True)
    finally:
        h.np.nonzero = original
    exact = anchors @ vectors.T
    for i in range(20):
        own = [j for j in range(50) if j != i]
        assert best.score[first[i]].tolist() == sorted(exact[i, own], reverse=True)[:5]
    assert 0 < sum(scored) < 19 * 60  # of 19 x 2,000
