import random
import re

import numpy as np
import pyarrow as pa
import pytest

from thermobox.llm.near_dedup import (
    SKETCH_BITS, allowed_ones, near_components, odd_sketch, op5, shingle_sets,
)

WORD = re.compile("[^\x20\x09-\x0d]+")


def sets(text, width):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    if len(words) < width:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(width))))


def brute(rows, width, percent):
    """{doc_id: (set size, smallest reachable id)} by comparing all pairs that share a shingle."""
    own = {i: sets(t, width) for i, t in rows}
    holders, parent = {}, {i: i for i, _ in rows}
    for i, s in own.items():
        for x in s:
            holders.setdefault(x, set()).add(i)

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    seen = set()
    for ids in holders.values():
        ids = sorted(ids)
        for k, b in enumerate(ids):
            for a in ids[:k]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    common = len(own[a] & own[b])
                    if 100 * common >= percent * (len(own[a]) + len(own[b]) - common):
                        x, y = sorted((top(a), top(b)))
                        parent[y] = x
    return {i: (len(own[i]), top(i)) for i, _ in rows}


def check(spark, rows, width, percent, found):
    want = brute(rows, width, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()}
    assert got == want
    return want


def test_sets_of_odd_texts():
    texts = [None, "", "  \n", "One", "one two", "two one", "A b C d", "a B c d a b c", " x y\x0bz w ", "É é", "one  two"]
    got = [len(s) for s in shingle_sets(pa.array(texts), 3)]
    assert got == [len(sets(t, 3)) for t in texts]
    one, two, swapped, again = (next(iter(shingle_sets(pa.array([texts[i]]), 3))).tolist() for i in (3, 4, 5, 10))
    assert one != two and two != swapped and two == again


@pytest.mark.parametrize("size", [60, 400, 1500, 20_000])
def test_sketches_pass_at_the_threshold_and_stop_well_below(size):
    rng = np.random.default_rng(0)
    for percent in (80, 85):
        most = allowed_ones(2 * size, percent, np.exp, np.sqrt)
        assert most < SKETCH_BITS / 2

        def ones(similarity):
            both = round(2 * size * similarity / (1 + similarity))
            pool = rng.integers(0, 1 << 63, 2 * size - both, dtype=np.uint64) * np.uint64(2)
            pool ^= pool >> np.uint64(31)
            a, b = (odd_sketch(np.unique(x)) for x in (pool[:size], pool[-size:]))
            return int(np.bitwise_count((a ^ b).view(np.uint64)).sum())

        assert max(ones(percent / 100 + 0.005) for _ in range(200)) <= most
        assert np.mean([ones(percent / 100 - 0.15) > most for _ in range(50)]) > 0.9


@pytest.mark.parametrize("width, percent", [(3, 85), (5, 80)])
def test_real_documents(spark, width, percent):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = check(spark, rows, width, percent, near_components(docs, width, percent))
    assert sum(i != c for i, (_, c) in want.items()) > 10


def test_chains_and_a_large_group_of_near_copies(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    rows, text = [], list(base)
    for i in range(60):  # each is close to the one before, the ends are not
        rows.append((1000 - i, " ".join(text)))
        at = rng.randrange(len(text))
        text[at] = f"c{i}"
    for i in range(250):  # changed at one to six places: some are close to the base, some to few others only
        copy = list(base)
        for _ in range(rng.randrange(1, 7)):
            copy[rng.randrange(len(copy))] = f"n{rng.randrange(40)}"
        rows.append((2000 + i, " ".join(copy)))
    rows += [(3000 + i, " ".join(f"r{rng.randrange(9)}" for _ in range(30))) for i in range(60)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(spark, rows, 3, 85, op5(docs))


def test_copies_nulls_and_clashing_columns(spark):
    rows = [(9, "Same text here"), (4, "same TEXT here"), (7, "same text  here"), (1, ""), (2, None), (3, ""),
            (5, "two words"), (6, "two words"), (8, "word"), (10, "x " * 50_000), (11, "x " * 40_000)]
    wide = [(i, t, "k", 1, 2, 3) for i, t in rows] + [(None, "same text here", "k", 1, 2, 3), (9, "Same text here", "k", 1, 2, 3)]
    docs = spark.createDataFrame(wide, "doc_id long, text string, set_key string, rep int, component_id int, n int")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in op5(docs).collect()), key=str)
    want = [(i, n, c, i == c) for i, (n, c) in brute(rows, 3, 85).items()] + [(None, 1, None, True), (9, 1, 4, False)]
    assert got == sorted(want, key=str)


def test_empty_table(spark):
    assert op5(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_rows_that_share_an_id_are_judged_one_by_one(spark):
    from thermobox.llm.near_dedup import distinct_documents

    near = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    rows = [(1, near, "a"), (7, near + " end", "b"), (7, "quite another text that stands alone here", "c"),
            (7, "quite another text that stands alone here", "c"), (-5, "a third text without any likeness to the rest", "d"),
            (9, "quite another text that stands alone here", "e"), (None, near, "f"), (None, near, "f"), (8, None, "g"), (8, "", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "map(1, 2) AS row", "'x' AS `a.b`", "1 AS fresh")
    kept = distinct_documents(docs)
    assert kept.columns == docs.columns
    found = sorted(((r["doc_id"], r["source"]) for r in kept.collect()), key=str)
    assert found == sorted([(1, "a"), (9, "e"), (-5, "d"), (None, "f"), (None, "f"), (8, "g")], key=str)
