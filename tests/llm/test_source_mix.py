import hashlib
import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from thermobox.llm import source_mix as mix
from thermobox.llm.source_mix import FLAT, assign_positions, op2, training_order

DOCS = "doc_id long, source string, text string"


def targets(spark, sizes, weights, total, most):
    sources = spark.createDataFrame([(i, n, float(w)) for i, (n, w) in enumerate(zip(sizes, weights))], "i int, size long, weight double")
    return [r["target"] for r in mix.fill_targets(sources, total, most).orderBy("i").collect()]


def test_targets_are_filled(spark):
    assert targets(spark, [10, 10, 10], [1, 1, 1], 45, 2) == [15, 15, 15]
    assert targets(spark, [1, 100, 100], [3, 1, 2], 150, 2) == pytest.approx([2, 148 / 3, 296 / 3])
    assert targets(spark, [5, 5], [1, 3], 20, 2) == [10, 10]
    assert targets(spark, [1, 2, 4, 8, 100], [1, 1, 1, 1, 1], 100, 2) == [2, 4, 8, 16, 70]
    assert targets(spark, [], [], 0, 2) == [] and targets(spark, [0, 0], [1, 1], 0, 2) == [0, 0]


def ordered(docs, target, schedule=FLAT, **how):
    rows = mix.prepare(docs, docs.columns)
    sums = mix.range_sums(rows)
    sources = mix.list_sources(sums).withColumn("target", F.lit(float(target)))
    return training_order(assign_positions(rows, sums, sources, [schedule], F.lit(0), **how))


def integral(schedule, t, target):
    """Demand at time t, by fine steps."""
    def weight(x):
        for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
            if t0 <= x <= t1:
                return w0 + (w1 - w0) * (x - t0) / (t1 - t0)
    n = 2000
    steps = [(i + 0.5) / n for i in range(n)]
    return target * sum(weight(x) for x in steps if x < t) / sum(weight(x) for x in steps)


SCHEDULES = [FLAT, ((0.0, 3.0), (1.0, 0.0)), ((0.0, 0.0), (0.4, 2.0), (0.6, 2.0), (1.0, 1.0))]


@pytest.mark.parametrize("schedule", SCHEDULES)
def test_positions_invert_the_demand(spark, schedule):
    docs = spark.createDataFrame([(i, "s", "w " * (1 + i % 7)) for i in range(300)], DOCS)
    target = 1.6 * sum(1 + i % 7 for i in range(300))
    rows = ordered(docs, target, schedule).select("mix_row.doc_id", "mix_epoch", "mix_position", "mix_words").collect()
    assert [r.mix_position for r in rows] == sorted(r.mix_position for r in rows)
    assert sum(r.mix_words for r in rows) == int(target + 0.5)
    done = 0
    for r in rows:  # in order of position the words taken so far are the demand at that position
        assert abs(integral(schedule, r.mix_position, target) - done) < 0.02 * target
        done += r.mix_words


def test_whole_copies(spark):
    docs = spark.createDataFrame([(i, "s", "w " * 10) for i in range(50)], DOCS)
    rows = ordered(docs, 737.0, cut=False).collect()
    assert len(rows) == 74 and {r.mix_words for r in rows} == {10}


def test_contract(spark):
    rows = op2(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    again = op2(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(7)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    taken, target, size = defaultdict(int), {}, {}
    source = {r.doc_id: r.source for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]], size[source[r.doc_id]] = r.target, r.source_size
    assert all(abs(taken[s] - target[s]) <= 0.5 and target[s] <= 2 * size[s] for s in target)
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))


def brute(docs):
    """(doc_id, size, source_size, target, taken), by the definition."""
    size = [len((text or "").split()) for _, _, text in docs]
    total = defaultdict(int)
    for (_, source, _), n in zip(docs, size):
        total[source] += n
    names = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: mix.WEIGHTS[i % 3] for i, s in enumerate(names)}
    stopped = set()
    while True:
        left = 1.5 * sum(size) - sum(2 * total[s] for s in stopped)
        open_ = [s for s in names if s not in stopped]
        level = left / sum(weight[s] for s in open_) if open_ else 0
        more = {s for s in open_ if level * weight[s] > 2 * total[s]}
        if not more:
            break
        stopped |= more
    target = {s: 2.0 * total[s] if s in stopped else level * weight[s] for s in names}

    def place(doc):
        return hashlib.md5(f"{'' if doc[0] is None else doc[0]}|{doc[2] or ''}".encode()).hexdigest()

    out, start = [], defaultdict(int)
    for doc, n in sorted(zip(docs, size), key=lambda d: place(d[0])):
        s, wanted = doc[1], math.floor(target[doc[1]] + 0.5)
        taken = sum(max(0, min(n, wanted - start[s] - epoch * total[s])) for epoch in (0, 1))
        out.append((doc[0], n, total[s], target[s], taken))
        start[s] += n
    return out


def key(row):
    return tuple((x is None, x or 0) for x in row)


@pytest.mark.parametrize("rows_of_a_range", [mix.RANGE_ROWS, 5])
def test_odd_rows_against_brute_force(spark, monkeypatch, rows_of_a_range):
    monkeypatch.setattr(mix, "RANGE_ROWS", rows_of_a_range)
    docs = [(1, None, "a b"), (2, "é", None), (3, "z", ""), (None, "z", "one two three"), (None, "z", "one two three"), (4, "", "x"),
            (7, "z", "short"), (7, "z", "another text"), (8, "z", "w " * 200_000), *[(None, "hot", f"text {i} " * (i % 5)) for i in range(60)],
            *[(100 + i, f"s{i}", "a few words") for i in range(25)]]
    frame = spark.createDataFrame(docs, DOCS).selectExpr(
        "*", "0 AS taken", "1 AS mix_range", "2 AS _source", "'x' AS `a.b`", "map(1, 2) AS size")
    got = sorted(map(tuple, op2(frame).collect()), key=key)
    want = sorted(brute(docs), key=key)
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want])


def test_training_order_keeps_any_columns(spark):
    docs = spark.createDataFrame([(i, "s", "w w") for i in range(9)], DOCS).selectExpr("*", "1 AS _source", "2 AS mix_row", "'x' AS `a.b`", "map(1, 2) AS m")
    rows = ordered(docs, 18.0, cut=False).select("mix_row.*")
    assert rows.columns == docs.columns and sorted(r["doc_id"] for r in rows.collect()) == list(range(9))


def test_texts_are_shuffled_twice(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    plan = ordered(docs, 1000.0, cut=False)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.split("\n") if "Exchange" in line and "Broadcast" not in line]
    assert len(exchanges) == 3, plan  # window, offsets of the ranges, order of training


def test_empty_table(spark):
    assert op2(spark.createDataFrame([], DOCS)).collect() == []
