import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from thermobox.llm.line_quality import BINS, document_scores, fit, line_features, op7

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = op7(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 500 and np.mean([r.predicted == r.quality for r in held]) > 0.97


def test_features_of_lines():
    owner, size, places = line_features(pa.array(["one two\n\n  \nONE ONE", None, "", "x%%% y&&&\nx%%% y&&&", "é\tü"]))
    assert owner.tolist() == [0, 0, 3, 3, 4] and size.tolist() == [7, 7, 9, 9, 5]
    assert places.shape == (5, len(BINS) + 1) and (places[:, 0] == 0).all()
    first = dict(zip([n for n, _ in BINS], np.cumsum([1] + [len(b) + 1 for _, b in BINS])))
    names = [n for n, _ in BINS]

    def bin_of(row, name):
        return places[row, 1 + names.index(name)] - first[name]

    assert [bin_of(r, "copies") for r in range(5)] == [0, 0, 0, 1, 0]
    assert bin_of(1, "capitals") > bin_of(0, "capitals") and bin_of(1, "repeats") > bin_of(0, "repeats")
    assert bin_of(2, "symbols_by_word") > bin_of(0, "symbols_by_word")


def test_weighted_marginals_by_hand(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    crf, prior = fit(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    text = "The plain words of a first line.\nSHOUT!! SHOUT!! SHOUT!! SHOUT!!\nplain words again, with an end."
    _, size, places = line_features(pa.array([text]))
    rows = np.zeros((3, crf.own.shape[1]))
    rows[np.arange(3)[:, None], places] = 1
    scores = crf.emissions(rows)
    weight = {}
    for path in np.ndindex(2, 2, 2):
        p = list(path)
        weight[path] = np.exp(crf.ends[0, p[0]] + crf.ends[1, p[2]] + scores[range(3), p].sum() + crf.move[p[0], p[1]] + crf.move[p[1], p[2]])
    good = [sum(w for path, w in weight.items() if path[t]) / sum(weight.values()) for t in range(3)]
    both = document_scores(pa.array(["", text, None]), crf, prior)
    assert np.allclose(both, [prior, (np.array(good) * size).sum() / size.sum(), prior])
    assert np.allclose(document_scores(pa.array([text] * 3 + ["a\n" * 3000]), crf, prior)[:3], both[1])


def test_odd_rows_and_clashing_columns(spark):
    docs = spark.createDataFrame(
        [(1, None, 9.0, 1), (2, "", 9.0, 1), (None, "some words here", 9.0, 1), (3, "x" * 300_000, 9.0, 1), (3, "x", 9.0, 1)],
        "doc_id long, text string, score double, predicted int",
    )
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    rows = op7(docs, labels).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert [r.held_out for r in rows if r.doc_id is None] == [False]
    no_labels = op7(docs, labels.where(F.lit(False))).collect()
    assert {r.score for r in no_labels} == {0.5}


def test_labels_of_the_held_out_fold_are_not_read(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    scores = [{r.doc_id: r.score for r in op7(docs, x).collect()} for x in (labels, turned)]
    assert scores[0] == scores[1]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert op7(docs, spark.createDataFrame([], "doc_id long, quality int")).collect() == []


def test_training_lines_are_spread_over_a_text():
    from thermobox.llm.line_quality import RUN_LINES, TRAINING_RUNS, _runs

    assert _runs(0) == [(0, 0)] and _runs(RUN_LINES * TRAINING_RUNS) == [(0, RUN_LINES * TRAINING_RUNS)]
    runs = _runs(10_000)
    assert len(runs) == TRAINING_RUNS and runs[0][0] == 0 and runs[-1][1] == 10_000
    assert all(b - a == RUN_LINES for a, b in runs) and all(runs[i][1] <= runs[i + 1][0] for i in range(TRAINING_RUNS - 1))
