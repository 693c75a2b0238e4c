import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from thermobox.llm import log_bilinear as m

SCHEMA = "doc_id long, text string"
SF_DIR = "/root/testdata/sf0.01"


def tokens(text):
    lowered = re.sub(rb"[A-Z]", lambda x: x[0].lower(), (text or "").encode())
    return [w.decode() for w in re.findall(rb"[^\x20\x09-\x0D]+", lowered)] + [None]


def is_held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def brute(docs):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base) of each row."""
    count = Counter(t for doc_id, text in docs if not is_held_out(doc_id) for t in tokens(text))
    n, v = sum(count.values()), len(count)
    return [(d, is_held_out(d), len(ts), sum(count[t] > 0 for t in ts), n, sum(math.log10((count[t] + 1) / (n + v + 1)) for t in ts))
            for d, ts in ((d, tokens(text)) for d, text in docs)]


def same(found, wanted):
    order = lambda r: (r[0] is None, r[0] or 0, r[2], r[3])
    found, wanted = sorted(map(tuple, found), key=order), sorted(wanted, key=order)
    assert [r[:5] for r in found] == [r[:5] for r in wanted]
    assert [r[5] for r in found] == pytest.approx([r[5] for r in wanted], rel=1e-12)
    assert all(math.isfinite(r[6]) and r[6] < 0 for r in found)


@pytest.mark.parametrize("head", [m.HEAD_WORDS, 3])
def test_odd_rows_against_brute_force(spark, monkeypatch, head):
    monkeypatch.setattr(m, "HEAD_WORDS", head)
    docs = [(0, None), (1, ""), (2, " \t\n"), (3, "One one TWO"), (4, "x" * 100_000 + " one"), (5, "a b c " * 30_000), (None, "two é z"),
            (None, "two é z"), (5, "É é"), *[(10 + i, f"one two w{i} w{i // 2}") for i in range(40)]]
    frame = spark.createDataFrame(docs, SCHEMA).selectExpr("*", "1 AS rid", "'x' AS `a.b`", "map(1, 2) AS word", "0 AS held_out")
    found = m.op13(frame)
    assert found.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("n_tokens", "bigint"), ("n_known", "bigint"),
                            ("train_tokens", "bigint"), ("base_score", "double"), ("score", "double")]
    same(found.collect(), brute(docs))


def test_empty_and_nothing_to_learn(spark):
    assert m.op13(spark.createDataFrame([], SCHEMA)).collect() == []
    out = next(i for i in range(100) if is_held_out(i))
    found = m.op13(spark.createDataFrame([(out, "a a")], SCHEMA)).collect()
    assert [tuple(r)[:6] for r in found] == [(out, True, 3, 0, 0, 0.0)]


@pytest.fixture(scope="module")
def learnt(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    own = docs.select("doc_id", "text", m.held_out(docs["doc_id"]).alias("held_out"))
    counts = m.stored(m.count_words(own), "test-counts")
    vocabulary = m.build_vocabulary(counts)
    return docs, counts, vocabulary, m.train(own, vocabulary)


def test_probabilities_add_up_to_one(spark, learnt):
    _, counts, vocabulary, model = learnt
    table = m.normaliser_table(spark, vocabulary, model)
    tables = model.score_tables()
    for near, far in ((m.END, m.END), (2, m.RARE), (5, 9)):
        assert np.exp(tables[0][near] + tables[1][far] - table[near, far]).sum() == pytest.approx(1, abs=1e-4)
    tokens, types = vocabulary.rare
    own = set(vocabulary.words[:vocabulary.modelled])
    rare = [r["c"] for r in counts.where("word IS NOT NULL AND c > 0").collect() if r["word"] not in own]
    assert len(rare) == types and sum(rare) == tokens
    assert sum(c + 1 for c in rare) + 1 == tokens + types + 1  # the seen ones and one unseen


def test_scores_by_the_model_itself(spark, learnt):
    """Scores of some texts, token by token from the definition."""
    docs, _, vocabulary, model = learnt
    rows = [r for r in docs.orderBy("doc_id").limit(20).collect()]
    own = docs.where("doc_id < 20").select("doc_id", "text", m.held_out(docs["doc_id"]).alias("held_out"))
    head = m._score_head(own, vocabulary, model, m.normaliser_table(spark, vocabulary, model)).collect()
    found = {r["doc_id"]: r["model"] for r in head}
    number = {w: i for i, w in enumerate(vocabulary.words)}
    rare_tokens, rare_types = vocabulary.rare
    for r in rows:
        places = [m.END, m.END]
        total = 0.0
        for token in tokens(r["text"]):
            n = number.get(token, -1)
            place = m.END if token is None else n + 2 if 0 <= n < vocabulary.modelled else m.RARE
            h = model.given[places[-1]] * model.weight[0] + model.given[places[-2]] * model.weight[1]
            s = (model.wanted @ h + model.bias).astype(np.float64)
            total += (s[place] - np.log(np.exp(s).sum())) / np.log(10)
            if place == m.RARE and n >= 0:
                total += math.log10((vocabulary.counts[n] + 1) / (rare_tokens + rare_types + 1))
            places.append(place)
        assert found[r["doc_id"]] == pytest.approx(total, rel=1e-4)


def test_better_than_single_words_on_held_out_texts(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    found = m.op13(spark.read.parquet(f"{SF_DIR}/documents.parquet")).collect()
    same(found, brute(docs))
    kept = [r for r in found if r["held_out"]]
    assert sum(r["score"] for r in kept) > sum(r["base_score"] for r in kept)
