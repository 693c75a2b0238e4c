import math
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest

from thermobox.llm import target_resampling as t
from thermobox.llm.words import LETTERS, Words

SCHEMA = "doc_id long, text string"


def grams(text):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return words, [b" ".join(words[i:i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute(docs, target):
    features = [grams(text) for _, text in docs]
    s = Counter(zlib.crc32(f) % t.BUCKETS for _, fs in features for f in fs)
    u = Counter(zlib.crc32(f) % t.BUCKETS for text in target for f in grams(text)[1])
    s_all, u_all = sum(s.values()), sum(u.values())

    def gain(b):
        return math.floor(1000 * math.log((u[b] + 1) * (s_all + t.BUCKETS) / ((s[b] + 1) * (u_all + t.BUCKETS))))

    rows = []
    for (doc_id, _), (words, fs) in zip(docs, features):
        weight = sum(gain(zlib.crc32(f) % t.BUCKETS) for f in fs)
        h = int(sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((doc_id, len(words), len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2]))
    out = [(d, n, w, score, i + 1 if i < 5 * len(able) // 100 else None) for i, (d, _, n, w, score) in enumerate(able)]
    return out + [(d, n, w, score, None) for d, words, n, w, score in rows if words < 20]


def key(row):
    return tuple((x is None, x or 0) for x in row)


def test_odd_rows_against_brute_force(spark):
    long = "abc déf x1 " * 20_000
    texts = [None, "", " ,;", "Word", "the cat SAT on the mat " * 5, "É A-Z été ÀB " * 9, "x" * 70_000 + " y", long]
    docs = [(i, x) for i, x in enumerate(texts)] + [(None, texts[4]), (None, texts[4]), (7, texts[5])]
    docs += [(100 + i, f"{'lorem ipsum ' * (i % 7)}dolor w{i} sit amet " * 8) for i in range(60)]
    target = [(1, "the cat sat on the mat"), (2, None), (3, "lorem dolor")]
    frame = spark.createDataFrame(docs, SCHEMA).selectExpr("*", "1 AS weight", "'x' AS `a.b`", "map(1, 2) AS bucket")
    found = t.op11(frame, spark.createDataFrame(target, "item_id long, text string"))
    assert found.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    assert sorted(map(tuple, found.collect()), key=key) == sorted(brute(docs, [x for _, x in target]), key=key)


@pytest.mark.parametrize("head", [t.Head((), ()), t.Head((b"the", b"cat"), ((0, 1),)), t.Head((b"b", b"the", b"mat", b"cat", b"on"), ((1, 3), (4, 1)))])
def test_any_head_gives_the_same_buckets(head):
    texts = ["the cat sat on the mat", "the", None, "on the mat the cat b", "cat"]
    words = Words(pa.array(texts), LETTERS)
    found = Counter()
    for buckets in head.buckets(words):
        found.update(b for b in buckets.tolist() if b < t.BUCKETS)
    assert found == Counter(zlib.crc32(f) % t.BUCKETS for x in texts for f in grams(x)[1])


def test_states_shift_as_the_checksum_does():
    head = t.Head(tuple(f"w{'x' * i}".encode() for i in range(20)), ())
    states = np.array([zlib.crc32(b"left%d" % i) for i in range(20)], dtype=np.uint32)
    expected = [zlib.crc32(b"left%d " % i + head.words[i]) for i in range(20)]
    assert head.extended(states, np.arange(20)).tolist() == expected


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert t.op11(none, none.selectExpr("doc_id AS item_id", "text")).collect() == []
    one = spark.createDataFrame([(5, "a b")], SCHEMA)
    assert [tuple(r) for r in t.op11(one, none.selectExpr("doc_id AS item_id", "text")).collect()] == brute([(5, "a b")], [])


@pytest.mark.parametrize("head", [t.Head((), ()), t.Head((b"sit", b"ipsum", b"lorem"), ((2, 1),))])
def test_any_head_gives_the_same_draw(spark, monkeypatch, head):
    docs = [(i, f"{'lorem ipsum ' * (i % 7)}dolor w{i} sit amet " * 8) for i in range(60)]
    monkeypatch.setattr(t, "learn_head", lambda _: head)
    found = t.op11(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([(1, "lorem dolor sit")], "item_id long, text string"))
    assert sorted(map(tuple, found.collect()), key=key) == sorted(brute(docs, ["lorem dolor sit"]), key=key)
