import hashlib
import random
import re

import numpy as np
import pytest

from thermobox.llm.crf import Crf, forward_backward, padded, viterbi
from thermobox.llm.pii import KINDS, LABELS, _one_hot, _training_rows, base_spans, find_pii, luhn, redact, trained

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    """The contract's words, pattern by pattern."""
    out = []
    for k, kind in enumerate(KINDS):
        for m in re.finditer(PATTERNS[kind], text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                    "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


ODD = [
    None, "", "a@b", "a@b.c", "@b.c", "x@@y.z", "a@b.c@d.e.f", "a@b@c.d", "..%+-@-.-", "é.a@b.ç", "a@b.c.", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.1",
    "001.002.003.0255", "1.2.3.", "4111111111111111", "4111 1111-1111 1111 2", "41111111111111112", "+1 (212) 555-0147", "+1+2 212 555 01479",
    "++12125550147", "+1((((((((", "+1 212 555 0147 4111111111111111", "4111111111111111 1.2.3.4", "٤111111111111111 +٤", "x" * 70_000 + "@y.z",
    "1" * 70_000, "1 " * 70_000, "+1" * 40_000, "a@" * 40_000, "😀 a@b.co 😀 10.0.0.1", "0-0-0-0-0-0-0-0-0-0-0-0-0-0",
]


def test_base_spans_equal_the_plain_patterns():
    for text in ODD[:25] + ODD[30:]:
        assert base_spans(text or "") == brute(text), text
    rng = random.Random(1)
    for _ in range(4000):
        text = "".join(rng.choice("0123456789..@@+-() aZ%é\n") for _ in range(rng.randrange(60)))
        assert base_spans(text) == brute(text), text
    for text in ODD[25:30]:
        base_spans(text)  # in linear time


def test_real_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = find_pii(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = brute(texts[r.doc_id])
        assert [r[f"n_{k}"] for k in KINDS] == [sum(b[1] == i for b in base) for i in range(4)]
        named = [f"{KINDS[k]}:{a}:{b}" for a, k, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(named).encode()).hexdigest()
        assert set(named) <= set(r.spans.split(",")) or not named


def test_forward_backward_and_viterbi_by_enumeration():
    rng = np.random.default_rng(0)
    n, k = 5, 3
    scores, move, ends = rng.normal(size=(n, k)), rng.normal(size=(k, k)), rng.normal(size=(2, k))
    paths = np.array(np.meshgrid(*[range(k)] * n, indexing="ij")).reshape(n, -1).T
    weight = np.array([ends[0, p[0]] + ends[1, p[-1]] + scores[np.arange(n), p].sum() + move[p[:-1], p[1:]].sum() for p in paths])
    share = np.exp(weight) / np.exp(weight).sum()
    both, lengths = padded([scores, scores[:1]], k)
    marginals, steps = forward_backward(both, lengths, move, ends)
    for t in range(n):
        assert np.allclose(marginals[0, t], [share[paths[:, t] == j].sum() for j in range(k)])
    alone = np.exp(ends[0] + ends[1] + scores[0])
    assert np.allclose(marginals[1, 0], alone / alone.sum()) and not marginals[1, 1:].any()
    want = [[(share * ((paths[:, :-1] == i) & (paths[:, 1:] == j)).sum(axis=1)).sum() for j in range(k)] for i in range(k)]
    assert np.allclose(steps, want)
    chains = [scores, scores[:1], scores[1:4], np.zeros((0, k))]
    found = viterbi(chains, move, ends)
    assert found[0].tolist() == paths[weight.argmax()].tolist() and len(found[3]) == 0
    assert found[1][0] == (ends[0] + scores[0] + ends[1]).argmax()


def test_trained_on_the_table():
    crf = trained()
    for words, labels in _training_rows():
        assert viterbi([crf.emissions(_one_hot(words))], crf.move, crf.ends)[0].tolist() == labels


def spans(spark, text):
    return find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().spans


@pytest.mark.parametrize("text, kind, found", [
    ("please ring (415) 555-0123 tonight", "phone", "(415) 555-0123"), ("dial 555-0142 now", "phone", "555-0142"),
    ("call +1 (269) 555-3296 4524132264652876 now", "phone", "+1 (269) 555-3296"),
    ('the token = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8" is', "secret", "9b0b3c6a43eb78aa99cbd7049c572391524f37a8"),
])
def test_spans_beyond_the_patterns(spark, text, kind, found):
    at = text.index(found)
    assert f"{kind}:{at}:{at + len(found)}" in spans(spark, text).split(",")


@pytest.mark.parametrize("text", [
    "version 2.0 of chapter 12 in 1998", "plain words only. And more of them", "", "3.50 to 4.25 on 12/05/2021 at 10:45", "lot 99-b, room 2b",
])
def test_clean_texts_stay_clean(spark, text):
    assert spans(spark, text) == ""


def test_redaction_keeps_columns_and_nulls(spark):
    docs = spark.createDataFrame(
        [(1, "a@b.co, 10.0.0.1", "k"), (2, None, "k"), (None, "x", None), (3, "clean", "é")], "doc_id long, text string, spans string"
    )
    rows = sorted(map(tuple, redact(docs).collect()), key=str)
    assert rows == sorted([(1, "<EMAIL>, <IP>", "k"), (2, None, "k"), (None, "x", None), (3, "clean", "é")], key=str)
    assert find_pii(docs).count() == 4


def test_empty_table(spark):
    assert find_pii(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_labels_start_with_the_kinds():
    assert LABELS[1:5] == KINDS and Crf(2, 3).own.shape == (3, 2, 3)


def test_lines_are_decoded_whole():
    """Spans are those of the best path over each whole line, by emissions and Viterbi alone, also where the shortcut applies."""
    import random

    from thermobox.llm.pii import _trim, crf_spans

    rng = random.Random(4)
    words = ["the", "call", "card", "555-0142", "(415)", "password=hunter", "9b0b3c6a43eb78aa99cbd7049c572391524f37a8", "=", '"quoted"', "é", "1998",
             "ring", "secret", "4111", "1111", "x", "a@b.co", "plain,", "words."]
    texts = [" ".join(rng.choice(words) + rng.choice(["", "", "\n", "  "]) for _ in range(rng.randrange(60))) for _ in range(80)]
    texts += ["", " \n ", "plain " * 30_000 + "call 555-0142 now", "é" * 50_000]
    crf = trained()
    for text, found in zip(texts, crf_spans(texts, crf)):
        want, at = [], 0
        for line in text.split("\n"):
            places = [(m.start() + at, m.end() + at) for m in re.finditer(r"[^\x20\x09-\x0D]+", line)]
            if places:
                labels = viterbi([crf.emissions(_one_hot([text[a:b] for a, b in places]))], crf.move, crf.ends)[0]
                for i, label in enumerate(labels):
                    if label and (i == 0 or labels[i - 1] != label):
                        end = next((j for j in range(i, len(labels)) if labels[j] != label), len(labels))
                        start, stop = _trim(text, places[i][0], places[end - 1][1])
                        if start < stop:
                            want.append((start, LABELS[label], stop))
            at += len(line) + 1
        assert found == want


def test_precision_and_recall_on_made_texts():
    """Sentences that are not in the training table: nearly all secrets and local numbers are found, hardly anything else."""
    import random

    from thermobox.llm.pii import crf_spans

    rng = random.Random(9)
    fill = "morning river they walked along under heavy trees while nobody spoke about that quiet old garden again".split()
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    make = [
        ("secret", lambda: f"password={''.join(rng.choice('abcdefghijkmnopqrst') for _ in range(rng.randrange(6, 14)))}"),
        ("secret", lambda: f"token={''.join(rng.choice('0123456789abcdef') for _ in range(32))}"),
        ("phone", lambda: f"555-{digits(4)}"), ("phone", lambda: f"({digits(3)}) 555-{digits(4)}"),
    ]
    cues = {"secret": ["set", "with", "found", "left"], "phone": ["call", "ring", "phone", "dial"]}
    plain = ["in 1987 there were 52 boats", "version 3.1 was out", "size=small colour=blue", "he paid 12.50 for 3 of them", "the secret of the lake",
             "room 41 on floor 2", "a score of 21-17 today", 'she said "never again" and left', "the password was forgotten"]
    texts, wanted = [], []
    for i in range(400):
        before, after = (" ".join(rng.choice(fill) for _ in range(rng.randrange(2, 9))) for _ in range(2))
        if i % 2:
            kind, one = make[i // 2 % len(make)]
            value, lead = one(), f"{before} {rng.choice(cues[kind])} "
            texts.append(f"{lead}{value} {after}")
            wanted.append((len(lead), kind, len(lead) + len(value)))
        else:
            texts.append(f"{before} {plain[i // 2 % len(plain)]} {after}")
            wanted.append(None)
    found = crf_spans(texts, trained())
    right = sum(w in f for w, f in zip(wanted, found) if w)
    given = sum(map(len, found))
    print("recall", right / 200, "precision", right / max(1, given))
    assert right / 200 > 0.9 and right / given > 0.9
