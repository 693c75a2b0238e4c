import re
from collections import Counter

import pytest

from thermobox.llm.quality_rules import BASE_COUNTS, RULES, Counts, op1, plan_cascade, quality_cascade

WORD = re.compile("[^\x20\x09-\x0d]+")
ODD = [None, "", " \n\t", "one", "a b c a b c", "a b a b a b a b", "É é\x0bß\x1cx y\x85z", "x\nx\n\n\n x\nx \nx", "#*$%&|<>" * 9, "a " * 30_000, "w" * 200_000]


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        dup += bool(WORD.search(line)) and line in seen
        seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered))


def test_base_counts_by_hand(spark):
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in enumerate(ODD)] + [(None, "a b", "k", 1), (3, "one", "k", 1)],
                                 "doc_id long, text string, rejected_by string, n_words int")
    rows = op1(docs).collect()
    got = Counter((r.doc_id, *(r[c] for c in BASE_COUNTS)) for r in rows)
    assert got == Counter([(i, *brute(t)) for i, t in enumerate(ODD)] + [(None, *brute("a b")), (3, *brute("one"))])
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_order_changes_the_work_and_not_the_verdict(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    names = [r.name for r in RULES]
    one, two = (quality_cascade(docs, order=o).collect() for o in (names, names[::-1]))
    kept = [{r.doc_id for r in rows if r.rejected_by is None} for rows in (one, two)]
    assert kept[0] == kept[1] and sum(r.n_rules for r in one) != sum(r.n_rules for r in two)
    assert all(r.n_rules == names.index(r.rejected_by) + 1 for r in one if r.rejected_by)


def test_plan_prefers_rejections_per_cost(spark):
    plan = plan_cascade(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    ranks = [p["rank"] for p in plan]
    assert ranks == sorted(ranks, reverse=True) and {p["rule"] for p in plan} == {r.name for r in RULES}
    assert all(0 < p["selectivity"] < 1 and p["cost"] > 0 for p in plan)


def test_junk_goes_and_prose_stays(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = op1(docs).join(labels, "doc_id").where("NOT base_failed").collect()
    assert all(r.kept == (r.quality == 1) for r in rows)


def test_counts_are_taken_once_and_on_demand():
    c = Counts(b"a b c")
    assert c["n_words"] == 3 and set(c._known) == {"n_words"}


@pytest.mark.parametrize("rows", [[], [(1, None)]])
def test_small_tables(spark, rows):
    assert [r.kept for r in op1(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [False] * len(rows)


def test_odd_columns_take_no_part(spark):
    from thermobox.llm.quality_rules import op1

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = docs.selectExpr("*", "'x' AS `a.b`", "map(1, 2) AS m", "1 AS n_words", "struct(1) AS kept")
    assert sorted(map(tuple, op1(odd).collect())) == sorted(map(tuple, op1(docs).collect()))
