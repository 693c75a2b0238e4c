import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from thermobox.llm.language_id import (
    EVIDENCE, MIN_GRAMS, SMOOTHING, STRENGTH, TextModel, fit_text, fuse, identify_pages, kept_documents, learn, op8, page_rows, primary_subtag,
    training_texts, trigrams, visible_text, with_evidence,
)

SF = "/root/testdata/sf0.01"


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = op8(docs).join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    assert np.mean([r.language == r.lang for r in rows]) > 0.99 and np.mean([r.kept for r in rows]) > 0.99


def test_a_wrong_declaration_does_not_win(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 500")
    wrong = docs.withColumn("lang", F.when(F.pmod("doc_id", F.lit(10)) == 3, F.lit("es")).otherwise(F.col("lang")))
    rows = op8(wrong).join(docs, "doc_id").collect()
    assert np.mean([r.language == r.lang for r in rows]) > 0.98


def test_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    declared = {r.page_id: r.declared for r in page_rows(pages).collect()}
    rows = identify_pages(pages).collect()
    assert len(rows) == len(declared) and np.mean([r.language == declared[r.page_id] for r in rows]) > 0.97


def test_rare_languages_and_copies(spark):
    def texts(words, lang, n, start):
        return [(start + i, " ".join(words[(i * 7 + j * j) % len(words)] + "aeiou"[(i >> j) % 5] for j in range(12)), lang, None) for i in range(n)]

    rows = texts("the house stands near water where people walk every morning".split(), "en", 15_000, 0)
    rows += texts("das Haus steht nahe beim Wasser wo Menschen jeden Morgen gehen".split(), "de", 10_000, 20_000)
    rows += [(40_000 + i, "One text that stands here many times over", "en", None) for i in range(5000)]
    rare = [(90_001, "talo on lähellä vettä missä ihmiset kävelevät joka aamu ja ilta", "fi", None),
            (90_002, "dom stoi blisko wody gdzie ludzie chodzą każdego ranka i wieczora", "pl", None)]
    docs = spark.createDataFrame(rows + rare, "doc_id long, text string, lang string, source string").repartition(8)
    assert fit_text(docs, "lang").languages == ["de", "en", "fi", "pl"]
    chosen = training_texts(docs, "lang", "text").collect()
    assert len(chosen) == len(set(chosen)) <= 2000 and sum(r.declared in ("fi", "pl") for r in chosen) == 2
    found = {r.doc_id: (r.language, r.kept) for r in op8(docs).where("doc_id > 90000").collect()}
    assert found == {90_001: ("fi", True), 90_002: ("pl", True)}


def test_page_fields(spark):
    html = '<HTML class=x LANG=\'fr-CA\'><style>p{}</style><script>var a="<p>";</script><!-- no --><p>Bon&nbsp;jour</p>'
    pages = spark.createDataFrame([(1, "https://u@Blog.Example.org:80/a", html), (2, "no address", None)], "page_id long, url string, html string")
    one, two = page_rows(pages).orderBy("page_id").collect()
    assert (one.declared, one.suffix, one.domain, one.host) == ("fr", "org", "example.org", "blog.example.org")
    assert one.text.split() == ["Bon", "jour"]
    assert (two.declared, two.suffix, two.domain, two.host) == (None,) * 4
    tags = spark.createDataFrame([("EN-us",), ("english",), ("",), (None,), (" de",)], "t string")
    assert [r[0] for r in tags.select(primary_subtag(F.col("t"))).collect()] == ["en", None, None, None, "de"]
    assert spark.range(1).select(visible_text(F.lit("a<br>b"))).first()[0] == "a b"


def brute(rows, model):
    """The posterior of every (text, declared, suffix, domain, host) row, in plain Python."""
    logs, grams = model.evidence(pa.array([r[0] for r in rows], pa.string()))
    post = np.exp(logs - logs.max(axis=1, keepdims=True))
    post /= post.sum(axis=1, keepdims=True)
    post[grams < MIN_GRAMS] = 0
    share = post.sum(axis=0) + SMOOTHING
    share /= share.sum()
    sums = [{} for _ in range(5)]
    for r, p, g in zip(rows, post, grams):
        for k in range(1, 5):
            if r[k] is not None and g >= MIN_GRAMS:
                sums[k][r[k]] = sums[k].get(r[k], 0) + p
    out = []
    for i, r in enumerate(rows):
        prior = share
        for k in (3, 4):
            rest = np.maximum(0, sums[k].get(r[k], post[i]) - post[i])
            prior = (rest + STRENGTH * prior) / (rest.sum() + STRENGTH)
        total = logs[i] + np.log(prior)
        for k in (1, 2):
            if r[k] in sums[k]:
                total = total + np.log((sums[k][r[k]] + SMOOTHING) / (sum(sums[k].values()) + SMOOTHING * len(sums[k])))
        p = np.exp(total - total.max())
        out.append(p / p.sum())
    return np.array(out), grams


def test_fusion_equals_brute_force(spark):
    pages = page_rows(spark.read.parquet(f"{SF}/pages.parquet")).collect()
    rows = [(r.text[:60], r.declared if i % 3 else None, r.suffix, r.domain, r.host) for i, r in enumerate(pages)]
    rows += [("", "en", "net", None, None), (None, None, None, None, None), ("12 34", "fr", None, None, "h"), ("der die", "xx", "yy", "zz", "zz")]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, text string, declared string, suffix string, domain string, host string")
    columns = {"declared": "declared", "suffix": "suffix", "domain": "domain", "host": "host"}
    model = fit_text(frame, "declared")
    evident = with_evidence(frame, model)
    got = {r.id: r for r in fuse(evident, learn(evident, model, columns), columns, ["id"]).collect()}
    want, grams = brute(rows, model)
    assert len(got) == len(rows)
    for i, p in enumerate(want):
        assert math.isclose(got[i].lid_probability, p.max(), rel_tol=1e-9)
        assert got[i].lid_kept == bool(p.max() >= 0.8 and grams[i] >= MIN_GRAMS)


def test_trigrams_do_not_cross_texts():
    code, owner = trigrams(pa.array(["ab", None, "abc", "", "a--b", "ABC"]))
    assert owner.tolist() == [2, 5] and code[0] == code[1]
    both = TextModel(["a", "b"], np.zeros((2, 1 << 15))).evidence(pa.array(["x" * 500]))
    assert both[1][0] == 498 and EVIDENCE < 498


def test_stage_keeps_columns_and_drops_letterless(spark):
    docs = spark.createDataFrame(
        [(1, "the words of the text", "en", "s", 5), (2, "12 34", "en", "s", 5), (3, None, None, None, None), (4, "mots de la langue", "fr", None, 1)] * 3,
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    kept = kept_documents(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} <= {1, 4} and kept.count() in (3, 6)


@pytest.mark.parametrize("rows", [[], [(1, "some text", None, None)]])
def test_nothing_to_learn_from(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert [(r.language, r.kept) for r in op8(docs).collect()] == [(None, False)] * len(rows)


def test_long_texts_are_learned_from_start_to_end(spark):
    from pyspark.sql import functions as F

    from thermobox.llm.language_id import TRAINING_CHARS, spread

    text = "".join(chr(97 + i * 26 // 50_000) for i in range(50_000))
    rows = [(1, text), (2, "z" * TRAINING_CHARS), (3, "é" * (TRAINING_CHARS + 1)), (4, ""), (5, None)]
    found = dict(map(tuple, spark.createDataFrame(rows, "i int, text string").select("i", spread(F.col("text"))).collect()))
    assert found[2] == rows[1][1] and found[4] == "" and found[5] is None and set(found[3]) == {"é", " "}
    assert found[1][0] == "a" and found[1][-1] == "z" and len(set(found[1])) > 8 and len(found[1]) <= TRAINING_CHARS + 8


@pytest.mark.parametrize("piece", ["<", "<script ", "<!--", "<style>", "<html lan", "&#", "</", "<a b=\"<"])
def test_unclosed_markup_takes_linear_time(spark, piece):
    import time

    from thermobox.llm.language_id import page_rows

    html = piece * (1_000_000 // len(piece))
    page_rows(spark.createDataFrame([(0, "u", "<p>warm up")], "page_id long, url string, html string")).collect()
    begin = time.perf_counter()
    rows = page_rows(spark.createDataFrame([(1, "http://a.b/", html + " end")], "page_id long, url string, html string")).collect()
    assert len(rows) == 1 and time.perf_counter() - begin < 20


def test_visible_text_keeps_what_is_outside_markup(spark):
    from thermobox.llm.language_id import visible_text

    html = "<html><style>x{}</style><p class='a'>One <b>two</b> &amp; three<!-- no --> a < b <script>no()</script>four <a t=\"x<y\">five</a><script>rest"
    found = spark.createDataFrame([(html,)], "html string").select(visible_text(F.col("html"))).first()[0]
    assert found.split() == ["One", "two", "three", "a", "b", "four", "five"]


def test_stage_keeps_any_columns(spark):
    from thermobox.llm.language_id import kept_documents

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("*", "'x' AS `a.b`", "map(1, 2) AS m")
    kept = kept_documents(docs)
    assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()
