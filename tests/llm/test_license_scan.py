import re

from thermobox.llm.license_scan import BASE_PHRASES, TEMPLATES, scan_licenses

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def base(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    found = {}
    for label, phrase in BASE_PHRASES.items():
        wanted = phrase.split()
        found[label] = [i for i in range(len(words)) if words[i:i + len(wanted)] == wanted]
    starts = sorted(i for places in found.values() for i in places)
    labels = ",".join(sorted(label for label, places in found.items() if places))
    return len(words), len(starts), starts[0] if starts else None, starts[-1] if starts else None, labels


ODD = [
    None, "", " --\n", "MIT License", "mit license mit license", "mit-license; MIT\nLICENSE", "emit license", "mit licenses", "MİT license",
    "mit liKense", "the Apache License. General Public License? general public", "é mit license é", "word " * 40_000 + "mit license",
    "licensed under the lesser general public license", "Mit 漢字 license", "mit license " * 5000,
]


def test_base_columns(spark):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(ODD)] + [(None, "mit license", "x", 1), (3, "MIT License", "x", 1)],
                                 "doc_id long, text string, labels string, words int")
    rows = scan_licenses(docs).collect()
    assert len(rows) == len(ODD) + 2
    for r in rows:
        want = base("mit license" if r.doc_id is None else ODD[r.doc_id])
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


def test_every_template_is_found_in_other_text(spark):
    rows = [(n, f"Some prose before it.\n{text.title()}.\nAnd prose after.") for n, (_, _, text, _) in enumerate(TEMPLATES)]
    for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert TEMPLATES[r.doc_id][1] in r.labels.split(",") and r.score == 1.0


def test_changed_notices(spark):
    rows = [
        (0, "permission is hereby granted, at no charge, to any person obtaining a copy of this software and associated documentation files"),
        (1, "redistribution and use of words; source and binary forms; conditions are met"),  # no mandatory phrase
        (2, "the license of the software is free and permission is asked"),
        (3, "This file: licensed under CC BY-NC 4.0. Licensed under the MIT License"),
    ]
    got = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].labels == "mit" and got[0].base_labels == "" and 0.6 <= got[0].score < 1
    assert got[1].labels == "" and got[2].labels == "" and got[2].score == 0
    assert got[3].labels == "cc-by-nc,mit" and got[3].base_labels == "mit"


def test_plan_is_native(spark):
    plan = scan_licenses(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian", plan)


def test_empty_table(spark):
    assert scan_licenses(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_accepted_share_is_always_looked_up(spark):
    """Words after a gap stand one place late; what is left in place is 60 percent or more, in any template."""
    from thermobox.llm.license_scan import ACCEPT_PERCENT, TEMPLATES, _phrase_start

    rows, wanted = [], []
    for number, (_, label, text, key) in enumerate(TEMPLATES):
        words = text.split()
        at = _phrase_start(text, key)
        for cut in range(-(-ACCEPT_PERCENT * len(words) // 100), len(words)):
            if not at < cut < at + len(key.split()):  # the phrase itself stays whole
                rows.append((len(rows), "before it " + " ".join(words[:cut] + ["inserted"] + words[cut:])))
                wanted.append(label)
    found = {r["doc_id"]: r["labels"].split(",") for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    missed = [(rows[i], found[i]) for i, label in enumerate(wanted) if label not in found[i]]
    assert len(rows) > 40 and not missed
