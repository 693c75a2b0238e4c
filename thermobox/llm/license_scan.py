"""License scan by a positional rare-token index, with DataFrame functions only.

The index holds a posting (template, position) for every word of a few notice templates. Document
frequencies of the template words are counted over the whole corpus. Per file and template, the
rarest template words that the file holds (highest IDF) are looked up, so many that a place with ACCEPT_PERCENT of
the words has at least VOTES of them (`looked_up`); each occurrence in the
file votes for the place where the template would start, and places with two votes (from different
template positions) are candidates. A candidate is accepted if at least ACCEPT of the template's
words stand at their places and every mandatory phrase stands within SHIFT words of its place.

One scan splits the words; what it stores is per file a count, the distinct template words, and,
only where all words of some mandatory phrase occur, the word list. Nothing below reads other texts.
No shuffle carries a text except these few word lists, by file.

Defined results: a null text is empty (0 words, no label, score 0); equal rows get equal results;
a null `doc_id` is a value like others; an empty table gives an empty result; other columns of
`docs`, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermobox.llm.common import ascii_lower, stored

# The phrases of the contract and public notice texts, as words.
BASE_PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
TEMPLATES = [
    ("mit_notice", "mit", "released under the mit license", "mit license"),
    ("mit_grant", "mit",
     "permission is hereby granted free of charge to any person obtaining a copy of this software and "
     "associated documentation files the software to deal in the software without restriction",
     "permission is hereby granted"),
    ("apache_notice", "apache", "licensed under the apache license version 2 0", "apache license"),
    ("apache_terms", "apache",
     "you may not use this file except in compliance with the license you may obtain a copy of the license at",
     "in compliance with the license"),
    ("gpl_notice", "gpl", "this work is licensed under the gnu general public license version 3",
     "general public license"),
    ("gpl_terms", "gpl",
     "this program is free software you can redistribute it and or modify it under the terms of the "
     "gnu general public license as published by the free software foundation",
     "general public license"),
    ("lgpl_terms", "lgpl",
     "under the terms of the gnu lesser general public license as published by the free software foundation",
     "lesser general public license"),
    ("bsd_terms", "bsd",
     "redistribution and use in source and binary forms with or without modification are permitted "
     "provided that the following conditions are met",
     "redistribution and use in source"),
    ("mpl_notice", "mpl", "this source code form is subject to the terms of the mozilla public license v 2 0",
     "mozilla public license"),
    ("reserved_notice", "all-rights-reserved", "all rights reserved", "all rights reserved"),
    ("cc_by_nc_notice", "cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc_by_notice", "cc-by",
     "this work is licensed under a creative commons attribution 4 0 international license",
     "creative commons attribution"),
]

VOTES, ACCEPT_PERCENT, SHIFT = 2, 60, 2
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def looked_up(words: int) -> int:
    """Words to look up of a template: if all others but VOTES of an accepted share are left out, VOTES remain."""
    accepted = -(-ACCEPT_PERCENT * words // 100)
    return words - accepted + VOTES


def _vocabulary() -> list[str]:
    return sorted({word for _, _, text, _ in TEMPLATES for word in text.split()})


def _texts(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _phrase_start(template: str, phrase: str) -> int:
    words, wanted = template.split(), phrase.split()
    return next(i for i in range(len(words)) if words[i:i + len(wanted)] == wanted)


def _words(lowered: Column) -> Column:
    return F.filter(F.split(lowered, SEPARATORS), lambda w: w != "")


def _holds_all(held: Column, phrase: str) -> Column:
    return F.size(F.array_except(_texts(sorted(set(phrase.split()))), held)) == 0


def scan_words(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_words, held (distinct template words), words (null where no mandatory phrase can be).

    `lower` may turn a non-ASCII letter into a-z, which never moves a word's borders, so it serves
    for the count and as a first look (`held`); `words`, on which all is decided, is lower-cased exactly.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    quick = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"), _words(F.lower(text)).alias("quick"))
    seen = quick.select(
        "doc_id", "text", "text_key", F.size("quick").cast("long").alias("n_words"),
        F.array_intersect("quick", _texts(_vocabulary())).alias("held"),
    )
    possible = F.lit(False)
    for phrase in sorted({*BASE_PHRASES.values(), *[key for *_, key in TEMPLATES]}):
        possible = possible | _holds_all(F.col("held"), phrase)
    words = F.when(possible, _words(ascii_lower(text)))
    return seen.select("doc_id", "text_key", "n_words", "held", words.alias("words"))


def word_frequencies(scanned: DataFrame) -> dict[str, int]:
    """Documents that hold each template word; as many entries as the templates have words."""
    counts = scanned.select(F.explode("held").alias("word")).groupBy("word").count()
    return {r["word"]: r["count"] for r in counts.collect()}


def base_places(words: Column) -> dict[str, Column]:
    """Per base phrase, the positions (from 0) where its words stand consecutively."""
    def starts(phrase: str) -> Column:
        *before, last = phrase.split()

        def place(word: Column, at: Column) -> Column:
            fits = word == last
            for back, earlier in enumerate(reversed(before), 1):
                fits = fits & (F.get(words, at - back) == earlier)
            return F.when(fits, at - len(before))

        return F.array_compact(F.transform(words, place))

    return {label: starts(phrase) for label, phrase in BASE_PHRASES.items()}


def _verified(words: Column, number: int, start: Column) -> Column:
    """(label, share) of template `number` at `start`; null if it is not accepted."""
    _, label, text, key = TEMPLATES[number]
    expected, wanted = text.split(), key.split()
    hits = sum((F.when(F.get(words, start + i) == w, 1).otherwise(0) for i, w in enumerate(expected)), F.lit(0))
    at = start + _phrase_start(text, key)
    present = F.lit(False)
    for shift in range(-SHIFT, SHIFT + 1):
        fits = F.lit(True)
        for i, w in enumerate(wanted):
            fits = fits & F.coalesce(F.get(words, at + shift + i) == w, F.lit(False))
        present = present | fits
    share = hits.cast("double") / F.lit(float(len(expected)))
    accepted = (100 * hits >= ACCEPT_PERCENT * len(expected)) & present
    return F.when(accepted, F.struct(F.lit(label).alias("label"), share.alias("share")))


def find_templates(scanned: DataFrame, frequencies: dict[str, int]) -> DataFrame:
    """doc_id, text_key, found: accepted (label, share) pairs; only files with a candidate place."""
    frequency = F.create_map(*[x for w in _vocabulary() for x in (F.lit(w), F.lit(frequencies.get(w, 0)))])
    held = scanned.where("words IS NOT NULL").dropDuplicates(["doc_id", "text_key"])
    picks = []
    for _, _, text, key in TEMPLATES:
        own = F.array_intersect("held", _texts(sorted(set(text.split()))))
        ranked = F.array_sort(F.transform(own, lambda w: F.struct(frequency[w].alias("n"), w.alias("w"))))
        rarest = F.transform(F.slice(ranked, 1, looked_up(len(text.split()))), lambda s: s["w"])
        picks.append(F.when(_holds_all(F.col("held"), key), rarest).otherwise(F.array().cast("array<string>")))
    picked = held.select("doc_id", "text_key", "words", F.array(*picks).alias("picks"))

    postings = [(w, t, i) for t, (_, _, text, _) in enumerate(TEMPLATES) for i, w in enumerate(text.split())]
    entries = [F.struct(F.lit(w).alias("word"), F.lit(t).alias("template"), F.lit(i).alias("at")) for w, t, i in postings]
    index = held.sparkSession.range(1).select(F.inline(F.array(*entries)))
    votes = (
        picked.select("doc_id", "text_key", "picks", F.posexplode("words").alias("pos", "word"))
        .where(F.array_contains(F.flatten("picks"), F.col("word")))
        .join(F.broadcast(index), "word")  # as long as the templates, whatever the corpus
        .where(F.array_contains(F.get("picks", F.col("template")), F.col("word")))
        .groupBy("doc_id", "text_key", "template", (F.col("pos") - F.col("at")).alias("start"))
        .agg(F.countDistinct("at").alias("votes"))
        .where(F.col("votes") >= VOTES)
    )
    candidates = votes.groupBy("doc_id", "text_key").agg(
        F.collect_list(F.struct("template", "start")).alias("candidates")  # of one file: bounded by its length
    )
    right = picked.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "words")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("text_key").eqNullSafe(F.col("_key"))

    def judge(c: Column) -> Column:
        verdict = F.lit(None).cast("struct<label:string,share:double>")
        for number in range(len(TEMPLATES)):
            verdict = F.when(c["template"] == number, _verified(F.col("words"), number, c["start"])).otherwise(verdict)
        return verdict

    return candidates.join(right, same).select(
        "doc_id", "text_key", F.array_compact(F.transform("candidates", judge)).alias("found")
    )


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Per row of `docs`: doc_id, n_words, base phrase places, labels, score.

    `score` is the largest share of template words matched by an accepted place; a file with a base
    phrase and no accepted place has 0.5, a file without either 0.
    """
    scanned = stored(scan_words(docs), "license-words")
    found = find_templates(scanned, word_frequencies(scanned))
    found = found.where(F.size("found") > 0).select(
        F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"),
        F.array_distinct(F.transform("found", lambda f: f["label"])).alias("more"),
        F.array_max(F.transform("found", lambda f: f["share"])).alias("share"),
    )
    by_label = base_places(F.col("words"))
    starts = F.coalesce(F.flatten(F.array(*by_label.values())), F.array().cast("array<int>"))
    labels = [F.when(F.size(place) > 0, F.lit(label)) for label, place in by_label.items()]
    based = scanned.select(
        "doc_id", "text_key", "n_words", starts.alias("starts"), F.array_compact(F.array(*labels)).alias("own")
    )
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("text_key").eqNullSafe(F.col("_key"))
    none = F.array().cast("array<string>")
    joined = based.join(found, same, "left").withColumn("all", F.array_union("own", F.coalesce("more", none)))
    return joined.select(
        "doc_id", "n_words",
        F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").cast("long").alias("first_word"),
        F.array_max("starts").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("own")), ",").alias("base_labels"),
        F.array_join(F.array_sort("all"), ",").alias("labels"),
        F.greatest(F.coalesce("share", F.lit(0.0)), F.when(F.size("own") > 0, 0.5).otherwise(0.0)).alias("score"),
    )


def oracle() -> str:
    """DuckDB SQL for the same rows, from relations of words, by another route than arrays."""
    postings = ", ".join(
        f"({t}, {i}, '{w}')" for t, (_, _, text, _) in enumerate(TEMPLATES) for i, w in enumerate(text.split())
    )
    keys = ", ".join(
        f"({t}, {_phrase_start(text, key)}, '{key}', {len(key.split())}, '{label}', {len(text.split())}, {looked_up(len(text.split()))})"
        for t, (_, label, text, key) in enumerate(TEMPLATES)
    )
    base = ", ".join(f"('{label}', '{phrase}', {len(phrase.split())})" for label, phrase in BASE_PHRASES.items())
    lowered = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH posting(t, i, word) AS (VALUES {postings}),
template(t, key_at, key, key_len, label, n, picks) AS (VALUES {keys}),
phrase(label, phrase, len) AS (VALUES {base}),
d AS (SELECT row_number() OVER () AS rid, doc_id,
             regexp_extract_all({lowered}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
w AS (SELECT rid, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos FROM d),
v AS (SELECT DISTINCT rid, word FROM w WHERE word IN (SELECT word FROM posting)),
freq AS (SELECT word, count(*) AS n FROM v GROUP BY word),
place AS (SELECT rid, label, pos FROM (
            SELECT rid, pos, word || ' ' || lead(word, 1) OVER o AS two,
                   word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o AS three
            FROM w WINDOW o AS (PARTITION BY rid ORDER BY pos)), phrase
          WHERE (len = 2 AND two = phrase) OR (len = 3 AND three = phrase)),
based AS (SELECT rid, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word,
                 string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM place GROUP BY rid),
keyed AS (SELECT v.rid, t FROM v, template WHERE list_contains(string_split(key, ' '), v.word)
          GROUP BY v.rid, t, key HAVING count(*) = len(list_distinct(string_split(key, ' ')))),
picked AS (SELECT rid, t, word FROM template JOIN (
             SELECT keyed.rid, keyed.t, v.word,
                    row_number() OVER (PARTITION BY keyed.rid, keyed.t ORDER BY freq.n, v.word) AS r
             FROM keyed JOIN v ON v.rid = keyed.rid
             JOIN (SELECT DISTINCT t, word FROM posting) AS p ON p.t = keyed.t AND p.word = v.word
             JOIN freq ON freq.word = v.word) USING (t) WHERE r <= picks),
vote AS (SELECT picked.rid, picked.t, w.pos - posting.i AS start
         FROM picked JOIN w ON w.rid = picked.rid AND w.word = picked.word
         JOIN posting ON posting.t = picked.t AND posting.word = picked.word
         GROUP BY ALL HAVING count(DISTINCT posting.i) >= {VOTES}),
share AS (SELECT vote.rid, vote.t, vote.start, count(*) AS hits
          FROM vote JOIN posting ON posting.t = vote.t
          JOIN w ON w.rid = vote.rid AND w.pos = vote.start + posting.i AND w.word = posting.word GROUP BY ALL),
accepted AS (SELECT share.rid, label, hits / n::DOUBLE AS share
             FROM share JOIN template USING (t) JOIN d ON d.rid = share.rid
             WHERE 100 * hits >= {ACCEPT_PERCENT} * n AND list_contains(
               [start + key_at + s >= 0
                AND array_to_string(words[start + key_at + s + 1:start + key_at + s + key_len], ' ') = key
                FOR s IN range(-{SHIFT}, {SHIFT + 1})], true)),
label AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
          FROM (SELECT rid, label FROM place UNION ALL SELECT rid, label FROM accepted) GROUP BY rid),
best AS (SELECT rid, max(share) AS share FROM accepted GROUP BY rid)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base,
       first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       greatest(coalesce(share, 0), CASE WHEN n_base > 0 THEN 0.5 ELSE 0 END)::DOUBLE AS score
FROM d LEFT JOIN based USING (rid) LEFT JOIN label USING (rid) LEFT JOIN best USING (rid)
"""
