"""Language identification by Bayesian fusion of text, declared language, address suffix and host.

    log P(language | row) = tempered log P(text | language) + log P(declared | language)
                            + log P(suffix | language) + log P(language | host)

The text likelihood is a naive Bayes over letter trigrams. Its languages are all that any row with text declares, each
fitted on distinct texts (the smallest hashes), of each at most TRAINING_CHARS characters in pieces spread evenly over the whole text: about TRAINING_ROWS texts together, dealt
evenly over the languages, and LEAST_TEXTS of each that has so many. The labels are refined by the model itself, so some
wrong declarations do no harm; a language that would lose all its texts keeps them. As neighbouring trigrams are not independent, a text counts for at most
EVIDENCE trigrams. The other factors are learned from all rows: the text posteriors are summed by declared language,
suffix, host and domain. The host's prior is smoothed towards its domain's, that towards the share of the
language among all rows, and a row's own posterior is left out of its host's and domain's.

A row is kept if the best language has a probability of at least MIN_PROBABILITY and the text has at least
MIN_GRAMS letter trigrams.

Defined results: a null, empty or letterless text has no text evidence and is not kept; a null or unknown
declaration, suffix or host says nothing; equal rows get equal results; ties go to the language first in
code point order; without any declared language, or for an empty table, `language` is null and nothing
is kept. All columns of the input are carried; those added start with `lid_`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thermobox.llm.common import LOWER, column, join_repeated, map_texts, pieces, stored

BUCKETS = 1 << 15
TRAINING_ROWS, TRAINING_CHARS, TRAINING_PIECES, LEAST_TEXTS = 2000, 8000, 8, 20
EVIDENCE, STRENGTH, SMOOTHING = 40, 5.0, 0.5
MIN_PROBABILITY, MIN_GRAMS = 0.8, 1

_LETTER = np.zeros(256, dtype=bool)
_LETTER[list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = True
_FOLD = np.frombuffer(LOWER, dtype=np.uint8).copy()
_FOLD[~_LETTER] = 32


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every byte trigram with at most one blank, and the place of its text. Non-letters are blanks."""
    filled = pc.fill_null(texts.cast(pa.large_string()), "")
    buffers = filled.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[filled.offset:filled.offset + len(filled) + 1]
    if buffers[2] is None or offsets[-1] - offsets[0] < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    folded = _FOLD[np.frombuffer(buffers[2], dtype=np.uint8)[offsets[0]:offsets[-1]]]
    owner = np.repeat(np.arange(len(filled)), np.diff(offsets))
    blank = folded == 32
    inside = (owner[2:] == owner[:-2]) & (blank[:-2].astype(np.int8) + blank[1:-1] + blank[2:] <= 1)
    wide = folded.astype(np.uint32)
    code = (wide[:-2] * np.uint32(0x9E3779B1) + wide[1:-1] * np.uint32(0x85EBCA77) + wide[2:] * np.uint32(0xC2B2AE3D))
    code = (code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (code >> np.uint32(17))[inside].astype(np.int64), owner[:-2][inside]


@dataclass(frozen=True)
class TextModel:
    languages: list[str]
    logs: np.ndarray  # languages x BUCKETS, log probability of a bucket

    def evidence(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Tempered log likelihood (texts x languages) and the number of trigrams."""
        code, owner = trigrams(texts)
        n = np.bincount(owner, minlength=len(texts))
        sums = np.column_stack([np.bincount(owner, self.logs[k][code], minlength=len(texts)) for k in range(len(self.languages))]) \
            if self.languages else np.zeros((len(texts), 0))
        return sums * np.minimum(1.0, EVIDENCE / np.maximum(n, 1))[:, None], n


def _table(codes: list[np.ndarray], labels: np.ndarray, n: int) -> np.ndarray:
    counts = np.full((n, BUCKETS), 0.1)
    for code, label in zip(codes, labels):
        counts[label] += np.bincount(code, minlength=BUCKETS)
    return np.log(counts / counts.sum(axis=1, keepdims=True))


def _even(sizes: list[int], total: int) -> int:
    """The level at which sizes cut to it sum to about `total`."""
    level, left = 0, total
    for i, n in enumerate(sorted(sizes)):
        level = max(level, min(n, left // (len(sizes) - i)))
        left -= min(n, left // (len(sizes) - i))
    return level


def spread(text: Column) -> Column:
    """A text of at most TRAINING_CHARS characters whole; of a longer one TRAINING_PIECES pieces, evenly from start to end."""
    size, last = TRAINING_CHARS // TRAINING_PIECES, TRAINING_PIECES - 1
    piece = F.transform(
        F.sequence(F.lit(0), F.lit(last)),
        lambda i: F.substring(text, (1 + F.floor(i * (F.length(text) - size) / last)).cast("int"), F.lit(size)))
    return F.when(F.length(text) > TRAINING_CHARS, F.array_join(piece, " ")).otherwise(text)


def training_texts(rows: DataFrame, declared: str, text: str) -> DataFrame:
    """declared, text: a bounded number of distinct texts of every declared language, of each what `spread` takes."""
    marked = rows.where(F.col(declared).isNotNull() & (F.length(text) > 0)).select(
        F.col(declared).alias("declared"), F.xxhash64(text).alias("key"), F.col(text).alias("text")
    )
    keys = stored(marked.select("declared", "key").distinct(), "lid-keys")
    counts = keys.groupBy("declared").count()
    sizes = [r["count"] for r in counts.collect()]  # one per language
    each = max(_even(sizes, TRAINING_ROWS), min(LEAST_TEXTS, 10_000 // max(len(sizes), 1)), 1)
    # keys are uniform: about twice the wanted number lie below the share, and only they are ranked
    share = F.least(F.lit(1.0), F.lit(2.0 * each + 100) / F.col("count"))
    low = keys.join(F.broadcast(counts), "declared").where(F.pmod("key", F.lit(1_000_003)) < share * 1_000_003)
    rank = F.row_number().over(Window.partitionBy("declared").orderBy(F.pmod("key", F.lit(1_000_003)), "key"))
    chosen = low.withColumn("rank", rank).where(F.col("rank") <= each).select("declared", "key")
    cut = spread(F.col("text"))
    return marked.join(F.broadcast(chosen), ["declared", "key"]).groupBy("declared", "key").agg(F.min(cut).alias("text")).drop("key")


def fit_text(rows: DataFrame, declared: str, text: str = "text") -> TextModel:
    """The text model of a bounded number of texts of every declared language."""
    sample = training_texts(rows, declared, text).collect()
    sample = sorted((r["declared"], r["text"]) for r in sample)
    languages = sorted({d for d, _ in sample})
    codes = [trigrams(pa.array([t]))[0] for _, t in sample]
    labels = np.array([languages.index(d) for d, _ in sample], dtype=int)
    for _ in range(3):
        logs = _table(codes, labels, len(languages)) if languages else np.zeros((0, BUCKETS))
        guess = np.array([logs[:, c].sum(axis=1).argmax() if len(c) else k for c, k in zip(codes, labels)], dtype=int)
        guess = np.where(np.isin(labels, guess), guess, labels)
        if (guess == labels).all():
            break
        labels = guess
    return TextModel(languages, logs)


def with_evidence(rows: DataFrame, model: TextModel, text: str = "text", keep_text: bool = True) -> DataFrame:
    """`rows` with lid_text (log likelihood by language) and lid_grams."""
    kept = [f for f in rows.schema.fields if keep_text or f.name != text]
    schema = T.StructType([*kept, T.StructField("lid_text", T.ArrayType(T.DoubleType())), T.StructField("lid_grams", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text, 1 << 20):
            logs, n = model.evidence(batch.column(text))
            columns = [batch.column(f.name) for f in kept] + [pa.array(list(logs), pa.list_(pa.float64())), pa.array(n)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return map_texts(rows, run, schema)


def _shares(logs: Column) -> Column:
    """Probabilities from logs, as an array."""
    top = F.array_max(logs)
    weights = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(weights, F.lit(0.0), lambda s, x: s + x)
    return F.transform(weights, lambda x: x / total)


def _sums(rows: DataFrame, key: str, n: int) -> DataFrame:
    """Per value of `key` the number of rows and the sums of their text posteriors."""
    sums = [F.sum(F.get("_post", F.lit(k))) for k in range(n)]
    counted = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"), F.array(*sums).alias("_sums"))
    return counted


@dataclass
class Evidence:
    """What all rows say about declarations, suffixes, domains and hosts. Tables of value, sums of posteriors."""

    model: TextModel
    share: list[float]
    tables: dict[str, DataFrame]


def learn(evident: DataFrame, model: TextModel, columns: dict[str, str]) -> Evidence:
    """`columns` names, of declared, suffix, domain and host, those that `evident` has."""
    n = len(model.languages)
    letters = evident.where(F.col("lid_grams") >= MIN_GRAMS).withColumn("_post", _shares(F.col("lid_text")))
    totals = letters.agg(*[F.sum(F.get("_post", F.lit(k))).alias(f"s{k}") for k in range(n)]).first() if n else []
    sums = np.array([x or 0.0 for x in totals]) + SMOOTHING
    tables = {}
    for kind, column in columns.items():
        counted = _sums(letters, column, n)
        if kind in ("host", "domain"):
            counted = counted.where("_n > 1")  # without the row itself a lone row has no host
        tables[kind] = stored(counted.select(F.col(column).alias(f"lid_{kind}"), F.col("_sums").alias(f"lid_{kind}_sums")), f"lid-{kind}")
    return Evidence(model, (sums / sums.sum()).tolist(), tables)


def fuse(evident: DataFrame, learned: Evidence, columns: dict[str, str], salt_by: list[str]) -> DataFrame:
    """`evident` with lid_language, lid_probability and lid_kept."""
    n = len(learned.model.languages)
    share = F.array(*[F.lit(s) for s in learned.share]) if n else F.array().cast("array<double>")
    own = F.when(F.col("lid_grams") >= MIN_GRAMS, _shares(F.col("lid_text"))).otherwise(F.transform("lid_text", lambda x: F.lit(0.0)))
    rows = evident.withColumn("lid_own", own)
    totals = {}
    for kind, column in columns.items():
        rows = rows.withColumn(f"lid_{kind}", F.col(column))
        rows = join_repeated(rows, learned.tables[kind], f"lid_{kind}", salt_by)
        if kind in ("declared", "suffix"):
            # P(value | language) needs the languages' totals over all values of the kind
            sums = [F.coalesce(F.sum(F.get(f"lid_{kind}_sums", F.lit(k))), F.lit(0.0)) for k in range(n)]
            found = learned.tables[kind].agg(F.count("*").alias("n"), *[s.alias(f"s{k}") for k, s in enumerate(sums)]).first()
            totals[kind] = [found[f"s{k}"] + SMOOTHING * max(found["n"], 1) for k in range(n)]

    def smoothed(kind: str, towards: Column) -> Column:
        if kind not in columns:
            return towards
        rest = F.zip_with(f"lid_{kind}_sums", "lid_own", lambda a, b: F.greatest(F.lit(0.0), a - b))
        total = F.aggregate(rest, F.lit(0.0), lambda s, x: s + x) + STRENGTH
        mixed = F.zip_with(rest, towards, lambda a, b: (a + STRENGTH * b) / total)
        return F.coalesce(F.when(F.col(f"lid_{kind}_sums").isNotNull(), mixed), towards)

    rows = rows.withColumn("lid_prior", smoothed("domain", share))
    rows = rows.withColumn("lid_prior", smoothed("host", F.col("lid_prior")))
    logs = F.zip_with("lid_text", "lid_prior", lambda a, b: a + F.log(b))
    for kind, total in totals.items():
        given = F.zip_with(f"lid_{kind}_sums", F.array(*[F.lit(t) for t in total]), lambda a, b: F.log((a + SMOOTHING) / b))
        said = F.coalesce(given, F.transform("lid_text", lambda x: F.lit(0.0)))
        logs = F.zip_with(logs, said, lambda a, b: a + b)
    rows = rows.withColumn("lid_shares", _shares(logs)).withColumn("lid_probability", F.array_max("lid_shares"))
    names = F.array(*[F.lit(x) for x in learned.model.languages]) if n else F.array().cast("array<string>")
    best = F.get(names, (F.array_position("lid_shares", F.col("lid_probability")) - 1).cast("int"))
    rows = rows.withColumn("lid_language", best)
    kept = (F.col("lid_probability") >= MIN_PROBABILITY) & (F.col("lid_grams") >= MIN_GRAMS)
    extra = ["lid_own", "lid_prior", "lid_shares", *(f"lid_{k}" for k in columns), *(f"lid_{k}_sums" for k in columns)]
    return rows.withColumn("lid_kept", F.coalesce(kept, F.lit(False))).drop(*extra)


def primary_subtag(tag: Column) -> Column:
    """`en` of `EN-gb`; null where there is none."""
    found = F.lower(F.regexp_extract(F.coalesce(tag, F.lit("")), r"^\s*([A-Za-z]{2,3})(?![A-Za-z])", 1))
    return F.when(found != "", found)


def visible_text(html: Column) -> Column:
    """Text outside tags, scripts, styles and comments; entities become blanks.

    What is opened and not closed reaches to the end (scripts, styles, comments) or to the next `<` (tags), so no
    place of the text is looked at again for a later opening.
    """
    hidden = r"<script\b.*?(?:</script>|\z)|<style\b.*?(?:</style>|\z)|<!--.*?(?:-->|\z)"
    return F.regexp_replace(html, rf"(?is){hidden}|</?[a-z][^<>]*+>?|<[^<>]*+>|<|&#?+\w++;", " ")


def page_rows(pages: DataFrame) -> DataFrame:
    """page_id, text, declared (of the markup), suffix, domain and host (of the address)."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    host = F.when(host != "", host)
    labels = F.split(host, r"\.")
    suffix = F.when(F.size(labels) > 1, F.element_at(labels, -1))
    domain = F.when(F.size(labels) > 1, F.array_join(F.slice(labels, -2, 2), "."))
    tag = F.regexp_extract(F.coalesce("html", F.lit("")), r"(?i)<html\b[^<>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", 1)
    return pages.select("page_id", visible_text(F.col("html")).alias("text"), primary_subtag(tag).alias("declared"),
                        suffix.alias("suffix"), domain.alias("domain"), host.alias("host"))


PAGE_COLUMNS = {"declared": "declared", "suffix": "suffix", "domain": "domain", "host": "host"}
#: A document's lang is its declared language, its source the host it came from; it has no address.
DOCUMENT_COLUMNS = {"declared": "lid_lang", "host": "source"}


def identify_pages(pages: DataFrame) -> DataFrame:
    """page_id, language, probability, kept."""
    rows = page_rows(pages)
    model = fit_text(rows, "declared")
    evident = stored(with_evidence(rows, model, keep_text=False), "lid-evidence")
    done = fuse(evident, learn(evident, model, PAGE_COLUMNS), PAGE_COLUMNS, ["page_id"])
    return done.select("page_id", F.col("lid_language").alias("language"), F.col("lid_probability").alias("probability"), F.col("lid_kept").alias("kept"))


def op8(docs: DataFrame) -> DataFrame:
    """doc_id, language, probability, kept of every document."""
    rows = docs.select("doc_id", "text", primary_subtag(F.col("lang")).alias("lid_lang"), "source")
    model = fit_text(rows, "lid_lang")
    evident = stored(with_evidence(rows, model, keep_text=False), "lid-evidence")
    done = fuse(evident, learn(evident, model, DOCUMENT_COLUMNS), DOCUMENT_COLUMNS, ["doc_id"])
    return done.select("doc_id", F.col("lid_language").alias("language"), F.col("lid_probability").alias("probability"), F.col("lid_kept").alias("kept"))


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of `docs` whose language is identified, with their columns."""
    rows = docs.withColumn("lid_lang", primary_subtag(F.col("lang")))
    model = fit_text(rows, "lid_lang")
    slim = with_evidence(rows.select("text", "lid_lang", "source"), model, keep_text=False)
    learned = learn(stored(slim, "lid-evidence"), model, DOCUMENT_COLUMNS)
    done = fuse(with_evidence(rows, model), learned, DOCUMENT_COLUMNS, ["doc_id"])
    return done.where("lid_kept").select(*[column(c) for c in docs.columns])
