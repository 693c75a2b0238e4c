"""Text quality by a linear-chain conditional random field over lines.

Each line is good or bad; its features are shares of symbols, capitals, repeated words and so on, cut into
bins, and those of the line before and after. Labelled documents give the labels: each line of a document
has the document's label, and as one chain is one document, the CRF learns how far neighbours agree.
A document's score is the mean of the forward-backward marginals of "good" over its lines, weighted by
their lengths in characters of UTF-8.

The CRF is fitted on at most TRAINING_DOCS labelled documents (by a hash of doc_id, none of the held-out
fold), of each one text and at most TRAINING_RUNS runs of RUN_LINES lines, spread evenly over the whole text; a text without
more lines is taken whole. Every whole text is scored.

Defined results: a text without a line that holds a word (null, empty, blank) scores the share of good
documents in the training sample; lines without a word are no lines; a null `doc_id` is not held out and never
trained on; several labels for one document count as the smallest; without labelled rows every score is 0.5;
an empty table gives no rows. Of other columns nothing is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermobox.llm.common import map_texts, pieces
from thermobox.llm.crf import Crf, forward_backward, padded, train

TRAINING_DOCS, TRAINING_RUNS, RUN_LINES = 1500, 4, 20
HELD_OUT = 2  # remainder of crc32(doc_id) by 4
THRESHOLD = 0.7


def _classes(members: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(members)] = True
    return table


_UPPER = _classes(bytes(range(65, 91)))
_LETTER = _classes(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))
_DIGIT = _classes(b"0123456789")
_SYMBOL = _classes(b"#*$%&|<>{}[]\\^~_=@/")
_SHOUT = _classes(b"!?")
_STOP = _classes(b".,;:")

#: Measure and the upper borders of its bins.
BINS = (
    ("symbols_by_word", (0.0, 0.05, 0.2, 0.5, 1.0)), ("shouts_by_word", (0.0, 0.1, 0.4)), ("stops_by_word", (0.0, 0.05, 0.15, 0.4)),
    ("capitals", (0.0, 0.05, 0.15, 0.4, 0.8)), ("letters", (0.5, 0.7, 0.9, 0.97)), ("digits", (0.0, 0.02, 0.1, 0.3)),
    ("repeats", (0.0, 0.05, 0.2, 0.5)), ("distinct", (0.3, 0.5, 0.7, 0.9)), ("word_length", (2.5, 4.0, 6.0, 9.0, 14.0)),
    ("words", (1, 3, 8, 20, 60, 200)), ("copies", (0,)),
)
FEATURES = 1 + sum(len(borders) + 1 for _, borders in BINS)


def _counts(mask: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(mask, dtype=np.int64)]
    return total[stops] - total[starts]


def line_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all lines with a word, in order: the text's place, the length in bytes, the feature places (lines x measures + 1)."""
    lists = pc.split_pattern(pc.fill_null(texts.cast(pa.large_string()), ""), "\n")
    lines = lists.flatten()
    owner = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    words = pc.ascii_split_whitespace(lines)
    coded = words.flatten().dictionary_encode()
    code, length = coded.indices.to_numpy().astype(np.int64), pc.binary_length(words.flatten()).to_numpy()
    place = np.repeat(np.arange(len(lines)), np.diff(words.offsets.to_numpy()))
    real = length > 0
    code, place = code[real], place[real]
    n_words = np.bincount(place, minlength=len(lines))
    kept = np.flatnonzero(n_words)
    if not len(kept):
        return np.zeros(0, np.int64), np.zeros(0), np.zeros((0, len(BINS) + 1), np.int64)

    buffers = lines.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[lines.offset:lines.offset + len(lines) + 1]
    raw = np.frombuffer(buffers[2], dtype=np.uint8)[offsets[0]:offsets[-1]] if buffers[2] else np.zeros(0, np.uint8)
    starts, stops = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
    starts, stops = starts[kept], stops[kept]
    size = (stops - starts).astype(float)
    n = n_words[kept].astype(float)
    count = {name: _counts(table[raw], starts, stops) for name, table in
             (("upper", _UPPER), ("letter", _LETTER), ("digit", _DIGIT), ("symbol", _SYMBOL), ("shout", _SHOUT), ("stop", _STOP))}

    again = np.zeros(len(code), dtype=bool)
    for back in (1, 2, 3):
        again[back:] |= (code[back:] == code[:-back]) & (place[back:] == place[:-back])
    repeats = np.bincount(place[again], minlength=len(lines))[kept]
    pairs = np.unique(place * (len(coded.dictionary) + 1) + code) // (len(coded.dictionary) + 1)
    distinct = np.bincount(pairs, minlength=len(lines))[kept]

    same = lines.dictionary_encode().indices.to_numpy().astype(np.int64)[kept]
    key = owner[kept] * (int(same.max()) + 1) + same
    copies = np.ones(len(kept), dtype=np.int64)
    copies[np.unique(key, return_index=True)[1]] = 0

    letters = np.maximum(count["letter"], 1)
    inked = np.maximum(size - n + 1, 1)
    measures = {
        "symbols_by_word": count["symbol"] / n, "shouts_by_word": count["shout"] / n, "stops_by_word": count["stop"] / n,
        "capitals": count["upper"] / letters, "letters": count["letter"] / inked, "digits": count["digit"] / inked,
        "repeats": repeats / n, "distinct": distinct / n, "word_length": inked / n, "words": n, "copies": copies,
    }
    columns, first = [np.zeros(len(kept), np.int64)], 1  # place 0 is the bias
    for name, borders in BINS:
        columns.append(first + np.searchsorted(borders, measures[name], "left"))
        first += len(borders) + 1
    return owner[kept], size, np.column_stack(columns)


def held_out(doc_id="doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == HELD_OUT, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_DOCS) -> tuple[Crf | None, float]:
    """The CRF and the share of good documents, from a bounded sample of labelled documents outside the held-out fold."""
    marked = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").where(~held_out())
    marked = marked.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    known = {r["doc_id"]: r["quality"] for r in chosen.collect()}
    texts = docs.where(F.col("doc_id").isin(list(known))) if known else docs.limit(0)
    # of rows that share an id one text, that with the smallest hash
    texts = texts.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 2 << 20):
            owner, _, places = line_features(batch.column("text"))
            edges = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            ids, numbers, lists = [], [], []
            for i in range(batch.num_rows):
                for number, (a, b) in enumerate(_runs(int(edges[i + 1] - edges[i]))):
                    ids.append(i), numbers.append(number), lists.append(places[edges[i] + a:edges[i] + b].ravel())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(ids, pa.int64())), pa.array(numbers, pa.int32()), pa.array(lists, pa.list_(pa.int64()))],
                names=["doc_id", "run", "places"],
            )

    found = map_texts(texts, measured, "doc_id long, run int, places array<long>").collect()  # TRAINING_DOCS x TRAINING_RUNS at most
    data = []
    for r in sorted(found, key=lambda r: (r["doc_id"], r["run"])):
        places = np.array(r["places"], dtype=np.int64).reshape(-1, len(BINS) + 1)
        if len(places):
            data.append((_one_hot(places), np.full(len(places), int(known[r["doc_id"]] > 0))))
    seen = {r["doc_id"] for r in found}
    good = sum(known[i] > 0 for i in seen)
    return (train(data, FEATURES, 2, rounds=80) if data else None), (good / len(seen) if seen else 0.5)


def _runs(lines: int) -> list[tuple[int, int]]:
    """Where the training lines of a text with so many lines start and stop."""
    if lines <= TRAINING_RUNS * RUN_LINES:
        return [(0, lines)]
    first = np.linspace(0, lines - RUN_LINES, TRAINING_RUNS).astype(int)
    return [(int(a), int(a) + RUN_LINES) for a in first]


def _one_hot(places: np.ndarray) -> np.ndarray:
    out = np.zeros((len(places), FEATURES))
    out[np.arange(len(places))[:, None], places] = 1
    return out


def document_scores(texts: pa.Array, crf: Crf | None, prior: float) -> np.ndarray:
    scores = np.full(len(texts), prior)
    if crf is None:
        return scores
    owner, size, places = line_features(texts)
    if not len(owner):
        return scores
    # a line's part in its own score and its neighbours': sums of the weight rows of its features
    before, own, after = (crf.own[k][places].sum(axis=1) for k in range(3))
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    stop = np.r_[first[1:], len(owner)]
    line = own.copy()
    line[1:] += before[:-1] * (owner[1:] == owner[:-1])[:, None]
    line[:-1] += after[1:] * (owner[1:] == owner[:-1])[:, None]
    order = np.argsort(stop - first, kind="stable")
    while len(order):
        # chains of like length, together at most about a million cells
        longest = stop[order[-1]] - first[order[-1]]
        some, order = order[-max(1, 1_000_000 // int(longest)):], order[:-max(1, 1_000_000 // int(longest))]
        stacked, lengths = padded([line[first[i]:stop[i]] for i in some], 2)
        marginals, _ = forward_backward(stacked, lengths, crf.move, crf.ends)
        weights, _ = padded([size[first[i]:stop[i], None] for i in some], 1)
        scores[owner[first[some]]] = (marginals[:, :, 1] * weights[:, :, 0]).sum(axis=1) / weights[:, :, 0].sum(axis=1)
    return np.clip(scores, 0.0, 1.0)


def score_documents(docs: DataFrame, crf: Crf | None, prior: float) -> DataFrame:
    """doc_id, score of every row of `docs`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 2 << 20):
            scores = document_scores(batch.column("text"), crf, prior)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], names=["doc_id", "score"])

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, score double")


def op7(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score_documents(docs, *fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
