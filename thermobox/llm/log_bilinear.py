"""Language-model scores: a log-bilinear neural model trained with noise-contrastive estimation.

Tokens are words and one end after each text. The model predicts a token from the CONTEXT tokens before it: the
context words' vectors, each weighted by place, add up to a predicted vector, and a token's score is its product
with the token's own vector plus a bias. Its vocabulary is the end, MODEL_WORDS frequent words and "rare"; a rare
word's probability is that of "rare" times its smoothed share of the rare training tokens, so that the
probabilities of all words seen, one unseen and the end add up to one.

Training is in numpy on every training document: each task goes over its own texts once, from common
parameters, telling tokens from noise drawn by unigram frequency; the tasks' parameters are averaged by tokens. The
common start comes from the same procedure in one task on a random sample of about WARM_ROWS training documents.
Scores are linear in the context words, so matrix products over the vocabulary give a score table
for each context place, and batches of products give the normaliser of every context; a token's log-probability
is then read from these tables.

Counts of all words are taken over all documents. The HEAD_WORDS most frequent go to the tasks with their counts;
all others stay rows: what a text holds of them is joined with the counts by word and summed by text. Broadcast:
the head (HEAD_WORDS words of at most HEAD_BYTES bytes), parameters and normalisers, all of fixed size.

Defined results: a null or empty text is one token, the end; repeated rows are rows of their own; a null doc_id counts
as not held out; without training documents all counts are 0 and the model is near uniform; an empty table gives no
rows. Other columns of `docs` are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermobox.llm.common import map_texts, most_frequent, pieces, stored
from thermobox.llm.words import VISIBLE, Words

FOLDS, HELD_OUT = 7, 2  # of crc32(doc_id)
HEAD_WORDS, HEAD_BYTES = 1 << 15, 64
MODEL_WORDS, DIMENSION, CONTEXT = 1022, 24, 2
END, RARE = 0, 1  # places in the vocabulary; words follow. The end also stands before a text
NOISE, BATCH, RATE, WARM_ROWS, SEED = 128, 2048, 0.05, 4000, 7
#: Parameter vectors that one task adds up.
FAN_IN = 64


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def count_words(docs: DataFrame) -> DataFrame:
    """word (null: the end), c: training tokens, n: tokens of all `docs` (doc_id, text, held_out)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            words = Words(batch.column("text"), VISIBLE)
            learnt = ~batch.column("held_out").to_numpy(zero_copy_only=False)
            n = np.bincount(words.codes, minlength=len(words.distinct))
            c = np.bincount(words.codes[learnt[words.text]], minlength=len(words.distinct))
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([words.distinct.cast(pa.large_string()), pa.nulls(1, pa.large_string())]).cast(pa.string()),
                 pa.array(np.r_[c, learnt.sum()].astype(np.int64)), pa.array(np.r_[n, batch.num_rows].astype(np.int64))],
                names=["word", "c", "n"],
            )

    return map_texts(docs, counted, "word string, c long, n long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


@dataclass(frozen=True)
class Vocabulary:
    """Counts of the head and of everything together; the model's words lead the head."""

    words: tuple[str, ...]
    counts: tuple[int, ...]
    modelled: int  # of `words`, from the first
    ends: int
    tokens: int  # N
    types: int  # V

    @property
    def size(self) -> int:
        return 2 + self.modelled

    @property
    def rare(self) -> tuple[int, int]:
        """Training tokens and types without a place of their own."""
        tokens = self.tokens - self.ends - sum(self.counts[:self.modelled])
        return tokens, self.types - self.modelled - (self.ends > 0)

    def frequencies(self) -> np.ndarray:
        """Smoothed shares of the places."""
        c = np.array([self.ends, self.rare[0], *self.counts[:self.modelled]], dtype=np.float64) + 1
        return c / c.sum()

    def encode(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each token, ends included: place in the vocabulary; number of head word or -1; and where each text starts."""
        head = pc.fill_null(pc.index_in(words.distinct, value_set=pa.array(self.words, pa.string()).cast(pa.large_binary())), -1)
        texts = len(words.edges) - 1
        number = np.full(len(words.codes) + texts, -1, dtype=np.int64)
        place = np.full(len(number), END, dtype=np.int64)
        at = np.arange(len(words.codes)) + words.text
        number[at] = head.to_numpy(zero_copy_only=False)[words.codes]
        place[at] = np.where((number[at] >= 0) & (number[at] < self.modelled), number[at] + 2, RARE)
        return place, number, words.edges[:-1] + np.arange(texts)


def build_vocabulary(counts: DataFrame) -> Vocabulary:
    """From `count_words`; at most HEAD_WORDS rows come to the driver."""
    total = counts.agg(F.sum("c").alias("tokens"), F.sum((F.col("c") > 0).cast("long")).alias("types"),
                       F.sum(F.when(F.col("word").isNull(), F.col("c"))).alias("ends")).first()
    short = counts.where(F.octet_length("word") <= HEAD_BYTES)
    head = [(r["word"], r["c"]) for r in most_frequent(short, "n", ["word"], HEAD_WORDS)]
    head.sort(key=lambda r: (-r[1], r[0]))
    seen = sum(c > 0 for _, c in head)
    return Vocabulary(tuple(w for w, _ in head), tuple(c for _, c in head), min(MODEL_WORDS, seen),
                      total["ends"] or 0, total["tokens"] or 0, total["types"] or 0)


def contexts(place: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The CONTEXT places before each token, nearest first; the end stands before a text."""
    text = np.zeros(len(place), dtype=np.int64)
    text[starts[1:]] = 1
    since = np.arange(len(place)) - starts[np.cumsum(text)] if len(place) else text
    out = np.full((CONTEXT, len(place)), END, dtype=np.int64)
    for back in range(CONTEXT):
        inside = np.flatnonzero(since > back)
        out[back, inside] = place[inside - back - 1]
    return out


class Model:
    """Vectors of context and predicted tokens, weights of the context places, biases."""

    def __init__(self, frequencies: np.ndarray):
        self.frequencies = frequencies
        size, rng = len(frequencies), np.random.default_rng(SEED)
        self.given = rng.normal(0, 0.1, (size, DIMENSION)).astype(np.float32)
        self.wanted = rng.normal(0, 0.1, (size, DIMENSION)).astype(np.float32)
        self.weight = np.full((CONTEXT, DIMENSION), 0.5, dtype=np.float32)
        self.bias = np.log(frequencies).astype(np.float32)

    def _parameters(self) -> list[np.ndarray]:
        return [self.given, self.wanted, self.weight, self.bias]

    def vector(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self._parameters()])

    def load(self, vector: np.ndarray) -> Model:
        at = 0
        for p in self._parameters():
            p[...] = vector[at:at + p.size].reshape(p.shape)
            at += p.size
        return self

    def train(self, streams: Iterable[tuple[np.ndarray, np.ndarray]]) -> int:
        """One pass over (place, context) of some tokens, by noise-contrastive estimation; the number of tokens."""
        rng, seen = np.random.default_rng(SEED), 0
        squares = [np.ones_like(p) for p in self._parameters()]  # AdaGrad
        rarity = np.log(NOISE * self.frequencies).astype(np.float32)
        steps = np.cumsum(self.frequencies)

        def move(which: int, rows, slope: np.ndarray) -> None:
            squares[which][rows] += slope * slope
            self._parameters()[which][rows] += RATE * slope / np.sqrt(squares[which][rows])

        def gathered(rows: np.ndarray, slopes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            order = np.argsort(rows, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(rows[order]) != 0])
            return rows[order][first], np.add.reduceat(slopes[order], first, axis=0)

        for place, context in streams:
            for start in range(0, len(place), BATCH):
                target, before = place[start:start + BATCH], context[:, start:start + BATCH]
                noise = np.minimum(np.searchsorted(steps, rng.random(NOISE)), len(steps) - 1)
                vectors = [self.given[b] for b in before]
                predicted = sum(v * w for v, w in zip(vectors, self.weight))
                own = (predicted * self.wanted[target]).sum(axis=1) + self.bias[target] - rarity[target]
                other = predicted @ self.wanted[noise].T + (self.bias[noise] - rarity[noise])
                right = 1 / (1 + np.exp(np.clip(own, -30, 30)))  # what the true token lacks of probability 1
                wrong = -1 / (1 + np.exp(np.clip(-other, -30, 30)))
                back = right[:, None] * self.wanted[target] + wrong @ self.wanted[noise]
                rows = np.r_[target, noise]
                slopes = np.vstack([right[:, None] * predicted, wrong.T @ predicted])
                move(1, *gathered(rows, slopes))
                move(3, *gathered(rows, np.r_[right, wrong.sum(axis=0)]))
                move(0, *gathered(np.concatenate(before), np.vstack([back * w for w in self.weight])))
                move(2, slice(None), np.stack([(back * v).sum(axis=0) for v in vectors]))
                seen += len(target)
        return seen

    def score_tables(self) -> np.ndarray:
        """[back, given, wanted]: what a token at that place before adds to the score; the bias is in the first."""
        tables = np.stack([(self.given * w) @ self.wanted.T for w in self.weight])
        tables[0] += self.bias
        return tables

    def normalisers(self, nearest: np.ndarray) -> np.ndarray:
        """Log of the sum over all tokens, for each of the `nearest` tokens and each token before it."""
        far = self.given * self.weight[1]
        out = np.empty((len(nearest), len(far)), dtype=np.float32)
        for row, token in zip(out, nearest):
            scores = (far + self.given[token] * self.weight[0]) @ self.wanted.T + self.bias
            top = scores.max(axis=1, keepdims=True)
            row[:] = top[:, 0] + np.log(np.exp(scores - top).sum(axis=1))
        return out


def _round(docs: DataFrame, vocabulary: Vocabulary, model: Model) -> Model:
    """Each task trains on its texts; the average of their parameters, by tokens."""
    start = model.vector()

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(vocabulary.frequencies()).load(start)

        def streams():
            for batch in pieces(batches, "text", 2 << 20):
                place, _, starts = vocabulary.encode(Words(batch.column("text"), VISIBLE))
                yield place, contexts(place, starts)

        n = own.train(streams())
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array([float(n)]), pa.array([(own.vector().astype(np.float64) * n).tobytes()])], names=["n", "sums"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0.0, np.zeros(len(start))
        for batch in batches:
            for weight, sums in zip(batch.column("n").to_pylist(), batch.column("sums")):
                n, total = n + weight, total + np.frombuffer(sums.as_buffer(), dtype=np.float64)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tobytes()])], names=["n", "sums"])

    sums = map_texts(docs.select("text"), trained, "n double, sums binary")
    parts = sums.rdd.getNumPartitions()
    while True:
        parts = -(-parts // FAN_IN)
        sums = sums.repartition(parts).mapInArrow(added, "n double, sums binary")
        if parts <= FAN_IN:
            break
    rows = sums.collect()  # at most FAN_IN
    n = sum(r["n"] for r in rows)
    if not n:
        return model
    return Model(vocabulary.frequencies()).load(sum(np.frombuffer(r["sums"]) for r in rows) / n)


def train(docs: DataFrame, vocabulary: Vocabulary) -> Model:
    """A model of the training documents in `docs` (doc_id, text, held_out)."""
    learnt = docs.where("NOT held_out")
    share = min(1.0, WARM_ROWS / max(1, learnt.count()))
    few = (learnt.sample(share, seed=SEED) if share < 1 else learnt).repartition(1)
    model = Model(vocabulary.frequencies())
    for part in (few, learnt):
        model = _round(part, vocabulary, model)
    return model


def normaliser_table(spark, vocabulary: Vocabulary, model: Model) -> np.ndarray:
    """[nearest, one before]: the normaliser of every context; as many rows as the vocabulary."""
    vector = model.vector()

    def worked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(vocabulary.frequencies()).load(vector)
        for batch in batches:
            nearest = batch.column("id").to_numpy()
            for start in range(0, len(nearest), 64):
                some = nearest[start:start + 64]
                rows = own.normalisers(some)
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([r.tobytes() for r in rows])], names=["id", "row"])

    rows = spark.range(0, vocabulary.size, 1, max(1, vocabulary.size // 64)).mapInArrow(worked, "id long, row binary").collect()
    out = np.empty((vocabulary.size, vocabulary.size), dtype=np.float32)
    for r in rows:
        out[r["id"]] = np.frombuffer(r["row"], dtype=np.float32)
    return out


SCORED = ("doc_id long, held_out boolean, n_tokens long, n_known long, base double, model double, "
          "tail array<struct<word:string,n:long>>")


def _score_head(docs: DataFrame, vocabulary: Vocabulary, model: Model, normalisers: np.ndarray) -> DataFrame:
    """Sums over the tokens in the head of each text, and the other words with their number."""
    vector = model.vector()
    tokens, types = vocabulary.rare

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Model(vocabulary.frequencies()).load(vector).score_tables()
        counts = np.array([*vocabulary.counts, vocabulary.ends], dtype=np.float64)  # the end last, as number -1
        base = np.log10((counts + 1) / (vocabulary.tokens + vocabulary.types + 1))
        within = np.log10((counts + 1) / (tokens + types + 1))
        for batch in pieces(batches, "text", 4 << 20):
            words = Words(batch.column("text"), VISIBLE)
            place, number, starts = vocabulary.encode(words)
            near, far = contexts(place, starts)
            log = (tables[0][near, place] + tables[1][far, place] - normalisers[near, far]).astype(np.float64) / np.log(10)
            tail = (number < 0) & (place == RARE)
            log += np.where((place == RARE) & ~tail, within[number], 0.0)
            plain = np.where(tail, 0.0, base[number])
            known = ~tail & (counts[number] > 0)
            # distinct words of the tail by text
            at = np.flatnonzero(tail)
            text = np.searchsorted(starts, at, "right") - 1
            code = words.codes[at - text].astype(np.int64)
            key, n = np.unique(text * max(1, len(words.distinct)) + code, return_counts=True)
            edges = np.searchsorted(key, np.arange(batch.num_rows + 1) * max(1, len(words.distinct)))
            some = words.distinct.take(pa.array(key % max(1, len(words.distinct)))).cast(pa.large_string()).cast(pa.string())
            lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.StructArray.from_arrays([some, pa.array(n.astype(np.int64))], ["word", "n"]))
            sums = [np.add.reduceat(x, starts) if len(starts) else x for x in (np.ones(len(place), np.int64), known.astype(np.int64), plain, log)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), *map(pa.array, sums), lists],
                names=["doc_id", "held_out", "n_tokens", "n_known", "base", "model", "tail"],
            )

    return map_texts(docs, scored, SCORED)


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of `docs`."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held_out"))
    counts = stored(count_words(own), "word-counts")
    vocabulary = build_vocabulary(counts)
    model = train(own, vocabulary)
    normalisers = normaliser_table(docs.sparkSession, vocabulary, model)
    head = _score_head(own, vocabulary, model, normalisers).withColumn("rid", F.monotonically_increasing_id())
    head = stored(head, "head-scores")
    tokens, types = vocabulary.rare
    words = head.select("rid", F.inline("tail")).join(counts.select("word", "c"), "word", "left")
    c = F.coalesce("c", F.lit(0)).cast("double")
    tail = words.select(
        "rid", (F.col("n") * (c > 0).cast("long")).alias("n_known"),
        (F.col("n") * F.log10((c + 1) / F.lit(float(vocabulary.tokens + vocabulary.types + 1)))).alias("base"),
        (F.col("n") * F.log10((c + 1) / F.lit(float(tokens + types + 1)))).alias("model"),
    )
    together = head.drop("tail").unionByName(tail, allowMissingColumns=True)
    return together.groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"),
        F.sum("n_known").alias("n_known"), F.lit(vocabulary.tokens).cast("long").alias("train_tokens"),
        F.sum("base").alias("base_score"), F.sum("model").alias("score"),
    ).drop("rid")


def op13(docs: DataFrame) -> DataFrame:
    return score_documents(docs)
