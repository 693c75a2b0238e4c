"""Importance resampling towards a target text distribution, over hashed word n-grams.

Features are all runs of 1 to 3 words; a feature's bucket is its CRC-32 modulo BUCKETS. Bucket totals of the
corpus and of the target give each bucket a gain, a document's weight is the sum over its features, and
weight plus Gumbel noise from the document's id ranks the documents: the highest scores are the draw.

The vocabulary has a head and a tail. Head: the HEAD_WORDS most frequent words, broadcast with their exact CRC
states, and the HEAD_PAIRS most frequent pairs of them with theirs. Longer features of head words follow
from these states by the linearity of the CRC, in array operations. Tail: a feature with any other word
takes the CRC of its bytes. Both ways give the same bucket, so which words are head changes the work only;
they are counted in the whole texts of a random sample of about SAMPLE_ROWS documents. Totals and weights cover every document.

Broadcast: the head (bounded by HEAD_WORDS of at most HEAD_BYTES bytes and HEAD_PAIRS numbers) and one gain per
bucket. Nothing of a document is shuffled but its id and numbers, for the ranking, which is by range.

Defined results: a null or empty text has no features, weight 0, and cannot be drawn; repeated rows are rows of
their own with equal scores; ties go by doc_id (null first), then n_features; a null doc_id hashes as an empty
one; an empty table gives no rows, an empty target gives totals of 0. Other columns of `docs` are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermobox.llm.common import map_texts, most_frequent, pieces, stored
from thermobox.llm.words import LETTERS, Words
from thermobox.operators.series import index_by

BUCKETS, LONGEST = 10_000, 3
HEAD_WORDS, HEAD_BYTES, HEAD_PAIRS = 1 << 15, 32, 1 << 16
SAMPLE_ROWS = 20_000
DRAWN_PERCENT, LEAST_WORDS, SEED = 5, 20, 42


def _byte_step() -> np.ndarray:
    """The CRC-32 table: what one zero byte makes of each low byte (reflected polynomial of the standard)."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


def _shifts(longest: int) -> np.ndarray:
    """[n, k, b]: the state b << 8k after n zero bytes; a state's shift is the xor over its four bytes."""
    step = _byte_step()
    out = np.empty((longest + 1, 4, 256), dtype=np.uint32)
    out[0] = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, longest + 1):
        out[n] = (out[n - 1] >> 8) ^ step[out[n - 1] & 255]
    return out


@dataclass(frozen=True)
class Head:
    """Frequent words, most frequent first, and frequent pairs of them as (place, place)."""

    words: tuple[bytes, ...]
    pairs: tuple[tuple[int, int], ...]

    def __getstate__(self):
        return {"words": self.words, "pairs": self.pairs}  # tables are made again where they are used

    @cached_property
    def _values(self) -> pa.Array:
        return pa.array(self.words, pa.large_binary())

    @cached_property
    def _states(self) -> np.ndarray:
        return np.array([zlib.crc32(w) for w in self.words], dtype=np.uint32)

    @cached_property
    def _onward(self) -> tuple[np.ndarray, np.ndarray]:
        """CRC and length of a blank and the word."""
        crc = np.array([zlib.crc32(b" " + w) for w in self.words], dtype=np.uint32)
        return crc, np.array([len(w) + 1 for w in self.words], dtype=np.int64)

    @cached_property
    def _shift(self) -> np.ndarray:
        return _shifts(1 + max(map(len, self.words), default=0))

    @cached_property
    def _pair_table(self) -> tuple[np.ndarray, np.ndarray]:
        """Pair key and state by slot; of pairs that share a slot the more frequent one stays."""
        keys = np.full(1 << self._slot_bits, -1, dtype=np.int64)
        states = np.zeros(len(keys), dtype=np.uint32)
        if self.pairs:
            first, second = np.array(self.pairs[::-1], dtype=np.int64).T
            key = first * len(self.words) + second
            slot = self._slot(key)
            keys[slot] = key
            states[slot] = self.extended(self._states[first], second)
        return keys, states

    @property
    def _slot_bits(self) -> int:
        return 2 + max(1, len(self.pairs)).bit_length()

    def _slot(self, key: np.ndarray) -> np.ndarray:
        mixed = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self._slot_bits)).astype(np.int64)

    def extended(self, states: np.ndarray, word: np.ndarray) -> np.ndarray:
        """States after a blank and the head word at place `word`."""
        crc, length = self._onward
        n = length[word]
        out = crc[word]
        for k in range(4):
            out = out ^ self._shift[n, k, (states >> np.uint32(8 * k)) & np.uint32(255)]
        return out

    def places(self, distinct: pa.Array) -> np.ndarray:
        """Place in the head of each word, -1 for words of the tail."""
        return pc.fill_null(pc.index_in(distinct, value_set=self._values), -1).to_numpy(zero_copy_only=False)

    def buckets(self, words: Words) -> Iterator[np.ndarray]:
        """For n = 1, 2, 3: the bucket of the run of n words at each word, BUCKETS where no such run starts."""
        place = self.places(words.distinct)[words.codes].astype(np.int64)
        known, states = place >= 0, np.zeros(len(place), dtype=np.uint32)
        states[known] = self._states[place[known]]
        ends = words.at + words.lengths
        for n in range(1, LONGEST + 1):
            whole = words.runs(n)
            if n > 1:
                reach = len(place) - n + 1
                known[:max(reach, 0)] &= place[n - 1:] >= 0
                i = np.flatnonzero(whole & known)
                longer = np.zeros_like(states)
                if n == 2 and len(i):
                    keys, pair_states = self._pair_table
                    key = place[i] * len(self.words) + place[i + 1]
                    slot = self._slot(key)
                    hit = keys[slot] == key
                    longer[i[hit]] = pair_states[slot[hit]]
                    i = i[~hit]
                longer[i] = self.extended(states[i], place[i + n - 1])
                states = longer
            direct = np.flatnonzero(whole & ~known)
            own = states.copy()
            joined, crc = words.joined, zlib.crc32
            own[direct] = np.fromiter(
                (crc(joined[a:b]) for a, b in zip(words.at[direct].tolist(), ends[direct + n - 1].tolist())),
                dtype=np.uint32, count=len(direct),
            )
            yield np.where(whole, own % np.uint32(BUCKETS), np.uint32(BUCKETS)).astype(np.int64)


def learn_head(docs: DataFrame, words: int = HEAD_WORDS, pairs: int = HEAD_PAIRS) -> Head:
    """The most frequent words and pairs in a sample of about SAMPLE_ROWS of `docs`; any head gives the same buckets."""
    share = min(1.0, SAMPLE_ROWS / max(docs.count(), 1))
    drawn = docs.select("text").sample(share, seed=SEED) if share < 1 else docs.select("text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            found = Words(batch.column("text"), LETTERS)
            n = len(found.distinct)
            short = pc.less_equal(pc.binary_length(found.distinct), HEAD_BYTES).to_numpy(zero_copy_only=False)
            single = np.flatnonzero(short)
            two = np.flatnonzero(found.runs(2))
            two = two[short[found.codes[two]] & short[found.codes[two + 1]]]
            key, times = np.unique(found.codes[two].astype(np.int64) * max(n, 1) + found.codes[two + 1], return_counts=True)
            count = np.bincount(found.codes, minlength=n)[single]
            first = found.distinct.take(pa.array(np.r_[single, key // max(n, 1)]))
            second = found.distinct.take(pa.array(np.r_[np.zeros(len(single), np.int64), key % max(n, 1)],
                                                  mask=np.arange(len(single) + len(key)) < len(single)))
            yield pa.RecordBatch.from_arrays(
                [first.cast(pa.binary()), second.cast(pa.binary()), pa.array(np.r_[count, times].astype(np.int64))],
                names=["first", "second", "n"],
            )

    rows = map_texts(drawn, counted, "first binary, second binary, n long")
    rows = rows.groupBy("first", "second").agg(F.sum("n").alias("n"))
    rows = stored(rows, "head-counts")
    frequent = [bytes(r["first"]) for r in most_frequent(rows.where("second IS NULL"), "n", ["first"], words)]
    place = {w: i for i, w in enumerate(frequent)}
    couples = most_frequent(rows.where("second IS NOT NULL"), "n", ["first", "second"], pairs)
    known = [(place.get(bytes(r["first"])), place.get(bytes(r["second"]))) for r in couples]
    return Head(tuple(frequent), tuple((a, b) for a, b in known if a is not None and b is not None))


def bucket_totals(texts: DataFrame, head: Head) -> np.ndarray:
    """Features of all texts by bucket; a task sends at most BUCKETS numbers."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS + 1, dtype=np.int64)
        for batch in pieces(batches, "text", 4 << 20):
            for buckets in head.buckets(Words(batch.column("text"), LETTERS)):
                total += np.bincount(buckets, minlength=BUCKETS + 1)
        at = np.flatnonzero(total[:BUCKETS])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    sums = map_texts(texts.select("text"), counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, dtype=np.int64)
    for r in sums.collect():  # at most BUCKETS rows
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed bucket shares, rounded down."""
    ratio = (target + 1.0) * (source.sum() + float(BUCKETS)) / ((source + 1.0) * (target.sum() + float(BUCKETS)))
    return np.floor(1000.0 * np.log(ratio)).astype(np.int64)


def document_weights(docs: DataFrame, head: Head, gains: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight of each row of `docs`."""

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worth = np.r_[gains, 0]
        for batch in pieces(batches, "text", 4 << 20):
            words = Words(batch.column("text"), LETTERS)
            own = np.zeros(len(words.text), dtype=np.int64)
            for buckets in head.buckets(words):
                own += worth[buckets]
            weight = np.diff(np.r_[0, np.cumsum(own)][words.edges])
            n = np.diff(words.edges).astype(np.int64)
            features = sum(np.maximum(0, n - back) for back in range(LONGEST))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n), pa.array(features), pa.array(weight)],
                names=["doc_id", "n_words", "n_features", "weight"],
            )

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_texts(slim, weighed, "doc_id long, n_words long, n_features long, weight long")


def gumbel_noise(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of a Gumbel variate from the id's hash, rounded down."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = DRAWN_PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_features, weight, score, rank: every row of `docs`; rank null where it is not drawn."""
    head = learn_head(docs)
    gains = bucket_gains(bucket_totals(docs, head), bucket_totals(target, head))
    scored = document_weights(docs, head, gains).withColumn("score", F.col("weight") + gumbel_noise(F.col("doc_id")))
    # stored in rank order, documents that cannot be drawn last: a position is a rank
    late = (F.col("n_words") < least_words).cast("int")
    order = scored.withColumns({"late": late, "falling": -F.col("score")})
    ranked = index_by(order, "late", ("falling", "doc_id", "n_features"))
    able = ranked.frame.where("late = 0").count()
    rank = F.when(F.col("step") < percent * able // 100, F.col("step") + 1)
    return ranked.frame.select("doc_id", "n_features", "weight", "score", rank.cast("long").alias("rank"))


#: DuckDB. CRC-32 from its polynomial, over the bytes of each distinct feature.
SQL = rf"""
WITH crc_table AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) ORDER BY n) AS step
  FROM range(256) AS r(n)),
w AS (
  SELECT 'd' AS side, row_number() OVER () AS rid, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words, doc_id
  FROM documents
  UNION ALL
  SELECT 'b', row_number() OVER (), regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), NULL
  FROM benchmark),
p AS (SELECT side, rid, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM w),
r AS (SELECT side, rid, word, lead(word, 1) OVER o AS two, lead(word, 2) OVER o AS three
      FROM p WINDOW o AS (PARTITION BY side, rid ORDER BY pos)),
f AS (SELECT side, rid, word AS feature FROM r
      UNION ALL SELECT side, rid, word || ' ' || two FROM r WHERE two IS NOT NULL
      UNION ALL SELECT side, rid, word || ' ' || two || ' ' || three FROM r WHERE three IS NOT NULL),
g AS (SELECT side, rid, feature, count(*) AS n FROM f GROUP BY ALL),
u AS (SELECT feature, xor(list_reduce(
          list_transform(range(octet_length(encode(feature))), lambda i: ('0x' || substr(hex(feature), 2 * i + 1, 2))::BIGINT),
          lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % {BUCKETS} AS bucket
      FROM (SELECT DISTINCT feature FROM g), crc_table),
h AS (SELECT side, rid, bucket, sum(n) AS n FROM g JOIN u USING (feature) GROUP BY ALL),
s AS (SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 'b'), 0) AS t FROM h GROUP BY bucket),
a AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM s),
gain AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (s_all + {BUCKETS})::DOUBLE / ((s + 1)::DOUBLE * (t_all + {BUCKETS})::DOUBLE)))::BIGINT AS gain
         FROM s, a),
weight AS (SELECT rid, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight
           FROM h JOIN gain USING (bucket) WHERE side = 'd' GROUP BY rid),
scored AS (SELECT doc_id, len(words) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
                  coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((
                    ('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
           FROM w LEFT JOIN weight USING (rid) WHERE side = 'd'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_words >= {LEAST_WORDS} ORDER BY score DESC, doc_id NULLS FIRST, n_features) AS place,
                  count(*) FILTER (n_words >= {LEAST_WORDS}) OVER () AS able FROM scored)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_words >= {LEAST_WORDS} AND place <= {DRAWN_PERCENT} * able // 100 THEN place END AS rank
FROM ranked
"""


def op11(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return resample(docs, benchmark)
