"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of TABLES tables hashes a vector to floor((a.v + b) / width) over HASHES Gaussian projections.
A query visits, per table, its own bucket and then buckets whose hash values are perturbed by +-1, in the
order of their estimated success (the expected sum of squared distances to the crossed borders). The
largest inner product becomes the smallest distance by one more component: candidates get
sqrt(m^2 - |v|^2), queries are scaled to the largest norm m and get 0.

Buckets are dealt into units of about UNIT_ROWS rows (by the leading hash values, so that perturbed buckets
stay close); a unit with more rows is cut into blocks. A task holds one block and streams the queries
that probe it, so what is shuffled is the index once per table, a row per query and unit, and at
most k rows per query and block; candidate pairs are never rows. The exact double-precision score
decides, first in the block and then over all blocks and tables.

`fit` takes the number of probes from a sample of at most SAMPLE_ROWS vectors: the first of a doubling
series whose recall among the sample reaches TARGET_RECALL. Neighbours in the whole table are closer than
in the sample, so recall there is higher. The width is at least REACH distances from a query to its neighbours, with
the one more component, which is large where norms differ. Where MOST_PROBES do not reach TARGET_RECALL, all queries run
against every bucket of one table, which is exact; so do queries that find fewer than k although more rows exist.

Defined results: vectors that are null, zero, hold null or non-finite components, or have another length
than most vectors take no part, nor do rows with a null id; rows that repeat an id count once, with the
smallest vector; ties go to the smaller id; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thermobox.llm.common import stored

TABLES, HASHES, WIDTH, REACH = 8, 8, 2.0, 1.7
SAMPLE_ROWS, SAMPLE_QUERIES, TARGET_RECALL, MOST_PROBES = 4000, 200, 0.96, 1280
UNIT_ROWS = 1 << 16
KEPT_PAIRS = 2_000_000  # scored pairs a task keeps before it cuts them to the best k per query


@dataclass(frozen=True)
class Hashing:
    """Projections of all tables; a bucket is a 64-bit sum of hash values times odd numbers."""

    dimension: int
    largest: float  # norm
    width: float
    probes: int
    units: int
    every: bool = False  # probes do not reach the recall: look into every bucket
    seed: int = 20240229

    def _parameters(self):
        rng = np.random.default_rng(self.seed)
        directions = rng.normal(size=(TABLES, self.dimension + 1, HASHES))
        shifts = rng.uniform(0, self.width, size=(TABLES, HASHES))
        factors = rng.integers(1, 1 << 62, size=(TABLES, HASHES), dtype=np.int64) | 1
        return directions, shifts, factors

    def _leading(self) -> int:
        return min(HASHES, 1 + int(np.ceil(np.log2(max(self.units, 1)))))

    def _hashed(self, vectors: np.ndarray, query: bool):
        norms = np.linalg.norm(vectors, axis=1)
        if query:
            whole = np.column_stack([vectors * (self.largest / norms)[:, None], np.zeros(len(vectors))])
        else:
            whole = np.column_stack([vectors, np.sqrt(np.maximum(0.0, self.largest**2 - norms**2))])
        directions, shifts, factors = self._parameters()
        for table in range(TABLES):
            at = (whole @ directions[table] + shifts[table]) / self.width
            yield table, at, np.floor(at), factors[table]

    def _unit(self, table: int, leading: np.ndarray) -> np.ndarray:
        mixed = (leading.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        return (mixed % np.uint64(self.units)).astype(np.int64) * TABLES + table

    def index(self, vectors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per table the bucket and the unit of each vector."""
        n = self._leading()
        for table, _, hashes, factors in self._hashed(vectors, query=False):
            h = hashes.astype(np.int64)
            yield h @ factors, self._unit(table, h[:, :n] @ factors[:n])

    def probe(self, vectors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per table the buckets to visit, best first, and their units (queries x probes)."""
        steps = probing_sequence(HASHES, self.probes)
        n = self._leading()
        for table, at, hashes, factors in self._hashed(vectors, query=True):
            h = hashes.astype(np.int64)
            down = at - hashes
            order = np.argsort(np.column_stack([down, 1 - down]), axis=1, kind="stable")
            change = np.concatenate([-factors, factors])
            lead = np.concatenate([-factors[:n], np.zeros(HASHES - n, np.int64), factors[:n], np.zeros(HASHES - n, np.int64)])
            buckets = (h @ factors)[:, None] + change[order] @ steps.T
            leading = (h[:, :n] @ factors[:n])[:, None] + lead[order] @ steps.T
            yield buckets, self._unit(table, leading)


def probing_sequence(hashes: int, number: int) -> np.ndarray:
    """0/1 rows over the 2 x `hashes` borders ranked by distance: the first `number` valid perturbation sets.

    Expected squared distance of the border of rank j, for uniform places in the bucket: Lv et al.,
    "Multi-Probe LSH", VLDB 2007. A set may not cross both borders of one hash, which are ranks j and 2m+1-j.
    """
    m = hashes
    j = np.arange(1, 2 * m + 1)
    near = j * (j + 1) / (4 * (m + 1) * (m + 2))
    k = 2 * m + 1 - j
    score = np.where(j <= m, near, 1 - k / (m + 1) + k * (k + 1) / (4 * (m + 1) * (m + 2)))
    rows, heap = [np.zeros(2 * m, dtype=np.int64)], [(score[0], (0,))]
    while heap and len(rows) < number:
        total, chosen = heapq.heappop(heap)
        if not any(2 * m - 1 - i in chosen for i in chosen):
            row = np.zeros(2 * m, dtype=np.int64)
            row[list(chosen)] = 1
            rows.append(row)
        last = chosen[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (total - score[last] + score[last + 1], chosen[:-1] + (last + 1,)))
            heapq.heappush(heap, (total + score[last + 1], chosen + (last + 1,)))
    return np.array(rows)


def clean_vectors(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """id, vector: the rows that take part, one per id."""
    usable = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("vector")).where(
        F.col("id").isNotNull() & F.col("vector").isNotNull()
        & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists("vector", lambda x: x != 0)
    )
    lengths = usable.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    kept = usable.where(F.size("vector") == (lengths["n"] if lengths else 0))
    return kept.groupBy("id").agg(F.min("vector").alias("vector"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def fit(vectors: DataFrame) -> Hashing:
    """Hashing for `vectors` (id, vector), with the number of probes from a bounded sample."""
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    total = vectors.agg(F.count("*").alias("n"), F.max(norm).alias("largest"), F.max(F.size("vector")).alias("dimension")).first()
    share = min(1.0, SAMPLE_ROWS / max(total["n"], 1))
    chosen = vectors.where(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < share * 1_000_003).limit(SAMPLE_ROWS)
    sample = np.array([r["vector"] for r in chosen.select("vector").collect()], dtype=np.float64)
    units = 1 + total["n"] // UNIT_ROWS
    largest, dimension = total["largest"] or 1.0, total["dimension"] or 0
    if len(sample) < 2:
        return Hashing(dimension, largest, WIDTH * largest, 1, units)
    queries = sample[:SAMPLE_QUERIES]
    scores = queries @ sample.T
    scores[np.arange(len(queries)), np.arange(len(queries))] = -np.inf
    k = min(20, len(sample) - 1)
    nearest = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    # |a - q|^2 with the one more component, for queries scaled to the largest norm
    cosines = np.take_along_axis(scores, nearest, axis=1) / (np.linalg.norm(queries, axis=1)[:, None] * largest)
    apart = largest * float(np.sqrt(np.mean(np.maximum(0.0, 2 - 2 * cosines))))
    spread = float(np.sqrt(np.mean(np.sum((sample - sample.mean(axis=0)) ** 2, axis=1))))
    width = max(WIDTH * spread, REACH * apart) or WIDTH * largest
    probes = 20
    while True:
        hashing = Hashing(dimension, largest, width, probes, units)
        found = np.zeros(nearest.shape, dtype=bool)
        for (own, _), (visited, _) in zip(hashing.index(sample), hashing.probe(queries)):
            for i, near in enumerate(nearest):
                found[i] |= np.isin(own[near], visited[i])
        if found.mean() >= TARGET_RECALL:
            return hashing
        if probes >= MOST_PROBES:
            return replace(hashing, every=True)
        probes = probes * 5 // 4


def _best(queries: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best rows of each query: largest score, then smallest id."""
    order = np.lexsort((ids, -scores, queries))
    q = queries[order]
    starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, int)
    rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
    return order[rank < k]


class Block:
    """The index rows of one block, sorted by bucket."""

    def __init__(self, ids: np.ndarray, buckets: np.ndarray, vectors: np.ndarray):
        order = np.argsort(buckets, kind="stable")
        self.ids, self.vectors, buckets = ids[order], vectors[order], buckets[order]
        self.starts = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]])
        self.stops = np.r_[self.starts[1:], len(buckets)]
        self.buckets = buckets[self.starts]

    def search(self, query_ids: np.ndarray, queries: np.ndarray, probes: list, k: int):
        """(query place, row place, exact score): for each query its k best rows in the buckets it probes."""
        asked, wanted = [], []
        for i, buckets in enumerate(probes):
            hit = np.arange(len(self.buckets)) if buckets is None else np.flatnonzero(np.isin(self.buckets, buckets))
            asked.append(np.full(len(hit), i))
            wanted.append(hit)
        asked, wanted = np.concatenate(asked), np.concatenate(wanted)
        order = np.argsort(wanted, kind="stable")
        asked, wanted = asked[order], wanted[order]
        edges = np.searchsorted(wanted, np.arange(len(self.buckets) + 1))
        floor = np.full(len(queries), -np.inf)
        kept, held = [], 0
        for b in range(len(self.buckets)):
            who = asked[edges[b]:edges[b + 1]]
            if not len(who):
                continue
            for start in range(self.starts[b], self.stops[b], 4096):
                rows = np.arange(start, min(start + 4096, self.stops[b]))
                scores = queries[who] @ self.vectors[rows].T
                scores[query_ids[who][:, None] == self.ids[rows]] = -np.inf
                if len(rows) >= k:
                    kth = np.partition(scores, len(rows) - k, axis=1)[:, len(rows) - k]
                    floor[who] = np.maximum(floor[who], kth)
                # a little below the floor, as a product's last bits depend on where a row stands
                slack = 1e-9 * (1 + np.abs(floor[who]))
                q, r = np.nonzero((scores >= np.where(np.isfinite(floor[who]), floor[who] - slack, -np.inf)[:, None]) & (scores > -np.inf))
                kept.append((who[q], rows[r]))
                held += len(q)
            if held > KEPT_PAIRS:
                kept = [self._cut(query_ids, queries, kept, k)[:2]]
                held = len(kept[0][0])
        if not kept:
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        return self._cut(query_ids, queries, kept, k)

    def _cut(self, query_ids, queries, kept, k):
        q = np.concatenate([x[0] for x in kept])
        r = np.concatenate([x[1] for x in kept])
        scores = np.empty(len(q))
        for s in range(0, len(q), 100_000):
            scores[s:s + 100_000] = (queries[q[s:s + 100_000]] * self.vectors[r[s:s + 100_000]]).sum(axis=1)
        best = _best(q, self.ids[r], scores, k)
        return q[best], r[best], scores[best]


FOUND = "query_id long, vec_id long, score double"


def build_index(vectors: DataFrame, hashing: Hashing) -> tuple[DataFrame, DataFrame]:
    """(unit, block, bucket, id, vector), each vector once per table, or in the first table only; (unit, blocks)."""
    kind = dict(vectors.dtypes)["vector"]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for bucket, unit in islice(hashing.index(_matrix(batch.column("vector"))), 1 if hashing.every else TABLES):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(unit), pa.array(bucket), batch.column("id"), batch.column("vector")],
                        names=["unit", "bucket", "id", "vector"],
                    )

    index = stored(vectors.select("id", "vector").mapInArrow(hashed, f"unit long, bucket long, id long, vector {kind}"), "index")
    blocks = index.groupBy("unit").agg((1 + F.floor(F.count("*") / UNIT_ROWS)).alias("blocks"))
    return index.join(blocks, "unit").select(
        "unit", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"), "bucket", "id", "vector"
    ), blocks


def search(vectors: DataFrame, queries: DataFrame, k: int, hashing: Hashing) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each query. Both sides hold id, vector."""
    kind = dict(vectors.dtypes)["vector"]
    index, blocks = build_index(vectors, hashing)

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for visited, units in hashing.probe(_matrix(batch.column("vector"))):
                rows, at, lists = [], [], []
                for i in range(batch.num_rows):
                    for unit in np.unique(units[i]):
                        rows.append(i), at.append(unit), lists.append(np.unique(visited[i][units[i] == unit]))
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at, pa.int64()), pa.array(lists, pa.list_(pa.int64())),
                     batch.column("id").take(take), batch.column("vector").take(take)],
                    names=["unit", "probes", "id", "vector"],
                )

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block, parts = None, None, []
        for batch in batches:
            units, numbers = batch.column("unit").to_numpy(), batch.column("block").to_numpy()
            sides = batch.column("side").to_numpy()
            change = np.flatnonzero((np.diff(units) != 0) | (np.diff(numbers) != 0) | (np.diff(sides) != 0)) + 1
            for a, b in zip(np.r_[0, change], np.r_[change, batch.num_rows]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if (units[a], numbers[a]) != key:
                    key, block, parts = (units[a], numbers[a]), None, []
                ids, vectors_ = part.column("id").to_numpy(), _matrix(part.column("vector"))
                if sides[a] == 0:
                    parts.append((ids, part.column("bucket").to_numpy(), vectors_))
                elif parts or block is not None:
                    if block is None:
                        block = Block(*(np.concatenate([p[i] for p in parts]) for i in range(3)))
                        parts = []
                    probes = [None if p is None else np.array(p) for p in part.column("probes").to_pylist()]
                    q, r, score = block.search(ids, vectors_, probes, k)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[q]), pa.array(block.ids[r]), pa.array(score)], names=["query_id", "vec_id", "score"]
                    )

    def found(requests: DataFrame) -> DataFrame:
        asked = requests.join(blocks, "unit").select(
            "unit", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "probes", "id", "vector"
        )
        rows = index.select("unit", "block", F.lit(0).alias("side"), "bucket", F.lit(None).cast("array<long>").alias("probes"), "id", "vector")
        rows = rows.unionByName(asked.select("unit", "block", F.lit(1).alias("side"), F.lit(0).cast("long").alias("bucket"), "probes", "id", "vector"))
        dealt = rows.repartition("unit", "block").sortWithinPartitions("unit", "block", "side")
        return dealt.mapInArrow(scored, FOUND)

    def everywhere(some: DataFrame) -> DataFrame:
        each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(hashing.units - 1).cast("long")))
        again = some.select("id", "vector", each.alias("unit")).withColumn("unit", F.col("unit") * TABLES)  # first table
        return found(again.select("unit", F.lit(None).cast("array<long>").alias("probes"), "id", "vector"))

    if hashing.every:
        first = everywhere(queries)
    else:
        requests = queries.select("id", "vector").mapInArrow(probed, f"unit long, probes array<long>, id long, vector {kind}")
        first = stored(found(requests), "neighbours")
        most = F.lit(max(0, min(k, vectors.count() - 1)))
        enough = first.groupBy("query_id").agg(F.countDistinct("vec_id").alias("n")).where(F.col("n") >= most)
        short = queries.join(enough, queries["id"] == enough["query_id"], "left_anti")
        if not short.isEmpty():
            first = first.unionByName(everywhere(short))
    ranked = first.dropDuplicates(["query_id", "vec_id"]).withColumn(
        "rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    )
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4(embeddings: DataFrame) -> DataFrame:
    vectors = stored(clean_vectors(embeddings, "vec_id", "embedding"), "vectors")
    queries = vectors.where(F.col("id") % 20 == 0)
    return search(vectors, queries, 20, fit(vectors))
