"""Hard negatives for anchors: rows of another label whose score lies in a window below a positive's score.

Vectors become integers (components floor(SCALE * x)), so scores are exact. Positives of an anchor are its best rows
of the same label; for each positive the best rows of another label with LOW * p <= 100 * s <= HIGH * p are its negatives.

Scores are bounded over a spanning tree of the anchors. For a candidate x, an anchor c and its parent p in the tree,
<c, x> = <p, x> + <c - p, x> lies within |c - p| |x| of <p, x>. A task holds a block of candidates and walks down the
tree of each group of anchors: the interval of a child is its parent's, widened by edge times norm, and only
candidates whose interval overlaps what the anchor still looks for are scored again (a matrix product where
they are many), which makes their interval a point for the anchor's children. What an anchor looks for are scores above
its worst kept positive, or inside a positive's window and above the worst negative kept for it, so the
intervals wanted shrink while the block is read.

Every row is a candidate in one block. Anchors are a stated share of the rows; they are put into groups of at most
GROUP_ROWS near ones (around pivots, split by hash), their trees are built once, and each group is sent to every
block. A task sends at most the wanted number of rows per anchor and block; they are ranked by anchor. Pivots
are at most PIVOTS anchors, the only rows on the driver.

Defined results: rows with a null id, label or vector, or with a null or non-finite component take no part, nor do
rows with a scaled norm of 2^26 or more, whose scores need not be exact in doubles; shorter vectors count as followed by
zeros; rows that are equal in id, label and vector count once, rows that share only the id are rows of
their own, but not each other's positives or negatives; ties go to the smaller id, then to the smaller hash of the vector. An anchor
without a positive has no rows; an empty table gives none. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thermobox.llm.common import stored

SCALE, ANCHOR_EVERY, MOVED_EVERY, LABELS = 256, 50, 7, 10
POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95
GROUP_ROWS, PIVOTS = 256, 512
#: Components of a block of candidates, and of the part of it that is bounded at a time.
BLOCK_VALUES, PART_VALUES = 1 << 22, 1 << 20
#: Above this share of a part's rows a whole matrix product is cheaper than picked rows.
DENSE = 0.15
MOST_NORM = float(1 << 26)


def integer_rows(table: DataFrame, id_column: str, vector_column: str, label_column: str) -> DataFrame:
    """id, label, vector (array of double, whole numbers), norm, tie: the rows that take part."""
    scaled = F.transform(F.col(vector_column), lambda x: F.floor(x.cast("double") * SCALE).cast("double"))
    finite = ~F.exists(vector_column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= MOST_NORM))
    rows = table.select(
        F.col(id_column).cast("long").alias("id"), F.col(label_column).cast("long").alias("label"),
        F.when(finite, scaled).alias("vector"),
    ).where("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    rows = rows.withColumn("norm", norm).where(F.col("norm") < MOST_NORM).dropDuplicates(["id", "label", "vector"])
    return rows.withColumn("tie", F.xxhash64("vector"))


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    """Rows of `dimension` components, shorter vectors filled with zeros."""
    offsets = column.offsets.to_numpy()
    lengths = np.diff(offsets)
    out = np.zeros((len(column), dimension))
    out[np.arange(dimension) < lengths[:, None]] = column.values.slice(offsets[0], offsets[-1] - offsets[0]).to_numpy()
    return out


def spanning_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimum spanning tree from row 0: parent (-1 for the root), edge length and depth of each row."""
    n = len(vectors)
    parent, edge, depth = np.full(n, -1), np.zeros(n), np.zeros(n, dtype=np.int64)
    nearest, left = np.full(n, np.inf), np.ones(n, dtype=bool)
    near = np.full(n, -1)
    at = 0
    for _ in range(n):
        left[at] = False
        parent[at] = near[at]
        if near[at] >= 0:
            edge[at], depth[at] = nearest[at], depth[near[at]] + 1
        apart = np.sqrt(((vectors - vectors[at]) ** 2).sum(axis=1))
        closer = left & (apart < nearest)
        nearest[closer], near[closer] = apart[closer], at
        at = int(np.argmin(np.where(left, nearest, np.inf)))
    return parent, edge, depth


TREE = "group long, place int, parent int, edge double, depth int, anchor long, id long, label long, vector array<double>, norm double"


def anchor_trees(anchors: DataFrame, dimension: int, group_rows: int = GROUP_ROWS) -> DataFrame:
    """`anchors` (anchor, id, label, vector, norm) in groups of about `group_rows` near ones, each with its place in a tree."""
    n = anchors.count()
    pivots = [r["vector"] for r in anchors.orderBy(F.xxhash64("id")).select("vector").limit(min(PIVOTS, 1 + n // group_rows)).collect()]

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = np.zeros((len(pivots), dimension))
        for row, pivot in zip(centres, pivots):
            row[:len(pivot)] = pivot
        for batch in batches:
            own = _matrix(batch.column("vector"), dimension)
            apart = (centres**2).sum(axis=1) - 2 * own @ centres.T
            yield batch.append_column("pivot", pa.array(apart.argmin(axis=1) if len(centres) else np.zeros(len(own), int), pa.int64()))

    schema = "anchor long, id long, label long, vector array<double>, norm double, pivot long"
    near = stored(anchors.select("anchor", "id", "label", "vector", "norm").mapInArrow(dealt, schema), "anchors")
    parts = near.groupBy("pivot").agg((1 + F.floor(F.count("*") / group_rows)).alias("parts"))  # at most PIVOTS rows
    grouped = near.join(F.broadcast(parts), "pivot").withColumn(
        "group", F.col("pivot") + PIVOTS * F.pmod(F.xxhash64("anchor"), F.col("parts")))

    def planted(group: pa.Table) -> pa.Table:
        order = group.sort_by([("anchor", "ascending")]).combine_chunks()
        parent, edge, depth = spanning_tree(_matrix(order.column("vector").combine_chunks(), dimension))
        return pa.table({
            "group": order.column("group"), "place": pa.array(np.arange(len(order)), pa.int32()),
            "parent": pa.array(parent, pa.int32()), "edge": pa.array(edge), "depth": pa.array(depth, pa.int32()),
            **{name: order.column(name) for name in ("anchor", "id", "label", "vector", "norm")},
        })

    return stored(grouped.drop("pivot", "parts").groupBy("group").applyInArrow(planted, TREE), "trees")


class Best:
    """For each of some wants (an anchor, or an anchor and a positive): the best `k` rows so far."""

    def __init__(self, wants: int, k: int):
        self.k = k
        self.score = np.full((wants, k), -np.inf)
        self.row = np.full((wants, k), -1)

    @property
    def floor(self) -> np.ndarray:
        return self.score[:, -1]

    def add(self, want: int, scores: np.ndarray, rows: np.ndarray) -> None:
        """Row numbers are in the order of ties."""
        score, row = np.r_[self.score[want], scores], np.r_[self.row[want], rows]
        order = np.lexsort((row, -score))[:self.k]
        self.score[want], self.row[want] = score[order], row[order]


class Block:
    """Candidates of one block, in the order of ties."""

    def __init__(self, ids, labels, norms, ties, vectors):
        order = np.lexsort((ties, ids))
        self.ids, self.labels, self.norms, self.ties, self.vectors = (x[order] for x in (ids, labels, norms, ties, vectors))

    def search(self, tree: dict, wants: list[list[tuple[float, float]]], k: int, same_label: bool) -> tuple[Best, np.ndarray]:
        """The best `k` rows for each window (low, high) of each anchor of a tree, and the first want of each anchor."""
        first = np.r_[0, np.cumsum([len(w) for w in wants])]
        best = Best(int(first[-1]), k)
        dimension = max(1, self.vectors.shape[1])
        step = max(1, PART_VALUES // max(dimension, len(wants)))
        for start in range(0, len(self.ids), step):
            self._part(np.arange(start, min(start + step, len(self.ids))), tree, wants, first, best, same_label)
        return best, first

    def _part(self, rows, tree, wants, first, best, same_label) -> None:
        vectors, norms, labels, ids = self.vectors[rows], self.norms[rows], self.labels[rows], self.ids[rows]
        n = len(wants)
        low, high = np.empty((n, len(rows))), np.empty((n, len(rows)))
        for level in tree["levels"]:
            if tree["parent"][level[0]] < 0:
                low[level], high[level] = -np.inf, np.inf  # nothing is known of a root's scores
            else:
                reach = tree["edge"][level][:, None] * norms * (1 + 1e-9) + 1e-3
                low[level] = low[tree["parent"][level]] - reach
                high[level] = high[tree["parent"][level]] + reach
            fits = (labels == tree["label"][level][:, None]) == same_label
            fits &= ids != tree["id"][level][:, None]
            overlap = np.zeros_like(fits)
            for i, anchor in enumerate(level):
                for j, (bottom, top) in enumerate(wants[anchor]):
                    overlap[i] |= (high[anchor] >= max(bottom, best.floor[first[anchor] + j])) & (low[anchor] <= top)
            if tree["parent"][level[0]] >= 0:
                overlap &= fits  # a root is scored against all, for the sake of its children
            if not overlap.any():
                continue
            a, x = tree["vectors"][level], vectors
            if overlap.mean() > DENSE:
                scores = a @ x.T
                low[level] = high[level] = scores
            else:
                scores = np.zeros(overlap.shape)
                i, r = np.nonzero(overlap)
                for s in range(0, len(i), 65536):
                    part = slice(s, s + 65536)
                    scores[i[part], r[part]] = (a[i[part]] * x[r[part]]).sum(axis=1)
                low[level[i], r] = high[level[i], r] = scores[i, r]
            overlap &= fits
            for i, anchor in enumerate(level):
                for j, (bottom, top) in enumerate(wants[anchor]):
                    want = first[anchor] + j
                    inside = overlap[i] & (scores[i] >= max(bottom, best.floor[want])) & (scores[i] <= top)
                    found = np.flatnonzero(inside)
                    if len(found) > 4 * best.k:
                        at = np.argpartition(-scores[i][found], best.k - 1)[best.k - 1]
                        found = found[scores[i][found] >= scores[i][found[at]]]
                    if len(found):
                        best.add(want, scores[i][found], rows[found])


def _tree(part: pa.RecordBatch | pa.Table, dimension: int) -> dict:
    depth = part.column("depth").to_numpy()
    return {
        "parent": part.column("parent").to_numpy(), "edge": part.column("edge").to_numpy(),
        "levels": [np.flatnonzero(depth == d) for d in range(int(depth.max()) + 1)],
        "anchor": part.column("anchor").to_numpy(), "id": part.column("id").to_numpy(),
        "label": part.column("label").to_numpy(),
        "vectors": _matrix(part.column("vector").combine_chunks(), dimension),
    }


def search(candidates: DataFrame, trees: DataFrame, dimension: int, k: int, same_label: bool) -> DataFrame:
    """anchor, want, id, tie, score: per block, the best `k` rows for each window of each anchor.

    `trees` as from `anchor_trees`, with `windows` (array of struct low, high); `want` counts an anchor's windows from 0.
    """
    spark = candidates.sparkSession
    n = candidates.count()
    rows = max(1, BLOCK_VALUES // max(1, dimension))
    blocks = max(1 + n // rows, min(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + n // 2048))
    own = candidates.select(
        F.pmod(F.xxhash64("id", "vector"), F.lit(blocks)).alias("block"), F.lit(0).alias("side"), "id", "label", "vector", "norm", "tie")
    sent = trees.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.lit(1).alias("side"), "*")
    dealt = own.unionByName(sent, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", "side", "group", "place")

    def answered(block: Block, group: pa.Table) -> pa.RecordBatch:
        tree = _tree(group, dimension)
        wants = [[(w["low"], w["high"]) for w in some] for some in group.column("windows").to_pylist()]
        best, first = block.search(tree, wants, k, same_label)
        want, place = np.nonzero(best.row >= 0)
        owner = np.searchsorted(first, want, "right") - 1
        row = best.row[want, place]
        return pa.RecordBatch.from_arrays(
            [pa.array(tree["anchor"][owner]), pa.array((want - first[owner]).astype(np.int32)), pa.array(block.ids[row]),
             pa.array(block.ties[row]), pa.array(best.score[want, place].astype(np.int64))],
            names=["anchor", "want", "id", "tie", "score"],
        )

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block, kept, group, held = None, None, [], None, []

        def finished():
            if held and block is not None:
                yield answered(block, pa.concat_tables(held))

        for batch in batches:
            numbers, sides = batch.column("block").to_numpy(), batch.column("side").to_numpy()
            groups = np.where(sides == 1, batch.column("group").fill_null(0).to_numpy(zero_copy_only=False), -1)
            change = np.flatnonzero((np.diff(numbers) != 0) | (np.diff(groups) != 0) | (np.diff(sides) != 0)) + 1
            for a, b in zip(np.r_[0, change], np.r_[change, batch.num_rows]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if (numbers[a], groups[a]) != (key, group):
                    yield from finished()
                    held = []
                    if numbers[a] != key:
                        block, kept = None, []
                    key, group = numbers[a], groups[a]
                if sides[a] == 0:
                    kept.append([part.column(c).to_numpy() for c in ("id", "label", "norm", "tie")] + [_matrix(part.column("vector"), dimension)])
                    continue
                if block is None and kept:
                    block, kept = Block(*(np.concatenate(c) for c in zip(*kept))), []
                held.append(pa.Table.from_batches([part]))
        yield from finished()

    return dealt.mapInArrow(found, "anchor long, want int, id long, tie long, score long")


def _ranked(found: DataFrame, k: int, *by: str | Column) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id", "tie")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES,
         low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `rows` (id, label, vector, norm, tie) as from `integer_rows`; `anchors` some of them. A negative's score s and its
    positive's p satisfy low * p <= 100 * s <= high * p.
    """
    dimension = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    numbered = stored(anchors.withColumn("anchor", F.monotonically_increasing_id()), "anchor-rows")
    trees = anchor_trees(numbered, dimension)
    everything = F.array(F.struct(F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high")))
    best = _ranked(search(rows, trees.withColumn("windows", everything), dimension, positives, True), positives, "anchor")
    best = stored(best.select("anchor", "rank", "id", "score"), "positives")
    # at most `positives` of each anchor
    own = best.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("positive"))

    def share(score: Column, percent: int) -> Column:
        return score.cast("decimal(20,0)") * F.lit(percent) / F.lit(100)

    windows = F.transform("positive", lambda p: F.struct(
        F.ceil(share(p["score"], low)).cast("double").alias("low"), F.floor(share(p["score"], high)).cast("double").alias("high")))
    wanting = stored(trees.join(own, "anchor").withColumn("windows", windows), "windows")
    near = search(rows, wanting.drop("positive"), dimension, negatives, False)
    ranked = _ranked(near, negatives, "anchor", "want").select("anchor", "want", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = wanting.select("anchor", F.col("id").alias("anchor_id"), F.posexplode("positive").alias("want", "p"))
    return ranked.join(named, ["anchor", "want"]).select(
        "anchor_id", F.col("p.id").alias("positive_id"), "rank", "negative_id",
        F.col("p.score").alias("positive_score"), "negative_score",
    )


def op12(embeddings: DataFrame) -> DataFrame:
    rows = integer_rows(embeddings, "vec_id", "embedding", "label")
    moved = F.when(F.pmod("id", F.lit(MOVED_EVERY)) == 0, F.pmod(F.col("label") + 1, F.lit(LABELS))).otherwise(F.col("label"))
    rows = stored(rows.withColumn("label", moved), "vectors")
    return mine(rows, rows.where(F.pmod("id", F.lit(ANCHOR_EVERY)) == 0))


#: DuckDB, by brute force.
SQL = f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % {MOVED_EVERY} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label,
                  list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS e
           FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id AS other, a.label = c.label AS same, list_dot_product(a.e, c.e)::BIGINT AS score
      FROM v AS a JOIN v AS c ON a.vec_id <> c.vec_id WHERE a.vec_id % {ANCHOR_EVERY} = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= {POSITIVES})
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank,
       other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score
QUALIFY rank <= {NEGATIVES}
"""
