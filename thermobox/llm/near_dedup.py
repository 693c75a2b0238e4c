"""Near-duplicate components by MinHash banding, verified through odd sketches.

One pass over the texts gives each document its set of word shingles as 64-bit hashes, and of that set a
fingerprint, MinHash samples as BANDS band keys, and an odd sketch: of each of SAMPLE_BINS bins that divide
the hashes the smallest one is a sample (one permutation hashing), and every sample flips one of SKETCH_BITS
bits. So the ones in the XOR of two sketches count the samples that differ; of sets smaller than the number of bins
nearly every element is a sample, and the count is nearly exact.

1. Documents with equal sets form classes (one aggregate); below, only class representatives appear.
2. Representatives that share a band key with others meet. Each is paired with the smallest id of
   its bucket, pairs whose sketches differ in too many bits are dropped, and the rest are confirmed on the
   full sets.
3. Components of the confirmed links are contracted. A bucket whose members are in one component is
   done. In the others, members outside the bucket's largest component are compared, by sketch and in
   blocks, with all members of other components, each pair in the first bucket that it shares. A first
   pass confirms on the full sets only a member's closest pair per component, which joins most that is to be joined;
   a second one, after contraction, confirms all that is left.

So no pair of equal texts is ever a row, a large group of near copies costs one row per member and band,
and every pair of different components that shares a band key has been compared. Two sets of similarity s
share no key with probability (1 - s^4)^32: 7e-11 at 0.85, 5e-8 at 0.8.

A pair is dropped by its sketches if they differ in MARGIN standard deviations more than expected at the threshold.

Defined results: a null, empty or blank text has the empty set and is linked with nothing; a text with
fewer words than a shingle is one shingle of its whole sequence; rows with a null id take no part and
are kept alone (component null, kept true); rows that repeat an id are judged row by row; an empty table
gives no rows. Other columns of `docs` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermobox.llm.common import LOWER, column, join_repeated, map_texts, pieces, stored
from thermobox.operators.series import index_by

BANDS, BAND_ROWS = 32, 4
SAMPLE_BINS, SKETCH_BITS = 1024, 2048
MARGIN = 6.0
BLOCK_ROWS = 2048

_rng = np.random.default_rng(20110609)
_FACTORS = _rng.integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_FACTORS = _rng.integers(0, 1 << 63, (BANDS, BAND_ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE_FACTORS = _rng.integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit over all others (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text, sorted; words are split at ASCII blanks, A-Z lower-cased."""
    filled = pc.fill_null(texts.cast(pa.large_string()), "")
    split = pc.ascii_split_whitespace(filled)
    coded = split.flatten().dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    words = coded.dictionary.cast(pa.large_binary()).to_pylist()
    # splitting leaves an empty piece before leading and after trailing blanks
    blank = np.fromiter((not w for w in words), dtype=bool, count=len(words))
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w.translate(LOWER)) for w in words), dtype=np.uint64, count=len(words))
    at = coded.indices.to_numpy()
    real = ~blank[at] if len(words) else np.zeros(0, bool)
    kept = hashes[at][real] if len(words) else np.zeros(0, np.uint64)
    counts = np.r_[0, np.cumsum(real)]
    offsets = split.offsets.to_numpy()
    bounds = counts[offsets - offsets[0]]
    total = np.zeros(max(0, len(kept) - width + 1), dtype=np.uint64)
    for i in range(width):
        total += _mixed(kept[i:i + len(total)] * _PLACE_FACTORS[i])
    total = _mixed(total + np.uint64(width))
    for start, stop in zip(bounds[:-1], bounds[1:]):
        n = stop - start
        if n >= width:
            yield np.unique(total[start:stop - width + 1])
        elif n:
            short = sum(int(x) for x in _mixed(kept[start:stop] * _PLACE_FACTORS[:n])) + int(n)
            yield _mixed(np.array([short & (2**64 - 1)], dtype=np.uint64))
        else:
            yield np.zeros(0, dtype=np.uint64)


def minhashes(shingles: np.ndarray) -> np.ndarray:
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for start in range(0, len(shingles), 1024):
        part = shingles[start:start + 1024]
        np.minimum(least, (_FACTORS[:, None] * part[None, :]).min(axis=1), out=least)
    return least


def band_keys(samples: np.ndarray) -> np.ndarray:
    rows = samples.reshape(BANDS, BAND_ROWS)
    keys = _mixed(rows * _BAND_FACTORS).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _MIX
    return _mixed(keys).view(np.int64)


def odd_sketch(shingles: np.ndarray) -> np.ndarray:
    """`shingles` are sorted, so the first of a bin is its smallest."""
    _, first = np.unique(shingles & np.uint64(SAMPLE_BINS - 1), return_index=True)
    bits = _mixed(shingles[first] ^ _MIX) % np.uint64(SKETCH_BITS)
    parity = (np.bincount(bits.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(parity).view(np.int64)


def allowed_ones(total, percent: int, exp, sqrt):
    """Most ones in the XOR of two sketches of sets with `total` elements together, at the similarity or above.

    With u elements in the union, u / bins of them meet in a bin. A bin whose smallest element is in one set only adds
    a differing sample, and another one if the other set has an element there. Written for numbers, arrays and columns.
    """
    s = percent / 100
    load = total / ((1 + s) * SAMPLE_BINS)
    filled = 1 - exp(-load)
    each = 2 * filled - load * exp(-load)
    expected = SAMPLE_BINS * (1 - s) * each
    # sampling without replacement: no variance where every element is a sample
    sampled = SAMPLE_BINS * s * (1 - s) * (each * each / filled) * (1 - filled / load)
    most = expected + MARGIN * sqrt(sampled + expected * expected / SKETCH_BITS + 1)
    return SKETCH_BITS / 2 * (1 - exp(most * (-2 / SKETCH_BITS)))


SKETCHES = "doc_id long, n_shingles long, set_key binary, sketch array<long>, bands array<long>"


def sketch(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            sizes, keys, sketches, bands = [], [], [], []
            for shingles in shingle_sets(batch.column("text"), width):
                sizes.append(len(shingles))
                if len(shingles):
                    samples = minhashes(shingles)
                    keys.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                    sketches.append(odd_sketch(shingles))
                    bands.append(band_keys(samples))
                else:
                    keys.append(None), sketches.append(None), bands.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
                 pa.array(sketches, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "set_key", "sketch", "bands"],
            )

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, SKETCHES)


def full_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """rep, shingles: the full sets of the representatives in `wanted` (rep, set_key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            rows, sets = [], []
            keys = batch.column("set_key").to_pylist()
            for i, shingles in enumerate(shingle_sets(batch.column("text"), width)):
                if xxhash.xxh3_128_digest(shingles.tobytes()) == keys[i]:
                    rows.append(i), sets.append(shingles.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("rep").take(pa.array(rows, pa.int64())), pa.array(sets, pa.list_(pa.int64()))],
                names=["rep", "shingles"],
            )

    found = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(wanted, "rep")
    return map_texts(found.select("rep", "set_key", "text"), run, "rep long, shingles array<long>")


def _ones(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def close_by_sketch(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches allow the similarity."""
    left = classes.select(F.col("rep").alias("a"), F.col("n_shingles").alias("n_a"), F.col("sketch").alias("s_a"))
    right = classes.select(F.col("rep").alias("b"), F.col("n_shingles").alias("n_b"), F.col("sketch").alias("s_b"))
    near = _ones(F.col("s_a"), F.col("s_b")) <= allowed_ones(F.col("n_a") + F.col("n_b"), percent, F.exp, F.sqrt)
    fits = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    return pairs.join(left, "a").join(right, "b").where(fits & near).select("a", "b")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have the similarity."""
    left = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("s_a"))
    right = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("s_b"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("s_a", "s_b"))
    union = F.size("s_a") + F.size("s_b") - common
    return both.where(100 * common >= percent * union).select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) of every node with an edge (a, b).

    Every node moves to its smallest neighbour and the edges are contracted, until none is left; each
    round at least halves the nodes that still have edges.
    """
    edges, labels = stored(edges, "edges"), None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to")), "step")
        if labels is None:
            labels = step.select(F.col("a").alias("node"), F.col("to").alias("component"))
        else:
            moved = labels.join(step, labels["component"] == step["a"], "left")
            labels = stored(moved.select("node", F.coalesce("to", "component").alias("component")), "labels")
        to_a, to_b = step.select("a", F.col("to").alias("to_a")), step.select(F.col("a").alias("b"), F.col("to").alias("to_b"))
        left = edges.join(to_a, "a").join(to_b, "b").where("to_a <> to_b")
        edges = stored(left.select(F.col("to_a").alias("a"), F.col("to_b").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            return labels


def _cross_pairs(members: DataFrame, percent: int, closest: bool) -> DataFrame:
    """Pairs (a, b) of different components that share a bucket and are close by sketch.

    `members`: key, rep, center, component, n_shingles, sketch, bands of buckets with several components. Pairs
    with the bucket's center have been compared before. `closest`: of a member's pairs in a block and bucket
    only the closest with each other component.
    """
    sizes = members.groupBy("key", "component").agg(F.count("*").alias("n"))
    buckets = sizes.groupBy("key").agg(
        F.max_by("component", F.struct("n", "component")).alias("main"),
        (1 + F.floor(F.sum("n") / BLOCK_ROWS)).alias("blocks"),
    )
    columns = ["key", "block", "side", "rest", "rep", "component", "n_shingles", "sketch", "bands"]
    rows = join_repeated(members.where("rep <> center"), buckets, "key", ["rep"], "inner")
    rows = rows.withColumn("rest", (F.col("component") != F.col("main")).cast("int"))
    # side 0: all members, dealt over blocks; side 1: those outside the main component, again for each block
    here = rows.withColumn("block", F.pmod(F.xxhash64("rep"), "blocks")).withColumn("side", F.lit(0))
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    there = rows.where("rest = 1").withColumn("side", F.lit(1)).withColumn("block", blocks)
    dealt = here.select(*columns).unionByName(there.select(*columns))
    dealt = dealt.repartition("key", "block").sortWithinPartitions("key", "block", "side")

    def lists(part: pa.RecordBatch, name: str) -> np.ndarray:
        return part.column(name).flatten().to_numpy().view(np.uint64).reshape(part.num_rows, -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, parts, block = None, [], None
        for batch in batches:
            keys, numbers, sides = (batch.column(c).to_numpy() for c in ("key", "block", "side"))
            change = np.flatnonzero((np.diff(keys) != 0) | (np.diff(numbers) != 0) | (np.diff(sides) != 0)) + 1
            found: list[np.ndarray] = []
            for start, stop in zip(np.r_[0, change], np.r_[change, batch.num_rows]):
                if start == stop:
                    continue
                part = batch.slice(start, stop - start)
                if (keys[start], numbers[start]) != place:
                    place, parts, block = (keys[start], numbers[start]), [], None
                own = [part.column(c).to_numpy() for c in ("rest", "rep", "component", "n_shingles")]
                own += [lists(part, "sketch"), lists(part, "bands")]
                if sides[start] == 0:
                    parts.append(own)
                    continue
                if block is None:
                    block = [np.concatenate([p[i] for p in parts]) for i in range(6)]
                rest, reps, components_, n, sketches, bands = block
                for _, rep, component, size, bits, keys_ in zip(*own):
                    # two members outside the main component meet on both sides
                    fits = (components_ != component) & ((rest == 0) | (reps > rep))
                    at = np.flatnonzero(fits & (100 * np.minimum(n, size) >= percent * np.maximum(n, size)))
                    ones = np.bitwise_count(sketches[at] ^ bits).sum(axis=1)
                    near = ones <= allowed_ones(n[at] + size, percent, np.exp, np.sqrt)
                    at, ones = at[near], ones[near]
                    shared = (bands[at] == keys_).argmax(axis=1)
                    first = keys_[shared].view(np.int64) == place[0]
                    at, ones = at[first], ones[first]
                    if closest and len(at):
                        order = np.argsort(ones, kind="stable")
                        at = at[order][np.unique(components_[at[order]], return_index=True)[1]]
                    found.append(np.column_stack([np.minimum(reps[at], rep), np.maximum(reps[at], rep)]))
            pairs = np.concatenate(found) if found else np.zeros((0, 2), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _join_rest(labels: DataFrame, members: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, closest: bool) -> DataFrame:
    """`labels` (node, component) after the links between members of different components of a bucket."""
    placed = members.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    placed = placed.withColumn("component", F.coalesce("component", "rep"))
    mixed = placed.groupBy("key").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")
    ).where("low <> high AND n > 2").select("key")
    open_ = join_repeated(placed, mixed, "key", ["rep"], "inner").join(classes.select("rep", "n_shingles", "sketch", "bands"), "rep")
    links = confirm(_cross_pairs(stored(open_, "open"), percent, closest), sets, percent)
    to_a = labels.select(F.col("node").alias("a"), F.col("component").alias("to_a"))
    to_b = labels.select(F.col("node").alias("b"), F.col("component").alias("to_b"))
    links = links.join(to_a, "a", "left").join(to_b, "b", "left")
    links = links.select(F.coalesce("to_a", "a").alias("a"), F.coalesce("to_b", "b").alias("b"))
    joined = components(links.where("a <> b").distinct())
    last = joined.select(F.col("node").alias("component"), F.col("component").alias("last"))
    moved = labels.join(last, "component", "left").select("node", F.coalesce("last", "component").alias("component"))
    return stored(moved.unionByName(joined.join(labels, "node", "left_anti").select("node", "component")), "labels")


def near_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), kept (doc_id = component_id), per row of `docs`."""
    sketches = stored(sketch(docs, width), "sketches")
    classes = stored(
        sketches.where("set_key IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_key").agg(
            F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.first("n_shingles").alias("n_shingles"),
            F.first("sketch").alias("sketch"), F.first("bands").alias("bands"),
        ), "classes",
    )
    rows = classes.select("rep", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.min("rep").alias("center"), F.count("*").alias("n")).where("n > 1").drop("n")
    members = stored(join_repeated(rows, shared, "key", ["rep"], "inner"), "members")
    meeting = members.select("rep").distinct()
    sets = stored(full_sets(docs, classes.join(meeting, "rep").select("rep", "set_key"), width), "sets")

    pairs = members.where("rep <> center").select(F.col("center").alias("a"), F.col("rep").alias("b")).distinct()
    links = confirm(close_by_sketch(pairs, classes, percent), sets, percent)
    labels = components(links)
    for closest in (True, False):
        labels = _join_rest(labels, members, classes, sets, percent, closest)

    final = classes.select("set_key", "rep", "n").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    final = final.select("set_key", "rep", "n", F.coalesce("component", "rep").alias("component_id"))
    found = final.where("n > 1 OR component_id <> rep").select("set_key", "component_id")
    known = join_repeated(sketches.select("doc_id", "n_shingles", "set_key"), found, "set_key", ["doc_id"])
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return known.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def distinct_documents(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` without near duplicates: of each group of linked texts the one with the smallest doc_id.

    Rows of one doc_id with different texts are documents of their own, judged one by one, after those whose doc_id stands
    once; rows equal in doc_id and text count as one, of which one row stays. Rows without a doc_id stay.
    """
    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    own = [column(c) for c in docs.columns]
    rows = docs.select(F.struct(*own).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    several = rows.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    again = join_repeated(rows.select("doc_id", digest.alias("digest")), several.withColumn("several", F.lit(True)), "doc_id", ["digest"], "inner")
    # each text of an id with several texts gets an id that no row has
    numbered = index_by(again.select("doc_id", "digest").distinct(), "doc_id", ("digest",)).frame
    mixed = numbered.groupBy("doc_id").count().where("count > 1").select("doc_id", F.lit(True).alias("mixed"))
    numbered = numbered.join(mixed, "doc_id", "left")
    least, most = (x or 0 for x in rows.agg(F.min("doc_id"), F.max("doc_id")).first())
    unused = F.lit(most) + 1 + F.col("step") if most < 1 << 62 else F.lit(least) - 1 - F.col("step")
    fresh = F.when(F.col("mixed"), unused).otherwise(F.col("doc_id"))
    fresh = stored(numbered.select("doc_id", "digest", fresh.alias("fresh")), "fresh-ids")
    if fresh.isEmpty():
        marked = rows.withColumn("fresh", F.lit(None).cast("long"))
    else:
        marked = rows.withColumn("digest", digest).join(fresh, ["doc_id", "digest"], "left").drop("digest")
    marked = marked.withColumn("doc_id", F.coalesce("fresh", "doc_id"))
    gone = stored(near_components(marked.select("doc_id", "text"), width, percent).where("NOT kept").select("doc_id").distinct(), "duplicates")
    left = marked.join(gone, "doc_id", "left_anti")
    once = left.where("fresh IS NULL").select("row")
    if not fresh.isEmpty():
        once = once.unionByName(left.where("fresh IS NOT NULL").groupBy("doc_id").agg(F.first("row").alias("row")).select("row"))
    return once.select("row.*")


def op5(docs: DataFrame) -> DataFrame:
    return near_components(docs, width=3, percent=85)
