"""Mixing sources to target weights with a time-varying curriculum.

Each source has a target number of words and a schedule: piecewise-linear relative weight over
training time 0..1. The integral of the schedule, scaled to the target, is the source's cumulative
demand. A source offers its documents in an order drawn from a hash of id and text, again and again; the copy
that starts at word c of that stream is trained on when the demand reaches c, so its position is the
inverse of the demand at c. Copies past the demand are not taken. `training_order` range-sorts the
copies of all sources by position.

The stream offsets are prefix sums over hash ranges: a source is cut into ranges of about RANGE_ROWS
documents and ranges are summed before rows are, so a source with a third of all rows is dealt over
many tasks. Sources, their targets and the sums of their ranges are tables, joined on the partitioning of the
prefix sums: a text is shuffled once for its place in the stream and once for the order of training.

Defined results: a null text has size 0 and is never taken; a null source is a source of its own,
ordered last; null and repeated `doc_id`s are rows like others; rows equal in id and text are interchangeable
and stand next to each other, so reruns agree; an empty table gives no rows. The columns of `docs` travel
in one structure, so their names cannot clash with those used here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thermobox.llm.common import column, stored, word_count
from thermobox.operators.series import index_by

RANGE_ROWS = 4096
Schedule = Sequence[tuple[float, float]]
FLAT: Schedule = ((0.0, 1.0), (1.0, 1.0))
#: A hash range of a source.
RANGE = ("mix_source", "mix_unnamed", "mix_range")


def prepare(docs: DataFrame, carried: Sequence[str]) -> DataFrame:
    """mix_row (the carried columns), RANGE, mix_key, mix_size of each row."""
    text = F.coalesce("text", F.lit(""))
    key = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text).cast("binary"))
    ranges = 1 + docs.count() // RANGE_ROWS
    # the first 8 hex digits of the order key deal the rows evenly, in its order
    at = F.conv(F.substring("mix_key", 1, 8), 16, 10).cast("double") / float(1 << 32)
    return docs.select(
        F.struct(*[column(c) for c in carried]).alias("mix_row"), F.coalesce("source", F.lit("")).alias("mix_source"),
        F.col("source").isNull().alias("mix_unnamed"), key.alias("mix_key"), word_count(F.col("text")).alias("mix_size"),
    ).withColumn("mix_range", F.floor(at * ranges))


def range_sums(rows: DataFrame) -> DataFrame:
    """RANGE and n, the words in it, stored."""
    return stored(rows.groupBy(*RANGE).agg(F.sum("mix_size").alias("n")), "mix-ranges")


def list_sources(sums: DataFrame) -> DataFrame:
    """mix_source, mix_unnamed, number (from 0, by code point, null last), size of each source, stored."""
    sizes = sums.groupBy("mix_source", "mix_unnamed").agg(F.sum("n").alias("size"))
    return index_by(sizes, "mix_unnamed", ("mix_source",)).frame.withColumnRenamed("step", "number")


def fill_targets(sources: DataFrame, total: float, most: float) -> DataFrame:
    """`sources` (size, weight, ...) with target: shares of `total` by weight; one above `most` times its size
    stops there and the rest is reshared."""
    weight, cap = F.col("weight"), most * F.col("size")
    level, stopped = 0.0, -1
    while True:  # each round stops at least one more source
        over = F.lit(level) * weight > cap
        now = sources.where(weight > 0).agg(
            F.count_if(over).alias("n"), F.sum(F.when(over, cap)).alias("full"), F.sum(F.when(~over, weight)).alias("open")
        ).first()
        if now["n"] == stopped or not now["open"]:
            break
        level, stopped = (total - (now["full"] or 0)) / now["open"], now["n"]
    share = F.lit(level) * weight
    target = F.when(weight <= 0, 0.0).when(share > cap, cap).otherwise(share)
    return sources.withColumn("target", target.cast("double"))


def segments(schedule: Schedule, demand: Column) -> Column:
    """(start time, weight there in words, slope, demand at the start) of each piece."""
    area = sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]))
    done, out = 0.0, []
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        parts = (w0 / area, (w1 - w0) / (t1 - t0) / area, done)
        out.append(F.array(F.lit(t0), *[F.lit(x) * demand for x in parts]))
        done += (t1 - t0) * (w0 + w1) / 2 / area
    return F.array(*out)


def assign_positions(rows: DataFrame, sums: DataFrame, sources: DataFrame, schedules: Sequence[Schedule],
                     chosen: Column, cut: bool = True) -> DataFrame:
    """`rows` with mix_source_size, mix_target and mix_copies: (epoch, position, words) of each copy taken.

    `sources` with size and target; `chosen` is the number of a source's schedule. `cut`: the copy at the end of the demand
    counts with the words that are still wanted; else copies are whole, that one is taken if the demand reaches
    its middle, and a document without words is taken once, at the start.
    """
    demand = F.floor(F.col("target") + 0.5)
    curve = F.get(F.array(*[segments(s, demand.cast("double")) for s in schedules]), chosen)
    spec = sources.select(
        "mix_source", "mix_unnamed", F.col("size").alias("mix_source_size"), F.col("target").alias("mix_target"),
        demand.alias("mix_demand"), F.when(demand > 0, curve).otherwise(F.array().cast("array<array<double>>")).alias("mix_segments"),
    )
    earlier = Window.partitionBy("mix_source", "mix_unnamed").orderBy("mix_range")
    before = sums.withColumn("mix_before", F.sum("n").over(earlier) - F.col("n")).drop("n")
    before = stored(before.join(spec, ["mix_source", "mix_unnamed"]), "mix-offsets")
    inside = Window.partitionBy(*RANGE).orderBy("mix_key").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("mix_start", F.sum("mix_size").over(inside) - F.col("mix_size"))
    # the same keys as the prefix sums: the rows stay where they are
    rows = rows.join(before.hint("shuffle_hash"), list(RANGE)).withColumn("mix_start", F.col("mix_start") + F.col("mix_before"))

    size, wanted = F.col("mix_size"), F.col("mix_demand")
    epochs = F.when(size > 0, F.sequence(F.lit(0), F.ceil(wanted / F.col("mix_source_size")).cast("int")))

    def copy(epoch: Column) -> Column:
        start = F.col("mix_start") + epoch * F.col("mix_source_size")
        part = F.greatest(F.lit(0), F.least(size, wanted - start))
        words = part if cut else F.when(2 * start + size <= 2 * wanted, size).otherwise(0)
        return F.struct(epoch.alias("epoch"), _position(start).alias("position"), words.cast("long").alias("words"))

    copies = F.filter(F.transform(F.coalesce(epochs, F.array().cast("array<int>")), copy), lambda c: c["words"] > 0)
    if not cut:
        once = F.struct(F.lit(0).alias("epoch"), F.lit(0.0).alias("position"), F.lit(0).cast("long").alias("words"))
        copies = F.when(size > 0, copies).otherwise(F.array(once))
    return rows.withColumn("mix_copies", copies).select("mix_row", "mix_key", "mix_size", "mix_source_size", "mix_target", "mix_copies")


def _position(words: Column) -> Column:
    """The time at which the source's demand reaches `words`."""

    def solve(s: Column) -> Column:
        start, weight, slope, rest = s[0], s[1], s[2], words - s[3]
        # weight * x + slope / 2 * x^2 = rest, in the form that holds for slope 0 as well
        root = F.sqrt(F.greatest(F.lit(0.0), weight * weight + 2 * slope * rest))
        return start + F.when(rest > 0, 2 * rest / (weight + root)).otherwise(0.0)

    segment = F.filter("mix_segments", lambda s: s[3] <= words)
    return F.get(F.transform(F.slice(segment, -1, 1), solve), F.lit(0))


def training_order(assigned: DataFrame) -> DataFrame:
    """mix_row, mix_epoch, mix_position, mix_words: one row per copy taken, range-sorted by mix_position."""
    copies = assigned.select("mix_row", "mix_key", F.explode("mix_copies").alias("c")).select(
        "mix_row", "mix_key", F.col("c.epoch").alias("mix_epoch"), F.col("c.position").alias("mix_position"), F.col("c.words").alias("mix_words"))
    return copies.orderBy("mix_position", "mix_key", "mix_epoch").drop("mix_key")


# The contract's weights, repeating over the sources, and a curriculum for each.
WEIGHTS = (3.0, 1.0, 2.0)
SCHEDULES = (
    ((0.0, 2.0), (1.0, 1.0)),  # heavy sources lead
    ((0.0, 1.0), (0.5, 1.0), (1.0, 3.0)),  # light ones come late
    FLAT,
)
SHARE, MOST = 1.5, 2


def op2(docs: DataFrame) -> DataFrame:
    """Per document its size, its source's size and target, and the words taken, in training order."""
    rows = stored(prepare(docs, ["doc_id"]), "mix-rows")  # ids and sizes; the texts are read once
    sums = range_sums(rows)
    turn = F.pmod("number", F.lit(len(WEIGHTS))).cast("int")
    sources = list_sources(sums).withColumn("weight", F.get(F.array(*map(F.lit, WEIGHTS)), turn))
    words = sources.agg(F.sum("size")).first()[0] or 0
    assigned = assign_positions(rows, sums, fill_targets(sources, SHARE * words, MOST), SCHEDULES, turn)
    taken = F.aggregate("mix_copies", F.lit(0).cast("long"), lambda total, c: total + c["words"])
    first = F.get(F.transform("mix_copies", lambda c: c["position"]), F.lit(0))
    return assigned.orderBy(first.asc_nulls_last(), "mix_key").select(
        "mix_row.doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"), taken.alias("taken"),
    )


#: DuckDB. The level at which the largest possible number of sources has stopped at its cap is the right one.
SQL = r"""
WITH d AS (SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')) AS place, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
           FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight
      FROM d GROUP BY source),
c AS (SELECT *, row_number() OVER (ORDER BY 2 * source_size / weight, source) AS k FROM s),
l AS (SELECT a.n AS stopped, (1.5::DOUBLE * (SELECT sum(source_size) FROM s)
               - coalesce((SELECT sum(2 * source_size) FROM c WHERE k <= a.n), 0))
             / (SELECT sum(weight) FROM c WHERE k > a.n) AS level
      FROM range((SELECT count(*) FROM s)) AS a(n)),
level AS (SELECT stopped, level FROM l
          WHERE NOT EXISTS (SELECT 1 FROM c WHERE k > stopped AND level * weight > 2 * source_size)
          ORDER BY stopped LIMIT 1),
t AS (SELECT source, source_size,
             CASE WHEN k <= stopped THEN 2.0::DOUBLE * source_size ELSE level * weight END AS target FROM c, level),
o AS (SELECT d.* EXCLUDE (place), source_size, target, CAST(floor(target + 0.5) AS BIGINT) AS demand,
             sum(size) OVER (PARTITION BY d.source ORDER BY place ROWS UNBOUNDED PRECEDING) - size AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(greatest(0, least(size, demand - start))
            + greatest(0, least(size, demand - start - source_size)) AS BIGINT) AS taken
FROM o
"""
