"""Helpers shared by the corpus operators: tables, shared storage, words, keyed minima."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters between words in every contract that takes `[^\x20\x09-\x0D]+`.
BLANKS = b"\t\n\x0b\x0c\r "


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below `spark.checkpoint.dir`, which driver and executors share.

    Only a local master without that setting (tests) falls back to a folder in /tmp.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and return the written rows.

    Cuts lineage so that a lost executor costs its own tasks only, and the work is done once.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tokenizer_file(name: str) -> str:
    """Where the installed package of public vocabularies keeps `name`; the same on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def column(name: str) -> Column:
    """The column of exactly this name, dots and quotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def ascii_lower(column: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


#: Rows of an Arrow batch that carries whole texts between Spark and Python; its memory stays with both sides.
TEXT_BATCH_ROWS = 1000


def map_texts(df: DataFrame, function, schema) -> DataFrame:
    """`mapInArrow` for rows with whole texts: the session's batches are cut to TEXT_BATCH_ROWS rows where they are larger."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name, "10000")) <= TEXT_BATCH_ROWS:
        conf.set(name, str(TEXT_BATCH_ROWS))
    names = df.columns

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return function(batch.rename_columns(names) for batch in batches)

    return df.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(named, schema)  # it resolves names, where a dot means a field


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null gives the empty text."""
    return [value or b"" for value in column.cast(pa.large_binary()).to_pylist()]


def pieces(batches: Iterable[pa.RecordBatch], column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts together stay near `limit` bytes."""
    for batch in batches:
        lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop
        pa.default_memory_pool().release_unused()  # a worker stays; what its last batch needed should not


def word_count(column: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+`; 0 for null."""
    return F.coalesce(F.regexp_count(column, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def most_frequent(rows: DataFrame, count: str, ties: list[str], limit: int) -> list:
    """About `limit` rows, at most, with the largest `count`, largest first.

    Rows are told apart by size class first, so that no task sends rows that cannot be among them; a class
    that would bring more than four times `limit` rows (such as all that occur once) is left out as a whole.
    """
    size = F.floor(F.log2(F.col(count)) * 8)
    classes = rows.where(F.col(count) > 0).groupBy(size.alias("size")).count().orderBy(F.desc("size")).collect()  # hundreds at most
    total, least = 0, None
    for r in classes:
        total += r["count"]
        if total > 4 * limit:
            break
        least = r["size"]
        if total >= limit:
            break
    if least is None:
        return []
    return rows.where((F.col(count) > 0) & (size >= least)).orderBy(F.desc(count), *ties).limit(limit).collect()


#: Ways in which the rows of one key are dealt in `join_repeated`; AQE splits what is still too large.
SALTS = 8


def join_repeated(df: DataFrame, found: DataFrame, key: str, salt_by: list[str], how: str = "left") -> DataFrame:
    """Join of `found` (one row per key, only keys with something to add) on `key`.

    A third of all rows may share a key, so the rows of a key are dealt over SALTS tasks and
    each row of `found` is repeated for each. Rows with a null key keep nulls.
    """
    salt = F.pmod(F.xxhash64(*salt_by), F.lit(SALTS)).cast("int")
    copies = found.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return df.withColumn("_salt", salt).join(copies, [key, "_salt"], how).drop("_salt")
