"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Sizes are small integers, so the packing needs only how many pieces of each size there are: at most
`capacity` counts, whatever the corpus. `plan_packing` works on these counts: pieces of the full
capacity stand alone; large pieces (over a third of the capacity), of which at most two fit in a
sequence, are matched greedily, each with the largest partner that still fits; smaller pieces, from
the largest down, go where they leave the smallest gap. The plan is a short list of runs ("pieces
number r..r+n of size s go to sequences q..q+n at offset o"), and the rows find their place from
their rank among the pieces of their size, so no task ever holds more than a batch of rows.

Defined results: a null text is empty and gives one piece of one token (the end id 0); equal rows and
equal sizes are told apart by rank; a null `doc_id` is carried along; an empty table gives no rows.
Other columns of `docs`, whatever their names, are not read.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thermobox.llm.common import map_texts, pieces, stored

CAPACITY, END_ID = 2048, 0
#: Units whose ids a worker keeps; beyond it the memory is emptied and refilled.
CACHED_UNITS = 250_000
_PLAIN = r"^(?P<letters>\p{L}+)(?P<marks>[!-&(-/:-@\[-`{-~]*)$"


class WordTokenizer:
    """Ids of whole texts, looked up by unit.

    The tokenizer's pre-tokenizer never joins characters across white space, so a text's ids are
    those of its words in order. A word of letters followed by ASCII punctuation (no apostrophe) is
    two units, letters and punctuation, each cut alone by the pre-tokenizer; any other word is one
    unit. New letter units are encoded many at a time, joined by blanks, and told apart by the
    end-of-word mark of their last id.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        for unit, number in vocabulary.items():
            self.ends[number] = unit.endswith("</w>")
        self.units: dict[str, bytes] = {"": b""}

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _learn_letters(self, new: list[str]) -> None:
        for start in range(0, len(new), 2000):
            some = new[start:start + 2000]
            ids = self._encode(" ".join(some))
            stops = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(stops) == len(some):
                self.units.update((unit, ids[a:b].tobytes()) for unit, a, b in zip(some, [0, *stops], stops))
            else:  # a character that this tokenizer does not take for a letter
                self.units.update((unit, self._encode(unit).tobytes()) for unit in some)

    def _ids(self, units: list[str], letters: bool) -> list[bytes]:
        """Little-endian 32-bit ids of each unit."""
        if len(self.units) > CACHED_UNITS:
            self.units = {"": b""}
        new = [u for u in units if u not in self.units]
        if letters:
            self._learn_letters(new)
        else:
            self.units.update((u, self._encode(u).tobytes()) for u in new)
        return [self.units[u] for u in units]

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after the other, and where each text's ids start (one more entry)."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary
        parts = pc.extract_regex(words.cast(pa.string()), _PLAIN)
        plain = parts.is_valid()
        # the tokenizer lowers character by character, so lowering ASCII beforehand changes nothing
        letters = pc.if_else(plain, pc.ascii_lower(parts.field("letters")), "").dictionary_encode()
        marks = pc.if_else(plain, parts.field("marks"), "").dictionary_encode()
        others = pc.if_else(plain, "", words.cast(pa.string())).dictionary_encode()
        ids = [self._ids(x.dictionary.to_pylist(), i == 0) for i, x in enumerate((letters, marks, others))]
        first = np.cumsum([0] + [len(x) for x in ids])
        # at most two of a word's three units hold anything: letters and marks, or the whole word
        units = np.column_stack([x.indices.to_numpy() + first[i] for i, x in enumerate((letters, marks, others))])
        joined = [u for x in ids for u in x]
        lengths = np.fromiter(map(len, joined), dtype=np.int64, count=len(joined)) // 4
        flat = np.frombuffer(b"".join(joined), dtype="<u4")

        def gather(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            n = lengths[rows]
            ends = np.cumsum(n)
            source = (np.cumsum(lengths) - lengths)[rows] - (ends - n)
            return np.repeat(source, n) + np.arange(int(ends[-1]) if len(ends) else 0), n

        at, n = gather(units.ravel())
        flat, lengths = flat[at], n.reshape(-1, 3).sum(axis=1)  # now by word
        at, n = gather(coded.indices.to_numpy())
        words_before = split.offsets.to_numpy() - split.offsets[0].as_py()
        return flat[at], np.r_[0, np.cumsum(n)][words_before]


@functools.cache
def _tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID,
               with_ids: bool = False) -> DataFrame:
    """The documents' ids, `end_id` after each, cut into pieces of at most `capacity` tokens."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(tokenizer_path)
        for batch in pieces(batches, "text", 4 << 20):
            ids, starts = tokenizer.texts(batch.column("text"))
            row, piece, start, length, crc, kept = [], [], [], [], [], []
            for i in range(batch.num_rows):
                own = np.append(ids[starts[i]:starts[i + 1]], np.uint32(end_id)).astype("<u4", copy=False)
                for k, at in enumerate(range(0, len(own), capacity)):
                    part = own[at:at + capacity]
                    row.append(i), piece.append(k), start.append(at), length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    if with_ids:
                        kept.append(part.astype(np.int32))
            columns = [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                       pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            if with_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = PIECES + ", ids array<int>" * with_ids
    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), cut, schema)


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Runs (size, first rank, number, first sequence, offset), and the number of sequences.

    `counts` maps a size to its number of pieces. Runs are sorted by size and rank.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    used = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # free tokens: [(first sequence, number), ...]
    sequences = 0

    def take(size: int, number: int, sequence: int, offset: int) -> None:
        runs.append((size, used[size], number, sequence, offset))
        used[size] += number
        left[size] -= number

    def put(gap: int, sequence: int, number: int) -> None:
        if gap:
            gaps.setdefault(gap, []).append((sequence, number))

    large = sorted((s for s in left if 3 * s > capacity), reverse=True)
    for size in large:
        while left[size]:
            partner = next((p for p in large if p <= capacity - size and left[p] - (p == size) > 0), None)
            number = left[size]
            if partner == size:
                number = left[size] // 2
            elif partner is not None:
                number = min(number, left[partner])
            take(size, number, sequences, 0)
            if partner is not None:
                take(partner, number, sequences, size)
            put(capacity - size - (partner or 0), sequences, number)
            sequences += number
    for size in sorted((s for s in left if left[s]), reverse=True):
        while left[size]:
            gap = min((g for g in gaps if g >= size), default=None)
            if gap is None:
                number = -(-left[size] // (capacity // size))
                gap = capacity
                gaps[gap] = [(sequences, number)]
                sequences += number
            first, free = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
            number = min(free, left[size])
            take(size, number, first, capacity - gap)
            put(gap - size, first, number)
            if number < free:
                put(gap, first + number, free - number)
    table = np.array(sorted(runs), dtype=np.int64).reshape(-1, 5)
    return table, sequences


#: Rows that share a slot when ranks are counted; slots grow with the table.
SLOT_ROWS = 100_000


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`cut` (columns of `cut_pieces`) with `sequence_id` and `offset`.

    The rows are numbered as they are stored, and dealt by that number over slots of about SLOT_ROWS
    rows. A rank within a size is the rank in the slot plus the counts of the slots before.
    """
    cut = stored(cut.withColumn("row", F.monotonically_increasing_id()), "pieces")
    sizes = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs, _ = plan_packing(sizes, capacity)

    slots = 1 + sum(sizes.values()) // SLOT_ROWS
    dealt = cut.withColumn("slot", F.pmod(F.xxhash64("row"), F.lit(slots)))
    ordered = Window.partitionBy("length").orderBy("slot")
    before = (
        dealt.groupBy("length", "slot").agg(F.count("*").alias("n"))
        .select("length", "slot", (F.sum("n").over(ordered) - F.col("n")).alias("before"))
    )
    within = F.row_number().over(Window.partitionBy("length", "slot").orderBy("row")) - 1
    ranked = dealt.withColumn("rank", within).join(before, ["length", "slot"])
    ranked = ranked.withColumn("rank", (F.col("rank") + F.col("before")).cast("long"))
    kept = cut.drop("row").columns
    schema = T.StructType([f for f in cut.schema.fields if f.name != "row"]
                          + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = runs[:, 0] * (1 << 44) + runs[:, 1]
        for batch in batches:
            size = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            run = runs[np.searchsorted(keys, size * (1 << 44) + rank, "right") - 1]
            sequence = run[:, 3] + rank - run[:, 1]
            columns = [batch.column(c) for c in kept] + [pa.array(sequence), pa.array(run[:, 4])]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return ranked.select(*kept, "rank").mapInArrow(place, schema)


def op6(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    return pack(cut_pieces(docs, tokenizer_path))


def assemble(packed: DataFrame) -> DataFrame:
    """sequence_id, ids: the token ids of each sequence, from rows of `pack` that carry `ids`."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # at most `capacity` tokens
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
