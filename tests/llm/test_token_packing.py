import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from thermobox.llm.common import tokenizer_file
from thermobox.llm.token_packing import CAPACITY, WordTokenizer, assemble, cut_pieces, op6, pack, plan_packing

PATH = tokenizer_file("word_bpe_49k.json")
TEXTS = [
    None, "", "   \n", "Hello, world! it's 42 o'clock -- we'll see... don't",
    "the&&& of*** Émile ÉTÉ,, naïve été İstanbul ΣΑΣ ß STRASSE  x y 　z",
    "<|endoftext|> a<|startoftext|>b 漢字 テスト 🙂🙂 1234.5678 a_b_c x@y.z", "K Å ﬁ ǅ ʰa", "word " * 5000, "a" * 3000,
    "ab12cd ab'12 'twas 's's İx\tq\x0bw\x0ce\x1cr\x85t",
]


def brute(text):
    ids = Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [0]
    return [ids[i:i + CAPACITY] for i in range(0, len(ids), CAPACITY)]


def test_word_lookup_equals_whole_text_encoding():
    tokenizer = WordTokenizer(PATH)
    for _ in range(2):  # the second time from memory
        ids, starts = tokenizer.texts(pa.array(TEXTS, pa.string()))
        for i, text in enumerate(TEXTS):
            want = Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids
            assert ids[starts[i]:starts[i + 1]].tolist() == want, text


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_a_valid_packing(seed):
    rng = random.Random(seed)
    sizes = [min(2048, max(1, int(rng.lognormvariate(5.5, 1.3)))) for _ in range(3000)]
    counts = Counter(sizes)
    runs, sequences = plan_packing(counts)
    ranks, filled = {s: set() for s in counts}, {}
    for size, rank, number, first, offset in runs.tolist():
        for k in range(number):
            assert rank + k not in ranks[size]
            ranks[size].add(rank + k)
            filled.setdefault(first + k, []).append((offset, size))
    assert all(ranks[s] == set(range(n)) for s, n in counts.items())
    assert set(filled) == set(range(sequences))
    for items in filled.values():
        end = 0
        for offset, size in sorted(items):
            assert offset == end
            end += size
        assert end <= CAPACITY
    assert sequences <= 1.02 * -(-sum(sizes) // CAPACITY) + 2


def test_large_pieces_pair_at_most_twice():
    runs, sequences = plan_packing({700: 6, 1300: 2, 1348: 1, 50: 3})
    # 1348+700, 1300+700 twice, then 700+700 and a lone 700; 50s go to the smallest gaps that hold them
    assert sequences == 5
    assert [r[4] for r in runs.tolist() if r[0] == 50] and runs[:, 2].sum() == 12


def test_plan_of_nothing():
    runs, sequences = plan_packing({})
    assert runs.shape == (0, 5) and sequences == 0


def test_packed_rows(spark):
    rows = [(i, t, "x", -1) for i, t in enumerate(TEXTS)] + [(None, "null id", "x", 0), (3, TEXTS[3], "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece string, offset int")
    packed = op6(docs, PATH).collect()
    want = Counter()
    for doc_id, text, *_ in rows:
        start = 0
        for k, part in enumerate(brute(text)):
            want[(doc_id, k, start, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes()))] += 1
            start += len(part)
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want
    by_sequence = {}
    for r in packed:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= CAPACITY


def test_assembled_ids(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, "three")], "doc_id long, text string")
    ids = assemble(pack(cut_pieces(docs, PATH, with_ids=True))).collect()
    assert len(ids) == 1 and sorted(ids[0].ids) == sorted(brute("one two")[0] + brute("three")[0])


def test_empty_table(spark):
    assert op6(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
