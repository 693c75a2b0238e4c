from collections import Counter, defaultdict

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_near_dedup import brute as brute_components
from tests.llm.test_pii import brute as brute_pii
from thermobox.llm.common import stored, tokenizer_file

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """The rows that each stage gets, and what the last one returns."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame(
        [(900_000, "12 34 --", "en", "src0", 8), (900_001, None, None, None, None), (None, "plain words without an id", "en", None, 25),
         (900_002, "Same words stand here for a while and then they end.", "en", "src1", 50),
         (900_002, "Same words stand here for a while and then they end.", "en", "src1", 50),
         (900_003, "same words stand HERE for a while and then they end.", "fr", None, 50)], docs.schema)
    frames = [docs.unionByName(extra)]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(stored(stage(spark, frames[-1], SF), "test-stage"))
    return frames, [f.collect() for f in frames]


def test_columns(steps):
    frames, _ = steps
    assert all(f.dtypes == frames[0].dtypes for f in frames[:-1])


def test_language_stage(steps):
    _, rows = steps
    kept = Counter(rows[1])
    assert not kept - Counter(rows[0])
    gone = Counter(rows[0]) - kept
    assert 900_000 in {r.doc_id for r in gone} and all(len(r.text or "") < 20 for r in gone)


def test_near_duplicate_stage(steps):
    _, rows = steps
    want = {i for i, (_, c) in brute_components([(r.doc_id, r.text) for r in rows[1] if r.doc_id is not None], 5, 80).items() if i == c}
    assert Counter(r.doc_id for r in rows[2] if r.doc_id is not None) == Counter(dict.fromkeys(want, 1))
    assert sum(r.doc_id is None for r in rows[2]) == sum(r.doc_id is None for r in rows[1])
    assert set(rows[2]) <= set(rows[1]) and {900_002} == want & {900_002, 900_003}


def test_personal_data_stage(steps):
    _, rows = steps
    before = {r.doc_id: r for r in rows[2]}
    assert len(rows[3]) == len(rows[2])
    for r in rows[3]:
        found = brute_pii(before[r.doc_id].text)
        if not any(c.isdigit() or c in "@+" for c in before[r.doc_id].text or ""):
            assert r.text == before[r.doc_id].text
        assert not brute_pii(r.text) and r.n_chars == (None if r.text is None else len(r.text))
        assert (r.text.count("<EMAIL>") if r.text else 0) >= min(1, sum(f[1] == 0 for f in found))


def test_mix_stage(steps):
    _, rows = steps
    before, after = Counter(rows[3]), Counter(rows[4])
    assert set(before) == set(after) and all(1 <= after[r] <= 2 * before[r] for r in before)
    size, taken = defaultdict(int), defaultdict(int)
    for r, n in before.items():
        size[r.source] += n * len((r.text or "").split())
    for r, n in after.items():
        taken[r.source] += n * len((r.text or "").split())
    assert 1.1 < sum(taken.values()) / sum(size.values()) < 1.4


def test_packing_stage(steps):
    _, rows = steps
    encode = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json")).encode
    want = Counter()
    for r in rows[4]:
        want[r.doc_id] += len(encode(r.text or "", add_special_tokens=False).ids) + 1
    got = Counter()
    for r in rows[5]:
        got[r.doc_id] += r.length
    assert got == want
    filled = Counter()
    for r in rows[5]:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 2048 and len(filled) <= sum(filled.values()) / 2048 * 1.1 + 2


def test_run(spark, steps):
    result = corpus_pipeline.run(spark, SF)
    assert result.columns == steps[0][-1].columns and result.count() > 0
