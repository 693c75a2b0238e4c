"""Quality rules as a short-circuit cascade, ordered by rejection per cost.

Each rule is a predicate over integer counts of a text. Counts are computed when a rule first
asks for them and kept for the rules after it, so a text that an early, cheap rule rejects never
pays for the dear ones. `plan_cascade` runs every rule alone over a sample of texts inside Spark
tasks, measures seconds and rejections, and orders the rules by rejections per second. The order
changes the cost only: a text is kept if no rule rejects it.

Defined results: a null text counts as empty; an empty text has counts of 0 and is rejected by
`few_words`; rows are judged one by one, so repeated rows, ties and extra columns change nothing;
an empty table gives an empty result. A column of `docs` named like an output is replaced.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thermobox.llm.common import BLANKS, as_bytes, map_texts, pieces

SYMBOLS = b"#*$%&|<>"
#: Rows asked for in the sample that costs and selectivities are estimated on.
SAMPLE_ROWS = 512
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123)) + bytes(range(128, 256))


class Counts:
    """Counts of one text, each computed once and only if asked for."""

    def __init__(self, raw: bytes):
        self.raw = raw
        self._known: dict[str, int] = {}

    def __getitem__(self, name: str) -> int:
        if name not in self._known:
            self._known[name] = _COUNTERS[name](self)
        return self._known[name]

    @property
    def words(self) -> list[bytes]:
        if not hasattr(self, "_words"):
            self._words = self.raw.split()  # bytes split at the six ASCII blanks only
        return self._words

    @property
    def lines(self) -> list[bytes]:
        if not hasattr(self, "_lines"):
            self._lines = self.raw.split(b"\n")
        return self._lines


def _word_chars(c: Counts) -> int:
    points = len(c.raw.decode("utf-8", "replace"))
    return points - sum(c.raw.count(bytes([b])) for b in BLANKS)


def _dup_lines(c: Counts) -> int:
    seen: set[bytes] = set()
    repeated = 0
    for line in c.lines:
        if line in seen:
            repeated += bool(line.strip())
        else:
            seen.add(line)
    return repeated


def _repeat_words(c: Counts) -> int:
    words = c.words
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    often = Counter(windows)
    covered, end = 0, 0
    for at, window in enumerate(windows):
        if often[window] > 1:
            covered += at + 3 - max(at, end)
            end = at + 3
    return covered


_COUNTERS: dict[str, Callable[[Counts], int]] = {
    "n_bytes": lambda c: len(c.raw),
    "n_words": lambda c: len(c.words),
    "word_chars": _word_chars,
    "n_symbols": lambda c: sum(c.raw.count(bytes([b])) for b in SYMBOLS),
    "n_lines": lambda c: sum(1 for line in c.lines if line.strip()),
    "n_dup_lines": _dup_lines,
    "n_repeat_words": _repeat_words,
    "n_upper": lambda c: len(c.raw) - len(c.raw.translate(None, _UPPER)),
    "n_letter_bytes": lambda c: len(c.raw) - len(c.raw.translate(None, _LETTERS)),
}


@dataclass(frozen=True)
class Rule:
    """A text is rejected where `rejects(counts)` holds."""

    name: str
    rejects: Callable[[Counts], bool]


#: Limits are ratios of integers, so that every engine gives the same verdict.
BASE_RULES = (
    Rule("few_words", lambda c: c["n_words"] < 50),
    Rule("repeated_windows", lambda c: 100 * c["n_repeat_words"] > 50 * c["n_words"]),
)
RULES = BASE_RULES + (
    Rule("symbols", lambda c: 100 * c["n_symbols"] > 20 * c["n_words"]),
    Rule("capitals", lambda c: 100 * c["n_upper"] > 40 * c["n_letter_bytes"]),
    Rule("repeated_lines", lambda c: 100 * c["n_dup_lines"] > 50 * c["n_lines"]),
    Rule("few_letters", lambda c: 100 * c["n_letter_bytes"] < 50 * c["n_bytes"]),
    Rule("word_length", lambda c: not 2 * c["n_words"] <= c["word_chars"] <= 20 * c["n_words"]),
)


def plan_cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE_ROWS) -> list[dict]:
    """Cost (seconds a text) and selectivity (share rejected) of each rule, best first.

    The sample is about `rows` rows, spread over the table by a hash of id and text; each sampled text is
    measured in the task that read it, and only one row per rule comes to the driver.
    """
    total = docs.count()
    keep = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_003))
    sample = docs.where(keep < F.lit(min(1.0, rows / max(total, 1)) * 1_000_003)).select("text")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {rule.name: [0, 0, 0.0] for rule in rules}
        for batch in pieces(batches, "text"):
            for raw in as_bytes(batch.column(0)):
                for rule in rules:
                    begin = time.perf_counter()
                    rejected = rule.rejects(Counts(raw))
                    into = found[rule.name]
                    into[0] += 1
                    into[1] += rejected
                    into[2] += time.perf_counter() - begin
        yield pa.RecordBatch.from_pylist(
            [{"rule": k, "n": v[0], "rejected": v[1], "seconds": v[2]} for k, v in found.items()],
            schema=pa.schema([("rule", pa.string()), ("n", pa.int64()), ("rejected", pa.int64()), ("seconds", pa.float64())]),
        )

    sums = map_texts(sample, measure, "rule string, n long, rejected long, seconds double")
    sums = sums.groupBy("rule").agg(F.sum("n").alias("n"), F.sum("rejected").alias("rejected"), F.sum("seconds").alias("seconds"))
    by_name = {r["rule"]: r for r in sums.collect()}
    plan = []
    for rule in rules:
        r = by_name.get(rule.name)
        n = max(r["n"], 1) if r else 1
        cost = max(r["seconds"] / n, 1e-9) if r else 1e-9
        # half a rejection more than seen: a rule without rejections in the sample is ordered by its cost
        share = ((r["rejected"] if r else 0) + 0.5) / (n + 1)
        plan.append({"rule": rule.name, "cost": cost, "selectivity": share, "rank": share / cost})
    return sorted(plan, key=lambda p: (-p["rank"], p["rule"]))


def quality_cascade(
    docs: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    order: list[str] | None = None,
    report: tuple[str, ...] = (),
    keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """Columns `keep`, the counts named in `report`, `rejected_by` (null: kept), `n_rules` run.

    Without `order` the rules are ordered by `plan_cascade` on a sample of `docs`.
    `rejected_by` names the first rule of that order that rejects the text.
    """
    order = order or [p["rule"] for p in plan_cascade(docs, rules)]
    by_name = {rule.name: rule for rule in rules}
    cascade = [by_name[name] for name in order]
    carried = [c for c in keep if c not in report]
    schema = T.StructType(
        [docs.schema[c] for c in carried]
        + [T.StructField(c, T.LongType()) for c in report]
        + [T.StructField("rejected_by", T.StringType()), T.StructField("n_rules", T.IntegerType())]
    )

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            verdicts, ran, counts = [], [], {name: [] for name in report}
            for raw in as_bytes(batch.column("text")):
                c, verdict, n = Counts(raw), None, 0
                for rule in cascade:
                    n += 1
                    if rule.rejects(c):
                        verdict = rule.name
                        break
                verdicts.append(verdict)
                ran.append(n)
                for name in report:
                    counts[name].append(c[name])
            columns = [batch.column(c) for c in carried]
            columns += [pa.array(counts[name], pa.int64()) for name in report]
            columns += [pa.array(verdicts, pa.string()), pa.array(ran, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return map_texts(docs.select(*carried, "text"), judge, schema)


BASE_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def op1(docs: DataFrame) -> DataFrame:
    """The contract's counts and verdicts; `kept` is the verdict of the whole cascade."""
    judged = quality_cascade(docs, report=BASE_COUNTS)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select("doc_id", *BASE_COUNTS, failed.alias("base_failed"), F.col("rejected_by").isNull().alias("kept"))


#: DuckDB. A window of three words repeats where its words, joined by blanks, occur twice in the text.
SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
p AS (SELECT rid, generate_subscripts(words, 1) AS i, words FROM w WHERE len(words) >= 3),
g AS (SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM p WHERE i <= len(words) - 2),
r AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g),
c AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words
      FROM r, (VALUES (0), (1), (2)) AS s(k) WHERE n > 1 GROUP BY rid),
l AS (SELECT rid, generate_subscripts(lines, 1) AS i, unnest(lines) AS line
      FROM (SELECT rid, string_split(text, chr(10)) AS lines FROM w)),
d AS (SELECT rid, sum(CASE WHEN k > 1 AND has THEN 1 ELSE 0 END) AS n_dup_lines, sum(CASE WHEN has THEN 1 ELSE 0 END) AS n_lines
      FROM (SELECT rid, regexp_matches(line, '[^\x20\x09-\x0D]') AS has,
                   row_number() OVER (PARTITION BY rid, line ORDER BY i) AS k FROM l) GROUP BY rid),
s AS (SELECT w.rid, doc_id, len(words) AS n_words,
             length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words,
             length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper,
             strlen(text) - length(regexp_replace(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]', '', 'g')) AS n_letter_bytes,
             strlen(text) AS n_bytes
      FROM w LEFT JOIN c ON c.rid = w.rid LEFT JOIN d ON d.rid = w.rid)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 20 * n_words
            OR 100 * n_upper > 40 * n_letter_bytes OR 100 * n_dup_lines > 50 * n_lines
            OR 100 * n_letter_bytes < 50 * n_bytes
            OR NOT (2 * n_words <= word_chars AND word_chars <= 20 * n_words)) AS kept
FROM s
"""
