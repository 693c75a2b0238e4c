"""Personal data: exact patterns, plus spans from a linear-chain conditional random field.

The base spans are the leftmost non-overlapping matches of one pattern per kind, checked (octets, Luhn,
digit counts) and dropped without retry where the check fails. The CRF reads words (split at ASCII
blanks) through features of their shape and of their neighbours' shapes; it is trained from the small
labelled table below and decoded by Viterbi, many chains at a time in numpy. Every line of every text is a chain, of
whatever length. Runs of one label become a span; spans that meet a base span are dropped.

Defined results: a null text is empty; rows are judged one by one, so repeated rows give equal
results; a null `doc_id` is carried along; an empty table gives no rows. Offsets count code points.
Other columns of `docs` are not read by `find_pii`, and kept by `redact`.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermobox.llm.common import map_texts, pieces
from thermobox.llm.crf import Crf, train, viterbi
from thermobox.llm.words import BLANK, Words

KINDS = ("email", "ip", "card", "phone")
LABELS = ("o", "email", "ip", "card", "phone", "secret")

# --- base spans -----------------------------------------------------------------------------

# The contract's patterns. A match can start inside a run of digits only if the
# run's start could not match, so looking back for a digit changes nothing but the time.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL_TAIL = re.compile(r"[A-Za-z0-9._%+-]*+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def _small(part: str) -> bool:
    significant = part.lstrip("0")
    return len(significant) < 4 and int(significant or 0) <= 255


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end), sorted."""
    found = [(a, 0, b) for a, b in _emails(text)]
    found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _digits(m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(found)


# --- the labelled table ---------------------------------------------------------------------

#: [kind words] marks a span; every other word is O. Invented addresses, numbers and keys.
TRAINING = """
write to [email ann.lee@mail.example.org] before noon
reply at [email bob42@site7.example.com] or call later
mail: [email k.j_smith+news@a-b.example.net], thanks
contact [email info@example.co.uk]. We answer soon
der Brief ging an [email post.12@mail3.example.de] gestern abend
[email x1@y2.example] is the address
she wrote [email maria.sol.9@correo.example.es] and left
server [ip 10.0.0.12] did not answer
from [ip 192.168.1.254], port 8080 was open
logged in from [ip 203.0.113.77] at night
hosts [ip 8.8.4.4] and [ip 172.16.254.1] were seen
la máquina [ip 198.51.100.9] no responde
card [card 4111111111111111] was charged
pay with [card 5500 0000 0000 0004] today
number [card 4012-8888-8888-1881] is on file
carte [card 6011000990139424] refusée hier
the [card 4222222222222220] of the customer
[card 3530 1113 3330 0000] expires soon
call [phone +1 (212) 555-0147] for help
phone [phone +44 20 7946 0018] any time
tel [phone (415) 555-0132] or leave a note
ring [phone 555-0199] after six
my number is [phone +49 30 901820] at home
fax [phone 617-555-0110] and wait
appelez le [phone +33 1 99 00 12 34] demain
llame al [phone +34 910 123 456] ahora
reach us: [phone (800) 555-0175]. Ask for Ann
token = [secret "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"] was found
api_key: [secret 3c6e0b8a9c15224a8228b9a98ca1531d] do not share
[secret password=hunter2x77] in the file
the old line [phone 555-0163] was noted
under [phone 555-0188] we are open
she gave [phone 555-0121] and then [phone (303) 555-0190] to us
set [secret password=a94a8fe5ccb19ba61c] and restart
they left [secret password=opensesame] in a note
[secret secret=tangerine] was all it took
with [secret token=swordfish], nobody asked
the line [secret passwd=Correct-Horse] stood there
x = y holds when a=b and c=d
size=large colour=red and so on
he gave the password to nobody
the secret of the house is old
a token of thanks was sent
secret = [secret "b1946ac92492d2347c6235b4d2611184"] in the log
version 2.0 of the work and 3.1 of the other
licensed under the terms of version 2.0. All of it
in 1998 there were 42 houses and 17 barns
chapter 12 has 300 pages, of which 45 are new
the price rose from 3.50 to 4.25 in 2019
on 12/05/2021 at 10:45 the train left
room 101 and room 2b are free
a+b is not c+d in C++ or Java
see section 4.1.2 for more, then 4.1.3
about 1,000,000 people and 250,000 cars
he scored 21-17 and then 6-4
@ noon we met, @bob said hello
the year 2024-01-15 was noted as 20240115
under license 3. The rest is free
5 of 10 and 3% of 7% were left
order 4471 of lot 99-b was late
the word stands here alone and nothing follows it
and then the next line of plain words goes on
"quoted words" are plain as well
no. 7 and no. 8 were sold on day 3.
""".strip()

_CANDIDATE = re.compile(r"[0-9@+]")
_HEX = re.compile(r"[0-9a-f]{16,}")


def _training_rows() -> list[tuple[list[str], list[int]]]:
    rows = []
    for line in TRAINING.splitlines():
        words, labels, label = [], [], 0
        for raw in line.split():
            if raw.startswith("["):
                label = LABELS.index(raw[1:])
                continue
            words.append(raw.replace("]", ""))
            labels.append(label)
            if "]" in raw:
                label = 0
        rows.append((words, labels))
    return rows


# --- features -------------------------------------------------------------------------------

FEATURES = (
    "bias", "digit", "no_digit", "at", "at_dot", "plus", "paren_digits", "dots_3", "dots_1", "hyphen_digits", "only_digits",
    "digits_1_2", "digits_3", "digits_4", "digits_5_9", "digits_10_13", "digits_14_19", "digits_20", "quote", "hex", "equals",
    "letter_digit", "comma_digits", "slash_colon", "cue_phone", "cue_card", "cue_mail", "cue_net", "cue_key", "cue_number", "percent", "digits_7_split",
    "key_equals",
)
_CUES = {
    "cue_phone": ("call", "phone", "tel", "ring", "fax", "appelez", "llame", "reach"),
    "cue_card": ("card", "carte", "pay", "charged"), "cue_mail": ("mail", "email", "write", "contact", "reply", "address"),
    "cue_net": ("server", "host", "hosts", "from", "ip"), "cue_key": ("token", "api_key", "secret", "password", "passwd", "="),
    "cue_number": ("version", "chapter", "section", "room", "no", "order", "license", "page", "lot", "in"),
}
_CUE_OF = {word: cue for cue, words in _CUES.items() for word in words}


_EDGES = ".,;:!?\"'"
#: What holds of a word without digit, @, +, =, quote or cue.
_PLAIN = [FEATURES.index("bias"), FEATURES.index("no_digit")]


def shape(word: str) -> list[int]:
    """Places in FEATURES of what holds of a word."""
    core = word.strip(_EDGES)
    key, equals, value = core.partition("=")
    given = bool(key and value) and _CUE_OF.get(key.strip("\"'").lower()) == "cue_key"
    if not _CANDIDATE.search(word):
        cue = _CUE_OF.get(core.lower())
        names = ["bias", "no_digit"] + [cue] * bool(cue) + ["cue_key"] * (word == "=")
        names += ["quote"] * word.startswith('"') + ["equals"] * bool(key and equals) + ["key_equals"] * given
        return [FEATURES.index(n) for n in dict.fromkeys(names)]
    n = len(_digits(core))
    letters = any(c.isalpha() for c in core)
    digits_only = core.replace(".", "").replace("-", "")
    tests = {
        "bias": True, "digit": n > 0, "no_digit": n == 0, "at": "@" in core,
        "at_dot": "@" in core[1:] and "." in core.partition("@")[2], "plus": core.startswith("+") and n > 0,
        "paren_digits": core.startswith("(") and core.endswith(")") and core[1:-1].isdigit(),
        "dots_3": core.count(".") == 3 and digits_only.isdigit(), "dots_1": core.count(".") in (1, 2) and digits_only.isdigit(),
        "hyphen_digits": "-" in core and core.replace("-", "").isdigit(), "only_digits": core.isdigit(),
        "digits_1_2": 1 <= n <= 2, "digits_3": n == 3, "digits_4": n == 4, "digits_5_9": 5 <= n <= 9,
        "digits_10_13": 10 <= n <= 13, "digits_14_19": 14 <= n <= 19 and not letters, "digits_20": n >= 20 and not letters,
        "quote": word.startswith('"'), "hex": bool(_HEX.search(core)) and letters, "equals": "=" in core,
        "letter_digit": letters and n > 0, "comma_digits": "," in core and core.replace(",", "").isdigit(),
        "slash_colon": "/" in core or ":" in core, "percent": "%" in core,
        "key_equals": given, "digits_7_split": n == 7 and len(core) == 8 and core[3:4] == "-",
    }
    return [i for i, name in enumerate(FEATURES) if tests.get(name)]


def _one_hot(words: list[str]) -> np.ndarray:
    out = np.zeros((len(words), len(FEATURES)))
    for i, word in enumerate(words):
        out[i, shape(word)] = 1
    return out


@functools.cache
def trained() -> Crf:
    """The CRF of the labelled table."""
    return train([(_one_hot(words), np.array(labels)) for words, labels in _training_rows()], len(FEATURES), len(LABELS))


# --- texts ----------------------------------------------------------------------------------


def _trim(text: str, start: int, end: int) -> tuple[int, int]:
    while start < end and text[start] in "\"'<[{,;:":
        start += 1
    while end > start and text[end - 1] in "\"'>]},;:.!?":
        end -= 1
    return start, end


#: Words whose features a worker keeps; beyond it the memory is emptied and refilled.
CACHED_WORDS = 200_000
_SHAPES: dict[str, list[int]] = {}


def _distinct_scores(words: Words, crf: Crf) -> np.ndarray:
    """What each distinct word gives to the labels of the word after it, its own and that of the word before: (3, words, labels)."""
    if len(_SHAPES) > CACHED_WORDS:
        _SHAPES.clear()
    strings = words.distinct.cast(pa.large_string())
    cue = pc.is_in(pc.utf8_lower(pc.utf8_trim(strings, characters=_EDGES)), value_set=pa.array(_CUE_OF, pa.large_string()))
    special = pc.or_(pc.match_substring_regex(strings, r'[0-9@+="]'), cue).to_numpy(zero_copy_only=False)
    scores = np.empty((3, len(strings), len(LABELS)))
    scores[:] = crf.own[:, _PLAIN].sum(axis=1)[:, None]
    at = np.flatnonzero(special)
    shapes = []
    for word in strings.take(pa.array(at)).to_pylist():
        found = _SHAPES.get(word)
        if found is None:
            found = shape(word)
            if len(word) < 40:
                _SHAPES[word] = found
        shapes.append(found)
    if shapes:
        first = np.cumsum([0] + [len(s) for s in shapes[:-1]])
        scores[:, at] = np.add.reduceat(crf.own[:, np.concatenate(shapes)], first, axis=1)
    return scores


def _surely_plain(scores: np.ndarray, edges: np.ndarray, crf: Crf) -> np.ndarray:
    """Chains whose best labels are all O, as seen without decoding.

    A path that leaves O at some words gains at those words and at the steps on either side; if every word loses more by
    leaving O than its two steps can gain, no path is better than O throughout.
    """
    if len(edges) < 2 or not len(scores):
        return np.ones(max(0, len(edges) - 1), dtype=bool)
    into = np.maximum(0.0, crf.move - crf.move[0, 0])[:, 1:].max(axis=0)  # the most that a step into a label gains
    back = np.maximum(0.0, crf.move[1:, 0] - crf.move[0, 0])  # and a step from it to O
    first, last = edges[:-1], edges[1:] - 1
    gain = scores[:, 1:] - scores[:, :1] + into + back
    gain[first] += np.maximum(0.0, crf.ends[0, 1:] - crf.ends[0, 0])
    gain[last] += np.maximum(0.0, crf.ends[1, 1:] - crf.ends[1, 0])
    return np.maximum.reduceat(gain.max(axis=1), first) < 0


def crf_spans(texts: list[str], crf: Crf) -> list[list[tuple[int, str, int]]]:
    """(start, kind, end) of the runs of one label in each text; a line is a chain."""
    spans: list[list[tuple[int, str, int]]] = [[] for _ in texts]
    words = Words(pa.array(texts, pa.large_string()), BLANK)
    if not len(words.codes):
        return spans
    to_next, own, to_previous = (s[words.codes] for s in _distinct_scores(words, crf))
    line = np.cumsum(words.raw == 10)[words.starts]
    same = (words.text[1:] == words.text[:-1]) & (line[1:] == line[:-1])
    own[1:] += to_next[:-1] * same[:, None]
    own[:-1] += to_previous[1:] * same[:, None]
    edges = np.r_[0, np.flatnonzero(~same) + 1, len(own)]
    labels = np.zeros(len(own), dtype=np.int64)
    unsure = np.flatnonzero(~_surely_plain(own, edges, crf))
    for i, best in zip(unsure, viterbi([own[edges[i]:edges[i + 1]] for i in unsure], crf.move, crf.ends)):
        labels[edges[i]:edges[i + 1]] = best
    change = np.r_[True, ~same | (labels[1:] != labels[:-1])]
    first = np.flatnonzero(change)
    last = np.r_[first[1:], len(labels)] - 1
    found = labels[first] > 0
    for a, b in zip(first[found].tolist(), last[found].tolist()):
        i = words.text[a]
        text, begin = texts[i], words.first[i]
        # bytes to code points: bytes that continue a character do not count
        start, end = (int(np.count_nonzero((words.raw[begin:stop] & 0xC0) != 0x80)) for stop in (words.starts[a], words.starts[b] + words.lengths[b]))
        start, end = _trim(text, start, end)
        if start < end:
            spans[i].append((start, LABELS[labels[a]], end))
    return spans


def all_spans(texts: list[str], crf: Crf) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, str, int]]]]:
    """Per text the base spans, and all spans (start, kind, end): base ones and those of the CRF that meet none."""
    out = []
    for text, more in zip(texts, crf_spans(texts, crf)):
        base = base_spans(text)
        taken = sorted((a, b) for a, _, b in base)
        kept, at, reach = [], 0, 0
        for start, kind, end in more:
            while at < len(taken) and taken[at][0] < end:
                reach = max(reach, taken[at][1])
                at += 1
            if reach <= start:
                kept.append((start, kind, end))
        both = [(a, KINDS[k], b) for a, k, b in base] + kept
        order = {kind: i for i, kind in enumerate(LABELS[1:])}
        out.append((base, sorted(both, key=lambda s: (s[0], order[s[1]], s[2]))))
    return out


def _joined(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


PII = ", ".join(["doc_id long", *(f"n_{k} long" for k in KINDS), "base_sha256 string", "spans string"])


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, the number of base spans by kind, a digest of the base spans, all spans."""
    crf = trained()
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 2 << 20):
            found = all_spans([t or "" for t in batch.column("text").to_pylist()], crf)
            counts = [pa.array([sum(s[1] == k for s in base) for base, _ in found], pa.int64()) for k in range(len(KINDS))]
            digests = [hashlib.sha256(_joined((a, KINDS[k], b) for a, k, b in base).encode()).hexdigest() for base, _ in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *counts, pa.array(digests, pa.string()), pa.array([_joined(s) for _, s in found], pa.string())],
                names=names,
            )

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, PII)


def redact(docs: DataFrame) -> DataFrame:
    """`docs` with every span of `text` replaced by <KIND>; where spans overlap, by the first one's kind."""
    crf = trained()

    def masked(text: str | None, spans: list[tuple[int, str, int]]) -> str | None:
        if not spans:
            return text
        parts, done = [], 0
        for start, kind, end in spans:
            if start >= done:
                parts += [text[done:start], f"<{kind.upper()}>"]
            done = max(done, end)
        return "".join(parts) + text[done:]

    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 2 << 20):
            texts = batch.column("text").to_pylist()
            found = all_spans([t or "" for t in texts], crf)
            new = pa.array([masked(t, s) for t, (_, s) in zip(texts, found)], batch.schema.field("text").type)
            columns = list(batch.columns)
            columns[at] = new
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return map_texts(docs, run, docs.schema)
