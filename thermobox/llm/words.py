"""The words of many texts at once, as arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from thermobox.llm.common import BLANKS, LOWER, as_bytes

#: Everything but digits, letters a-z and bytes of non-ASCII characters becomes a blank; A-Z become a-z.
LETTERS = bytes(b if b in b"0123456789abcdefghijklmnopqrstuvwxyz" or b > 127 else 32 for b in LOWER)
#: White space becomes a blank.
BLANK = bytes(32 if b in BLANKS else b for b in range(256))
#: White space becomes a blank; A-Z become a-z.
VISIBLE = bytes(32 if b in BLANKS else b for b in LOWER)


class Words:
    """The words of some texts, in order; `clean` says what each byte becomes, a blank ends a word."""

    def __init__(self, texts: pa.Array, clean: bytes):
        values = as_bytes(texts)
        data = np.frombuffer((b" ".join(values) + b" ").translate(clean), dtype=np.uint8)
        letter = data != 32
        before = np.r_[False, letter[:-1]]
        starts, stops = np.flatnonzero(letter & ~before), np.flatnonzero(~letter & before)
        first = np.r_[0, np.cumsum([len(v) + 1 for v in values])]
        #: the texts' bytes as they are, a blank after each; where texts and words start in them
        self.raw, self.first, self.starts = np.frombuffer(b" ".join(values) + b" ", dtype=np.uint8), first[:-1], starts
        #: texts + 1: number of the first word of each text
        self.edges = np.searchsorted(starts, first)
        self.text = np.repeat(np.arange(len(values)), np.diff(self.edges))
        self.lengths = stops - starts
        offsets = np.r_[0, np.cumsum(self.lengths)]
        flat = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[letter])]
        )
        coded = flat.dictionary_encode()
        self.distinct, self.codes = coded.dictionary, coded.indices.to_numpy()
        #: the words, one blank after each
        self.joined = memoryview(data[letter | before])
        self.at = offsets[:-1] + np.arange(len(starts))

    def runs(self, n: int) -> np.ndarray:
        """Whether `n` words of one text start at each word."""
        whole = np.zeros(len(self.text), dtype=bool)
        if len(whole) >= n:
            whole[:len(whole) - n + 1] = self.text[n - 1:] == self.text[:len(whole) - n + 1]
        return whole
