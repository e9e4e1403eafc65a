"""Token ids of whole texts, with a memo of word pieces in front of the tokenizers library.

The vocabulary this serves (lower case, word ends, white space dropped) cuts a text into
pieces with a fixed pattern and never merges across them, so the ids of a text are those of
its pieces in order. Pieces repeat: each distinct one is encoded by the library once per
worker and remembered by its 64-bit hash: of n different pieces between two emptyings of the memo
(MEMO_LIMIT at most) some two share one with probability n squared / 2^65, under 2e-8. Texts outside Latin-1, with contractions or with the
strings of special tokens go to the library whole. tests/llm holds the result against the
library's encoding of whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd

from lodestone.llm.textblocks import span_hashes

#: Remembered pieces; the memo is emptied when full, which costs time and changes nothing.
MEMO_LIMIT = 800_000
#: Characters encoded together.
GROUP = 1 << 21
#: A text over this is cut at white space before it is encoded.
LONG = 1 << 21
CUT = re.compile(r"[\t-\r ]")
#: Texts with these go to the library whole: pieces that the run rule below does not describe.
SPECIAL = re.compile(r"<\||'(?:[stmd]|re|ve|ll)", re.IGNORECASE)
WORD_END = "</w>"


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Lower case of Latin-1, and the class of each: 0 white space, 1 letter, 2 number, 3 other."""
    import unicodedata

    lower = np.arange(256, dtype=np.uint8)
    kind = np.full(256, 3, np.uint8)
    for i in range(256):
        c = chr(i)
        if len(c.lower()) == 1 and ord(c.lower()) < 256:
            lower[i] = ord(c.lower())
        group = unicodedata.category(c)[0]
        kind[i] = 0 if c in "\t\n\v\f\r \x85\xa0" else 1 if group == "L" else 2 if group == "N" else 3
    return lower, kind


LOWER, KIND = _tables()


class WordEncoder:
    """encode_all(texts) gives each text's ids as an array of unsigned 32-bit integers, no special tokens added."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.pieces = Tokenizer(self.whole.model)  # the same vocabulary in memory
        self.pieces.normalizer = normalizers.Sequence([])
        self.pieces.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.whole.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)  # hashes of remembered pieces, ascending
        self.rows = np.zeros(0, np.int32)  # and the row of each
        self.at = np.zeros(1024, np.int64)  # where a remembered piece's ids begin, and one more
        self.ids = np.zeros(4096, np.uint32)

    def encode(self, text: str | None) -> np.ndarray:
        return next(self.encode_all([text]))

    def encode_all(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """In the order of texts; a null text has no ids."""
        held: list[str] = []
        size = 0
        for text in texts:
            text = text or ""
            if len(text) > LONG:
                yield from self._group(held)
                held, size = [], 0
                yield np.concatenate([ids for part in _parts(text) for ids in self._group([part])])
                continue
            held.append(text)
            size += len(text)
            if size > GROUP:
                yield from self._group(held)
                held, size = [], 0
        yield from self._group(held)

    def _group(self, texts: list[str]) -> Iterator[np.ndarray]:
        if not texts:
            return
        raw: list[bytes] = []
        whole: list[int] = []
        for i, text in enumerate(texts):
            try:
                raw.append(text.encode("latin-1"))
                if ("'" in text or "<|" in text) and SPECIAL.search(text):
                    raise ValueError
            except ValueError:
                del raw[i:]
                raw.append(b"")
                whole.append(i)
        others = dict(zip(whole, self.whole.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False))) if whole else {}
        ends = np.cumsum([len(x) for x in raw])
        block = LOWER[np.frombuffer(b"".join(raw), np.uint8)]
        flat, bounds = self._latin(block, np.concatenate([[0], ends]))
        for i in range(len(texts)):
            yield np.array(others[i].ids, np.uint32) if i in others else flat[bounds[i] : bounds[i + 1]]

    def _latin(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts at[i]..at[i + 1] of lower-case Latin-1 data: all of them, and each text's bounds there."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        kind = KIND[data]
        begin = np.ones(len(data) + 1, bool)
        begin[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        begin[at] = True
        starts = np.flatnonzero(begin[:-1])
        ends = np.append(starts[1:], len(data))
        keep = kind[starts] > 0
        starts, ends = starts[keep], ends[keep]
        order, distinct = pd.factorize(span_hashes(data, starts, ends))
        rows = self._rows(data, starts, ends, order, distinct)[order]
        lengths = self.at[rows + 1] - self.at[rows]
        stops = np.cumsum(lengths)
        total = int(stops[-1]) if len(stops) else 0
        flat = self.ids[np.repeat(self.at[rows] - (stops - lengths), lengths) + np.arange(total)]
        bounds = np.concatenate([[0], stops])[np.searchsorted(starts, at)]
        return flat, bounds

    def _rows(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, order: np.ndarray, distinct: np.ndarray) -> np.ndarray:
        rows = self._remembered(distinct)
        missing = np.flatnonzero(rows < 0)
        if not len(missing):
            return rows
        n = len(self.known)
        if n + len(missing) > MEMO_LIMIT and n:
            self._forget()
            return self._rows(data, starts, ends, order, distinct)
        first = np.zeros(len(distinct), np.int64)
        first[order[::-1]] = np.arange(len(order))[::-1]
        raw = data.tobytes()
        spans = zip(starts[first[missing]].tolist(), ends[first[missing]].tolist())
        texts = [raw[a:b].decode("latin-1") for a, b in spans]
        for i in range(0, len(texts), 1024):
            self._learn(n + i, texts[i : i + 1024])
        rows[missing] = np.arange(n, n + len(missing))
        missing = missing[np.argsort(distinct[missing])]
        at = np.searchsorted(self.known, distinct[missing])
        self.known = np.insert(self.known, at, distinct[missing])
        self.rows = np.insert(self.rows, at, rows[missing])
        return rows

    def _remembered(self, keys: np.ndarray) -> np.ndarray:
        """The row of each piece, -1 for those not known."""
        if not len(self.known):
            return np.full(len(keys), -1, np.int64)
        at = np.minimum(np.searchsorted(self.known, keys), len(self.known) - 1)
        return np.where(self.known[at] == keys, self.rows[at], -1).astype(np.int64)

    def _learn(self, n: int, pieces: list[str]) -> None:
        """Ids of the pieces that get the rows from n on."""
        ids = np.array(self.pieces.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids, np.uint32)
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(pieces):
            raise ValueError("this vocabulary does not mark the end of each word piece")
        base = self.at[n]
        while len(self.at) < n + len(pieces) + 1:
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        while len(self.ids) < base + len(ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.at[n + 1 : n + len(pieces) + 1] = base + stops
        self.ids[base : base + len(ids)] = ids


def _parts(text: str) -> Iterator[str]:
    """A long text in pieces that end before white space."""
    begin = 0
    while begin < len(text):
        cut = CUT.search(text, begin + LONG)
        end = cut.start() if cut else len(text)
        yield text[begin:end]
        begin = end


@cache
def encoder(path: str) -> WordEncoder:
    """One encoder a worker process, kept from task to task."""
    return WordEncoder(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
