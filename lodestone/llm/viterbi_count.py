"""Token counts of a unigram vocabulary by a Viterbi pass that keeps no path.

An Aho-Corasick automaton finds every vocabulary piece that ends at each position; dynamic
programming carries, for each position, the best score so far and the number of pieces on that
path. Tie rules are those of the tokenizers library's Unigram model: of equal scores the piece
that starts earliest wins; a character that is no piece itself costs the lowest score less 10 as
an unknown, and a run of unknowns counts as one token.

Pieces and scores are read from a public vocabulary file. Where no piece crosses a word border
and scores are whole numbers (so sums are exact in any order), words are independent: each
distinct word of up to MEMO_CHARS characters is segmented once per worker and its count
remembered. The pass holds no more than HELD positions, however long a text without spaces is.

Defined cases: a null or empty text has 0 tokens; repeated rows are counted one by one; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.arrow import map_rows
from lodestone.session import table

SPACE = "▁"
WORD = re.compile(f"{SPACE}+[^{SPACE}]*")
UNKNOWN_PENALTY = 10.0
#: Words remembered, and the longest of them.
MEMO_LIMIT, MEMO_CHARS = 400_000, 200
#: Positions held before all but the last ones are let go.
HELD = 1 << 16


def vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of the ordinary pieces of a SentencePiece file."""
    import sentencepiece

    known = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(known.id_to_piece(i), known.get_score(i)) for i in range(known.get_piece_size()) if not (known.is_control(i) or known.is_unknown(i) or known.is_byte(i) or known.is_unused(i))]


class Counter:
    """count(text) gives the number of tokens."""

    def __init__(self, pieces: list[tuple[str, float]]) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.longest = max(len(piece) for piece, _ in pieces)
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        crossing = any(SPACE in piece.lstrip(SPACE) for piece, _ in pieces)
        self.by_word = not crossing and all(float(score).is_integer() for _, score in pieces) and any(piece == SPACE for piece, _ in pieces)
        self.memo: dict[str, int] = {}

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        text = SPACE + text.replace(" ", SPACE)
        if not self.by_word:
            return self.viterbi(text)
        words = WORD.findall(text)
        memo = self.memo
        rare = sum(self.viterbi(word) for word in words if len(word) > MEMO_CHARS)
        words = [word for word in words if len(word) <= MEMO_CHARS]
        missing = set(words).difference(memo)
        if missing:
            if len(memo) + len(missing) > MEMO_LIMIT:
                memo.clear()
                missing = set(words)
            for word in missing:
                memo[word] = self.viterbi(word)
        return rare + sum(map(memo.__getitem__, words))

    def viterbi(self, text: str) -> int:
        n = len(text)
        score, count, unknown = [0.0], [0], [False]  # of the last positions, at least as many as the longest piece has characters
        base = 0
        found = self.automaton.iter(text)
        end, match = next(found, (n, None))
        for i in range(n):
            best, start, single = None, i, False
            while end == i:
                length, gain = match
                at = i + 1 - length
                gain += score[at - base]
                if best is None or gain > best or gain == best and at < start:
                    best, start = gain, at
                single = single or length == 1
                end, match = next(found, (n, None))
            gain = score[-1] + self.unknown
            if not single and (best is None or gain > best):
                count.append(count[-1] + (not unknown[-1]))
                score.append(gain)
                unknown.append(True)
            else:
                score.append(best)
                count.append(count[start - base] + 1)
                unknown.append(False)
            if len(score) > HELD:
                cut = len(score) - self.longest - 1
                del score[:cut], count[:cut], unknown[:cut]
                base += cut
        return count[-1]


@cache
def counter(path: str) -> Counter:
    return Counter(vocabulary(path))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def count_tokens(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) of every whole text."""
    path = path or default_vocabulary()

    def run(rows: Iterator[tuple]) -> Iterable[tuple]:
        known = counter(path)
        for doc, text in rows:
            yield doc, known.count(text)

    chosen = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return map_rows(chosen, run, "doc_id long, n_tokens long", pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
