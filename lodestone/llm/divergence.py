"""Quality rules by distribution divergence from language references.

The references come from the corpus itself: for each language label, the histogram of character
classes and of the COMMON most frequent words (and all others together), over all documents. A
document is compared with every reference by Jensen-Shannon distance (base 2, 0 to 1) and must
be near one of them in characters and in words. Short texts carry too little evidence: below
MIN_CHARS characters or MIN_WORDS words that histogram is not judged.

Base rules on words [^\\x20\\x09-\\x0D]+ come first: fewer than 10 words, or over a fifth of the
words inside 5-word windows that occur twice or more, fails.

Every label gives a reference, from exact counts of all its words. References are compared in
blocks of BLOCK labels, so that any number of labels is judged and a worker holds one block.

Defined cases: a null text has no words (all counts 0, failed); a null language counts as "";
repeated rows are judged one by one and all count for the references; if there are no references
(an empty table) nothing diverges; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import chain, groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.arrow import map_rows
from lodestone.session import materialize, table

COMMON = 64
#: Labels whose references are shipped to the workers at a time.
BLOCK = 2048
MIN_CHARS, MIN_WORDS = 120, 40
#: The greatest distance allowed: a constant, and a share that falls with the root of the text's size as chance does.
CHAR_LIMIT, WORD_LIMIT = (0.12, 2.0), (0.26, 1.05)
WINDOW = 5
#: Distinct words held before a partition's counts so far are handed on.
HELD_WORDS = 400_000
CLASSES = ("upper", "lower", "beyond ascii", "digit", "space", "mark", "symbol", "other")
SYMBOLS = "#*$%&|<>"

_CLASS = np.full(256, 2, np.uint8)
for _i in range(128):
    _c = chr(_i)
    _CLASS[_i] = 0 if _c.isupper() else 1 if _c.islower() else 3 if _c.isdigit() else 4 if _c in " \t\n\r\v\f" else 5 if _c in ".,;:!?'\"()-" else 6 if 32 < _i < 127 else 7


def character_classes(text: str) -> np.ndarray:
    """Counts of CLASSES."""
    raw = text.encode("latin-1", "replace") if text.isascii() else text.translate(_Beyond()).encode("latin-1", "replace")
    return np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=len(CLASSES))


class _Beyond(dict):
    """Maps code points outside Latin-1 to one that counts as beyond ASCII."""

    def __missing__(self, key: int) -> int:
        return key if key < 256 else 255


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms, base 2; 1 if one of them is empty."""
    if not p.sum() or not q.sum():
        return 1.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        total = np.where(p > 0, p * np.log2(p / m), 0).sum() + np.where(q > 0, q * np.log2(q / m), 0).sum()
    return float(np.sqrt(max(0.0, total / 2)))


def limit(rule: tuple[float, float], size: int) -> float:
    return rule[0] + rule[1] / size**0.5


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more in the text, their first occurrence included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    rank = ids[:n]
    for k in range(1, window):  # exact: a pair of ranks is a number below n squared
        rank = np.unique(rank * len(number) + ids[k : n + k], return_inverse=True)[1]
        if rank.max() == n - 1:
            return 0  # all windows differ already
    twice = np.bincount(rank)[rank] > 1
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, np.flatnonzero(twice), 1)
    np.add.at(edges, np.flatnonzero(twice) + window, -1)
    return int((np.cumsum(edges) > 0).sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.encode().split()]
    return len(lines) - len(set(lines))


class References(NamedTuple):
    characters: dict[str, np.ndarray]
    words: dict[str, dict[bytes, int]]  # the common words' numbers
    counts: dict[str, np.ndarray]  # of the common words, and of all others last


def divergences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The addends of twice the Jensen-Shannon divergence, base 2."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(p > 0, p * np.log2(2 * p / (p + q)), 0) + np.where(q > 0, q * np.log2(2 * q / (p + q)), 0)


class Nearest:
    """The least distances of a text to references, all of them at once."""

    def __init__(self, known: References) -> None:
        self.characters = np.array([q / q.sum() for q in known.characters.values() if q.sum()]).reshape(-1, len(CLASSES))
        self.none = not known.characters
        counts = [(known.words[x], q) for x, q in known.counts.items() if q.sum()]
        self.totals = np.array([q.sum() for _, q in counts])
        self.others = np.array([q[-1] for _, q in counts])
        lists: dict[bytes, list[tuple[int, float]]] = defaultdict(list)
        for i, (numbers, q) in enumerate(counts):
            for word, k in numbers.items():
                lists[word].append((i, q[k]))
        self.lists = {w: (np.array([i for i, _ in x]), np.array([k for _, k in x])) for w, x in lists.items()}

    def character_distance(self, classes: np.ndarray) -> float:
        if self.none:
            return 0.0
        if not len(self.characters) or not classes.sum():
            return 1.0
        total = divergences(classes / classes.sum(), self.characters).sum(axis=1).min()
        return float(np.sqrt(max(0.0, total / 2)))

    def word_distance(self, words: list[bytes]) -> float:
        if self.none:
            return 0.0
        if not len(self.totals) or not words:
            return 1.0
        seen, n, size = Counter(words), len(words), len(self.totals)
        absent, own, shared = self.totals - self.others, np.zeros(size), np.zeros(size)
        met = self.lists.keys() & seen.keys()
        if met:
            found = [self.lists[w] for w in met]
            at, k = np.concatenate([i for i, _ in found]), np.concatenate([x for _, x in found])
            times = np.repeat([seen[w] for w in met], [len(i) for i, _ in found])
            absent = absent - np.bincount(at, k, size)
            own = np.bincount(at, times, size)
            shared = np.bincount(at, divergences(times / n, k / self.totals[at]), size)
        # a bin that only the reference has adds its whole share
        total = (shared + absent / self.totals + divergences((n - own) / n, self.others / self.totals)).min()
        return float(np.sqrt(max(0.0, total / 2)))


def reference_blocks(docs: DataFrame) -> Iterator[References]:
    """Of docs(text, lang), BLOCK labels at a time."""
    fields = pa.schema([("lang", pa.string()), ("kind", pa.string()), ("name", pa.binary()), ("n", pa.int64())])

    def count(rows: Iterator[tuple]) -> Iterable[tuple]:
        chars: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(CLASSES), np.int64))
        words: dict[str, Counter] = defaultdict(Counter)
        totals: Counter = Counter()
        held = 0

        def hand_on() -> Iterator[tuple]:
            for lang, counter in words.items():
                n = counter.total()
                totals[lang] += n
                yield from ((lang, "word", w, k) for w, k in counter.items())
            words.clear()

        for text, lang in rows:
            if not text:
                continue
            lang = lang or ""
            chars[lang] += character_classes(text)
            words[lang].update(text.encode("utf-8", "surrogatepass").split())
            held += 1
            if held % 256 == 0 and sum(map(len, words.values())) > HELD_WORDS:
                yield from hand_on()
        yield from hand_on()
        for lang, counts in chars.items():
            yield from ((lang, "char", bytes([k]), int(n)) for k, n in enumerate(counts) if n)
        yield from ((lang, "total", b"", n) for lang, n in totals.items())

    counted = map_rows(docs.select("text", "lang"), count, "lang string, kind string, name binary, n long", fields)
    summed = counted.groupBy("lang", "kind", "name").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "name")
    chosen = materialize(summed.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= COMMON), "reference")
    # at most COMMON + classes + 1 rows a label, fetched a partition at a time
    found = References({}, {}, {})
    for lang, own in groupby(chosen.orderBy("lang", "kind", "rank").toLocalIterator(), lambda r: r["lang"]):
        if len(found.words) == BLOCK:
            yield found
            found = References({}, {}, {})
        chars, common, total = np.zeros(len(CLASSES)), [], 0
        for r in own:
            if r["kind"] == "char":
                chars[r["name"][0]] = r["n"]
            elif r["kind"] == "word":
                common.append(r)
            else:
                total = r["n"]
        counts = np.array([r["n"] for r in common], np.float64)
        found.characters[lang] = chars
        found.words[lang] = {bytes(r["name"]): i for i, r in enumerate(common)}
        found.counts[lang] = np.append(counts, total - counts.sum())
    yield found


def references(docs: DataFrame) -> References:
    """Of docs(text, lang), of all labels together."""
    found = References({}, {}, {})
    for block in reference_blocks(docs):
        for whole, part in zip(found, block):
            whole.update(part)
    return found


RESULT = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance")


def measured(rows: DataFrame, known: References) -> DataFrame:
    """Of rows(row, doc_id, text): RESULT without kept, with row, char_near and word_near."""
    counts = [(n, pa.int64()) for n in ("row", *RESULT[:6])]
    fields = pa.schema([*counts, *((n, pa.bool_()) for n in ("base_failed", "char_near", "word_near")), ("char_distance", pa.float64()), ("word_distance", pa.float64())])

    def run(records: Iterator[tuple]) -> Iterator[tuple]:
        nearest = Nearest(known)
        for row, doc, text in records:
            text = text or ""
            words = text.encode("utf-8", "surrogatepass").split()
            n = len(words)
            chars = len(text) - sum(map(text.count, " \t\n\r\v\f"))
            repeats = repeated_words(words)
            failed = n < 10 or 100 * repeats > 20 * n
            a = nearest.character_distance(character_classes(text)) if len(text) >= MIN_CHARS else None
            b = nearest.word_distance(words) if n >= MIN_WORDS else None
            near = (a is None or a <= limit(CHAR_LIMIT, len(text))), (b is None or b <= limit(WORD_LIMIT, n))
            yield row, doc, n, chars, sum(map(text.count, SYMBOLS)), duplicate_lines(text), repeats, failed, *near, a, b

    return map_rows(rows, run, "row long, doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, char_near boolean, word_near boolean, char_distance double, word_distance double", fields)


def judge(docs: DataFrame, known: References | Iterator[References], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, char_distance, word_distance)."""
    blocks = iter([known] if isinstance(known, References) else known)
    first, second = next(blocks), next(blocks, None)
    row = F.lit(0).cast("long") if second is None else F.monotonically_increasing_id()
    rows = docs.select(row.alias("row"), F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    if second is None:
        found = measured(rows, first)
    else:
        rows = materialize(rows, "rows")  # fixes the row numbers for all passes
        passes = [materialize(measured(rows, block), "measured") for block in chain([first, second], blocks)]
        same = [F.first(c).alias(c) for c in RESULT[:7]]
        near = [F.bool_or(c).alias(c) for c in ("char_near", "word_near")]
        found = reduce(DataFrame.union, passes).groupBy("row").agg(*same, *near, *(F.min(c).alias(c) for c in RESULT[8:]))
    return found.withColumn("kept", F.col("char_near") & F.col("word_near") & ~F.col("base_failed")).select(*RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, reference_blocks(docs))
