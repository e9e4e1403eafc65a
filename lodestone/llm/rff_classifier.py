"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

1. Every whole text becomes a short vector of statistics (lengths, character classes, repetition,
   case, punctuation, line shapes, and the worst stretch of 64 words by marks, repetition, capitals
   and pipes, which are what junk lines of web pages are made of). Language, source, id and
   labels are never among them.
2. Labelled rows whose crc32(doc_id as text) mod 3 is not 1 teach. About MAX_TRAIN_ROWS of them
   are used if there are more (those with the lowest hashes, by their share). Three quarters fit the scores,
   one quarter calibrates them, split by another hash.
3. Standardised statistics go through COS features cos(wx + b) that approximate a Gaussian kernel;
   each partition sums its share of the normal equations, the shares are added and ridge weights
   solved: what reaches the driver is one matrix, whatever the input.
4. Raw scores of calibrating rows are counted in fixed bins; pool-adjacent-violators on the bins
   gives a monotone map to 0..1, interpolated between pooled centres.

Defined cases: null and empty texts have all-zero statistics and are scored like any other; rows
with a null label do not teach; repeated doc_ids each teach and are each scored; without any
teaching row of both labels every score is the share of label 1 (0.5 if there is none); an empty
table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.arrow import lean
from lodestone.llm.arrow import rows as row_tuples
from lodestone.session import materialize, table

MAX_TRAIN_ROWS = 200_000
COS = 256
#: Added to the diagonal of the normal equations, a row.
RIDGE = 3.5e-6
BINS = 1000
LOW, HIGH = -0.5, 1.5
SEED = 7

STATISTICS = (
    "log_chars", "log_words", "mean_word", "sd_word", "upper", "digit", "space", "symbol", "mark", "other", "newline", "pipe", "bang",
    "caps_words", "symbol_words", "distinct_words", "top_word", "same_as_before", "distinct_lines", "mean_line", "line_ends", "entropy", "short_words", "bare_marks", "worst_symbols", "worst_repeat", "worst_caps", "worst_pipe",
)

_CLASS = np.full(256, 5, np.uint8)  # other letters and everything outside ASCII


def _classes() -> None:
    for i in range(128):
        c = chr(i)
        _CLASS[i] = 0 if c.isupper() else 1 if c.isdigit() else 2 if c in " \t\r\v\f\n" else 3 if c in "#*$%&|<>@^~_=+\\/{}[]" else 4 if c in ".,;:!?'\"()-" else 5 if c.isalpha() else 6


_classes()


def _counts(raw: bytes) -> np.ndarray:
    return np.bincount(np.frombuffer(raw.translate(_CLASS.tobytes()), np.uint8), minlength=7)


def statistics(text: str | None) -> list[float]:
    """The vector of STATISTICS of a whole text."""
    text = text or ""
    words = text.split()
    if not words:
        return [0.0] * len(STATISTICS)
    raw = text.encode("latin-1", "replace")
    n, m = len(text), len(words)
    counts = _counts(raw) / n
    lengths = np.fromiter(map(len, words), np.float64, m)
    seen = Counter(words)
    same = sum(map(str.__eq__, words, words[1:])) / m
    lines = [x for x in text.split("\n") if x.strip()]
    ends = sum(x.rstrip()[-1:] in ".!?" for x in lines) / len(lines)
    share = np.fromiter(seen.values(), np.float64, len(seen)) / m
    caps = sum(map(str.isupper, words)) / m
    last = Counter(map(_last, words))
    symbols = sum(v for k, v in last.items() if k in "#*$%&|<>") / m
    # junk often fills only some lines of a long text: the worst window of words counts as well
    worst = [0.0, 0.0, 0.0, 0.0]
    for at in (*range(0, m - 64, 64), max(0, m - 64)):  # the last window is as long as the others
        part = words[at : at + 64]
        k = len(part)
        worst[0] = max(worst[0], sum(w[-1] in "#*$%&<>" for w in part) / k)
        worst[1] = max(worst[1], 1 - len(set(part)) / k)
        worst[2] = max(worst[2], sum(map(str.isupper, part)) / k)
        worst[3] = max(worst[3], part.count("|") / k)
    return [
        np.log1p(n), np.log1p(m), lengths.mean(), lengths.std(), counts[0], counts[1], counts[2], counts[3], counts[4], counts[6],
        raw.count(b"\n") / m, raw.count(b"|") / m, raw.count(b"!") / m, caps, symbols, len(seen) / m, share.max(), same, len(set(lines)) / len(lines),
        np.log1p(m / len(lines)), ends, float(-(share * np.log(share)).sum() / max(1.0, np.log(m))), float((lengths <= 3).mean()), sum(w in "|-*#" for w in seen) / len(seen), *worst,
    ]


def _last(word: str) -> str:
    return word[-1]


def features(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, stats array<float>) of every whole text."""
    fields = pa.schema([("doc_id", pa.int64()), ("stats", pa.list_(pa.float32()))])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list] = ([], [])
        for doc, text in row_tuples(batches):
            held[0].append(doc)
            held[1].append(np.array(statistics(text), np.float32))
            if len(held[0]) == 2048:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(held, fields)], schema=fields)
                held = ([], [])
        if held[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(held, fields)], schema=fields)

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, "doc_id long, stats array<float>")


class Model(NamedTuple):
    centre: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray  # raw scores
    values: np.ndarray  # calibrated scores at the knots

    def raw(self, x: np.ndarray) -> np.ndarray:
        return expand(self, x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.values), 0.0, 1.0)


def expand(model: Model, x: np.ndarray) -> np.ndarray:
    """Cosine features of standardised statistics, and a one."""
    z = np.clip((x - model.centre) / model.scale, -8, 8)
    return np.hstack([np.sqrt(2 / COS) * np.cos(z @ model.frequencies + model.phases), np.ones((len(z), 1))])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def pool(counts: np.ndarray, ones: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: (centres of the pooled blocks, their shares of ones), both ascending."""
    blocks: list[list[float]] = []
    for n, k, c in zip(counts.tolist(), ones.tolist(), centres.tolist()):
        if not n:
            continue
        blocks.append([n, k, n * c])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            top = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], top)]
    a = np.array(blocks).reshape(-1, 3)
    return a[:, 2] / a[:, 0], a[:, 1] / a[:, 0]


def fit(taught: DataFrame) -> Model:
    """taught: (doc_id, stats, label 0/1), the rows that teach, few enough by the caller's bound."""
    d = len(STATISTICS)
    rng = np.random.default_rng(SEED)
    split = F.pmod(F.xxhash64("doc_id", F.lit("calibrate")), F.lit(4)) == 0
    spread = [f(F.col("stats")[i]).alias(f"{n}{i}") for i in range(d) for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    row = taught.agg(*spread, F.count("*").alias("n"), F.avg("label").alias("share")).first()
    share = 0.5 if row["share"] is None else float(row["share"])
    centre = np.array([row[f"m{i}"] or 0.0 for i in range(d)])
    scale = np.array([row[f"s{i}"] or 1.0 for i in range(d)])
    model = Model(centre, scale, rng.normal(0, 1 / np.sqrt(2 * d), (d, COS)), rng.uniform(0, 2 * np.pi, COS), np.zeros(COS + 1), np.array([0.0]), np.array([share]))
    if not row["n"] or not 0 < share < 1:
        return model
    size = COS + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            z = expand(model, _matrix(batch.column("stats")))
            total += z.T @ np.column_stack([z, batch.column("label").to_numpy(zero_copy_only=False)])
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["line", "share"])

    def added(lines: pa.Table) -> pa.Table:
        total = _matrix(lines.column("share").combine_chunks()).sum(0)
        return pa.table({"line": lines.column("line").slice(0, 1), "share": pa.array([total], pa.list_(pa.float64()))})

    parts = taught.filter(~split).select("stats", "label").mapInArrow(sums, "line int, share array<double>")
    lines = parts.groupBy("line").applyInArrow(added, "line int, share array<double>").collect()  # one matrix of fixed size
    system = np.array([r["share"] for r in sorted(lines, key=lambda r: r["line"])])
    n = system[-1, size - 1]
    model = model._replace(weights=np.linalg.solve(system[:, :size] + RIDGE * max(n, 1) * np.eye(size), system[:, size]))

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = model.raw(_matrix(batch.column("stats")))
            at = np.clip((raw - LOW) / (HIGH - LOW) * BINS, 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column("label").cast(pa.int32())], names=["bin", "label"])

    seen = taught.filter(split).select("stats", "label").mapInArrow(binned, "bin int, label int").groupBy("bin").agg(F.count("*").alias("n"), F.sum("label").alias("k")).collect()
    counts, ones = np.zeros(BINS), np.zeros(BINS)
    for r in seen:
        counts[r["bin"]], ones[r["bin"]] = r["n"], r["k"]
    if not counts.sum():
        return model._replace(knots=np.array([0.0, 1.0]), values=np.array([0.0, 1.0]))
    knots, values = pool(counts, ones, LOW + (np.arange(BINS) + 0.5) * (HIGH - LOW) / BINS)
    return model._replace(knots=knots, values=values)


def score(stats: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, raw)."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("stats"))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x)), pa.array(model.raw(x))], names=["doc_id", "score", "raw"])

    return stats.select("doc_id", "stats").mapInArrow(run, "doc_id long, score double, raw double")


def train(stats: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """stats: of features(); labels: (doc_id, label)."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    n = known.count()
    if n > MAX_TRAIN_ROWS:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * MAX_TRAIN_ROWS / n))
    return fit(materialize(stats.join(known, "doc_id"), "taught"))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """(doc_id, held_out, score, predicted, raw) of every document."""
    stats = materialize(features(docs), "stats")
    scored = score(stats, train(stats, labels, label))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "raw")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier accepts; their columns are kept as they are."""
    model = train(materialize(features(docs), "stats"), table(spark, sf_dir, "labels"))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                x = np.array([statistics(t) for t in part.column("text").to_pylist()], np.float32).astype(np.float64)
                yield part.filter(pa.array(model.score(x) >= 0.5))

    return docs.mapInArrow(run, docs.schema)

