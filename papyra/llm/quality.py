"""Quality classifier: cumulative-link regression on ordered grades over hashed text features."""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm._shared import kept, pieces, small_batches, text_or_empty

#: Buckets of hashed words, after them of hashed shapes, and then of lengths with shares of different words.
WORDS, SHAPES, REPEATS = 1 << 18, 1 << 12, 11 * 41
#: Rated documents that the model is fitted on, about; documents of these that a word must be in; rounds; weight decay.
SAMPLE_DOCS, LEAST_DOCS, ROUNDS, DECAY = 6000, 8, 600, 1e-5
#: Standard deviations by which a feature must differ between grades to get a weight.
LEAST_Z = 5.0
MOST_CHUNKS = 150_000
_RULES = [(re.compile(r"[^\W\d_]+"), lambda m: "A" if m[0].isupper() and len(m[0]) > 1 else "a"), (re.compile(r"\d+"), lambda m: "0"), (re.compile(r"(.)\1+"), lambda m: m[1] * 2)]
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def _bucket(text: str, size: int) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) % size


def word_and_shape(chunk: str) -> tuple[int, int, int]:
    """Buckets of a chunk between white space: its word, lower case without marks at the ends, the word's first four letters, and its shape, like `a,` or `A!!`."""
    word = _EDGES.sub("", chunk.lower())
    shape = chunk
    for pattern, by in _RULES:
        shape = pattern.sub(by, shape)
    return _bucket(word, WORDS) if word else -1, _bucket(f"{word[:4]} ...", WORDS) if len(word) > 4 else -1, WORDS + _bucket(shape, SHAPES)


class Features:
    """of(text): (buckets, values): 1 for each word and beginning that occurs, the root of its share for each shape, 1 for how much the text repeats itself."""

    def __init__(self, most: int = MOST_CHUNKS):
        self.cache: dict[str, tuple[int, int, int]] = {}
        self.most = most

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        counts = Counter(text.split())
        if len(self.cache) > self.most:
            self.cache.clear()
        cache = self.cache
        for chunk in set(counts).difference(cache):
            cache[chunk] = word_and_shape(chunk)
        if not counts:
            return np.zeros(0, np.int64), np.zeros(0)
        pairs = np.array(list(map(cache.__getitem__, counts)), np.int64)
        words = np.unique(pairs[:, :2])
        words = words[words >= 0]
        shares = np.bincount(pairs[:, 2] - WORDS, np.fromiter(counts.values(), np.float64, len(counts)), SHAPES)
        shapes = np.flatnonzero(shares)
        total = int(shares.sum())
        repeats = WORDS + SHAPES + 11 * min(total.bit_length(), 40) + 10 * len(counts) // total
        return np.concatenate([words, shapes + WORDS, [repeats]]), np.concatenate([np.ones(len(words)), np.sqrt(shares[shapes] / total), [1.0]])


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(x / 2))


class OrdinalModel:
    """P(grade > grades[k]) = sigmoid(w.x - t[k]) with the same weights w for all k and ascending thresholds t."""

    def __init__(self, grades: list[int], weights: np.ndarray, thresholds: np.ndarray):
        self.key, self.grades, self.weights, self.thresholds = uuid.uuid4().hex, grades, weights, thresholds

    def tails(self, score: np.ndarray) -> np.ndarray:
        return _sigmoid(np.asarray(score)[:, None] - self.thresholds)

    def expected(self, tails: np.ndarray) -> np.ndarray:
        return self.grades[0] + tails @ np.diff(self.grades)


def fit_ordinal(buckets: list[np.ndarray], values: list[np.ndarray], grade: np.ndarray, size: int = WORDS + SHAPES + REPEATS, rounds: int = ROUNDS, decay: float = DECAY, least_docs: int = LEAST_DOCS, least_z: float = LEAST_Z, one_sided: int = WORDS) -> OrdinalModel:
    """Maximum likelihood with weight decay, by Adam over all rows.

    A feature gets a weight only if it clearly differs between grades. Buckets below `one_sided`, the words, must speak
    for a lower grade: a short text lacks most words of good texts, which doesn't make it a bad one.
    """
    grades = sorted({int(g) for g in grade})
    if len(grades) < 2:
        return OrdinalModel(grades or [0], np.zeros(0), np.zeros(0))
    y = np.searchsorted(grades, grade)
    share = np.full(len(y), 1 / len(y))
    flat, value = np.concatenate(buckets), np.concatenate(values)
    row = np.repeat(np.arange(len(buckets)), list(map(len, buckets)))
    common = np.bincount(flat, minlength=size)[flat] >= least_docs
    flat, value, row = flat[common], value[common], row[common]
    used, flat = np.unique(flat, return_inverse=True)
    w, n = np.zeros(len(used)), len(y)
    # features without a clear correlation with any step of the grades are noise: they get no weight
    clear = np.zeros(len(used), bool)
    mean, square = np.bincount(flat, value, len(used)) / n, np.bincount(flat, value**2, len(used)) / n
    for k in range(1, len(grades)):
        for some in (y >= 0, y >= k - 1):
            up = (y >= k) & some
            z = np.bincount(flat, value * (up[row] - up.sum() / some.sum()) * some[row], len(used))
            z = np.where(used < one_sided, -z, np.abs(z))
            clear |= z > least_z * np.sqrt(np.maximum(square - mean**2, 1e-12) * some.sum() * (up.sum() / some.sum()) * (1 - up.sum() / some.sum()))
    keep = clear[flat]
    flat, value, row = flat[keep], value[keep], row[keep]
    kept, flat = np.unique(flat, return_inverse=True)
    used = used[kept]
    w = np.zeros(len(used))
    cut = np.linspace(-1, 1, len(grades) - 1) if len(grades) > 2 else np.zeros(1)
    free = np.r_[cut[:1], np.log(np.diff(cut))]  # thresholds: the first, then logarithms of the steps
    m, v = np.zeros(len(w) + len(free)), np.zeros(len(w) + len(free))
    for step in range(1, rounds + 1):
        t = np.cumsum(np.r_[free[:1], np.exp(free[1:])])
        f = np.bincount(row, w[flat] * value, n)
        above = np.c_[np.ones(n), _sigmoid(f[:, None] - t), np.zeros(n)]  # P(y >= 0), P(y >= 1), ..., 0
        hi, lo = above[np.arange(n), y], above[np.arange(n), y + 1]
        p = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi), lo * (1 - lo)
        df = -share * (dhi - dlo) / p
        gt = np.zeros(len(t) + 2)
        np.add.at(gt, y, share * dhi / p)
        np.add.at(gt, y + 1, -share * dlo / p)
        gt = gt[1:-1]
        steps = np.r_[1.0, np.exp(free[1:])]
        g = np.r_[np.bincount(flat, value * df[row], len(w)) + decay * w, np.cumsum(gt[::-1])[::-1] * steps]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, free = w - move[: len(w)], free - move[len(w) :]
    weights = np.zeros(size)
    weights[used] = w
    return OrdinalModel(grades, weights, np.cumsum(np.r_[free[:1], np.exp(free[1:])]))


def fit_quality(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", sample_docs: int = SAMPLE_DOCS) -> OrdinalModel:
    """Fits on about `sample_docs` rated rows, drawn by a hash of the id; their features alone reach the driver.

    ratings has an id and a grade; of several ratings of an id the lowest counts, of several texts the least. Rows
    without id, text or grade are left out. With fewer than two grades the model has no weights.
    """
    rated = ratings.select(F.col(id_col).cast("long").alias("k"), F.col(grade_col).cast("int").alias("grade")).filter("k is not null and grade is not null")
    rated = rated.groupBy("k").agg(F.min("grade").alias("grade"))
    share = min(1.0, sample_docs / max(1, rated.count()))
    rated = rated.filter(F.pmod(F.xxhash64("k", F.lit("quality sample")), F.lit(1_000_000)) < int(share * 1_000_000))
    texts = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("text")).filter("k is not null and text is not null")
    sample = texts.join(F.broadcast(rated), "k").groupBy("k", "grade").agg(F.min("text").alias("text")).select("grade", "text")  # about sample_docs rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch, some in pieces(batches, "text"):
            found = [features.of(t) for t in some]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a.astype(np.int32) for a, _ in found], pa.list_(pa.int32())), pa.array([b.astype(np.float32) for _, b in found], pa.list_(pa.float32()))], ["grade", "buckets", "vals"])

    rows = sample.mapInArrow(run, "grade int, buckets array<int>, vals array<float>").toArrow()
    order = np.argsort([x.sum() for x in (b.values.to_numpy() for b in rows["buckets"])], kind="stable") if rows.num_rows else []  # the same fit whatever the rows' order
    rows = rows.take(pa.array(order, pa.int64()))
    return fit_ordinal([b.values.to_numpy() for b in rows["buckets"]], [b.values.to_numpy().astype(np.float64) for b in rows["vals"]], rows["grade"].to_numpy())


def score_quality(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """id, expected_grade, tail_probability, accepted of each row; null text counts as empty.

    tail_probability is that of the highest grade; accepted: it is at least `least`. With a model of one grade or none
    every row is accepted: its tail probability is 1. Each row, repeated ones too, has its answer; an empty table gives
    an empty one, and other columns don't matter.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(docs, text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = kept("quality", Features)
        for batch, texts in pieces(batches, "text"):
            if len(model.grades) > 1:
                score = np.array([model.weights[a] @ b for a, b in map(features.of, texts)])
                tails = model.tails(score)
                grade, tail = model.expected(tails), tails[:, -1]
            else:
                grade, tail = np.full(len(texts), float(model.grades[0])), np.ones(len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(grade), pa.array(tail), pa.array(tail >= least)], ["doc_id", "expected_grade", "tail_probability", "accepted"])

    return slim.mapInArrow(run, "doc_id long, expected_grade double, tail_probability double, accepted boolean").withColumnRenamed("doc_id", id_col)


def keep_quality(docs: DataFrame, model: OrdinalModel, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """docs without the rows that score_quality does not accept; columns as they were.

    Null texts count as empty, repeated rows are judged alike, rows with a null id too; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = kept("quality", Features)
        for batch, texts in pieces(batches, text_col):
            if len(model.grades) > 1:
                score = np.array([model.weights[a] @ b for a, b in (features.of(t or "") for t in texts)])
                batch = batch.filter(pa.array(model.tails(score)[:, -1] >= least))
            yield batch

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def graded_labels(labels: DataFrame) -> DataFrame:
    """doc_id, grade: 0 for poor text, 1 for good text that is toxic, 2 for good text. A null quality leaves the row out; a null toxic is no."""
    grade = F.when(F.col("quality") <= 0, 0).when(F.coalesce("toxic", F.lit(0)) > 0, 1).when(F.col("quality") > 0, 2)
    return labels.select("doc_id", grade.alias("grade")).filter("grade is not null")


def op3(spark, sf_dir: str) -> DataFrame:
    """score_quality of documents, fitted on the rated ones. Odd rows: see score_quality."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_quality(docs, graded_labels(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return score_quality(docs, model)
